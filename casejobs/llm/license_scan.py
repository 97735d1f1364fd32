"""Licence scans: a trained paragraph classifier with an unknown class, confirmed by comparison with templates.

A sparse multinomial logistic regression over hashed word n-grams (one to three words) tells licence families apart. It
is trained on the templates below, on notices made of the licences' names, on variants of both, and on lines of the corpus
and scraps of licences as unknown. Its temperature and the weight of the unknown class are calibrated with a second model
from which every fourth family is left out, so that unseen families count as unknown.

A paragraph is a stretch of words from one word pair that licences have to another, with gaps of a few other words; it may
stand anywhere in a line, or run over wrapped lines, and blank lines end it. It has a family if its calibrated probability is
high enough, it shares enough word pairs with a template of that family, and it has a word or a pair of words that no other
family's templates have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Words, chunks, mix, released

# Families and wording of public licences.
TEMPLATES = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    "artistic": (
        "This package is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
        "The intent is that the Copyright Holder maintains some artistic control over the development of that Package while still keeping the Package available as open source and free software.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "bsl": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under the CC0 1.0 Universal Public Domain Dedication.",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
}
# Names and short identifiers of the families.
NAMES = {
    "agpl": ("GNU Affero General Public License", "AGPL", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"),
    "apache": ("Apache License", "Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0", "Apache-2.0"),
    "artistic": ("Artistic License", "Artistic License 2.0", "Artistic-2.0"),
    "bsd": ("BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "BSD-2-Clause", "BSD-3-Clause"),
    "bsl": ("Boost Software License", "Boost Software License, Version 1.0", "BSL-1.0"),
    "cc-by": ("CC BY", "CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0"),
    "cc-by-nc": ("CC BY-NC", "CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0"),
    "cc-by-sa": ("CC BY-SA", "CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0"),
    "cc0": ("CC0", "CC0 1.0", "CC0-1.0", "Creative Commons Zero"),
    "epl": ("Eclipse Public License", "Eclipse Public License, version 2.0", "EPL", "EPL-2.0"),
    "gpl": ("GNU General Public License", "GNU General Public License, version 3", "GNU GPL", "GPLv3", "GPL-3.0", "GPL-3.0-or-later"),
    "isc": ("ISC License", "ISC"),
    "lgpl": ("GNU Lesser General Public License", "GNU Lesser General Public License, version 3", "LGPL", "LGPL-3.0-or-later"),
    "mit": ("MIT License", "MIT"),
    "mpl": ("Mozilla Public License", "Mozilla Public License, version 2.0", "MPL", "MPL-2.0"),
    "unlicense": ("The Unlicense", "Unlicense"),
    "zlib": ("zlib License", "Zlib"),
}
#: Short notices are made of these and a name.
NOTICES = ("{}", "Licensed under {}", "Licensed under the {}", "Released under the {}", "License: {}", "SPDX-License-Identifier: {}", "This project is licensed under the terms of the {}", "This work is licensed under the {}")
FAMILIES = tuple(TEMPLATES)
UNKNOWN = len(FAMILIES)

FEATURE_BITS = 16
#: Lines of the corpus that are taken as examples of the unknown class, about.
SAMPLE_LINES = 2000
VARIANTS = 8
MIN_PROBABILITY = 0.6
#: Least number of word pairs shared with a short template (all of a still shorter one's), and with a longer one if its own
#: share of the pairs is no fewer; and the least share: of a template's or the paragraph's pairs, the smaller of both, or of the
#: paragraph's alone if the template is short.
LEAST_PAIRS, SHORT_PAIRS, LEAST_SHARE = 3, 8, 0.6
#: Words between two licence pairs of a paragraph, at most.
GAP = 4

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _c in range(128):
    if _c != 10 and not chr(_c).isalnum():
        _FOLD[_c] = 32


def templates(family: str) -> list[str]:
    """The family's wording and its short notices."""
    return list(dict.fromkeys([*TEMPLATES[family], *(x.format(n) for n in NAMES[family] for x in NOTICES)]))


def _lines(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, offsets of all lines, document of each line)."""
    breaks = np.flatnonzero(raw == 10) + 1
    edges = np.unique(np.concatenate([off, breaks]))
    doc = np.searchsorted(off, edges[:-1], side="right") - 1
    return _FOLD[raw], edges.astype(np.int64), doc


def _of_text(text: str) -> Words:
    raw = np.frombuffer(text.replace("\n", " ").encode(), np.uint8)
    return Words(_FOLD[raw], np.array([0, len(raw)], np.int64))


def _features(words: Words) -> np.ndarray:
    """Features of all n-grams of one to three words of one text; each counts once."""
    grams = (words.hash, words.grams(2)[0], words.grams(3)[0])
    return np.unique(np.concatenate(grams) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def _marks(words: Words) -> np.ndarray:
    """Hashes of words and word pairs; pairs are told from words by their lowest bit."""
    return np.unique(np.concatenate([words.hash & ~np.uint64(1), words.grams(2)[0] | np.uint64(1)]))


class _Set:
    """Membership in a set of hashes: by a table of their first bits, then by the hashes themselves."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.values >> np.uint64(44)).astype(np.int64)] = True

    def has(self, values: np.ndarray) -> np.ndarray:
        near = self.table[(values >> np.uint64(44)).astype(np.int64)]
        near[near] = np.isin(values[near], self.values)
        return near


@dataclass
class Classifier:
    """Weights (features; families and unknown), biases, temperature and the unknown class's calibration, the templates'
    word pairs, and the words and pairs that only one family has."""

    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    pairs: list[list[np.ndarray]]
    own_marks: list[np.ndarray]

    def probabilities(self, feature: np.ndarray) -> np.ndarray:
        score = self.bias + self.weights[feature].sum(axis=0) / np.sqrt(max(1, len(feature)))
        return _softmax(score[None] / self.temperature)[0]

    def share(self, pairs: np.ndarray, family: int) -> float:
        """The best template's shared part; 0 if few pairs are shared."""
        best = 0.0
        for own in self.pairs[family]:
            both = len(np.intersect1d(own, pairs, assume_unique=True))
            if both and both >= (min(LEAST_PAIRS, len(own)) if len(own) < SHORT_PAIRS else min(SHORT_PAIRS, LEAST_SHARE * len(own))):
                best = max(best, both / (len(pairs) if len(own) < SHORT_PAIRS else min(len(own), len(pairs))))
        return best

    def family(self, words: Words) -> tuple[int, float, float] | None:
        """(family, probability, share) of a paragraph, or None. Of families with equal probabilities the first counts."""
        p = self.probabilities(_features(words))
        best = int(p.argmax())
        if best == UNKNOWN or p[best] < MIN_PROBABILITY or not np.isin(_marks(words), self.own_marks[best]).any():
            return None
        share = self.share(np.unique(words.grams(2)[0]), best)
        return (best, float(p[best]), share) if share >= LEAST_SHARE else None


#: Pairs of such words, and of numbers, tell no families apart.
_PLAIN = frozenset(("version", "v", "license", "licence", "or", "later", "only", "and"))


def _plain_pairs(texts: list[str]) -> np.ndarray:
    found = {""}
    for text in texts:
        words = bytes(_FOLD[np.frombuffer(text.encode(), np.uint8)]).decode().split()
        plain = [w in _PLAIN or w.isdigit() or w[:1] == "v" and w[1:].isdigit() for w in words]
        found.update(f"{a} {b}" for a, b, x, y in zip(words, words[1:], plain, plain[1:]) if x and y)
    return np.unique(np.concatenate([_of_text(x).grams(2)[0] | np.uint64(1) for x in found]))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _variants(text: str, rng: np.random.Generator, n: int) -> list[str]:
    """The text with some words left out, cut at the ends, or put into other words; short notices stay whole."""
    words = text.split()
    out = [text]
    for _ in range(n - 1):
        kept = [w for w in words if len(words) < 8 or rng.random() > 0.08] or words
        if len(kept) > 12 and rng.random() < 0.5:
            a = int(rng.integers(0, len(kept) // 3))
            kept = kept[a : len(kept) - int(rng.integers(0, len(kept) // 3))]
        if rng.random() < 0.3:
            kept = [*(["Copyright", "(c)", str(int(rng.integers(1990, 2026))), "The", "Authors."] if rng.random() < 0.5 else ["Note:"]), *kept]
        out.append(" ".join(kept))
    return list(dict.fromkeys(out))


def _descend(x: np.ndarray, label: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of a multinomial logistic regression; all classes weigh the same."""
    kinds = UNKNOWN + 1
    weight = (1.0 / np.bincount(label, minlength=kinds)[label]).astype(np.float32)
    weight /= weight.sum()
    w, bias, truth = np.zeros((x.shape[1], kinds), np.float32), np.zeros(kinds, np.float32), np.eye(kinds, dtype=np.float32)[label]
    momentum, momentum_b = np.zeros_like(w), np.zeros_like(bias)
    for _ in range(steps):
        gap = (_softmax(x @ w + bias) - truth) * weight[:, None]
        momentum = 0.9 * momentum + x.T @ gap + 1e-5 * w
        momentum_b = 0.9 * momentum_b + gap.sum(axis=0)
        w -= 5.0 * momentum
        bias -= 0.5 * momentum_b
    return w, bias


def licence_features() -> np.ndarray:
    """Features of all templates, in order: n-grams that no licence has tell nothing apart."""
    return np.unique(np.concatenate([_features(_of_text(t)) for f in FAMILIES for t in templates(f)]))


def train(lines: list[tuple[np.ndarray, int]], seed: int = 3, steps: int = 100) -> Classifier:
    """Fits the classifier; ``lines`` are corpus lines as (features that licences have, number of all features)."""
    rng = np.random.default_rng(seed)
    texts = [templates(f) for f in FAMILIES]
    pairs = [[np.unique(_of_text(t).grams(2)[0]) for t in own] for own in texts]
    marks = [np.unique(np.concatenate([_marks(_of_text(t)) for t in own])) for own in texts]
    value, times = np.unique(np.concatenate(marks), return_counts=True)
    single = np.setdiff1d(value[times == 1], _plain_pairs([t for own in texts for t in own]))
    own_marks = [m[np.isin(m, single)] for m in marks]
    used = licence_features()

    scraps = [" ".join(rng.permutation(t.split())[:6]) for own in TEMPLATES.values() for t in own]  # words alone are no licence
    examples = [(v, f) for f, own in enumerate(texts) for t in own for v in _variants(t, rng, VARIANTS if t in TEMPLATES[FAMILIES[f]] else 2)]
    rows = [(_features(_of_text(t)), f) for t, f in [*examples, *((t, UNKNOWN) for t in scraps)]]
    rows = [(x[np.isin(x, used)], len(x), f) for x, f in rows] + [(x, n, UNKNOWN) for x, n in lines]
    label = np.array([f for _, _, f in rows])
    x = np.zeros((len(rows), len(used)), np.float32)
    for i, (own, n, _) in enumerate(rows):
        x[i, np.searchsorted(used, own)] = 1.0 / np.sqrt(max(1, n))

    # calibration: a model without every fourth family and every fourth example
    unseen = (label % 4 == 3) & (label != UNKNOWN)
    held = unseen | (np.arange(len(rows)) % 4 == 3)
    w, bias = _descend(x[~held], label[~held], steps)
    scores, truth = x[held] @ w + bias, np.where(unseen[held], UNKNOWN, label[held])
    each = 1.0 / np.bincount(truth, minlength=UNKNOWN + 1)[truth]
    each[truth == UNKNOWN] *= UNKNOWN  # half of the weight for what is unknown

    def loss(temperature: float, more: float) -> float:
        moved = scores + more * (np.arange(UNKNOWN + 1) == UNKNOWN)
        return float(-(each * np.log(_softmax(moved / temperature)[np.arange(len(truth)), truth] + 1e-12)).sum())

    temperature, more = min(((t, m) for t in np.geomspace(0.2, 2.0, 11) for m in np.linspace(-2.0, 2.0, 17)), key=lambda c: loss(*c))
    w, bias = _descend(x, label, steps)
    weights = np.zeros((1 << FEATURE_BITS, UNKNOWN + 1), np.float32)
    weights[used] = w
    bias[UNKNOWN] += more
    return Classifier(weights, bias, float(temperature), pairs, own_marks)


def sample_lines(docs: DataFrame, n: int = SAMPLE_LINES) -> list[tuple[np.ndarray, int]]:
    """About ``n`` lines from anywhere in the corpus, each chosen by a hash of its text and number, as features.

    A line comes as the features that licences have too, so whole lines count and yet a row is small.
    """
    total = docs.agg(F.sum(F.regexp_count("text", F.lit("\n")) + 1)).first()[0] or 0
    bound = np.uint64(min(1.0, n / max(1, total)) * (2**32 - 1))
    used = licence_features()

    @released
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(1).to_numpy().view(np.uint64)
            for row, _, raw, off in chunks(batch, "text"):
                folded, edges, doc = _lines(raw, off)
                number = np.arange(len(doc)) - np.searchsorted(doc, doc)
                picked = np.flatnonzero(mix(key[row + doc] + mix(number.astype(np.uint64))) >> np.uint64(32) < bound)
                found = [_features(Words(folded[edges[i] : edges[i + 1]], np.array([0, edges[i + 1] - edges[i]]))) for i in picked]
                known = [x[np.isin(x, used)].astype(np.int32).tobytes() for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(known, pa.binary()), pa.array([len(x) for x in found], pa.int64())], ["features", "n"])

    rows = docs.where(F.col("text").isNotNull()).select("text", F.xxhash64("text")).mapInArrow(take, "features binary, n bigint").where("n > 0").distinct()
    return sorted(((np.frombuffer(r.features, np.int32).astype(np.int64), r.n) for r in rows.collect()), key=lambda x: (x[0].tobytes(), x[1]))


def stretches(hits: np.ndarray, block: np.ndarray, gap: int) -> list[tuple[int, int]]:
    """Stretches (first word, end) of the word pairs that licences have (``hits``: their first words, in order) with at most
    so many other words between two; ``block`` tells which words may be together."""
    cut = np.flatnonzero((hits[1:] - hits[:-1] > gap + 2) | (block[hits[1:]] != block[hits[:-1]])) + 1 if gap else np.flatnonzero(np.diff(hits) > 1) + 1
    return [(int(x[0]), int(x[-1]) + 2) for x in np.split(hits, cut) if len(x)]


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``found``, an array of (line, lines, family, probability, share).

    Lines count from 1 and are split at newlines (a carriage return is a space); every word of a whole text is looked at.
    ``line`` is the line of a paragraph's first word and ``lines`` their number. A paragraph is tried as a whole, and so are
    its pieces without gaps. If pieces have other families by themselves than the whole, or the whole has none, they are
    reported one by one, and the whole only for a family that none of them has. A licence's name of one word without a word
    that licences have beside it is no notice. Null texts have no lines. Rows with repeated or null ids are scanned each for
    itself; other columns are left out.
    """
    classifier = docs.sparkSession.sparkContext.broadcast(train(sample_lines(docs)))

    @released
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = classifier.value
        any_pair = _Set(np.concatenate([p for own in c.pairs for p in own]))
        any_mark = _Set(np.concatenate(c.own_marks))
        for batch in batches:
            for row, end, raw, off in chunks(batch, "text"):
                folded = _FOLD[raw]
                words = Words(folded, off)
                out: list[list[dict]] = [[] for _ in range(end - row)]
                n = len(words.hash)
                # the line of each word, and a number that changes at blank lines and between documents
                breaks = np.concatenate([[0], np.cumsum(raw == 10)])
                line = breaks[words.start]
                block = np.cumsum(np.append(True, (np.diff(line) > 1) | (np.diff(words.doc) > 0))[:n])
                pair = np.zeros(n, np.uint64)
                inside = np.flatnonzero(words.doc[:-1] == words.doc[1:])
                pair[inside] = words.grams(2)[0]
                at = inside[block[inside] == block[inside + 1]]
                hits = at[any_pair.has(pair[at])]
                # no family without a word or pair of its own: how many of them stand before each word
                marks = np.zeros(n + 1, np.int64)
                marks[1:] = np.cumsum(any_mark.has(words.hash & ~np.uint64(1)))
                pair_marks = np.zeros(n + 1, np.int64)
                pair_marks[hits + 1] = any_mark.has(pair[hits] | np.uint64(1))
                pair_marks = np.cumsum(pair_marks)

                def tried(a: int, z: int) -> tuple | None:
                    if marks[z] == marks[a] and pair_marks[z - 1] == pair_marks[a]:
                        return None
                    part = folded[words.start[a] : words.start[z - 1] + words.length[z - 1]]
                    return c.family(Words(part, np.array([0, len(part)])))

                for a, z in stretches(hits, block, GAP):
                    whole = tried(a, z)
                    results = [(a, z, whole)] if whole else []
                    pieces = stretches(hits[np.searchsorted(hits, a) : np.searchsorted(hits, z)], block, 0)
                    singles = [x for x in ((i, j, tried(i, j)) for i, j in pieces) if x[2]] if len(pieces) > 1 else []
                    if singles and {x[2][0] for x in singles} != {whole and whole[0]}:  # several notices
                        results = singles + [x for x in results if whole[0] not in {y[2][0] for y in singles}]
                    for i, j, (family, p, share) in sorted(results):
                        doc = int(words.doc[i])
                        out[doc].append({"line": int(line[i] - breaks[off[doc]]) + 1, "lines": int(line[j - 1] - line[i]) + 1, "family": FAMILIES[family], "probability": p, "share": share})
                kind = pa.list_(pa.struct([("line", pa.int64()), ("lines", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("share", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(out, kind)], ["doc_id", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, found array<struct<line:bigint,lines:bigint,family:string,probability:double,share:double>>")
