"""Periodic runs of words by a dictionary of basic factors.

A basic factor is a stretch of 2^k words; the dictionary names the factors of each length so that equal ones have one name,
made from the names of their halves. Factors that stand in one place only are left out at every length, and so are all
longer ones with such a half, which keeps the dictionary small on plain text. On each level the next occurrence of the same
factor within twice its length proposes the distance as a period: where more words in a row than that distance have
their next factor at the same distance, the occurrences form arithmetic progressions, and the stretch that they cover has
the period. Each such stretch is extended word by word, and stretches found on several levels are put together.

A run of period q with four periods or more is found on the level whose factors have q to 2q - 1 words: inside the run each
factor's next occurrence is exactly q words on, since q is the smallest period, and more than q of them lie in a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .arrays import released
from .durable import small_batches

#: A run has so many words and so many periods at least.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Words whose factors are named together; a longer document is taken by itself.
CHUNK_WORDS = 100_000

RUN = "struct<start:bigint,length:bigint,period:bigint>"
#: From a document's id and number of words, which word stands at each place; None leaves them as they are.
Order = Callable[[int | None, int], "np.ndarray | None"]


def proposals(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each level: first word, end and period of the stretches that arithmetic progressions of its factors cover."""
    name, size, width = ids, len(ids), 1
    at = np.arange(size)
    key = ids.astype(np.int64)
    while len(at) > 1:
        order = np.argsort(key, kind="stable")  # places stay in order within a factor
        key, place = key[order], at[order]
        new = np.append(True, key[1:] != key[:-1])
        number = np.cumsum(new) - 1
        repeated = np.bincount(number)[number] > 1
        name = np.full(size, -1, np.int64)
        name[place[repeated]] = number[repeated]
        step = np.zeros(size + 1, np.int64)  # to the next occurrence, if that is near; one place more closes the last stretch
        near = ~new[1:] & (np.diff(place) <= 2 * width)
        step[place[:-1][near]] = np.diff(place)[near]
        cut = np.flatnonzero(np.diff(step, prepend=0))
        begin, end = cut[:-1], cut[1:]
        period = step[begin]
        long = (period > 0) & (end - begin > period)
        yield begin[long], end[long] - 1 + width + period[long], period[long]
        at = np.flatnonzero(name[: max(0, size - width)] >= 0)
        at = at[name[at + width] >= 0]
        key = name[at] * (number[-1] + 1) + name[at + width]
        width *= 2


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers, by start and period."""
    found: dict[tuple[int, int], int] = {}
    for level in proposals(ids):
        for start, end, q in zip(*(x.tolist() for x in level)):
            while start > 0 and ids[start - 1] == ids[start - 1 + q]:
                start -= 1
            while end < len(ids) and ids[end] == ids[end - q]:
                end += 1
            if end - start >= max(LEAST_WORDS, LEAST_PERIODS * q):
                found[start, end - start] = min(q, found.get((start, end - start), q))
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those of a run that come after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, q in runs:
        keep[start + q : start + length] = False
    return b" ".join(words if keep.all() else [words[i] for i in np.flatnonzero(keep)])


def _numbered(words: list[bytes], first: int) -> np.ndarray:
    """Numbers of the words, equal ones with one number, from ``first`` on."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, first + len(seen)) for w in words), np.int64, len(words))


def _of_chunk(docs: list[tuple[int | None, list[bytes], np.ndarray]]) -> pa.RecordBatch:
    """Results of some documents (id, words, word numbers). No word number is in two documents, so no factor across two of
    them is repeated, and no run is extended from one into the other."""
    ends = np.cumsum([len(w) for _, w, _ in docs])
    own: list[list] = [[] for _ in docs]
    for start, length, q in find_runs(np.concatenate([ids for _, _, ids in docs])):
        i = int(np.searchsorted(ends, start, side="right"))
        own[i].append((start - int(ends[i]) + len(docs[i][1]), length, q))
    flat = np.array([r for runs in own for r in runs], np.int64).reshape(-1, 3)
    structs = pa.StructArray.from_arrays([pa.array(c) for c in flat.T], ["start", "length", "period"])
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in own])]).astype(np.int32))
    texts = [collapsed(words, runs) for (_, words, _), runs in zip(docs, own)]
    columns = [pa.array([d for d, _, _ in docs], pa.int64()), pa.array([len(w) for _, w, _ in docs], pa.int64()), pa.ListArray.from_arrays(offsets, structs), pa.array(texts, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, order: Order | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, runs (start, length, period) and collapsed.

    Words are runs of other bytes than blanks, numbered from 0, and equal if their bytes are. A run is a stretch of words
    with smallest period q and at least six words and 4 q, which neither neighbour extends. ``runs`` are in order of
    start and period; ``collapsed`` is the text's words joined by one space without those that any run contains after its
    first q words. A null, empty or blank text has no words and no runs, and an empty collapsed text. Runs may overlap.
    ``order`` gives each place a word of the text first (see ``Order``). Repeated rows are taken each for itself; other
    columns are left out.
    """

    @released
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, n = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or b"").split()
                ids = _numbered(words, n)
                at = order(doc_id, len(words)) if order else None
                if at is not None:
                    words, ids = [words[i] for i in at], ids[at]
                some.append((doc_id, words, ids))
                n += len(words)
                if n >= CHUNK_WORDS:
                    yield _of_chunk(some)
                    some, n = [], 0
            if some:
                yield _of_chunk(some)

    rows = spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")))
    with small_batches(docs.sparkSession, "16m"):
        return rows.mapInArrow(work, f"doc_id bigint, n_words bigint, runs array<{RUN}>, collapsed string")
