"""SimHash near-duplicates against fingerprints bit by bit and all pairs of texts."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from casejobs.llm import simhash_dedup as sd


def slow_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, radius=2):
    """Least id of each row (id, fingerprint), by all pairs; rows may lack an id."""
    group = list(range(len(fps)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, (_, a) in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j][1]).bit_count() <= radius:
                group[root(i)] = root(j)
    ids = {}
    for i, (doc_id, _) in enumerate(fps):
        if doc_id is not None:
            ids[root(i)] = min(doc_id, ids.get(root(i), doc_id))
    return [ids.get(root(i)) for i in range(len(fps))]


@pytest.mark.parametrize("piece", [1 << 20, 1, 7])
def test_fingerprints(monkeypatch, piece):
    monkeypatch.setattr(sd, "PIECE_BYTES", piece)
    rng = random.Random(5)
    texts = ["", " \n\t", "one", "ONE", "two Words", "a b c", "É É É é", "x y z\x1cw v", "a  b\nc\td", "w" * 5000]
    texts += [" ".join(rng.choice(["Ab", "b", "C", "dé", "中"]) for _ in range(rng.randrange(700))) for _ in range(40)]
    for t in texts:
        assert sd.fingerprint(t.encode()) == slow_fingerprint(t)
    assert sd.fingerprint(b"") == 0 and sd.fingerprint(b"ONE") == sd.fingerprint(b" one ") != 0


def test_on_given_documents(spark, docs, texts):
    got = sd.near_duplicates(docs).collect()
    rows = [(i, slow_fingerprint(t)) for i, t in texts.items()]
    want = {i: (f"{fp:016x}", c) for (i, fp), c in zip(rows, slow_components(rows))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want and len(got) == len(rows)
    assert Counter(c for _, c in want.values()).most_common(1)[0][1] > 1


def chained(n=500, seed=3):
    """Fingerprints in clusters, chains and alone."""
    rng = random.Random(seed)
    out = [0, 1, 7, 2**64 - 1, 2**63, 2**63 + 1]
    while len(out) < n:
        x = rng.choice(out) if rng.random() < 0.6 else rng.getrandbits(64)
        for _ in range(rng.choice((1, 2, 2, 3, 4))):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


@pytest.mark.parametrize("parts", [2, 4, 8])
@pytest.mark.parametrize("tile", [4096, 7])
def test_links_of_tiles(spark, monkeypatch, parts, tile):
    """Every division into cells and tiles has the components of all pairs."""
    monkeypatch.setattr(sd, "TILE", tile)
    monkeypatch.setattr(sd, "STEP", 16)
    monkeypatch.setattr(sd, "PARTS", ((10**9, parts),))
    monkeypatch.setattr(sd, "MAX_BROADCAST_CELLS", 100_000 if tile > 7 else 0)
    fps = sorted(set(chained()))
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    edges = sd.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), len(fps)).collect()
    number = {x: i for i, x in enumerate(signed)}
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for e in edges:
        a, b = root(number[e.a]), root(number[e.b])
        label[max(a, b)] = min(a, b)
    assert [root(i) for i in range(len(fps))] == slow_components(list(enumerate(fps)))


def test_cells_within_the_radius(spark):
    """Population counts differ by no more than the bits, and cells further apart are never paired."""
    assert [len(sd._steps(p, 2)) for p in (2, 4, 8)] == [7, 21, 73]
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 2**63, 300).tolist() + [0, -1, 1, -2]
    for parts in (2, 4):
        laid, sizes = sd.tiles(spark.createDataFrame([(x,) for x in fps], "fp bigint"), parts)
        compared = sum(len(r.fps) * len(r.b_fps) for r in sd.tile_pairs(laid, sizes, parts).collect())
        assert compared < len(fps) ** 2 / {2: 4, 4: 20}[parts]


@pytest.mark.parametrize("often", [1000, 3])
def test_edges(spark, monkeypatch, often):
    monkeypatch.setattr(sd, "HOT_ROWS", often)
    texts = [(1, None), (2, ""), (9, " \n"), (None, None), (None, "some text of its own here"), (None, "some text of its own here"), (5, "some TEXT of its  own here"), (6, "w" * 60_000), (6, "another text under this id"), (7, "another text under this id")]
    texts += [(100 + i, "many equal rows of one text") for i in range(30)] + [(2**63 - 1, "last"), (-(2**63), "LAST"), (None, "nobody"), (None, "nobody")]
    df = spark.createDataFrame([(*t, 1, "x", "y") for t in texts], "doc_id bigint, text string, fp int, component_id string, n string")
    got = sd.near_duplicates(df)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    rows = [(i, slow_fingerprint(t)) for i, t in texts]
    want = sorted(repr((i, f"{fp:016x}", c)) for (i, fp), c in zip(rows, slow_components(rows)))
    assert sorted(repr(tuple(r)) for r in got.collect()) == want
    assert sd.near_duplicates(df.limit(0)).collect() == []


def test_forest():
    a, b = sd.forest(np.array([5, 4, 3, 9]), np.array([4, 3, 2, 8]), 10)
    assert sorted(zip(a.tolist(), b.tolist())) == [(3, 2), (4, 2), (5, 2), (9, 8)]
    assert [x.tolist() for x in sd.forest(np.zeros(0, int), np.zeros(0, int), 3)] == [[], []]
