"""Hard negatives against brute force over all pairs, and the tree against all distances."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from casejobs.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, label int, embedding array<double>"


def brute(rows, every=10, positives=5, negatives=10):
    """Sorted result rows; ``rows`` are (vec_id, label, components)."""
    usable = [(i, lab, [int(np.floor(256.0 * x)) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, label, v in usable:
        if a % every:
            continue
        score = [(sum(x * y for x, y in zip(v, w)), i, lab) for i, lab, w in usable if len(w) == len(v)]
        own = sorted((-s, i) for s, i, lab in score if lab == label and i != a)[:positives]
        for p, positive in own:
            near = sorted((-s, i) for s, i, lab in score if lab != label and 30 * -p <= 100 * s <= 90 * -p)[:negatives]
            out += [(a, positive, rank + 1, i, -p, -s) for rank, (s, i) in enumerate(near)]
    return sorted(out)


def found(spark, rows, every=10, **kw):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"rank": F.lit("x"), "key": F.lit(1), "leaf": F.lit(None).cast("int"), "v": F.lit(0.5)})
    got = hn.hard_negatives(df, F.col("vec_id") % every == 0, **kw)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def clusters(n, groups=12, size=6, spread=0.02, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size))
    x = centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, size))
    return [(i, int(rng.integers(0, 3)), list(map(float, v / np.linalg.norm(v)))) for i, v in enumerate(x)]


@pytest.mark.parametrize("leaf, block, pack", [(1024, 4096, 512), (20, 16, 8)])
def test_same_as_all_pairs(spark, monkeypatch, leaf, block, pack):
    for name, value in (("LEAF_ROWS", leaf), ("BLOCK_ROWS", block), ("PACK", pack)):
        monkeypatch.setattr(hn, name, value)
    rows = clusters(500)
    rows += [(1000 + i, i % 3, rows[0][2]) for i in range(120)]  # one vector in many rows: ties by id
    assert found(spark, rows) == brute(rows)


def test_small_sample_and_joined_leaf_sizes(spark, monkeypatch):
    """The tree of a small sample holds all rows, and leaf sizes are joined by a shuffle."""
    for name, value in (("SAMPLE_ROWS", 80), ("LEAST_SAMPLE", 4), ("BRANCHES", 3), ("LEAF_ROWS", 10), ("BLOCK_ROWS", 16), ("MAX_BROADCAST_LEAVES", 0)):
        monkeypatch.setattr(hn, name, value)
    rows = clusters(400, seed=5)
    assert found(spark, rows) == brute(rows)


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 1, [-1.0, 0.0]), (3, 2, [0.5, 0.5]), (4, 2, [0.27, 0.9]), (5, 3, [0.81, 0.0]), (6, None, [0.5, 0.5]), (7, 2, None)]
    rows += [(8, 2, [None, 0.5]), (9, 2, [inf, 0.5]), (11, 2, [nan, 0.5]), (None, 2, [0.5, 0.5]), (10, 9, [1.0, 0.0]), (12, 2, [0.5]), (20, 4, []), (13, 4, []), (14, 5, []), (30, 2, [0.0, 0.0]), (15, 2, [0.4, 0.1])]
    rows += [(1, 1, [0.9, 0.1]), (3, 2, [0.5, 0.5]), (16, 5, [300.5, -7e5]), (40, 5, [299.5, 1.0])]  # repeated rows, large numbers
    got = found(spark, rows)
    assert got == brute(rows) and {r[0] for r in got} >= {0, 20}
    assert found(spark, []) == [] and found(spark, rows[:1]) == []
    # an id with two different anchors: both, under the one id
    two = [(0, 1, [1.0, 0.0]), (0, 1, [0.0, 1.0]), (1, 1, [0.9, 0.9]), (2, 2, [0.5, 0.1]), (3, 2, [0.1, 0.5])]
    assert found(spark, two) == brute(two) and len(found(spark, two)) == 2


def test_scores_at_the_window(spark):
    """Scores exactly at 30 and 90 hundredths are in, and the next ones out."""
    rows = [(0, 1, [1.0]), (1, 1, [1000 / 256])]
    rows += [(i, 2, [x / 256]) for i, x in enumerate((299, 300, 301, 899, 900, 901), start=2)]
    assert [r[5] for r in found(spark, rows) if r[1] == 1] == [256 * x for x in (900, 899, 301, 300)]


def test_tree_eliminates_and_loses_nothing(monkeypatch):
    """On clusters most leaves are skipped; every vector within a window is in a leaf that is searched."""
    monkeypatch.setattr(hn, "LEAF_ROWS", 50)
    rng = np.random.default_rng(3)
    rows = np.floor(256 * np.array([v for _, _, v in clusters(4000, groups=40, seed=7)]))
    sample = rows[rng.permutation(len(rows))[:1000]]
    most = float((rows**2).sum(axis=1).max())
    tree = hn.fit(sample, len(rows), most)
    leaf, ranges = hn.route(tree, rows)
    for node, low, high in ranges:
        tree.nodes[node].low, tree.nodes[node].high = low, high
    assert len(tree.nodes) > 1 and len(set(leaf)) > 30
    queries = rows[:60]
    score = queries @ rows.T
    best = np.sort(score, axis=1)[:, ::-1].astype(np.int64)
    low, high = np.stack([best[:, 9], best[:, 50] // 2], axis=1), np.stack([best[:, 0], best[:, 50] // 2 + 40], axis=1)
    seen = defaultdict(set)
    for x, at in hn.search(tree, queries, low, high):
        for q in at:
            seen[q].add(x)
    for q in range(60):
        inside = ((score[q, :, None] >= low[q]) & (score[q, :, None] <= high[q])).any(axis=1)
        assert set(leaf[inside]) <= seen[q]
    share = lambda lo, hi: sum(len(at) for _, at in hn.search(tree, queries, lo, hi)) / (60 * len(set(leaf)))
    assert share(low[:, :1], high[:, :1]) < 0.2  # a ball around the query
    ring = best[:, 1500:1501]
    assert share(ring - 20, ring) < 0.6  # a thin annulus: what is too near is left out, too
    assert share(ring, ring - 1) == 0  # empty windows
    assert hn.fit(np.ones((500, 3)), 10**6, 3.0).root == 0  # equal vectors are not split
    assert random.Random(0) and hn.route(hn.Tree(1.0, 0, []), np.zeros((2, 1)))[0].tolist() == [0, 0]
