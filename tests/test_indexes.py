"""Search in indexes against the plain scans."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from casejobs import queries
from casejobs.operators import catalog, search_index, vector_index, vectors


def test_a_thousand_terms(spark, tmp_path):
    rng = random.Random(7)
    text = lambda a, b: "".join(rng.choice("abAB -é中") for _ in range(rng.randint(a, b)))
    rows = [(None if i % 11 == 0 else text(0, 6), None if i % 7 == 0 else text(0, 20), text(0, 9) if i % 5 else "") for i in range(400)] + [("same", "same", "same")] * 2
    df = spark.createDataFrame(rows, "id string, title string, location string").withColumn("gram", F.lit(0))
    terms = list({text(0, 6) for _ in range(1000)} | {"", "a", "É", "aB", "zzz", "%", "same"})
    search_index.write_index(df, str(tmp_path / "index"))
    got = search_index.search_many(spark, str(tmp_path / "index"), spark.createDataFrame([(t,) for t in [*terms, *terms[:9], None]], "term string"))
    assert got.columns == ["term", "id", "title", "location"]
    found = {}
    for r in got.collect():
        found.setdefault(r.term, []).append((r.id, r.title, r.location))
    low = [[(c or "").lower() for c in r] for r in rows]
    for t in terms:
        want = [r for r, own in zip(rows, low) if any(t.lower() in c and c for c in own)]
        assert sorted(map(repr, found.get(t, []))) == sorted(map(repr, want)), t
    for t in ("aB", "", "same", "É"):  # and as the search for one term
        assert sorted(map(repr, found.get(t, []))) == sorted(repr((r.id, r.title, r.location)) for r in catalog.search_cases(df, t).collect())
    # a term reads the parts of its own stretches
    one = search_index.search_many(spark, str(tmp_path / "index"), spark.createDataFrame([("same",)], "term string"))
    assert re.search(r"PartitionFilters: \[[^\]]*\(part#\d+ = \d+\)", one._jdf.queryExecution().executedPlan().toString())
    search_index.write_index(df.limit(0), str(tmp_path / "none"))
    assert search_index.search_many(spark, str(tmp_path / "none"), spark.createDataFrame([("a",), ("abc",), ("",)], "term string")).count() == 0


def plan_nodes(node):
    """All nodes of a plan that has run."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from plan_nodes(node.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from plan_nodes(node.plan())
    else:
        yield node
        for i in range(node.children().size()):
            yield from plan_nodes(node.children().apply(i))


@pytest.mark.parametrize("few", [0, 60])
def test_terms_that_grow_with_the_table(spark, tmp_path, monkeypatch, few):
    """Neither are the rows copied to all tasks, however small their files are, nor do rows meet each term that they share a stretch with."""
    monkeypatch.setattr(search_index, "FEW", few, raising=False)
    n = 3000
    rows = [(f"UAP-{i}", f"spis: 059UAP{i}.pdf" if i % 3 else None, f"Loc src{i % 20}") for i in range(n)]
    df = spark.createDataFrame(rows, "id string, title string, location string")
    terms = [f"p-{i}" for i in range(0, n, 7)] + ["P-7", "sRc1", "pdf", "UAP-2999", "00", "0", "", "p-x", "no such term"]
    search_index.write_index(df, str(tmp_path / "index"))
    got = search_index.search_many(spark, str(tmp_path / "index"), spark.createDataFrame([(t,) for t in terms], "term string"))
    low = [[c.lower() for c in r if c] for r in rows]
    want = [(t, *r) for t in set(terms) for r, own in zip(rows, low) if any(t.lower() in c for c in own)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    made = [(x.nodeName(), x.metrics().get("numOutputRows").get().value()) for x in plan_nodes(got._jdf.queryExecution().executedPlan()) if x.metrics().contains("numOutputRows")]
    assert max(rows for name, rows in made if name == "BroadcastExchange") <= max(few, 1), made
    assert max(rows for name, rows in made if "Join" in name) <= 8 * n, made


def test_searched_rows_meet_the_labels_by_a_shuffle(spark, data, monkeypatch):
    plans = []
    real = search_index.write_index

    def planned(df, target):
        plans.append(df.select(*search_index.SEARCHED)._jdf.queryExecution().executedPlan().toString())
        real(df, target)

    monkeypatch.setattr(search_index, "write_index", planned)
    queries.search_many(spark, data)
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


@pytest.fixture
def compared(monkeypatch):
    """Pairs of a query and a point that were compared."""
    n = []
    real = vector_index._best_of_units

    def counted(units, k):
        n.append(units.select(F.coalesce(F.sum(F.octet_length("ids") * F.octet_length("q_ids") / 64), F.lit(0.0))).first()[0])
        return real(units, k)

    monkeypatch.setattr(vector_index, "_best_of_units", counted)
    return n


def rounded(hits):
    return sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in hits.collect())


def test_clusters_give_the_same_hits_for_less(spark, monkeypatch, compared):
    monkeypatch.setattr(vector_index, "CLUSTER_POINTS", 40)
    monkeypatch.setattr(vector_index, "BLOCK", 64)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 8))
    rows = [(i, [float(x) for x in centres[i % 30] + 0.05 * rng.normal(size=8)]) for i in range(1500)]
    points = spark.createDataFrame(rows, "id bigint, vector array<double>")
    queries = points.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    hits = vector_index.ClusterIndex(points).search(queries, 5)
    assert rounded(hits) == rounded(vectors.knn_join(points, queries, 5))
    assert sum(compared) < 0.5 * 1500 * 75, compared


def test_odd_points_and_queries(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "CLUSTER_POINTS", 4)
    monkeypatch.setattr(vector_index, "BLOCK", 8)
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(3)]) for i in range(120)] + [(200 + i, [1.0, 2.0, 3.0]) for i in range(30)]
    rows += [(300, [0.0, 0.0, 0.0]), (301, [1.0]), (302, None), (None, [1.0, 1.0, 1.0]), (303, []), (304, [2.0])]
    points = spark.createDataFrame(rows, "id bigint, vector array<double>")
    asked = [(1, [1.0, 2.0, 3.0]), (2, [0.0, 0.0, 0.0]), (3, [5.0]), (4, None), (None, [1.0, 0.0, 0.0]), (5, [-1.0, 0.5, 0.0]), (5, [1.0, 0.0, 0.0]), (6, [1.0, 2.0])]
    queries = spark.createDataFrame(asked, "query_id bigint, vector array<double>")
    index = vector_index.ClusterIndex(points)
    for k in (1, 7, 500):
        assert [r[:3] for r in rounded(index.search(queries, k))] == [r[:3] for r in rounded(vectors.knn_join(points, queries, k))]
    assert vector_index.ClusterIndex(points.limit(0)).search(queries).count() == 0 and index.search(queries.limit(0)).count() == 0
