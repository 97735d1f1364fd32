"""Names of a gazetteer in texts against a search of every run of words."""

import random
import re

import pytest
from pyspark.sql import functions as F

from casejobs import constants as C
from casejobs.operators import places

CASES, GAZETTEER = "case_id string, text string", "name string, latitude double, longitude double"


def split(text):
    return tuple(x for x in re.split(r"[\W_]+", text.lower()) if x)


def brute(texts, names):
    known = {}
    for name, lat, lon in sorted(names, key=lambda n: (n[0].lower(), n[1], n[2]), reverse=True):
        if split(name):
            known[split(name)] = (name.lower(), lat, lon)
    out = []
    for case_id, text in texts:
        words = split((text or "")[: C.ENGINE_SENT_CHARS])
        runs = [(-len(" ".join(words[i:j])), i, words[i:j]) for i in range(len(words)) for j in range(i + 1, min(i + 9, len(words)) + 1) if words[i:j] in known]
        out.append((case_id, *known[min(runs)[2]]) if runs else (case_id, None, C.DEFAULT_LAT, C.DEFAULT_LON))
    return out


def found(spark, texts, names):
    return [tuple(r) for r in places.geotag(spark.createDataFrame(texts, CASES).withColumn("words", F.lit(1)), spark.createDataFrame(names, GAZETTEER).withColumn("chars", F.lit("x"))).collect()]


@pytest.fixture(params=[200_000, 0], ids=["trie", "joins"])
def both_ways(request, monkeypatch):
    monkeypatch.setattr(places, "MAX_BROADCAST_NAMES", request.param)


def test_names_of_any_form(spark, both_ways):
    names = [("St. Louis", 38.6, -90.2), ("Stratford-upon-Avon", 52.2, -1.7), ("San Pedro de Atacama", -22.9, -68.2), ("Paris", 48.9, 2.4), ("Paris", 33.7, -95.6), ("paris", 48.9, 2.4), ("Louis", 1.0, 1.0), ("--", 0.0, 0.0), ("İzmir", 38.4, 27.1)]
    texts = [("a", "Near St. Louis, at night"), ("b", "seen in Stratford-upon-Avon"), ("c", "by SAN PEDRO de\nAtacama!"), ("d", "Paris"), ("e", "St Louis"), ("f", "Louise"), ("g", None), ("h", ""), ("a", "Near Paris"), (None, "Paris, Paris"), ("i", "x" * C.ENGINE_SENT_CHARS + " Paris"), ("j", "St. Paris San Pedro de")]
    got = found(spark, texts, names)
    assert sorted(map(repr, got)) == sorted(map(repr, brute(texts, [n for n in names if n[0] != "İzmir"])))
    place = [(r[0], r[1]) for r in got]
    assert {("a", "st. louis"), ("b", "stratford-upon-avon"), ("c", "san pedro de atacama"), ("d", "paris"), ("e", "st. louis"), ("a", "paris"), ("j", "paris")} <= set(place) and len(got) == len(texts)
    assert [r[1:] for r in got if r[0] == "d"] == [("paris", 33.7, -95.6)]  # one row for a name that is there three times
    assert sorted(map(repr, found(spark, texts, []))) == sorted(map(repr, brute(texts, []))) and found(spark, [], names) == []


def test_random_names_and_texts(spark, both_ways):
    rng = random.Random(11)
    words = ["ab", "Ab", "c", "dd", "é", "中", "x1", "7"]
    glue = [" ", "-", ". ", ", ", "'", " (", "  "]
    make = lambda n: "".join(rng.choice(words) + rng.choice(glue) for _ in range(n))
    names = [(make(rng.randint(1, 6)), float(rng.randint(0, 9)), float(i % 7)) for i in range(400)]
    texts = [(f"c{i}", make(rng.randint(0, 60))) for i in range(300)]
    assert sorted(found(spark, texts, names)) == sorted(brute(texts, names))
    few = names[:5]
    assert sorted(found(spark, texts, few), key=repr) == sorted(brute(texts, few), key=repr)


def test_no_row_moves_with_the_trie(spark):
    texts, names = spark.range(50).select(F.col("id").cast("string").alias("case_id"), F.lit("in Paris").alias("text")), spark.createDataFrame([("Paris", 1.0, 2.0)], GAZETTEER)
    assert "hashpartitioning" not in places.geotag(texts, names)._jdf.queryExecution().executedPlan().toString()
