"""Hot keys and large side tables, against the plain way."""

import random

import pytest
from pyspark.sql import functions as F

from casejobs.operators import media, repair


@pytest.mark.parametrize("hot", [1, None])
def test_a_hot_video_is_numbered_in_many_tasks(spark, monkeypatch, hot):
    """Nine of ten frames are of one video, or of none: its numbers are those of one window, made in several ranges."""
    monkeypatch.setattr(media, "HOT_FRAMES", 300)
    monkeypatch.setattr(media, "HOT_SHARE", 5)
    rng = random.Random(1)
    rows = [(hot if i % 10 else rng.choice([2, 3, None, 1]), rng.choice([None, i // 7]), i, "x") for i in range(4000)]
    rng.shuffle(rows)
    frames = spark.createDataFrame(rows, "video_id bigint, ts bigint, event_id bigint, range string").withColumn("video", F.lit(0))
    plain = media._numbered(frames, "video_id", ("ts", "event_id"))
    got = media.number_frames(frames)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.select(*got.columns).collect()))
    ranges = []
    seen = type(frames).repartitionByRange
    monkeypatch.setattr(type(frames), "repartitionByRange", lambda self, *c: ranges.append(seen(self, 9, *c)) or ranges[-1])
    again = media._numbered_in_ranges(frames, "video_id", ("ts", "event_id"))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, got.collect()))
    assert ranges[0].withColumn("p", F.spark_partition_id()).where(F.col("frame.video_id").eqNullSafe(F.lit(hot))).select("p").distinct().count() >= 8
    assert media.number_frames(frames.limit(0)).count() == 0


def slow_repair(cases, rules):
    out = []
    for case_id, title, snippet in cases:
        fit = next((r for r in sorted(rules, key=lambda r: (r[0], r[1] or "")) if r[1] is not None and case_id is not None and r[1] in case_id), None)
        out.append((case_id, *(fit[2:] if fit else (title, snippet))))
    return sorted(map(repr, out))


CASES, RULES = "case_id string, title string, translation_snippet string", "priority int, pattern string, title string, translation_snippet string"


def repaired(spark, cases, rules):
    df = spark.createDataFrame(cases, CASES).withColumns({"part": F.lit(1), "rule": F.lit("x"), "n": F.lit(None).cast("int")})
    got = repair.repair_by_rules(df, spark.createDataFrame(rules, RULES))
    assert got.columns == df.columns
    return sorted(repr((r.case_id, r.title, r.translation_snippet)) for r in got.collect())


@pytest.mark.parametrize("few", [64, 0])
@pytest.mark.parametrize("empty", [False, True])
def test_rules_by_parts_are_rules_one_by_one(spark, monkeypatch, few, empty):
    monkeypatch.setattr(repair, "FEW_RULES", few)
    rng = random.Random(3)
    text = lambda a, b: "".join(rng.choice("abcé中-A") for _ in range(rng.randint(a, b)))
    cases = [(text(0, 12), "t", f"s{i}") for i in range(500)] + [(None, "t", "s"), ("", "t", "s"), ("abc", None, None), ("abc", None, None)]
    rules = [(rng.randint(0, 9), f"{text(1, 5)}", f"T{i}", None if i % 5 else f"S{i}") for i in range(40)] + [(0, None, "never", "never"), (3, "zz", "no", "no")]
    rules = [r for i, r in enumerate(rules) if r[:2] not in [x[:2] for x in rules[:i]]]
    rules += [(5, "", "all", "all")] if empty else []
    assert repaired(spark, cases, rules) == slow_repair(cases, rules)
    assert repaired(spark, cases, []) == slow_repair(cases, []) and repaired(spark, [], rules) == []


def test_a_hundred_thousand_rules(spark):
    cases = [(f"UAP-{i}-X", "t", "s") for i in range(3000)]
    rules = [(i, f"-{i}-", f"T{i}", f"S{i}") for i in range(100_000)]
    got = repaired(spark, cases, rules)
    assert got == sorted(repr((c, f"T{i}", f"S{i}")) for i, (c, _, _) in enumerate(cases))
