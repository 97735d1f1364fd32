"""Stores with commits: whole or not at all, once for several writers, and only files read that may matter."""

import random

import pytest
from pyspark.sql import functions as F

from casejobs.schema import CASE_SCHEMA
from casejobs.sources import cases as sources
from casejobs.sources import commits, points
from casejobs.streaming import dedupe, tasks


def batch(spark, numbers, address="u"):
    rows = [(f"{address}{i}", None if i is None else f"c{i:05d}", "pdf", i or 0) for i in numbers]
    return spark.createDataFrame(rows, "source_url string, case_id string, route string, n int").withColumn("enqueued_at", F.timestamp_seconds("n")).drop("n")


def stored(spark, target):
    return sorted((r.case_id, r.source_url) for r in tasks.read_store(spark, target).collect())


@pytest.fixture
def files_read(monkeypatch):
    """Numbers of the files that each step found to matter, and of all files."""
    seen = []
    real = commits.touched

    def touched(log, keys, key, files):
        found = real(log, keys, key, files)
        seen.append((len(found), len(files)))
        return found

    monkeypatch.setattr(tasks, "touched", touched)
    monkeypatch.setattr(sources, "touched", touched)
    return seen


def test_a_batch_reads_few_files(spark, tmp_path, files_read):
    target, rng = str(tmp_path / "store"), random.Random(5)
    numbers = list(range(800))
    rng.shuffle(numbers)
    for i in range(4):  # batches whose ranges overlap
        tasks.store_batch(batch(spark, numbers[200 * i : 200 * i + 200]), target)
    of_log = commits.Log(spark, target).files("tasks")
    assert len(of_log) >= 4 and all(f.low < f.high and f.filters for f in of_log)
    assert tasks.store_batch(batch(spark, [*numbers[:2], 5000], "again"), target)
    found, whole = files_read[-1]
    assert whole == len(of_log) and 1 <= found <= 3 < whole
    assert stored(spark, target) == sorted([(f"c{i:05d}", f"u{i}") for i in range(800)] + [("c05000", "again5000")])
    tasks.store_batch(batch(spark, [9001, 9002]), target)  # outside all ranges
    assert files_read[-1][0] == 0
    tasks.store_batch(batch(spark, [None, 7000, 7000]), target)
    assert ("c07000", "u7000") in stored(spark, target) and all(r[0] for r in stored(spark, target))


def test_no_key_is_missed_by_filters(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "BLOCK_BITS", 32_768)
    monkeypatch.setattr(commits, "BITS_A_KEY", 400)  # several blocks
    log = commits.Log(spark, str(tmp_path / "t"))
    rows = spark.range(3000).select(F.concat(F.lit("é"), F.col("id").cast("string")).alias("k"))
    files = log.write(rows.repartition(5), "k")
    log.commit(1, "a", {"t": files})
    assert len(files) == 5 and spark.read.parquet(f"{log.folder}/{files[0].filters}").groupBy("file").count().first()[1] > 1
    for i in range(0, 3000, 500):
        one = rows.where(F.col("k") == f"é{i}")
        held = log.read("t", "k string", commits.touched(log, one, "k", files)).where(F.col("k") == f"é{i}")
        assert held.count() == 1
    assert commits.touched(log, rows, "k", files) == files and commits.touched(log, rows.limit(0), "k", files) == []
    monkeypatch.setattr(commits, "MAX_LOOKED_UP", 0)
    assert commits.touched(log, rows.limit(1), "k", files) == [f for f in files if f.low <= rows.first().k <= f.high]


def test_two_writers_store_each_case_once(spark, tmp_path, monkeypatch):
    """The second writer commits while the first has made its files and is about to commit."""
    target = str(tmp_path / "store")
    tasks.store_batch(batch(spark, range(50)), target)
    real, meets = commits.Log.commit, []

    def slow(self, number, run, files, drops=False):
        if run == "first" and not meets:
            meets.append(tasks.store_batch(batch(spark, range(40, 90), "second"), target, "second"))
        return real(self, number, run, files, drops)

    monkeypatch.setattr(commits.Log, "commit", slow)
    assert tasks.store_batch(batch(spark, range(60, 120), "first"), target, "first") and meets == [True]
    want = [(f"c{i:05d}", f"{'u' if i < 50 else 'second' if i < 90 else 'first'}{i}") for i in range(120)]
    assert stored(spark, target) == want
    assert not tasks.store_batch(batch(spark, range(500)), target, "first")  # a batch that is done again
    assert stored(spark, target) == want and [c["run"] for c in commits.Log(spark, target).commits()][1:] == ["second", "first"]


def test_good_and_rejected_rows_come_together(spark, tmp_path, monkeypatch):
    """A run that fails between its two writes leaves nothing; the repeated run leaves both."""
    target = str(tmp_path / "cases")
    rows = [(i, f"c{i % 7}" if i % 3 else None, *[None] * 9) for i in range(30)]
    cases = spark.createDataFrame(rows, CASE_SCHEMA)
    real, calls = commits.Log.write, []

    def failing(self, frame, key=None):
        calls.append(key)
        if len(calls) == 2:
            raise OSError("lost")
        return real(self, frame, key)

    with monkeypatch.context() as m:
        m.setattr(commits.Log, "write", failing)
        with pytest.raises(OSError):
            sources.append_cases(cases, target, "run 1")
    assert calls == ["case_id", None] and not commits.Log(spark, target).commits()
    for _ in range(2):
        sources.append_cases(cases, target, "run 1")
    assert sorted((r.id, r.case_id) for r in sources.read_cases(spark, target).collect()) == sorted({f"c{i % 7}": (i, f"c{i % 7}") for i in reversed(range(30)) if i % 3}.values())
    assert sorted(r.id for r in sources.read_rejected(spark, target).collect()) == list(range(0, 30, 3))
    sources.reset_cases(spark, target)
    assert sources.read_cases(spark, target).count() == sources.read_rejected(spark, target).count() == 0


def test_a_plain_table_is_taken_over(spark, tmp_path):
    target = str(tmp_path / "plain")
    cases = spark.createDataFrame([(i, f"c{i}", *[None] * 9) for i in range(10)], CASE_SCHEMA)
    cases.where("id < 6").write.parquet(target)
    assert sources.read_cases(spark, target).count() == 6
    sources.append_cases(cases, target)
    assert sorted(r.id for r in sources.read_cases(spark, target).collect()) == list(range(10))


def test_points_are_merged_on_read(spark, tmp_path):
    """Equal to the last write of each id after each of five updates and after a compaction; updates rewrite nothing."""
    target, rng = str(tmp_path / "points"), random.Random(2)
    schema = "id bigint, vector array<float>, payload map<string,string>, seq bigint"
    make = lambda ids, seq: [(i, [float(rng.randint(0, 9))], {"n": str(rng.random())}, seq()) for i in ids]
    written = make(range(200), lambda: 5)
    points.write_points(spark.createDataFrame(written, schema), target)
    latest = {r[0]: r for r in written}
    for turn in range(5):
        rows = make(rng.sample(range(260), 40), lambda: rng.randint(3, 8 + turn))
        points.upsert(spark.createDataFrame(rows, schema), target)
        for r in rows:
            if r[0] not in latest or r[3] >= latest[r[0]][3]:
                latest[r[0]] = r
        got = {r.id: tuple(r) for r in points.read_points(spark, target).collect()}
        assert got == latest and points.read_points(spark, target).count() == len(latest)
    log = commits.Log(spark, target)
    base = log.files("base")
    assert len(log.files("delta")) >= 5 and all(c["files"].keys() == {"delta"} for c in log.commits()[1:])
    points.compact(spark, target)
    assert {r.id: tuple(r) for r in points.read_points(spark, target).collect()} == latest
    assert not log.files("delta") and not set(f.path for f in base) & set(f.path for f in log.files("base"))
    points.upsert(spark.createDataFrame([(1, [1.0], {"n": "last"}, 99)], schema), target)
    assert points.read_points(spark, target).where("id = 1").first().payload == {"n": "last"}


def test_small_files_are_put_together(spark, tmp_path, files_read, monkeypatch):
    """The same rows after compactions between batches; large files are not written again, earlier commits not read."""
    target, rng = str(tmp_path / "store"), random.Random(7)
    monkeypatch.setattr(commits, "FULL_ROWS", 250)
    log, numbers = commits.Log(spark, target), list(range(600))
    rng.shuffle(numbers)
    for i in range(6):
        tasks.store_batch(batch(spark, numbers[100 * i : 100 * i + 100]), target, f"batch {i}")
        if i in (2, 5):
            before = {f.path for f in log.files("tasks")}
            assert tasks.compact_store(spark, target, f"compaction {i}")
            large = {f.path for f in log.files("tasks")} & before
            assert bool(large) == (i == 5)  # what the first compaction made stays
        want = sorted((f"c{n:05d}", f"u{n}") for n in numbers[: 100 * i + 100])
        assert stored(spark, target) == want
    files = log.files("tasks")
    assert len(files) == 4 and sum(f.rows for f in files) == 600 and all(f.filters for f in files)
    assert len(log.commits()) == 1 and log.commits()[0]["number"] == 8  # the last compaction tells all
    assert not tasks.store_batch(batch(spark, range(700, 800)), target, "batch 1")  # its run is still known
    made = sorted((f for f in files if f.path not in large), key=lambda f: f.low)
    assert all(a.high < b.low for a, b in zip(made, made[1:]))
    assert tasks.store_batch(batch(spark, [3, 1000]), target) and files_read[-1][0] < files_read[-1][1]
    assert stored(spark, target) == sorted([*want, ("c01000", "u1000")])


def test_compaction_and_another_writer(spark, tmp_path, monkeypatch):
    """Tasks that are stored while a compaction has made its files are not lost."""
    target = str(tmp_path / "store")
    for i in range(2):
        tasks.store_batch(batch(spark, range(40 * i, 40 * i + 40)), target)
    real, meets = commits.Log.commit, []

    def slow(self, number, run, *rest):
        if run == "compaction" and not meets:
            meets.append(tasks.store_batch(batch(spark, range(60, 120)), target))
        return real(self, number, run, *rest)

    monkeypatch.setattr(commits.Log, "commit", slow)
    assert tasks.compact_store(spark, target, "compaction") and meets == [True]
    assert [r[0] for r in stored(spark, target)] == [f"c{i:05d}" for i in range(120)]
    assert not tasks.compact_store(spark, target)  # one file is left


def test_cases_and_rejected_rows_after_compaction_and_vacuum(spark, tmp_path):
    target = str(tmp_path / "cases")
    cases = spark.createDataFrame([(i, f"c{i}" if i % 4 else None, *[None] * 9) for i in range(40)], CASE_SCHEMA)
    cases.where("id < 10").write.parquet(target)  # made without commits
    for low in (10, 20):
        sources.append_cases(cases.where(F.col("id").between(low, low + 9)), target)
    log = commits.Log(spark, target)
    folders = lambda: {p.name for p in (tmp_path / "cases").iterdir() if p.is_dir() and p.name != "_commits"}
    rejected = sorted(f.path for f in log.files("rejected"))
    assert log.vacuum(0) == 0 and log.vacuum() == 0
    before = folders()
    assert sources.compact_cases(spark, target) and log.vacuum() == 0 and before < folders()  # too young to go
    lost = log.write(cases.limit(3), "case_id")  # of a try that is never committed
    assert log.vacuum(0) >= 4 and not folders() & {lost[0].path.split("/")[0], lost[0].filters}
    assert rejected == sorted(f.path for f in log.files("rejected"))
    assert [f.rows for f in log.files("cases")] == [25]
    assert sorted(r.id for r in sources.read_cases(spark, target).collect()) == [i for i in range(30) if i < 10 or i % 4]
    assert sorted(r.id for r in sources.read_rejected(spark, target).collect()) == [i for i in range(10, 30) if not i % 4]
    sources.reset_cases(spark, target)
    log.vacuum(0)
    assert not folders() and sources.read_cases(spark, target).count() == 0
    sources.append_cases(cases, target)
    assert sources.read_cases(spark, target).count() == 30 and log.commits()[-1]["number"] == 5


def drained(spark, source, target, state, bound):
    schema = "source_url string, case_id string, enqueued_at timestamp"
    passed = dedupe.dedupe_stream(spark.readStream.schema(schema).parquet(source), bound)
    passed.writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").start(target).awaitTermination()
    return sorted((r.case_id, r.source_url) for r in spark.read.parquet(target).collect())


def test_the_first_task_passes_until_the_bound(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def come(*rows):
        df = spark.createDataFrame(rows, "source_url string, case_id string, s int").select("source_url", "case_id", F.timestamp_seconds("s").alias("enqueued_at"))
        df.coalesce(1).write.mode("append").parquet(source)
        return drained(spark, source, target, state, "60 seconds")

    assert come(("b", "x", 1000), ("a", "x", 1000), ("c", "x", 999), ("z", "y", 1010), ("n", None, 1000), ("n", "q", None)) == [("x", "c"), ("y", "z")]
    assert come(("early", "x", 998), ("late", "x", 1050), ("w", "v", 1020)) == [("v", "w"), ("x", "c"), ("y", "z")]
    assert come(("t", "k", 2000)) == [("k", "t"), ("v", "w"), ("x", "c"), ("y", "z")]  # the watermark moves on, and x is forgotten
    assert come(("new", "x", 2001), ("newer", "x", 2002)) == [("k", "t"), ("v", "w"), ("x", "c"), ("x", "new"), ("y", "z")]
