"""Hand-made rows: one test for each trap."""

import os
import random
import re
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from casejobs import constants as C
from casejobs.functions import answers, links, naming, text
from casejobs.operators import catalog, crawl, ingest, media, repair, vectors
from casejobs.plans import ingest as plan
from casejobs.schema import CASE_COLUMNS, CASE_SCHEMA
from casejobs.sources import cases as sources
from casejobs.streaming import tasks


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


NAMES = ["no_dot", ".pdf", "a.b.PDF", "x" * 20, "x" * 21 + ".jpg", "y" * 31, "straße_straße_straße.pdf", "😀 a b_c.d.png", "a b_c.jpeg", "pdf"]


def test_ids_and_kinds_follow_the_model(spark):
    assert column(spark, NAMES, naming.case_id_batch) == ["UAP-" + n.replace(".", "-").replace("_", "-")[:30].upper() for n in NAMES]
    assert column(spark, NAMES, naming.case_id_engine) == ["UAP-" + n.replace(" ", "-").replace("_", "-")[:20].upper() for n in NAMES]
    kinds = {"pdf": "pdf", "mp4": "video", "jpg": "image", "jpeg": "image", "png": "image"}
    assert column(spark, NAMES, naming.media_kind) == [kinds.get(n.split(".")[-1].lower()) for n in NAMES]


def test_strip_and_cap(spark):
    values = [None, "", " \t\x1c\x1d ", " a ", "x" * 3000, "x" * 3001, "😀" * 3001]
    want = ["d" if not (v or "").strip() else v.strip()[:3000] for v in values]
    assert column(spark, values, lambda c: text.cap_text(c, 3000, F.lit("d"))) == want


def test_year(spark):
    values = ["in 1953.", "é2004", "20045 x1999", "_1999", "1899 2100 2099", None, "a 1999 2001"]
    want = [m[1] + "-01-01" if (m := re.search(r"\b(19\d{2}|20\d{2})\b", v or "")) else "D" for v in values]
    assert column(spark, values, lambda c: text.detect_year_date(c, F.lit("D"))) == want


GOLDEN_TERMS = [  # title, date, search term
    ("059UAP00011.pdf", "2001-01-01", "2001"),
    ("059UAP00011.pdf", None, "UAP"),
    ("059UAP00011", "N/A", "UAP"),
    (None, None, ""),
    ("", "Unknown", ""),
    ("Red Lights.pdf", None, "Red%20Lights"),
    ("Red Lights.pdf", "a1987b", "1987"),
    ("DOW-UAP_D12_Red-Lights-en_x.JPG", None, "Red%20Lights%20en"),
    ("a_b.mp4", "x19", "b"),
    ("a_.mov", None, "a"),
    ("_x", None, "x"),
    ("é !~*'().avi", None, "%C3%A9%20!~*'()"),
    ("a+b&c/d😀", None, "a%2Bb%26c%2Fd%F0%9F%98%80"),
    ("x.pdf.pdf", None, "x.pdf"),
    *((f"{prefix}059UAP1.pdf", "2001-01-01", "2001") for prefix in C.SEARCH_PREFIXES),
    *((f"{prefix.upper()} Utah", None, "Utah") for prefix in C.SEARCH_PREFIXES),
]


def test_search_addresses(spark):
    df = spark.createDataFrame([(i, t, d) for i, (t, d, _) in enumerate(GOLDEN_TERMS)], "i int, t string, d string").orderBy("i")
    got = [r[0] for r in df.select(links.portal_search_url(F.col("t"), F.col("d"))).collect()]
    assert got == [f"{C.PORTAL}?search={term}" for _, _, term in GOLDEN_TERMS]


def test_search_terms_hold_only_safe_characters(spark):
    rng = random.Random(4)
    pool = ["Odtajněný spis: ", "059UAP00011", ".pdf", ".MP4", "_", "a-b", " ", "é", "!~*'()", "+&/", "😀", "-"]
    rows = [("".join(rng.choices(pool, k=rng.randint(0, 6))), rng.choice([None, "N/A", "2001-01-01", "x19"])) for _ in range(300)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, d string").orderBy("i")
    for (_, date), (url,) in zip(rows, df.select(links.portal_search_url(F.col("t"), F.col("d"))).collect()):
        term = url.removeprefix(C.PORTAL + "?search=")
        assert re.fullmatch(r"(?:[A-Za-z0-9_.!~*'()-]|%[0-9A-F]{2})*", term) and unquote(term, errors="strict") is not None
        assert term == "2001" if date == "2001-01-01" else term != "2001"


@pytest.mark.parametrize(
    "raw,want",
    [
        ('{"translation_snippet": "s", "latitude": 1, "longitude": "2.5"}', ("s", 1.0, 2.5)),
        ("{}", (C.ANSWER_DEFAULTS["pdf"], C.DEFAULT_LAT, C.DEFAULT_LON)),
        ('{"translation_snippet": null, "latitude": null}', (None, None, C.DEFAULT_LON)),
        ('{"latitude": 1, "latitude": 2}', (C.ANSWER_DEFAULTS["pdf"], 2.0, C.DEFAULT_LON)),
        *((bad, (C.ANSWER_ERROR, C.DEFAULT_LAT, C.DEFAULT_LON)) for bad in ("nope", "", "[]", "null", "{'latitude': 1}", '{"a": 1} x', '{"a": 1')),
    ],
)
def test_answers(spark, raw, want):
    assert tuple(column(spark, [raw], lambda c: answers.parse_answer(c, F.lit("pdf")))[0]) == want


def cases(spark, rows):
    return spark.createDataFrame([(i, f"c{i}", None, None, None, lat, lon, status, None, None, None) for i, (lat, lon, status) in enumerate(rows)], CASE_SCHEMA)


def test_two_rules_of_statistics(spark):
    df = cases(spark, [(None, None, s) for s in ["Unresolved"] + [None] * 5 + ["Resolved"] * 4 + ["Other"] * 6])
    assert tuple(catalog.case_stats(df).first()) == (16, 15, 1, 6.2, 93.8)  # 6.25 goes to the even digit
    assert tuple(catalog.case_stats_view(catalog.catalog_rows(df)).first()) == (16, 4, 12, 75.0, 25.0)
    assert tuple(catalog.case_stats(df.limit(0)).first()) == C.EMPTY_STATS
    assert tuple(catalog.case_stats_view(catalog.catalog_rows(df.limit(0))).first()) == (0, 0, 0, 0.0, 100.0)


def test_falsy_defaults_and_map(spark):
    nan = float("nan")
    df = cases(spark, [(0.0, 1.0, ""), (-0.0, None, None), (nan, 2.0, "x"), (1.0, 2.0, "Resolved")])
    got = catalog.catalog_rows(df).orderBy("id").collect()
    assert [r.latitude for r in got][:2] == [C.DEFAULT_LAT] * 2 and got[0].status == "Unresolved" and got[1].longitude == C.DEFAULT_LON
    raw = df.drop("id").withColumnRenamed("case_id", "id")
    assert [r.popup for r in catalog.map_points(raw).collect()] == ["<b>c3</b><br/><br/>📍 "]


def test_search(spark):
    df = spark.createDataFrame([("A1", None, ""), ("", None, None), ("b", "Xa", "Y")], "id string, title string, location string")
    assert [r.id for r in catalog.search_cases(df, "a").collect()] == ["A1", "b"]
    assert [r.id for r in catalog.search_cases(df, "").collect()] == ["A1", "b"]


def test_links_of_real_html(spark):
    html = '<A HREF="x.PDF?a=1&amp;b">1</A><a>no</a><a href>e</a><script>"<a href=\'y.png\'>"</script><!-- <a href="z.mov"> --><a class=q href=\'httpfoo.mp4\'>2</a><a href="/p/v.mp4#t"><a href="page">'
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id bigint, html string")
    got = crawl.extract_links(df)
    assert [(r.pos, r.href) for r in got.orderBy("pos").collect()] == [(0, "x.PDF?a=1&b"), (1, ""), (2, "httpfoo.mp4"), (3, "/p/v.mp4#t"), (4, "page")]
    media_rows = crawl.media_links(got, "http://b/").orderBy("pos").collect()
    assert [(r.url, r.file_name) for r in media_rows] == [("http://b/x.PDF?a=1&b", "x.PDF"), ("httpfoo.mp4", "httpfoo.mp4"), ("http://b//p/v.mp4#t", "v.mp4#t")]


def test_routes(spark):
    values = ["a.mp4", "a.MP4", "VIDEO", "x.pdf", "a.mov?x"]
    assert column(spark, values, links.route_source) == ["video", "pdf", "video", "pdf", "pdf"]


def test_frames(spark):
    df = spark.createDataFrame([(v, i, i) for v, n in ((1, 1), (30, 30), (31, 31), (61, 61)) for i in range(n)], "video_id bigint, ts bigint, event_id bigint")
    report = {r.video_id: (r.total_frames, r.saved_frames) for r in media.frame_report(media.number_frames(df)).collect()}
    assert report == {1: (1, 1), 30: (30, 1), 31: (31, 2), 61: (61, 3)}
    row = media.hud_parallax(spark.createDataFrame([(25000.0, 142.5, 450.0)], "altitude_ft double, azimuth double, speed_kn double")).first()
    assert (row.altitude_m, row.azimuth_deg, row.true_speed_knots) == (7620.0, 142.5, 427.5)


def test_seed_then_repair(spark):
    seeded = sources.seed_if_empty(spark.createDataFrame([], CASE_SCHEMA), sources.seed_cases(spark))
    fixed = {r.case_id: (r.title, r.translation_snippet) for r in repair.repair_fixed(seeded).collect()}
    assert fixed == {r[0]: (r[1], r[2]) for r in C.REPAIR_RULES[3:]}
    assert sources.seed_if_empty(seeded, sources.seed_cases(spark)).count() == 3


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [0.0, 0.0], 0), (3, [2.0, 0.0], 0), (4, [-1.0, 1.0], 0), (1, [0.0, 1.0], 1)]
    points = spark.createDataFrame(rows, "id bigint, vector array<float>, seq bigint").withColumn("payload", F.create_map(F.lit("a"), F.lit("b")))
    latest = vectors.latest_per_id(points)
    top = vectors.search_similar(latest, [0.0, 1.0], 3).collect()
    assert [(r.id, round(r.score, 6)) for r in top] == [(1, 1.0), (4, 0.707107), (2, 0.0)]
    queries = spark.createDataFrame([(9, [0.0, 1.0])], "query_id bigint, vector array<float>")
    assert [r.id for r in vectors.knn_join(latest, queries, 3).orderBy("rank").collect()] == [1, 4, 2]
    both = vectors.payload(F.lit(1), F.lit("t"), F.create_map(F.lit("text"), F.lit("m")))
    assert spark.range(1).select(both.alias("p")).first().p == {"case_id": "1", "text": "m"}
    assert [r.id for r in vectors.check_collection(points, 3).select("id").distinct().orderBy("id").collect()] == [1, 2, 3, 4]


def test_knn_pairs_blocks_inside_spark(spark, monkeypatch):
    rng = random.Random(6)
    rows = {i: [0.0] * 3 if i == 40 else [float(rng.randint(-9, 9)) + i / 1000 for _ in range(3)] for i in range(400)}
    points = spark.createDataFrame(list(rows.items()) + [(1000, [1.0, 2.0]), (1001, None)], "id bigint, vector array<double>")
    queries = points.where("id % 20 = 0 AND id < 1000").withColumnRenamed("id", "query_id")
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 6)
    monkeypatch.setattr(vectors, "POINT_BLOCK", 37, raising=False)
    monkeypatch.setattr(vectors, "STEP", 4, raising=False)
    with monkeypatch.context() as m:  # query vectors don't pass through the driver
        for name in ("collect", "toPandas", "toLocalIterator"):
            m.setattr(type(points), name, lambda *_: pytest.fail("rows were sent to the driver"))
        hits = vectors.knn_join(points, queries, 4)

    def score(a, b):
        norm = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / norm if norm else 0.0

    want = {(q, n + 1): i for q in range(0, 400, 20) for n, i in enumerate(sorted(rows, key=lambda i: (-score(rows[q], rows[i]), i))[:4])}
    got = hits.collect()
    assert {(r.query_id, r.rank): r.id for r in got} == want and len(got) == len(want)
    assert all(abs(r.score - score(rows[r.query_id], rows[r.id])) < 1e-9 for r in got)


def test_ingest_twice_is_ingest_once(spark, tmp_path):
    files = spark.createDataFrame([("a.pdf",), ("b.txt",), ("x" * 25 + "1.mp4",), ("x" * 25 + "2.mp4",), ("bad.pdf",), ("scan.pdf",)], "file_name string")
    pages = spark.createDataFrame([("a.pdf", 2, "two 1999"), ("a.pdf", 1, " one"), ("bad.pdf", 1, None), ("scan.pdf", 1, "  ")], "file_name string, page_no int, text string").withColumn("error", F.when(F.col("file_name") == "bad.pdf", "broken"))
    target = str(tmp_path / "cases")
    sources.reset_cases(spark, target)
    for _ in range(2):
        new = plan.ingest(files, pages, sources.read_cases(spark, target), plan.ENGINE)
        assert new.columns == CASE_COLUMNS
        sources.append_cases(new, target)
    got = {r.title: r for r in sources.read_cases(spark, target).collect()}
    assert len(got) == 4
    a, bad, scan = (got[C.TITLE_PDF + n] for n in ("a.pdf", "bad.pdf", "scan.pdf"))
    assert (a.original_text, a.date) == ("one\ntwo 1999", "1999-01-01")
    assert bad.translation_snippet == C.PARSE_ERROR + "broken" and bad.original_text == "Zdrojový soubor: bad.pdf"
    assert scan.original_text == C.SCANNED_TEXT and scan.date == C.ENGINE_DATE
    assert C.TITLE_VIDEO + "x" * 25 + "1.mp4" in got
    assert plan.ingest(files, pages, sources.read_cases(spark, target).limit(0), plan.BATCH).count() == 6


def test_listing(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a b.pdf", "c%20d.txt", "sub/e.pdf"):
        (tmp_path / name).write_text("x")
    assert sorted(r.file_name for r in sources.list_incoming(spark, str(tmp_path)).collect()) == ["a b.pdf", "c%20d.txt"]
    below = {r.file_name for r in sources.list_incoming(spark, str(tmp_path), recursive=True).collect()}
    assert below == {"a b.pdf", "c%20d.txt"} | {f.name for f in tmp_path.glob("*/*") if f.stat().st_size}
    assert sources.list_incoming(spark, str(tmp_path / "none")).count() == 0


def test_stream_in_batches(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("http://h/a.mp4", f"c{i}", f"2024-01-01 00:00:{i:02d}") for i in range(6)]
    for part in (rows[:3], rows[2:5], rows[3:]):  # tasks come again
        df = spark.createDataFrame(part, "source_url string, case_id string, t string").select("source_url", "case_id", F.to_timestamp("t").alias("enqueued_at"))
        df.write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        tasks.ingest_stream(stream, target, str(tmp_path / "state")).awaitTermination()
    assert sorted(r.case_id for r in tasks.read_store(spark, target).collect()) == [f"c{i}" for i in range(6)]


def test_report_parts(spark):
    cand = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("c", "4")], "case_id string, file_name string")
    existing = spark.createDataFrame([("b",)], "case_id string")
    assert tuple(ingest.ingest_report(cand, cand, existing).first()) == (4, 2, 2)


def test_database_reads_by_ranges(spark, tmp_path):
    """An embedded database that comes with Spark; each range of ids is a part of its own."""
    url = f"jdbc:derby:memory:cases{os.getpid()};create=true"
    jdbc = {"url": url, "dbtable": "CASES", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = [tuple(i if f.name == "id" else f"c{i}" if f.name == "case_id" else 1.5 if f.dataType.typeName() == "double" else "x" for f in CASE_SCHEMA) for i in range(100)]
    cases = spark.createDataFrame(rows, CASE_SCHEMA)
    folded = cases.toDF(*[c.upper() for c in cases.columns])
    kinds = ", ".join(f"{f.name.upper()} VARCHAR(200)" for f in CASE_SCHEMA if f.dataType.typeName() == "string")
    folded.write.format("jdbc").options(**jdbc, createTableColumnTypes=kinds).mode("overwrite").save()
    got = sources.read_cases(spark, jdbc=jdbc, parts=4)
    assert got.schema.names == CASE_COLUMNS and got.rdd.getNumPartitions() == 4
    assert [r.id for r in got.select("id").distinct().orderBy("id").collect()] == list(range(100)) and got.count() == 100
    folded.limit(0).write.format("jdbc").options(**jdbc, truncate="true").mode("overwrite").save()
    assert sources.read_cases(spark, jdbc=jdbc).count() == 0
    own = jdbc | {"partitionColumn": "ID", "lowerBound": "0", "upperBound": "10", "numPartitions": "2"}
    assert sources.read_cases(spark, jdbc=own).rdd.getNumPartitions() == 2
