"""The registered queries over the given tables, and the same in SQL.

Fixtures turn the given tables into files, cases, pages, answers and so on, by arithmetic on the keys; their SQL reads the
same on both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as C
from .functions import answers as fa
from .functions import links as fl
from .functions import naming as fn
from .functions import text as ft
from .operators import answers, catalog, crawl, ingest, media, places, repair, search_index, vector_index, vectors
from .plans import crawl as crawl_plan
from .plans import ingest as ingest_plan
from .session import scratch
from .sources import cases as sources
from .sources import points as point_store
from .sources.commits import Log
from .streaming import dedupe
from .streaming import tasks as streams

Query = Callable[[SparkSession, str], DataFrame]

FILES_SQL = """
SELECT doc_id, lang, source, text,
  concat(CAST(doc_id % 400 AS STRING), 'UAP_', source, ' ', lang, '.rel_', CAST(doc_id AS STRING), '.',
    CASE doc_id % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'PDF' WHEN 2 THEN 'mp4' WHEN 3 THEN 'jpg'
                    WHEN 4 THEN 'PNG' WHEN 5 THEN 'jpeg' ELSE 'txt' END) AS file_name
FROM {documents}
"""

CASES_SQL = """
SELECT d.doc_id AS id,
  concat('UAP-', CAST(d.doc_id AS STRING)) AS case_id,
  CASE WHEN d.doc_id % 17 = 0 THEN CAST(NULL AS STRING)
       WHEN d.doc_id % 3 = 0 THEN concat('Odtajněný spis: 059UAP', CAST(d.doc_id AS STRING), '.pdf')
       WHEN d.doc_id % 3 = 1 THEN concat('Obrazový důkaz: DOW-UAP_D', CAST(d.doc_id AS STRING), '_Red-Lights-', d.lang, '_x.JPG')
       ELSE concat('Záznam: Utah (', d.source, ')!~*.mp4') END AS title,
  CASE d.doc_id % 9 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'N/A' WHEN 2 THEN '' WHEN 3 THEN 'Unknown'
       ELSE concat(CAST(1900 + d.doc_id % 126 AS STRING), '-01-01') END AS date,
  CASE WHEN d.doc_id % 8 = 0 THEN '' ELSE concat('Loc ', d.source) END AS location,
  CASE WHEN d.doc_id % 13 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(d.doc_id % 181 AS DOUBLE) - 90 END AS latitude,
  CASE WHEN d.doc_id % 19 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(d.doc_id % 361 AS DOUBLE) - 180 END AS longitude,
  CASE WHEN l.quality = 1 THEN 'Unresolved' WHEN l.quality = 0 THEN 'Resolved'
       WHEN d.doc_id % 3 = 0 THEN CAST(NULL AS STRING) WHEN d.doc_id % 3 = 1 THEN 'Unresolved'
       ELSE 'Under review' END AS status,
  CASE WHEN d.doc_id % 5 = 0 THEN CAST(NULL AS STRING) ELSE substring(d.text, 1, 200) END AS translation_snippet,
  d.text AS original_text,
  CASE WHEN d.doc_id % 6 = 0 THEN CAST(NULL AS STRING) ELSE concat('https://example.org/', d.source) END AS source_url
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""

#: Names of one to seven words, with punctuation, and one that stands twice.
PLACES = (
    ("the", 1.0, 2.0), ("of the", 3.0, 4.0), ("Of-The", 2.0, 4.5), ("Of The", 5.0, 4.0), ("la", 5.0, 6.0), ("de la", 7.0, 8.0), ("und", 9.0, 10.0),
    ("Thanedble the Anea Eriner", 11.0, 12.0), ("The, Anea", 13.0, 14.0), ("ATTION to thanedble, the anea-eriner (thanea)", 15.0, 16.0), ("the of. Nowhere", 17.0, 18.0),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FILES_SQL, documents=table(spark, sf_dir, "documents"))


def fx_cases(spark: SparkSession, sf_dir: str, *hints: str) -> DataFrame:
    """``hints``: how the labels are joined; else Spark decides."""
    labels = table(spark, sf_dir, "labels")
    for hint in hints:
        labels = labels.hint(hint)
    return spark.sql(CASES_SQL, documents=table(spark, sf_dir, "documents"), labels=labels)


def fx_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a document as the pages of its file."""
    return fx_files(spark, sf_dir).select("doc_id", "file_name", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select("doc_id", "file_name", (F.col("pos") + 1).cast("int").alias("page_no"), "text")


def fx_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every fifth file, as already stored."""
    return fx_files(spark, sf_dir).where("doc_id % 5 = 0").select(fn.case_id_engine(F.col("file_name")).alias("case_id")).distinct()


def fx_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    meta = F.create_map(F.lit("label"), F.col("label").cast("string"))
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), vectors.payload(F.col("vec_id"), F.concat(F.lit("text "), F.col("vec_id").cast("string")), meta).alias("payload"), F.lit(0).cast("bigint").alias("seq"))


def fx_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with media links put before the end, and a fetch result."""
    page = F.col("page_id").cast("string")
    some = (F.col("page_id") % 50).cast("string")
    more = F.concat(F.lit('<a href="files/'), page, F.lit('.PDF?x=1">f</a><A class="m" HREF="http://h.example/'), some, F.lit('.mp4#t">v</A><script>var s=\'<a href="x.png">\';</script><!-- <a href="y.mov"> -->'))
    status = F.when(F.col("page_id") % 10 == 7, 403).when(F.col("page_id") % 10 == 8, 500).otherwise(200)
    error = F.when(F.col("page_id") % 10 == 9, F.concat(F.lit("timeout "), page))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.replace(F.col("html"), F.lit("</body>"), F.concat(more, F.lit("</body>"))).alias("html"), status.alias("http_status"), error.alias("error"))


def fx_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.number_frames(table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), "ts", "event_id"))


def task_columns(events: DataFrame) -> DataFrame:
    k = F.col("event_id") % 5
    url = F.when(k == 0, "http://h/a.mp4").when(k == 1, "http://h/A.MP4").when(k == 2, "http://h/VIDEO/1").when(k == 3, "http://h/x.pdf").otherwise("http://h/b.mov?x")
    return events.select(url.alias("source_url"), F.col("user_id").cast("string").alias("case_id"), F.col("ts").alias("enqueued_at"))


def task_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of tasks; the name is a pattern, since a stream reads a folder or a pattern."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return task_columns(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*"))


def with_years(documents: DataFrame) -> DataFrame:
    k = F.col("doc_id") % 4
    tail = F.when(k == 0, " seen 1953.").when(k == 1, " é2004").when(k == 2, " 20045 x1999").otherwise("")
    return documents.select("doc_id", F.concat("text", tail).alias("text"))


def answered(cases: DataFrame) -> DataFrame:
    k = F.col("id") % 6
    raw = (
        F.when(k == 0, '{"translation_snippet": "s", "latitude": 1.5, "longitude": -2.25}')
        .when(k == 1, '{"translation_snippet": "s", "longitude": -2.25}')
        .when(k == 2, '{"latitude": null, "longitude": 3}')
        .when(k == 3, '{"translation_snippet": "x", "latitude": "40.7", "longitude": 3}')
        .otherwise("nope")
    )
    return cases.where("id % 6 <> 5").select("case_id", raw.alias("raw_json"))


def with_kind(cases: DataFrame) -> DataFrame:
    k = F.col("id") % 4
    return cases.withColumns({"kind": F.when(k == 0, "pdf").when(k == 1, "scanned").when(k == 2, "video").otherwise("image"), "file_name": F.concat("case_id", F.lit(".pdf"))})


def repaired_ids(cases: DataFrame) -> DataFrame:
    """Ids with the rules' patterns: one of each, one with two, one with none."""
    k = F.col("id") % 8
    prefix = F.lit("")
    for i, (pattern, _, _) in enumerate(C.REPAIR_RULES):
        prefix = F.when(k == i, pattern).otherwise(prefix)
    prefix = F.when(k == 6, "UTAH-1953 AUTO-FBI-").otherwise(prefix)
    return cases.withColumn("case_id", F.concat(prefix, "case_id"))


def digest(text: str = "text") -> list[Column]:
    return [F.length(text).cast("bigint").alias("n"), F.md5(F.col(text).cast("binary")).alias("md5")]


def case_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("file_name")
    kind = fn.media_kind(name)
    return fx_files(spark, sf_dir).select(
        "file_name", fn.case_id_batch(name).alias("batch_id"), fn.case_id_engine(name).alias("engine_id"), fn.file_ext(name).alias("ext"),
        kind.alias("kind"), fn.case_title(name, kind).alias("title"), fn.case_title_batch(name).alias("batch_title"),
    )


def supported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.supported_files(fx_files(spark, sf_dir)).select("file_name", "kind")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest_plan.candidates(fx_files(spark, sf_dir), ingest_plan.ENGINE).select("case_id", "file_name")


def existing_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.skip_existing(_candidates(spark, sf_dir), fx_existing(spark, sf_dir))


def existing_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.already_stored(_candidates(spark, sf_dir), fx_existing(spark, sf_dir))


def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.first_per_key(_candidates(spark, sf_dir), "case_id", "file_name")


def append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = fx_existing(spark, sf_dir)
    new = ingest_plan.new_files(fx_files(spark, sf_dir), existing, ingest_plan.ENGINE).select("case_id")
    return ingest.append_new(existing, new)


def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingest_report(fx_files(spark, sf_dir), _candidates(spark, sf_dir), fx_existing(spark, sf_dir))


def ingest_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same figures, counted while the new files' keys are written."""
    return ingest_plan.ingest_observed(fx_files(spark, sf_dir), fx_existing(spark, sf_dir), lambda new: new.write.parquet(scratch(spark, "new-files")))


def assemble(separator: str, max_pages: int | None, trim: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ingest.assemble_text(fx_pages(spark, sf_dir), separator, max_pages, trim, key="doc_id").select("doc_id", *digest())

    return query


def cap_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx_files(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.lit("  \n ")).otherwise(F.concat(F.lit(" \n"), "text", F.lit("\t"))))
    capped = ft.cap_text(F.col("text"), C.BATCH_TEXT_CHARS, fn.filled(C.BATCH_TEXT, F.col("file_name")))
    return rows.select("doc_id", capped.alias("text")).select("doc_id", *digest())


def year_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_years(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", ft.detect_year_date(F.col("text"), F.lit(C.ENGINE_DATE)).alias("date"))


def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.catalog_rows(fx_cases(spark, sf_dir))


def _raw_catalog(spark: SparkSession, sf_dir: str, *hints: str) -> DataFrame:
    return fx_cases(spark, sf_dir, *hints).drop("id").withColumnRenamed("case_id", "id")


def display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.display_rows(_raw_catalog(spark, sf_dir))


def map_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.map_points(_raw_catalog(spark, sf_dir))


def search_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search_links(_raw_catalog(spark, sf_dir))


def search_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search_cases(_raw_catalog(spark, sf_dir), "sRc1").select("id", "title", "location")


def search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that grow with the table, looked up in an index: parts of ids, and short, empty and unknown ones."""
    target = scratch(spark, "search")
    search_index.write_index(_raw_catalog(spark, sf_dir, "merge"), target)  # few columns move, and no labels to the driver
    docs = table(spark, sf_dir, "documents").where("doc_id % 7 = 0").select(F.concat(F.lit("p-"), F.col("doc_id").cast("string")).alias("term"))
    more = spark.createDataFrame([("sRc1",), ("_d1",), ("zz",), ("",), ("no such term",), ("7_",)], "term string")
    found = search_index.search_many(spark, target, docs.unionByName(more))
    return found.groupBy("term").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.with_status(fx_cases(spark, sf_dir), C.RESOLVED).select("case_id", "status")


def first_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.first_case(catalog.catalog_rows(fx_cases(spark, sf_dir))).select("id", "title")


def stats_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.case_stats(fx_cases(spark, sf_dir))


def stats_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.case_stats_view(catalog.catalog_rows(fx_cases(spark, sf_dir)))


def stats_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the cases with a status that no case has."""
    return catalog.case_stats(catalog.with_status(fx_cases(spark, sf_dir), "no such status"))


def export_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported JSON lines, read back."""
    path = scratch(spark, "catalog")
    sources.export_catalog_json(fx_cases(spark, sf_dir), path)
    back = spark.read.schema("id string, title string, date string, location string, status string, latitude double, longitude double, source_url string").json(path)
    return back.select("id", "title", "date", "location", "status", "latitude", "longitude", "source_url")


def append_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows taken and rejected by the sink, after two runs with the same rows, and one of them again."""
    rows = fx_cases(spark, sf_dir).withColumn("case_id", F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.concat(F.lit("c"), (F.col("id") % 700).cast("string"))))
    target = scratch(spark, "cases")
    sources.append_cases(rows, target, "first run")
    sources.append_cases(rows.where("case_id is not null"), target, "second run")
    sources.append_cases(rows, target, "first run")
    taken = sources.read_cases(spark, target).select("id", "case_id", F.lit("stored").alias("result"))
    return taken.unionByName(sources.read_rejected(spark, target).select("id", "case_id", F.lit("rejected").alias("result")))


def append_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case store after four runs, a compaction, a run that stores ids again, one done again, and files cleared away."""
    rows = fx_cases(spark, sf_dir).withColumn("case_id", F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.col("case_id")))
    target = scratch(spark, "cases")
    for i in range(4):
        sources.append_cases(rows.where(F.col("id") % 5 == i), target, f"run {i}")
    sources.compact_cases(spark, target)
    sources.append_cases(rows.where("case_id is not null"), target, "run 4")
    sources.append_cases(rows, target, "run 0")
    Log(spark, target).vacuum(0)
    taken = sources.read_cases(spark, target).select("id", "case_id", "title", F.lit("stored").alias("result"))
    return taken.unionByName(sources.read_rejected(spark, target).select("id", "case_id", "title", F.lit("rejected").alias("result")))


def reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of the case table after it was filled, emptied, and filled with every third case."""
    cases, target = fx_cases(spark, sf_dir), scratch(spark, "cases")
    sources.append_cases(cases, target)
    sources.reset_cases(spark, target)
    sources.append_cases(cases.where("id % 3 = 0"), target)
    return sources.read_cases(spark, target).select("id", "case_id")


def seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds an emptied case table, and leaves the full one as it is."""
    cases, rows = fx_cases(spark, sf_dir), sources.seed_cases(spark)
    first = sources.seed_if_empty(cases.where("id < 0"), rows).select(F.lit("empty").alias("was"), "case_id", "title")
    return first.unionByName(sources.seed_if_empty(cases, rows).select(F.lit("full").alias("was"), "case_id", "title"))


def llm_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = with_kind(fx_cases(spark, sf_dir))
    both = [answers.build_requests(cases, p).withColumn("profile", F.lit(p)) for p in ("batch", "engine")]
    return both[0].unionByName(both[1]).select("profile", "case_id", *digest("request"))


def llm_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = with_kind(fx_cases(spark, sf_dir))
    return answers.attach_answers(cases, answered(cases))


def llm_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx_files(spark, sf_dir).select("doc_id", fa.fallback_snippet(F.col("text")).alias("engine"), fa.fallback_snippet_batch(F.col("file_name")).alias("batch"))


def geotag(spark: SparkSession, sf_dir: str) -> DataFrame:
    gazetteer = spark.createDataFrame(list(PLACES), "name string, latitude double, longitude double")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("case_id"), "text")
    return places.geotag(docs, gazetteer)


def repair_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_fixed(repaired_ids(fx_cases(spark, sf_dir))).select("case_id", "title", "translation_snippet")


def repair_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(i, *r) for i, r in enumerate(C.REPAIR_RULES)], "priority int, pattern string, title string, translation_snippet string")
    return repair.repair_by_rules(repaired_ids(fx_cases(spark, sf_dir)), rules).select("case_id", "title", "translation_snippet")


def repair_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for every fifth document, so that the rules grow with the table; ids hold several patterns."""
    number = F.col("doc_id").cast("string")
    rules = table(spark, sf_dir, "documents").where("doc_id % 5 = 3").select((-F.length(number)).alias("priority"), F.concat(F.lit("P-"), number).alias("pattern"), F.concat(F.lit("rule "), number).alias("title"), number.alias("translation_snippet"))
    return repair.repair_by_rules(repaired_ids(fx_cases(spark, sf_dir)), rules).select("case_id", "title", *digest("translation_snippet"))


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fx_points(spark, sf_dir)
    updates = points.where("id % 3 = 0").withColumns({"vector": F.reverse("vector"), "seq": F.lit(1).cast("bigint")})
    return vectors.upsert_points(points, updates)


def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.get("vector", F.lit(0)).cast("double")
    return _upserted(spark, sf_dir).select("id", "seq", first.alias("first"), F.element_at("payload", "text").alias("text"), F.element_at("payload", "label").alias("label"))


def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same upsert in a stored table: a base, two deltas, a compaction, and a delta with writes that are too old."""
    points, target = fx_points(spark, sf_dir), scratch(spark, "points")
    updates = points.where("id % 3 = 0").withColumns({"vector": F.reverse("vector"), "seq": F.lit(1).cast("bigint")})
    point_store.write_points(points.where("id % 5 <> 0"), target)
    point_store.upsert(updates.where("id % 2 = 0"), target)
    point_store.upsert(points.where("id % 5 = 0").unionByName(updates.where("id % 2 = 1")), target)
    point_store.compact(spark, target)
    point_store.upsert(points.where("id % 3 = 0"), target)
    first = F.get("vector", F.lit(0)).cast("double")
    return point_store.read_points(spark, target).select("id", "seq", first.alias("first"), F.element_at("payload", "text").alias("text"), F.element_at("payload", "label").alias("label"))


def vector_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fx_points(spark, sf_dir).withColumn("vector", F.when(F.col("id") % 10 == 0, F.slice("vector", 1, 63)).otherwise(F.col("vector")))
    return vectors.check_collection(points, 64).select("id", F.size("vector").alias("dim"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fx_points(spark, sf_dir)
    query = points.where("id = 0").select("vector").first()[0]
    return vectors.search_similar(points, query).select("id", F.round("score", 6).alias("score"), F.element_at("payload", "text").alias("text"))


def _knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fx_points(spark, sf_dir)
    return vectors.knn_join(points, points.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"))


def vector_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def vector_index_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search in clusters."""
    points = fx_points(spark, sf_dir)
    hits = vector_index.ClusterIndex(points).search(points.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"))
    return hits.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def vector_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.hits_with_cases(_knn(spark, sf_dir), fx_cases(spark, sf_dir)).select("query_id", "rank", "id", "case_id", "title")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.extract_links(fx_crawl(spark, sf_dir))


def media_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.media_links(crawl.extract_links(fx_crawl(spark, sf_dir)))


def _downloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where("page_id % 4 = 0").select(F.concat(F.col("page_id").cast("string"), F.lit(".PDF")).alias("file_name"))


def new_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl_plan.to_download(fx_crawl(spark, sf_dir), _downloaded(spark, sf_dir))


def fetch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, error = F.col("http_status"), F.col("error")
    return fx_crawl(spark, sf_dir).select("page_id", fl.fetch_status(status, error).alias("status"), fl.fetch_message(status, error).alias("message"))


def crawl_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = new_downloads(spark, sf_dir)
    return crawl.crawl_report(new.withColumn("status", F.when(F.col("page_id") % 3 == 0, "error").otherwise("success")))


def frames_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.sample_frames(fx_frames(spark, sf_dir)).select("video_id", "event_id", "frame_no", "frame_name")


def frame_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.frame_report(fx_frames(spark, sf_dir))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("altitude_ft"), (F.col("l_discount") * 360).alias("azimuth"), F.col("l_quantity").cast("double").alias("speed_kn"))
    return media.hud_parallax(rows).drop("altitude_ft", "azimuth", "speed_kn")


def route_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1 over the whole queue, drained into a table."""
    target = scratch(spark, "routed")
    routed = streams.route_stream(task_stream(spark, sf_dir))
    routed.writeStream.option("checkpointLocation", scratch(spark, "routed-state")).trigger(availableNow=True).format("parquet").start(target).awaitTermination()
    return spark.read.parquet(target).groupBy("source_url", "route").agg(F.count("*").alias("n"))


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch(spark, "tasks")
    streams.ingest_stream(task_stream(spark, sf_dir), target, scratch(spark, "tasks-state")).awaitTermination()
    return streams.read_store(spark, target)


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3: the whole tasks that pass, each case's first."""
    target = scratch(spark, "deduped")
    passed = dedupe.dedupe_stream(task_stream(spark, sf_dir), "10000 days")
    passed.writeStream.option("checkpointLocation", scratch(spark, "deduped-state")).trigger(availableNow=True).format("parquet").start(target).awaitTermination()
    return spark.read.parquet(target).select("case_id", "source_url", "enqueued_at")


def list_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1: the documents' texts are put into a folder for each language, as lines of text files, and the files listed."""
    target = scratch(spark, "incoming")
    spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).write.partitionBy("lang").text(target)
    listed = sources.list_incoming(spark, target, recursive=True).withColumn("lang", F.regexp_extract("path", "/lang=([^/]*)/", 1))
    return listed.groupBy("lang").agg(F.sum("length").alias("n_bytes"), F.bool_and(F.col("file_name").endswith(".txt")).alias("all_texts"))


def _ingested(spark: SparkSession, sf_dir: str, profile: ingest_plan.Profile) -> DataFrame:
    return ingest_plan.ingest(fx_files(spark, sf_dir).select("file_name"), fx_pages(spark, sf_dir), fx_existing(spark, sf_dir), profile)


def ingest_job(profile: ingest_plan.Profile) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _ingested(spark, sf_dir, profile)
        return rows.select("case_id", "title", "date", "location", "latitude", "longitude", "status", "translation_snippet", *digest("original_text"), "source_url")

    return query


def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: ingest the files, put the new rows to the stored ones, and count."""
    new = _ingested(spark, sf_dir, ingest_plan.ENGINE)
    return catalog.case_stats(fx_cases(spark, sf_dir).select(*new.columns).unionByName(new))


def queries() -> dict[str, Query]:
    plain = (
        case_ids, supported_files, existing_skip, existing_stored, first_wins, append_new, ingest_report, ingest_observed, cap_text, year_date, display, map_points,
        search_url, search_cases, search_many, status_filter, first_case, stats_server, stats_view, stats_empty, export_catalog, append_cases, append_compacted, reset, seed,
        llm_requests, llm_answers, llm_fallback, geotag, repair_fixed, repair_table, repair_many, vector_upsert, vector_store, vector_check, vector_topk, vector_knn, vector_index_knn,
        vector_hits, links, media_links, new_downloads, fetch_status, crawl_report, frames_sampled, frame_report, telemetry, route_tasks,
        stream_ingest, stream_dedupe, list_incoming, ingest_stats,
    )
    out: dict[str, Query] = {f.__name__: f for f in plain}
    return out | {
        "catalog": catalog_rows,
        "assemble_all": assemble("\n", None, True),
        "assemble_first5": assemble("\n", C.ENGINE_PAGES, True),
        "assemble_plain": assemble("", None, False),
        "ingest_batch": ingest_job(ingest_plan.BATCH),
        "ingest_engine": ingest_job(ingest_plan.ENGINE),
    }
