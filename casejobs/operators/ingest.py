"""Turning files into case rows: which files are new, their texts, the report."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import media_kind
from ..functions.text import strip


def supported_files(files: DataFrame) -> DataFrame:
    return files.withColumn("kind", media_kind(F.col("file_name"))).where(F.col("kind").isNotNull())


def skip_existing(candidates: DataFrame, cases: DataFrame) -> DataFrame:
    """Candidates whose case_id is not stored yet. Only keys move; Spark broadcasts them if they are small."""
    return candidates.join(cases.select("case_id"), "case_id", "left_anti")


def already_stored(candidates: DataFrame, cases: DataFrame) -> DataFrame:
    return candidates.join(cases.select("case_id"), "case_id", "left_semi")


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the first in order: a partial minimum in each task, so hot keys move one row a task."""
    rows = df.groupBy(key).agg(F.min_by(F.struct("*"), F.col(order)).alias("row"))
    return rows.select("row.*")


def append_new(cases: DataFrame, new: DataFrame) -> DataFrame:
    return cases.unionByName(new)


def first_pages(pages: DataFrame, n: int) -> DataFrame:
    return pages.where(F.col("page_no") <= n)


def assemble_text(pages: DataFrame, separator: str = "\n", max_pages: int | None = None, trim: bool = True, key: str = "file_name") -> DataFrame:
    """Pages of a file put together in their order; the page limit is applied before the shuffle."""
    used = pages if max_pages is None else first_pages(pages, max_pages)
    listed = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    joined = F.array_join(F.transform(listed, lambda x: F.coalesce(x["text"], F.lit(""))), separator)
    texts = used.groupBy(key).agg(joined.alias("text"))
    return texts.withColumn("text", strip(F.col("text"))) if trim else texts


def ingest_report(files: DataFrame, candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """One row: files in the folder, newly stored cases, files skipped because their id is stored (before or just now)."""
    stored = existing.select("case_id").distinct().withColumn("known", F.lit(True))
    marked = candidates.join(stored, "case_id", "left").groupBy("case_id").agg(F.count("*").alias("n"), F.max("known").alias("known"))
    new = F.count_if(F.col("known").isNull())
    counts = marked.agg(new.alias("stored"), (F.coalesce(F.sum("n"), F.lit(0)) - new).alias("skipped"))
    return files.agg(F.count("*").alias("total")).join(counts)


def is_valid(case_id: Column) -> Column:
    """Rows that the case table takes: those with an id."""
    return case_id.isNotNull() & (case_id != "")
