"""The ingest job: files and page texts to new case rows, in two profiles."""

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.answers import fallback_snippet, fallback_snippet_batch, parse_answer
from ..functions.naming import case_id_batch, case_id_engine, case_title, case_title_batch, filled, media_kind
from ..functions.text import cap_text, detect_year_date
from ..operators.ingest import assemble_text, first_per_key, skip_existing, supported_files
from ..schema import CASE_COLUMNS, CASE_SCHEMA


@dataclass(frozen=True)
class Profile:
    """What tells the two ingest paths apart."""

    name: str
    case_id: Callable[[Column], Column]
    max_pages: int | None


BATCH = Profile("batch", case_id_batch, None)
ENGINE = Profile("engine", case_id_engine, C.ENGINE_PAGES)


def candidates(files: DataFrame, profile: Profile) -> DataFrame:
    """Files with case_id and kind; the engine profile drops other kinds first, so none can hide a supported file."""
    name = F.col("file_name")
    kept = supported_files(files) if profile is ENGINE else files.withColumn("kind", F.when(F.lower(name).endswith(".pdf"), "pdf").otherwise(F.coalesce(F.nullif(media_kind(name), F.lit("pdf")), F.lit("other"))))
    return kept.withColumn("case_id", profile.case_id(name))


def new_files(files: DataFrame, existing: DataFrame, profile: Profile) -> DataFrame:
    """One new file for each case id: the first by name among those whose id is not stored."""
    keys = candidates(files, profile).select("file_name", "kind", "case_id")
    return first_per_key(skip_existing(keys, existing), "case_id", "file_name")


def ingest(files: DataFrame, pages: DataFrame, existing: DataFrame, profile: Profile = ENGINE, answers: DataFrame | None = None) -> DataFrame:
    """New case rows, in the case schema.

    files: file_name. pages: file_name, page_no, text and, where extraction failed, error. answers: case_id, raw_json
    (plain text in the batch profile). Only the pages of new files move. Ids are hashes of the case id: dense numbers
    would need a global order, and case_id is the key.
    """
    new = new_files(files, existing, profile)
    pages = pages if "error" in pages.columns else pages.withColumn("error", F.lit(None).cast("string"))
    needed = pages.join(new.where("kind = 'pdf'").select("file_name"), "file_name", "left_semi")
    texts = assemble_text(needed.where("error is null"), "\n", profile.max_pages)
    errors = needed.groupBy("file_name").agg(F.min("error").alias("error"))
    rows = new.join(texts, "file_name", "left").join(errors, "file_name", "left")
    if answers is not None:
        rows = rows.join(answers.select("case_id", F.col("raw_json")), "case_id", "left")
    else:
        rows = rows.withColumn("raw_json", F.lit(None).cast("string"))
    return _batch_rows(rows) if profile is BATCH else _engine_rows(rows)


def ingest_observed(files: DataFrame, existing: DataFrame, write: Callable[[DataFrame], None], profile: Profile = ENGINE) -> DataFrame:
    """Writes the new files' keys (file_name, kind, case_id) by ``write`` and gives the report of this run, one row: total,
    stored and skipped, as ``ingest_report`` has them.

    The figures are counted on the rows that are written while they pass, so files and ids are read once.
    """
    total, usable, stored = (Observation(f"{name}-{uuid.uuid4().hex}") for name in ("total", "usable", "stored"))
    seen = files.observe(total, F.count(F.lit(1)).alias("n"))
    keys = candidates(seen, profile).select("file_name", "kind", "case_id").observe(usable, F.count(F.lit(1)).alias("n"))
    write(first_per_key(skip_existing(keys, existing), "case_id", "file_name").observe(stored, F.count(F.lit(1)).alias("n")))
    counts = [o.get["n"] for o in (total, usable, stored)]
    return files.sparkSession.createDataFrame([(counts[0], counts[2], counts[1] - counts[2])], "total bigint, stored bigint, skipped bigint")


def _cases(rows: DataFrame, **columns: Column) -> DataFrame:
    made = columns | {"id": F.xxhash64("case_id"), "status": F.lit(C.UNRESOLVED), "source_url": F.lit(C.PORTAL)}
    return rows.select(*[(F.col("case_id") if c == "case_id" else made[c]).cast(CASE_SCHEMA[c].dataType).alias(c) for c in CASE_COLUMNS])


def _batch_rows(rows: DataFrame) -> DataFrame:
    name = F.col("file_name")
    text = F.when(F.col("error").isNull(), F.col("text"))
    return _cases(
        rows, title=case_title_batch(name), date=F.lit(C.BATCH_DATE), location=F.lit(C.BATCH_LOCATION),
        latitude=F.lit(C.DEFAULT_LAT), longitude=F.lit(C.DEFAULT_LON),
        translation_snippet=F.coalesce("raw_json", fallback_snippet_batch(name)),
        original_text=cap_text(text, C.BATCH_TEXT_CHARS, filled(C.BATCH_TEXT, name)),
    )


def _engine_rows(rows: DataFrame) -> DataFrame:
    name, kind, failed = F.col("file_name"), F.col("kind"), F.col("error").isNotNull()
    pdf = (kind == "pdf") & ~failed
    full = F.when(pdf, F.coalesce("text", F.lit("")))
    stored = F.when(pdf, cap_text(full, C.ENGINE_TEXT_CHARS, F.lit(C.SCANNED_TEXT))).otherwise(filled(C.FILE_TEXT, name))
    asked = F.when(pdf & (full != ""), "pdf").when(pdf, "scanned").otherwise(kind)
    sent = F.when(asked == "pdf", stored).when(asked == "scanned", C.REQUEST_SCANNED).otherwise(C.REQUEST_MEDIA)
    rows = rows.withColumns({"answer": F.when(F.col("raw_json").isNotNull(), parse_answer(F.col("raw_json"), asked)), "stored": stored, "sent": sent})
    answered = F.col("raw_json").isNotNull() & ~failed
    snippet = F.when(failed, F.concat(F.lit(C.PARSE_ERROR), "error")).when(answered, F.col("answer.translation_snippet")).otherwise(fallback_snippet(F.col("sent")))
    return _cases(
        rows, title=case_title(name, kind), location=F.lit(C.ENGINE_LOCATION),
        date=F.when(pdf & (full != ""), detect_year_date(full, F.lit(C.ENGINE_DATE))).otherwise(C.ENGINE_DATE),
        latitude=F.when(answered, F.col("answer.latitude")).otherwise(C.DEFAULT_LAT),
        longitude=F.when(answered, F.col("answer.longitude")).otherwise(C.DEFAULT_LON),
        translation_snippet=snippet, original_text=F.col("stored"),
    )
