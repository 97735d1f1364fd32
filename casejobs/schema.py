"""Schemas of the tables that jobs exchange."""

from pyspark.sql import types as T

CASE_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType(), False)]
    + [T.StructField(c, T.StringType()) for c in ("case_id", "title", "date", "location")]
    + [T.StructField(c, T.DoubleType()) for c in ("latitude", "longitude")]
    + [T.StructField(c, T.StringType()) for c in ("status", "translation_snippet", "original_text", "source_url")]
)
CASE_COLUMNS = CASE_SCHEMA.fieldNames()
TASK_SCHEMA = "source_url string, case_id string, enqueued_at timestamp"
