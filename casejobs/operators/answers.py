"""Request and answer tables of the enrichment step."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.answers import fallback_snippet, parse_answer, request_batch, request_engine


def build_requests(cases: DataFrame, profile: str) -> DataFrame:
    """case_id and request of each row (case_id, file_name, kind, original_text)."""
    text = F.col("original_text")
    request = request_batch(text) if profile == "batch" else request_engine(F.col("file_name"), F.col("kind"), text)
    return cases.select("case_id", request.alias("request"))


def attach_answers(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Snippet and coordinates of each case; a case without an answer gets the fallback."""
    joined = cases.join(answers.select("case_id", "raw_json"), "case_id", "left")
    answer = F.when(F.col("raw_json").isNotNull(), parse_answer(F.col("raw_json"), F.col("kind")))
    rows = joined.withColumn("answer", answer)
    none = F.col("raw_json").isNull()
    return rows.select(
        "case_id",
        F.when(none, fallback_snippet(F.col("original_text"))).otherwise(F.col("answer.translation_snippet")).alias("translation_snippet"),
        F.when(none, C.DEFAULT_LAT).otherwise(F.col("answer.latitude")).alias("latitude"),
        F.when(none, C.DEFAULT_LON).otherwise(F.col("answer.longitude")).alias("longitude"),
    )
