"""The catalogue: rows with defaults, display, map points, search, statistics."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.links import portal_search_url
from ..functions.text import number_or_default, or_default


def catalog_rows(cases: DataFrame) -> DataFrame:
    """Ten columns; null, empty and 0.0 get defaults, id and title do not."""
    col = F.col
    return cases.select(
        col("case_id").alias("id"), "title",
        or_default(col("date"), C.BATCH_DATE).alias("date"),
        or_default(col("location"), C.BATCH_LOCATION).alias("location"),
        or_default(col("status"), C.UNRESOLVED).alias("status"),
        or_default(col("translation_snippet"), C.DEFAULT_SNIPPET).alias("translation_snippet"),
        or_default(col("original_text"), C.DEFAULT_TEXT).alias("original_text"),
        number_or_default(col("latitude"), C.DEFAULT_LAT).alias("latitude"),
        number_or_default(col("longitude"), C.DEFAULT_LON).alias("longitude"),
        or_default(col("source_url"), C.PORTAL).alias("source_url"),
    )


def display_rows(catalog: DataFrame) -> DataFrame:
    """What a list and a detail view print."""
    return catalog.select(
        or_default(F.col("id"), "N/A").alias("id"), "title",
        or_default(F.col("status"), "Unknown").alias("status"),
        F.when(F.col("status") == C.RESOLVED, "resolved").otherwise("open").alias("badge"),
        or_default(F.col("original_text"), C.NO_ORIGINAL).alias("original_text"),
        or_default(F.col("translation_snippet"), C.NO_ANALYSIS).alias("translation_snippet"),
    )


def map_points(catalog: DataFrame) -> DataFrame:
    """Rows whose coordinates are both there: not null, not 0 and not NaN. Null texts print as blanks."""
    there = lambda c: F.col(c).isNotNull() & (F.col(c) != 0.0) & ~F.isnan(c)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    popup = F.concat(F.lit("<b>"), text("id"), F.lit("</b><br/>"), text("title"), F.lit("<br/>📍 "), text("location"))
    return catalog.where(there("latitude") & there("longitude")).select("id", "latitude", "longitude", popup.alias("popup"))


def search_links(catalog: DataFrame) -> DataFrame:
    return catalog.select("id", portal_search_url(F.col("title"), F.col("date")).alias("url"))


def search_cases(catalog: DataFrame, term: str) -> DataFrame:
    """Rows whose id, title or location holds the term in any case; an empty term keeps rows that have any of them."""
    wanted = F.lower(F.lit(term))
    hit = lambda c: F.coalesce(F.lower(F.col(c)).contains(wanted) & (F.col(c) != ""), F.lit(False))
    return catalog.where(hit("id") | hit("title") | hit("location"))


def with_status(cases: DataFrame, status: str) -> DataFrame:
    return cases.where(F.col("status") == status)


def first_case(catalog: DataFrame) -> DataFrame:
    """The row that is selected first; the order, by id, is ours."""
    return catalog.orderBy("id").limit(1)


def case_stats(cases: DataFrame) -> DataFrame:
    """Server rule, over raw rows: what is not unresolved counts as resolved. An empty table has fixed figures."""
    counted = cases.agg(F.count("*").alias("total"), F.count_if(F.col("status") == C.UNRESOLVED).alias("open"))
    share = F.bround(F.col("open") / F.col("total") * 100, 1)
    total, resolved, unresolved, percent, rest = C.EMPTY_STATS
    empty = F.col("total") == 0
    return counted.select(
        F.when(empty, total).otherwise(F.col("total")).cast("bigint").alias("total_cases"),
        F.when(empty, resolved).otherwise(F.col("total") - F.col("open")).cast("bigint").alias("resolved_cases"),
        F.when(empty, unresolved).otherwise(F.col("open")).cast("bigint").alias("unresolved_cases"),
        F.when(empty, percent).otherwise(share).alias("unresolved_percentage"),
        F.when(empty, rest).otherwise(F.bround(100 - share, 1)).alias("resolved_percentage"),
    )


def case_stats_view(catalog: DataFrame) -> DataFrame:
    """Dashboard rule, over defaulted rows: what is not resolved counts as unresolved."""
    counted = catalog.agg(F.count("*").alias("total_cases"), F.count_if(F.col("status") == C.RESOLVED).alias("resolved_cases"))
    unresolved = F.col("total_cases") - F.col("resolved_cases")
    percent = F.when(F.col("total_cases") > 0, F.round(unresolved / F.col("total_cases") * 100, 1)).otherwise(0.0)
    return counted.select("total_cases", "resolved_cases", unresolved.alias("unresolved_cases"), percent.alias("unresolved_percentage"), F.round(100 - percent, 1).alias("resolved_percentage"))
