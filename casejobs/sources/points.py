"""The embedding table as a base and deltas, merged when it is read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vectors import latest_per_id
from .commits import Log, next_number

#: ``turn`` is the commit that wrote a row: of writes with one seq the later commit counts.
SCHEMA = "id bigint, vector array<float>, payload map<string,string>, seq bigint, turn bigint"
_COLUMNS = ["id", "vector", "payload", "seq"]
#: The ids of the deltas are broadcast up to this number (two longs each), and meet the base by a shuffle beyond.
MAX_BROADCAST_IDS = 1_000_000


def _sorted(points: DataFrame) -> DataFrame:
    return points.repartitionByRange("id").sortWithinPartitions("id")


def write_points(points: DataFrame, target: str, run: str | None = None) -> bool:
    """Makes the table anew: the latest of each id as a base sorted by id."""
    log = Log(points.sparkSession, target)
    rows = lambda commits: latest_per_id(points).select(*_COLUMNS, F.lit(next_number(commits)).cast("bigint").alias("turn"))
    return log.update(run or uuid.uuid4().hex, lambda commits: ({"base": log.write(_sorted(rows(commits)))}, True))


def upsert(updates: DataFrame, target: str, run: str | None = None) -> bool:
    """Adds updates as a delta; no row of the base or of earlier deltas is read or written."""
    log = Log(updates.sparkSession, target)
    rows = lambda commits: latest_per_id(updates).select(*_COLUMNS, F.lit(next_number(commits)).cast("bigint").alias("turn"))
    return log.update(run or uuid.uuid4().hex, lambda commits: ({"delta": log.write(rows(commits))}, False))


def read_points(spark: SparkSession, target: str) -> DataFrame:
    """id, vector, payload and seq of the last write of each id: the greatest seq, then the latest commit."""
    log = Log(spark, target)
    return _merged(log, log.commits())


def _merged(log: Log, commits: list[dict]) -> DataFrame:
    base = log.read("base", SCHEMA, log.files("base", commits))
    files = log.files("delta", commits)
    if not files:
        return base.select(*_COLUMNS)
    deltas = log.read("delta", SCHEMA, files)
    latest = deltas.groupBy("id").agg(F.max_by(F.struct(*_COLUMNS), F.struct("seq", "turn")).alias("row")).select("row.*")
    ids = latest.select("id", F.col("seq").alias("new_seq"))
    ids = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids
    kept = base.join(ids, "id", "left").where("new_seq IS NULL OR seq > new_seq")
    stale = kept.where("new_seq IS NOT NULL").select("id")
    return kept.select(*_COLUMNS).unionByName(latest.join(stale, "id", "left_anti").select(*_COLUMNS))


def compact(spark: SparkSession, target: str, run: str | None = None) -> bool:
    """Writes the merged table as the new base; readers see either the old files or the new ones."""
    log = Log(spark, target)

    def make(commits: list[dict]) -> tuple[dict, bool]:
        rows = _merged(log, commits).withColumn("turn", F.lit(next_number(commits)).cast("bigint"))
        return {"base": log.write(_sorted(rows))}, True

    return log.update(run or uuid.uuid4().hex, make)
