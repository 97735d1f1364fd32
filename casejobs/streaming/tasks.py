"""The task queue as a stream: routing, deduplication in flight, idempotent storing."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.links import route_source
from ..operators.ingest import first_per_key, skip_existing
from ..sources.commits import Log, touched

STORED_SCHEMA = "case_id string, source_url string, route string, enqueued_at timestamp"
_TABLE = "tasks"


def route_stream(tasks: DataFrame) -> DataFrame:
    """Tasks (source_url, case_id, enqueued_at) with their route; stateless."""
    return tasks.withColumn("route", route_source(F.col("source_url")))


def store_batch(batch: DataFrame, target: str, run: str | None = None) -> bool:
    """Adds the first task of each case that is not stored yet, in one commit; says whether it committed.

    Only files whose key range and filter may hold a case of the batch are read. A run (as a stream's batch) that is
    committed already changes nothing, and of several writers that store a case at once one is first: the others find it.
    A task without a case_id is not stored.
    """
    tasks = batch.where("case_id IS NOT NULL").withColumn("order", F.struct("enqueued_at", "source_url"))
    new = first_per_key(tasks, "case_id", "order").select("case_id", "source_url", "route", "enqueued_at").persist()
    log = Log(batch.sparkSession, target)

    def make(commits: list[dict]) -> tuple[dict, bool]:
        files = touched(log, new, "case_id", log.files(_TABLE, commits))
        fresh = skip_existing(new, log.read(_TABLE, STORED_SCHEMA, files)) if files else new
        return {_TABLE: log.write(fresh.repartitionByRange("case_id"), "case_id")}, False

    try:
        return log.update(run or uuid.uuid4().hex, make)
    finally:
        new.unpersist()


def read_store(spark: SparkSession, target: str) -> DataFrame:
    """The stored tasks; none if nothing was ever stored."""
    return Log(spark, target).read(_TABLE, STORED_SCHEMA)


def compact_store(spark: SparkSession, target: str, run: str | None = None) -> bool:
    """Puts small files of the stored tasks together by ranges of the case; a stream that stores meanwhile goes on."""
    return Log(spark, target).compact(_TABLE, STORED_SCHEMA, "case_id", run)


def ingest_stream(tasks: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Stores each case once, also if several queries, each with its own checkpoint, write to one target. A batch that
    is done again after a failure has the name that it had before."""
    routed = route_stream(tasks)
    writer = routed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: store_batch(batch, target, f"{checkpoint}#{n}") and None)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
