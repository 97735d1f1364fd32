"""Tables that are kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local session without that setting (as in tests) gets a folder of its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="casejobs-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


#: Rows of a file, about: of plain rows, and of rows with a text or what is made of it.
FILE_ROWS = 50_000
TEXT_ROWS = 10_000


def few_parts(df: DataFrame, rows: int, per_part: int = FILE_ROWS) -> DataFrame:
    """The table in no more parts than so many rows need, and than can run at once: a file for each of many tiny parts costs
    more than the rows in it. Nothing moves between tasks, and a large table stays as it is dealt."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_part)))


def checkpointed(df: DataFrame, rows: int | None = None, per_part: int = FILE_ROWS) -> DataFrame:
    """The table, computed once and written to the shared folder; a lost executor doesn't lose it.

    ``rows``: it has no more, so that a small table gets few files.
    """
    shared_folder(df.sparkSession)
    return (df if rows is None else few_parts(df, rows, per_part)).checkpoint()


def written(df: DataFrame, rows: int | None = None, per_part: int = FILE_ROWS) -> DataFrame:
    """As ``checkpointed``, as a compressed Parquet table in the same folder."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    (df if rows is None else few_parts(df, rows, per_part)).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Tables that are made inside pass no more than so many bytes at once to Python; for rows that hold whole texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)
