"""Session helper and the shared folder."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "casejobs", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` has more settings with ``__`` for dots."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which all executors share; without that setting, only in a local session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="casejobs-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt out to all cores if they are read in fewer parts than that, as a small file is; else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    files = rows.inputFiles()
    return rows.repartition(cores) if len(files) < cores else rows
