"""Reading and writing the case table, listings and exports."""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators.catalog import catalog_rows
from ..operators.ingest import first_per_key, is_valid, skip_existing
from ..schema import CASE_COLUMNS, CASE_SCHEMA
from .commits import Log, touched

_LISTING = "path string, file_name string, length bigint, modificationTime timestamp"


def list_incoming(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Files directly in a folder, or in it and all folders below, without their contents; a missing folder is empty.

    Spark leaves out names that start with ``_`` or ``.`` and files without content.
    """
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LISTING)
    return files.select("path", F.substring_index("path", "/", -1).alias("file_name"), "length", "modificationTime")


def read_cases(spark: SparkSession, path: str | None = None, jdbc: dict | None = None, parts: int = 64) -> DataFrame:
    """The case table from its commits, from a plain Parquet folder, or from a database by JDBC options (with ``dbtable``)."""
    if jdbc:
        rows = _by_ranges(spark, jdbc, parts).load()
        named = {c.lower(): c for c in rows.columns}  # some databases fold names to capitals
        return rows.select(*[F.col(named[f.name]).cast(f.dataType).alias(f.name) for f in CASE_SCHEMA])
    log = Log(spark, path)
    return log.read("cases", CASE_SCHEMA) if log.commits() else spark.read.schema(CASE_SCHEMA).parquet(path)


def _by_ranges(spark: SparkSession, jdbc: dict, parts: int) -> DataFrameReader:
    """A reader by ranges of the id, one query for each; the database is asked for the bounds unless they are given.

    Options of a partitioned read, if the caller gives them, stay as they are. An empty table is one part.
    """
    options = {k: str(v) for k, v in jdbc.items()}
    if "dbtable" in options and not any(k.lower() == "partitioncolumn" for k in options):
        ask = {k: v for k, v in options.items() if k != "dbtable"} | {"query": f"SELECT MIN(id) AS low, MAX(id) AS high FROM {options['dbtable']}"}
        low, high = spark.read.format("jdbc").options(**ask).load().first()
        if low is not None:
            options |= {"partitionColumn": "id", "lowerBound": str(low), "upperBound": str(int(high) + 1), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**options)


def split_valid(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = is_valid(F.col("case_id"))
    return cases.where(good), cases.where(~F.coalesce(good, F.lit(False)))


def append_cases(cases: DataFrame, target: str, run: str | None = None) -> bool:
    """Adds the rows that the table takes and, as rejected, those that it does not, in one commit: both or neither are seen.

    Rows without an id are rejected before the first of each id is chosen, so a bad row never hides a good one. Ids that
    are stored are skipped; only files that may hold one of the new ids are read for that. A run that is committed already
    changes nothing, and a failed one can be done again under its name. Says whether it committed.
    """
    good, bad = split_valid(cases)
    new = first_per_key(good.withColumn("order", F.coalesce("id", F.lit(0))), "case_id", "order").select(*CASE_COLUMNS)
    log = Log(cases.sparkSession, target)

    def make(commits: list[dict]) -> tuple[dict, bool]:
        found = [] if commits else log.plain_files()  # a table made without commits is taken over
        files = touched(log, new, "case_id", found or log.files("cases", commits))
        fresh = skip_existing(new, log.read("cases", CASE_SCHEMA, files)) if files else new
        return {"cases": found + log.write(fresh, "case_id"), "rejected": log.write(bad.select(*CASE_COLUMNS))}, False

    return log.update(run or uuid.uuid4().hex, make)


def read_rejected(spark: SparkSession, target: str) -> DataFrame:
    """The rows that the case table did not take."""
    return Log(spark, target).read("rejected", CASE_SCHEMA)


def reset_cases(spark: SparkSession, target: str) -> None:
    """Empties the table and its rejected rows; a table that is not there yet becomes an empty one."""
    Log(spark, target).update(uuid.uuid4().hex, lambda _: ({}, True))


def compact_cases(spark: SparkSession, target: str, run: str | None = None) -> bool:
    """Puts small files of the stored cases together by ranges of the id, so that later runs read fewer of them."""
    return Log(spark, target).compact("cases", CASE_SCHEMA, "case_id", run)


def seed_cases(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, c, title, date, place, lat, lon, C.UNRESOLVED, snippet, text, C.PORTAL) for i, (c, title, date, place, lat, lon, snippet, text) in enumerate(C.SEED_CASES)]
    return spark.createDataFrame(rows, CASE_SCHEMA)


def seed_if_empty(existing: DataFrame, seed: DataFrame) -> DataFrame:
    """The table itself, or the seed rows if it has no row at all."""
    return existing.unionByName(seed) if existing.isEmpty() else existing


def export_catalog_json(cases: DataFrame, path: str) -> None:
    """The catalogue as JSON lines with fixed key order; null keys stay."""
    catalog_rows(cases).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def catalog_json(cases: DataFrame) -> DataFrame:
    return catalog_rows(cases).select("id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
