"""Tables of Parquet files that are read as their commits say.

A commit is a small JSON file with the next number beside the data. It names the run that made it, the data files that it
adds to each table, and those that it takes away; files that no commit names are never read. A commit comes into being by one
rename to a name that must not be there yet: a run that fails before leaves nothing visible, the tables of one commit
appear together, and of several writers one is first while the others look again. The driver holds the names and key ranges
of the files, never their rows; the files' filters are tables beside the data and are looked through by Spark.

A commit that takes all earlier files away names all that stay and all earlier runs: readers start from the last such one.
``compact`` makes it and puts small files together by ranges of the key; ``vacuum`` deletes files that no commit needs.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A file's Bloom filter is in blocks of so many bits (as Spark's bitmap functions make them), with so many bits for each key;
#: a key's positions are all in one block.
BLOCK_BITS, BITS_A_KEY = 32_768, 10
_SHIFTS = (0, 20, 40)
#: Batches of so many keys at most are looked up in filters; a larger one would meet most files anyway and goes by ranges.
MAX_LOOKED_UP = 100_000
#: How often a writer that was not first looks again.
MAX_TRIES = 50
#: Rows of a file that compaction makes, about; files with less than half of them are put together.
FULL_ROWS = 1_000_000
#: Files of lost tries and dropped commits stay for so many seconds, since a reader or writer may be at work with them.
KEPT_SECONDS = 7 * 86_400


@dataclass
class DataFile:
    """A data file, the least and greatest of its keys, the folder of the table that has its filter, and its number of rows;
    without the first three it may hold any key."""

    path: str
    low: str | None = None
    high: str | None = None
    filters: str | None = None
    rows: int | None = None


def next_number(commits: list[dict]) -> int:
    """The number of the commit that comes after these."""
    return commits[-1]["number"] + 1 if commits else 1


class Log:
    """The commits of the tables below a folder, in any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._path = hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(self._conf)
        self._context = hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        self._no_options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def commits(self) -> list[dict]:
        """The commits in order, from the last on that names all files and runs before it; earlier ones are not read."""
        found: list[dict] = []
        for name in sorted(self._names("_commits", ".json"), reverse=True):
            found.append(json.loads(self._read(f"{self.folder}/_commits/{name}")) | {"number": int(name.removesuffix(".json"))})
            if "runs" in found[-1]:
                break
        return found[::-1]

    def _names(self, folder: str, end: str = "") -> list[str]:
        path = self._path(f"{self.folder}/{folder}" if folder else self.folder)
        return [n for s in (self._fs.listStatus(path) if self._fs.exists(path) else ()) if (n := s.getPath().getName()).endswith(end)]

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def files(self, table: str, commits: list[dict] | None = None) -> list[DataFile]:
        """The table's data files after these commits (all, by default), the oldest first."""
        held: dict[str, DataFile] = {}
        for commit in self.commits() if commits is None else commits:
            if commit["drops"]:
                held.clear()
            held |= {f["path"]: DataFile(**f) for f in commit["files"].get(table, [])}
        return list(held.values())

    def plain_files(self) -> list[DataFile]:
        """Parquet files directly in the folder, of a table that was made without commits."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder)) if s.isFile())
        return [DataFile(n) for n in names if n.endswith(".parquet")]

    def read(self, table: str, schema: str | StructType, files: list[DataFile] | None = None) -> DataFrame:
        """The rows of a table, or of some of its files."""
        files = self.files(table) if files is None else files
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{f.path}" for f in files))

    def write(self, rows: DataFrame, key: str | None = None) -> list[DataFile]:
        """Writes data files that no commit names yet; with a key, the range and the filter of each are made from what was
        written. A file without rows is left out then."""
        name, filters = (f"{kind}-{uuid.uuid4().hex}" for kind in ("data", "filters"))
        path = f"{self.folder}/{name}"
        rows.write.parquet(path)
        parts = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path)) if s.getPath().getName().startswith("part-"))
        if not key:
            return [DataFile(f"{name}/{p}") for p in parts]
        written = self.spark.read.schema(rows.schema).parquet(path).select(F.substring_index(F.input_file_name(), "/", -1).alias("file"), F.col(key).alias("key"))
        ranges = written.groupBy("file").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n")).collect()
        if ranges:
            blocks = self.spark.createDataFrame([(r.file, -(-r.n * BITS_A_KEY // BLOCK_BITS)) for r in ranges], "file string, blocks int")
            _filters(written, blocks).withColumn("file", F.concat(F.lit(f"{name}/"), "file")).write.parquet(f"{self.folder}/{filters}")
        return [DataFile(f"{name}/{r.file}", r.low, r.high, filters, r.n) for r in sorted(ranges)]

    def commit(self, number: int, run: str, files: dict[str, list[DataFile]], drops: list[str] | None = None) -> bool:
        """Makes the commit with this number, unless another writer has made it. ``drops``: all earlier files go, and these
        are all earlier runs, so nothing before this commit needs to be read."""
        body = {"run": run, "files": {t: [vars(f) for f in own] for t, own in files.items()}, "drops": drops is not None}
        body |= {} if drops is None else {"runs": drops}
        folder = self._path(f"{self.folder}/_commits")
        self._fs.mkdirs(folder)
        draft = self._path(f"{self.folder}/_commits/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(body).encode()))
        stream.close()
        try:
            self._context.rename(draft, self._path(f"{self.folder}/_commits/{number:012d}.json"), self._no_options)
        except Exception as e:  # Java's exceptions come wrapped
            if "FileAlreadyExists" not in str(e):
                raise
            self._fs.delete(draft, False)
            return False
        return True

    def update(self, run: str, make: Callable[[list[dict]], tuple[dict[str, list[DataFile]], bool]]) -> bool:
        """Commits what ``make`` writes, given the commits so far: the files, and whether earlier ones go.

        A run that is committed already changes nothing. A writer that was not first makes its files again, since those of
        the other may hold the same keys; the files of the lost try are never named.
        """
        for _ in range(MAX_TRIES):
            commits = self.commits()
            runs = [r for c in commits for r in (*c.get("runs", ()), c["run"])]
            if run in runs:
                return False
            files, drops = make(commits)
            if self.commit(next_number(commits), run, files, runs if drops else None):
                return True
        raise RuntimeError(f"other writers were first {MAX_TRIES} times")

    def compact(self, table: str, schema: str | StructType, key: str, run: str | None = None) -> bool:
        """Puts the table's small files together, sorted by ranges of the key, in one commit; says whether there were any.

        Large files, and the other tables, stay as they are, so a row is written again only while its file is small. The new
        files' ranges do not overlap. A writer that commits meanwhile is first, and this looks again.
        """

        def small(commits: list[dict]) -> list[DataFile]:
            return [f for f in self.files(table, commits) if f.rows is None or f.rows < FULL_ROWS // 2]

        def make(commits: list[dict]) -> tuple[dict[str, list[DataFile]], bool]:
            merged = small(commits)
            rows = self.read(table, schema, merged)
            n = sum(f.rows for f in merged) if all(f.rows is not None for f in merged) else rows.count()
            made = self.write(rows.repartitionByRange(-(-n // FULL_ROWS) or 1, key).sortWithinPartitions(key), key)
            paths = {f.path for f in merged}
            stay = {t: self.files(t, commits) for t in dict.fromkeys(t for c in commits for t in c["files"])}
            return stay | {table: [f for f in stay[table] if f.path not in paths] + made}, True

        return len(small(self.commits())) > 1 and self.update(run or uuid.uuid4().hex, make)

    def vacuum(self, kept_seconds: float = KEPT_SECONDS) -> int:
        """Deletes data and filter folders that nothing in the table needs and that are older; says how many.

        The age keeps files that a reader still reads or a writer is about to commit. Commits stay: a slow writer must not
        find its number free.
        """
        # listed before the commits are read: a folder committed in between is needed by what is read then
        found = [n for n in self._names("") if n.startswith(("data-", "filters-"))]
        commits = self.commits()
        files = [f for t in {t for c in commits for t in c["files"]} for f in self.files(t, commits)]
        needed = {f.path.split("/")[0] for f in files} | {f.filters for f in files}
        gone = [n for n in found if n not in needed and self._last_change(n) <= (time.time() - kept_seconds) * 1000]
        for name in gone:
            self._fs.delete(self._path(f"{self.folder}/{name}"), True)
        return len(gone)

    def _last_change(self, name: str) -> float:
        """When a file below the folder was last written, in milliseconds; folders themselves have no time in some stores. A
        folder without files may have a writer that begins: it counts as new."""
        files, times = self._fs.listFiles(self._path(f"{self.folder}/{name}"), True), []
        while files.hasNext():
            times.append(files.next().getModificationTime())
        return max(times, default=float("inf"))


def _hashes(key: Column) -> list[Column]:
    """What tells a key's block, and its positions there."""
    return [F.xxhash64(key, F.lit(0)).alias("h"), F.xxhash64(key, F.lit(1)).alias("g")]


def _filters(keys: DataFrame, blocks: DataFrame) -> DataFrame:
    """file, blocks, block and bits of the filters of the files' keys (file, key); partial bitmaps are put together."""
    placed = keys.join(F.broadcast(blocks), "file").select("file", "blocks", *_hashes(F.col("key")))  # a row a file
    positions = F.array(*(F.shiftrightunsigned("g", s).bitwiseAND(BLOCK_BITS - 1) for s in _SHIFTS))
    placed = placed.select("file", "blocks", F.pmod("h", "blocks").cast("int").alias("block"), F.explode(positions).alias("at"))
    return placed.groupBy("file", "blocks", "block").agg(F.bitmap_construct_agg("at").alias("bits"))


def touched(log: Log, keys: DataFrame, key: str, files: list[DataFile]) -> list[DataFile]:
    """The files that may hold one of these keys, by their ranges and filters, and by the filters' chance a few others."""
    keys = keys.select(F.col(key).alias("key")).where("key IS NOT NULL")
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("*")).first()
    files = [f for f in files if n and (f.low is None or (f.low <= high and low <= f.high))]
    filtered = {f.path for f in files if f.filters}
    if n > MAX_LOOKED_UP or not filtered:
        return files
    hashes = keys.select(*_hashes(F.col("key"))).toArrow()  # MAX_LOOKED_UP rows of two longs
    shared = log.spark.sparkContext.broadcast(tuple(c.to_numpy() for c in hashes.columns))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, g = shared.value
        at = [(g >> s) & (BLOCK_BITS - 1) for s in _SHIFTS]
        for batch in batches:
            hit = []
            for blocks, block, bits in zip(*(batch.column(c).to_pylist() for c in ("blocks", "block", "bits"))):
                own, held = h % blocks == block, np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
                hit.append(bool(np.logical_and.reduce([held[x[own]] for x in at]).any()))
            yield pa.RecordBatch.from_arrays([batch.column("file").filter(pa.array(hit, pa.bool_()))], ["file"])

    filters = log.spark.read.parquet(*(f"{log.folder}/{name}" for name in sorted({f.filters for f in files if f.filters})))
    found = {r.file for r in filters.mapInArrow(look, "file string").distinct().collect()}
    return [f for f in files if f.path in found or f.path not in filtered]
