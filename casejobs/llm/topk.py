"""Exact top-k search by a three-phase uniform threshold.

A vector is cut into slices of its dimensions; a score is the sum of its slices' scores, and each slice of each block of
candidates is a list of its own, in a row and a task of its own. Phase 1 gathers from every list the best entries of each
query by their score in that slice; the k-th best of these entries' whole scores is a safe cutoff. Phase 2 sends each
query's cutoff to all lists, which collect the entries with a slice score of at least cutoff / slices: an entry below that
in all slices cannot reach the cutoff. Phase 3 resolves the whole scores of the collected entries, and of no others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import released
from .durable import checkpointed

#: Few slices keep the threshold of a slice high: by chance, two slices of a common length collect some hundredths of all
#: entries, four a fifth.
SLICES = 2
#: Vectors in a block, about.
CANDIDATE_BLOCK = 16_384
QUERY_BLOCK = 1024
#: Queries whose scores a task holds at once, and entries that it resolves at once.
STEP = 128
ENTRIES = 100_000
_LOW = np.iinfo(np.int64).min


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and size of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("size"))


def _needed(ids: np.ndarray, whole: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that can be among a query's k best: of equal vectors those with the least ids.

    At most k of one id, and of these 2 k, so that k are left whichever id is the query's own.
    """
    order = np.lexsort((ids, *whole.T[::-1]))
    new = np.ones(len(order), bool)
    new[1:] = (whole[order][1:] != whole[order][:-1]).any(axis=1)
    new_id = new.copy()
    new_id[1:] |= ids[order][1:] != ids[order][:-1]

    def place(begins: np.ndarray) -> np.ndarray:
        begin = np.flatnonzero(begins)
        return np.arange(len(begins)) - np.repeat(begin, np.diff(np.append(begin, len(begins))))

    few = place(new_id) < k
    vector = np.cumsum(new)[few]
    return order[few][place(np.append(True, vector[1:] != vector[:-1])[: len(vector)]) < 2 * k]


def _pack(rows: DataFrame, block: str, k: int | None = None) -> DataFrame:
    """One row for each block and length: ids, cutoffs and the slices of floor(64 * x), as bytes of the narrowest integers.

    With ``k``, rows that cannot be among any query's k best are left out.
    """

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        size = table.column("size")[0].as_py()
        whole = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), size)
        whole = np.floor(64.0 * whole).astype(np.int64)
        cutoff = table.column("cutoff").fill_null(_LOW).to_numpy()
        if k is not None:
            stays = _needed(ids, whole, k)
            ids, whole, cutoff = ids[stays], whole[stays], cutoff[stays]
        low, high = whole.min(initial=0), whole.max(initial=0)
        kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
        parts = [np.ascontiguousarray(x).astype(kind).tobytes() for x in np.array_split(whole, SLICES, axis=1)]
        return pa.table({block: table.column(block)[:1], "size": pa.array([size], pa.int32()), "width": pa.array([np.dtype(kind).itemsize], pa.int32()), "ids": pa.array([ids.tobytes()]), "cutoffs": pa.array([cutoff.tobytes()]), "parts": pa.array([parts], pa.list_(pa.binary()))})

    return rows.groupBy(block, "size").applyInArrow(pack, f"{block} int, size int, width int, ids binary, cutoffs binary, parts array<binary>")


def _units(candidates: DataFrame, queries: DataFrame, n_candidates: int, n_queries: int, by_slice: bool) -> DataFrame:
    """Each pair of a candidate block and a query block, or of their slices, as one row: a stated query set, in blocks."""
    left = candidates.select("c", "size", "width", "ids", "parts").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    right = queries.select("q", "size", *(F.col(x).alias(f"q_{x}") for x in ("width", "ids", "cutoffs", "parts"))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_candidates - 1))))
    on = ["c", "q", "size"]
    if by_slice:
        n = (F.octet_length("ids") / 8).cast("int").alias("n")
        left = left.select("c", "q", "size", "width", n, F.posexplode("parts").alias("slice", "part"))
        right = right.select("c", "q", "size", "q_width", "q_ids", "q_cutoffs", F.posexplode("q_parts").alias("slice", "q_part"))
        on = [*on, "slice"]
    return left.join(right, on)


def _matrix(data: bytes, width: int, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{width}").reshape(n, -1) if data else np.zeros((n, 0), np.int8)


def _exact(a: np.ndarray, b: np.ndarray) -> type:
    """The narrowest type in which every sum of products of the rows of a and b is exact."""
    most = max(abs(int(a.min(initial=0))), int(a.max(initial=0))) * max(abs(int(b.min(initial=0))), int(b.max(initial=0))) * max(1, a.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def _slice_scores(row: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Scores (some queries, all candidates) of a row's slice, and these queries' cutoffs."""
    cutoffs = np.frombuffer(row["q_cutoffs"], np.int64)
    q = _matrix(row["q_part"], row["q_width"], len(cutoffs))
    c = _matrix(row["part"], row["width"], row["n"])
    kind = _exact(q, c)
    q, c = q.astype(kind), np.ascontiguousarray(c.T.astype(kind))
    for i in range(0, len(q), STEP):
        yield q[i : i + STEP] @ c, cutoffs[i : i + STEP]


_LISTS = "c int, q int, size int, slice int, counts binary, places binary"


def _lists(units: DataFrame, choose) -> DataFrame:
    """Of each slice of each unit, how many entries each query has, and their places, as ``choose`` picks them."""

    @released
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts, places = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
                for scores, cutoffs in _slice_scores(row):
                    q, c = choose(scores, cutoffs)
                    counts.append(np.bincount(q, minlength=len(scores)).astype(np.int32))
                    places.append(c.astype(np.int32))
                columns = [pa.array([row[x]], pa.int32()) for x in ("c", "q", "size", "slice")]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in (counts, places))], ["c", "q", "size", "slice", "counts", "places"])

    return units.mapInArrow(work, _LISTS)


def local_lists(units: DataFrame, k: int) -> DataFrame:
    """Phase 1: the k + 1 best entries of each query by the slice's score (one may be the query itself)."""

    def best(scores: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, n = scores.shape
        own = min(k + 1, n)
        places = np.argpartition(-scores, own - 1, axis=1)[:, :own] if own < n else np.tile(np.arange(n), (rows, 1))
        return np.repeat(np.arange(rows), own), places.ravel()

    return _lists(units, best)


def sufficient_entries(units: DataFrame) -> DataFrame:
    """Phase 2: the entries of each query whose slice score reaches the query's cutoff / slices."""

    def enough(scores: np.ndarray, cutoffs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = -(-np.maximum(cutoffs, _LOW // 2) // SLICES)[:, None]
        if np.issubdtype(scores.dtype, np.floating):
            least = np.nextafter(least.astype(scores.dtype), -np.inf)  # rounding must not lose an entry
        return np.nonzero(scores >= least)

    return _lists(units, enough)


def resolved(units: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """Whole scores of the listed entries that reach their query's cutoff, of each unit the k best: query_id, vec_id, score.

    ``n_resolved`` is the number of entries of the unit whose whole score was made.
    """

    @released
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, q_ids, cutoffs = (np.frombuffer(row[c], np.int64) for c in ("ids", "q_ids", "q_cutoffs"))
                a, b = (np.concatenate([_matrix(x, row[w], n) for x in row[p]], axis=1) for p, w, n in (("q_parts", "q_width", len(q_ids)), ("parts", "width", len(ids))))
                kind = _exact(a, b)
                ends = [np.concatenate([[0], np.cumsum(np.frombuffer(x["counts"], np.int32), dtype=np.int64)]) for x in row["lists"]]
                places = [np.frombuffer(x["places"], np.int32) for x in row["lists"]]
                for i in range(0, len(q_ids), STEP):
                    j = min(i + STEP, len(q_ids))
                    key = np.unique(np.concatenate([np.repeat(np.arange(i, j), np.diff(e[i : j + 1])) * len(ids) + p[e[i] : e[j]] for e, p in zip(ends, places)]))
                    kept = []
                    for at in range(0, len(key), ENTRIES):
                        q, c = np.divmod(key[at : at + ENTRIES], len(ids))
                        total = np.einsum("ij,ij->i", a[q].astype(kind), b[c].astype(kind)).astype(np.int64)
                        good = (total >= cutoffs[q]) & (ids[c] != q_ids[q])
                        kept.append((q[good], c[good], total[good]))
                    q, c, total = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*kept) if kept else ((), (), ())))
                    order = np.lexsort((ids[c], -total, q))
                    q, c, total = q[order], c[order], total[order]
                    top = np.arange(len(q)) - np.searchsorted(q, q) < k
                    n = np.full(int(top.sum()), len(key))
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[q[top]]), pa.array(ids[c[top]]), pa.array(total[top]), pa.array(n)], ["query_id", "vec_id", "score", "n_resolved"])

    one = lists.groupBy("c", "q", "size").agg(F.collect_list(F.struct("counts", "places")).alias("lists"))
    return units.join(one, ["c", "q", "size"]).mapInArrow(work, "query_id bigint, vec_id bigint, score bigint, n_resolved bigint")


def safe_cutoffs(entries: DataFrame, k: int) -> DataFrame:
    """(query_id, cutoff): the k-th best score of the entries; null if there are fewer. Merged in two steps."""

    def best(scores: Column) -> Column:
        return F.slice(F.sort_array(scores, asc=False), 1, k)

    some = entries.groupBy("query_id", (F.spark_partition_id() % 32).alias("part")).agg(best(F.collect_list("score")).alias("scores"))
    return some.groupBy("query_id").agg(best(F.flatten(F.collect_list("scores"))).alias("scores")).select("query_id", F.get("scores", F.lit(k - 1)).alias("cutoff"))


class Search:
    """The candidates and queries of one search, in blocks."""

    def __init__(self, vectors: DataFrame, is_query: Column, k: int):
        self.k, self.rows = k, usable(vectors).select("*", is_query.alias("asked"))
        n, n_queries = self.rows.agg(F.count("*"), F.count_if("asked")).first()
        self.c_blocks, self.q_blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
        none = F.lit(None).cast("bigint").alias("cutoff")
        self.candidates = checkpointed(_pack(self.rows.select("vec_id", "embedding", "size", self._block(self.c_blocks).alias("c"), none), "c", k))
        self.asked = self.rows.where("asked").select("vec_id", "embedding", "size", self._block(self.q_blocks).alias("q"))
        self.queries = _pack(self.asked.select("*", none), "q")

    @staticmethod
    def _block(blocks: int) -> Column:
        # rows of one id, or equal rows, may be a large part of the table: they are dealt by the part that they are read in, too
        return F.pmod(F.xxhash64("vec_id", "embedding", F.spark_partition_id()), F.lit(blocks)).cast("int")

    def units(self, by_slice: bool) -> DataFrame:
        return _units(self.candidates, self.queries, self.c_blocks, self.q_blocks, by_slice)

    def entries(self) -> DataFrame:
        """Each unit's best entries, by all three phases."""
        first = resolved(self.units(False), local_lists(self.units(True), self.k), self.k)
        cutoffs = checkpointed(safe_cutoffs(first, self.k))
        self.queries = _pack(self.asked.join(cutoffs.withColumnRenamed("query_id", "vec_id"), "vec_id", "left"), "q")
        return resolved(self.units(False), sufficient_entries(self.units(True)), self.k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """The k best candidates of each query by integer inner product of floor(64 * x), ties to the smaller id.

    Every usable row is a candidate but those with the query's own id; several rows with one id are as many candidates,
    and several queries with one id are ranked together. Rows take part if their id and vector are not null and all
    components are finite; only vectors of equal length are compared. Fewer than k candidates are all returned; an empty
    table gives no rows. Scores must fit a long. Other columns are left out.
    """
    entries = Search(vectors, is_query, k).entries()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return entries.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
