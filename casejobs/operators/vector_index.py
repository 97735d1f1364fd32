"""Exact cosine search among clusters of unit vectors, most of which the triangle inequality rules out.

Each vector lies in the cluster of its nearest centre, and a cluster's radius is the greatest distance in it. A query's
distance to a centre less the radius is the least that it can have to a vector of the cluster: if that is more than the
distance of its k-th best so far, the cluster has none of its k best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..session import scratch
from .vectors import _best_of_units, _unit, rank_hits

#: Points that the centres are fitted on at most, picked by a hash; rounds of the fit; points of a cluster, about; and the
#: most clusters of one length of vectors.
SAMPLE_POINTS, ROUNDS = 20_000, 5
CLUSTER_POINTS, MAX_CLUSTERS = 256, 2048
#: Points of a block and queries that are sent together, at most about.
BLOCK, PACK = 4096, 512
#: For rounding.
SLACK = 1e-9
#: The cluster of points that no centre is fitted for, and of zero vectors; it is never ruled out.
REST = -1


def fit(sample: np.ndarray, n: int) -> np.ndarray:
    """About n centres of unit vectors, by some rounds of k-means."""
    centres = sample[:: max(1, len(sample) // max(1, n))][:n]
    for _ in range(ROUNDS):
        nearest = (sample @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, nearest, sample)
        count = np.bincount(nearest, minlength=len(centres))
        centres = total[count > 0] / count[count > 0, None]
    return centres


def _distances(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (vectors**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * (vectors @ centres.T)
    return np.sqrt(np.maximum(0.0, squares))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Rows of one length of vectors, and these as unit vectors."""
    sizes = np.asarray(batch.column("size"))
    for size in np.unique(sizes):
        part = batch.filter(pa.array(sizes == size))
        yield int(size), part, _unit(np.asarray(part.column("vector").flatten(), np.float64).reshape(len(part), size))


class ClusterIndex:
    """Points (id, vector) in blocks of their clusters, as a table in the shared folder.

    To the driver come the sample, and a count and a radius for each cluster of the centres fitted on it.
    """

    def __init__(self, points: DataFrame):
        self.spark = points.sparkSession
        rows = points.where("id IS NOT NULL AND vector IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("size"))
        n = max(1, rows.count())
        share = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 31)) < F.lit(round(min(1.0, SAMPLE_POINTS / n) * (1 << 31)))
        sample = rows.where(share).limit(2 * SAMPLE_POINTS).toArrow()
        self.centres: dict[int, np.ndarray] = {}
        for batch in sample.combine_chunks().to_batches():
            for size, part, unit in _matrices(batch):
                unit = unit[(unit != 0).any(axis=1)]
                if len(unit):
                    wanted = min(MAX_CLUSTERS, -(-n * len(part) // len(sample) // CLUSTER_POINTS))
                    self.centres[size] = fit(unit, wanted)
        path = scratch(self.spark, "clusters")
        self._placed(rows).write.parquet(f"{path}/placed")
        placed = self.spark.read.parquet(f"{path}/placed")
        self.sizes = placed.groupBy("size", "cluster").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"), F.max("distance").alias("radius"))
        self.radius = {size: np.full(len(c), -np.inf) for size, c in self.centres.items()}
        for r in self.sizes.where("cluster >= 0").collect():  # clusters of fitted centres
            self.radius[r["size"]][r["cluster"]] = r["radius"]
        self._packed(placed.join(self.sizes.select("size", "cluster", "blocks"), ["size", "cluster"])).write.parquet(f"{path}/blocks")
        self.blocks = self.spark.read.parquet(f"{path}/blocks")

    def _placed(self, rows: DataFrame) -> DataFrame:
        shared = self.spark.sparkContext.broadcast(self.centres)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for size, part, unit in _matrices(batch):
                    cluster, distance = np.full(len(part), REST, np.int32), np.zeros(len(part))
                    if size in shared.value:
                        all_ = _distances(unit, shared.value[size])
                        some = (unit != 0).any(axis=1)
                        cluster[some] = all_[some].argmin(axis=1)
                        distance[some] = all_[some].min(axis=1)
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("vector"), part.column("size"), pa.array(cluster), pa.array(distance)], ["id", "vector", "size", "cluster", "distance"])

        return rows.mapInArrow(place, "id bigint, vector array<double>, size int, cluster int, distance double")

    @staticmethod
    def _packed(placed: DataFrame) -> DataFrame:
        def pack(table: pa.Table) -> pa.Table:
            size = table.column("size")[0].as_py()
            unit = _unit(table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, size))
            keys = {c: table.column(c)[:1].combine_chunks() for c in ("size", "cluster", "block")}
            return pa.table(keys | {"ids": pa.array([table.column("id").to_numpy().tobytes()]), "vectors": pa.array([unit.tobytes()])})

        block = F.pmod(F.xxhash64("id", "vector", F.spark_partition_id()), F.col("blocks")).cast("int")
        rows = placed.withColumn("block", block).select("id", "vector", "size", "cluster", "block")
        return rows.groupBy("size", "cluster", "block").applyInArrow(pack, "size int, cluster int, block int, ids binary, vectors binary")

    def _asked(self, queries: DataFrame, home: bool) -> DataFrame:
        """Packs of the queries (query_id, vector, size and the least score that counts) for the clusters that they need; with
        ``home``, for the nearest one only."""
        shared = self.spark.sparkContext.broadcast((self.centres, self.radius))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, radius = shared.value
            for batch in batches:
                for at in range(0, len(batch), PACK):
                    for size, part, unit in _matrices(batch.slice(at, PACK)):
                        ids, least = np.asarray(part.column("query_id")), np.asarray(part.column("least"))
                        to: list[tuple[int, np.ndarray]] = [] if home else [(REST, np.arange(len(ids)))]
                        if size in centres:
                            away = _distances(unit, centres[size])
                            if home:
                                nearest = np.where(np.isfinite(radius[size]), away, np.inf).argmin(axis=1)
                                to += [(c, np.flatnonzero(nearest == c)) for c in np.unique(nearest)]
                            else:  # a zero vector scores 0 with all
                                reach = np.where((unit != 0).any(axis=1), np.sqrt(np.maximum(0.0, 2 - 2 * least)), np.inf) + SLACK
                                needed = away - radius[size] <= reach[:, None]
                                to += [(c, np.flatnonzero(needed[:, c])) for c in np.flatnonzero(needed.any(axis=0))]
                        columns = [pa.array(np.full(len(to), size, np.int32)), pa.array([c for c, _ in to], pa.int32())]
                        yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x[i].tobytes() for _, i in to], pa.binary()) for x in (ids, unit))], ["size", "cluster", "q_ids", "q_vectors"])

        return queries.mapInArrow(send, "size int, cluster int, q_ids binary, q_vectors binary")

    def _hits(self, asked: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
        return rank_hits(_best_of_units(asked.join(blocks, ["size", "cluster", "block"]), k), k)

    def search(self, queries: DataFrame, k: int = C.TOP_K) -> DataFrame:
        """query_id, id, score and rank of each query's k best points (``queries``: query_id, vector), as ``knn_join`` has them.

        Queries without an id or a vector take no part; only vectors of equal length are compared; a zero vector's score is 0.
        """
        usable = queries.where("query_id IS NOT NULL AND vector IS NOT NULL")
        rows = usable.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("size"))
        first = self._asked(rows.withColumn("least", F.lit(-1.0)), True).withColumn("block", F.lit(0))
        bounds = self._hits(first, self.blocks.where("block = 0"), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
        bounded = rows.join(bounds, "query_id", "left").withColumn("least", F.coalesce("bound", F.lit(-1.0))).drop("bound")
        asked = self._asked(bounded, False).join(self.sizes.select("size", "cluster", "blocks"), ["size", "cluster"])
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        return self._hits(asked, self.blocks, k)
