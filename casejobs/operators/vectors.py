"""The embedding table: checks, upserts, exact cosine search."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C


def check_collection(points: DataFrame, dim: int = C.EMBED_DIM) -> DataFrame:
    """Points that the collection rejects: null or another length than ``dim``."""
    return points.where(F.col("vector").isNull() | (F.size("vector") != dim))


def payload(case_id: Column, text: Column, metadata: Column) -> Column:
    """map of case_id and text, overlaid by the metadata."""
    own = F.create_map(F.lit("case_id"), case_id.cast("string"), F.lit("text"), text)
    return F.map_concat(F.map_filter(own, lambda k, _: ~F.array_contains(F.map_keys(metadata), k)), metadata)


def latest_per_id(points: DataFrame) -> DataFrame:
    """The last write of each id; partial maxima, so a hot id moves one row a task."""
    return points.groupBy("id").agg(F.max_by(F.struct("*"), F.col("seq")).alias("row")).select("row.*")


def upsert_points(points: DataFrame, updates: DataFrame) -> DataFrame:
    return latest_per_id(points.unionByName(updates))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0.0 if one vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def search_similar(points: DataFrame, query: list[float], limit: int = C.TOP_K) -> DataFrame:
    """The ``limit`` best points for one vector, ties to the smaller id: each task keeps its best, no full sort."""
    score = cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query]))
    return points.select("id", score.alias("score"), "payload").orderBy(F.col("score").desc(), "id").limit(limit)


def rank_hits(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Vectors in a block of queries and in a block of points, about.
QUERY_BLOCK = 4096
POINT_BLOCK = 4096
#: Queries whose scores a task holds at once.
STEP = 256


def knn_join(points: DataFrame, queries: DataFrame, k: int = C.TOP_K) -> DataFrame:
    """query_id, id, score and rank of each query's k best points (``queries``: query_id, vector).

    Queries and points are packed into blocks, and each pair of blocks is one row, of which a task keeps the k best
    points of each query; only the two counts reach the driver. Rows without an id or a vector take no part; only
    vectors of equal length are compared.
    """
    points, queries = points.where("id IS NOT NULL AND vector IS NOT NULL"), queries.where("query_id IS NOT NULL AND vector IS NOT NULL")
    p_blocks, q_blocks = max(1, -(-points.count() // POINT_BLOCK)), max(1, -(-queries.count() // QUERY_BLOCK))
    left = _pack(points, "id", "p", p_blocks).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    right = _pack(queries, "query_id", "q", q_blocks).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(p_blocks - 1))))
    right = right.withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors"})
    return rank_hits(_best_of_units(left.join(right, ["p", "q", "size"]), k), k)


def _pack(rows: DataFrame, name: str, block: str, blocks: int) -> DataFrame:
    """One row for each block and length: ids and unit vectors as bytes."""

    def pack(table: pa.Table) -> pa.Table:
        size = table.column("size")[0].as_py()
        flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        unit = _unit(flat.astype(np.float64).reshape(table.num_rows, size))
        ids = table.column("id").to_numpy()
        return pa.table({block: table.column(block)[:1], "size": pa.array([size], pa.int32()), "ids": pa.array([ids.tobytes()]), "vectors": pa.array([unit.tobytes()])})

    number = F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int").alias(block)
    rows = rows.select(F.col(name).cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("size"), number)
    return rows.groupBy(block, "size").applyInArrow(pack, f"{block} int, size int, ids binary, vectors binary")


def _best_of_units(units: DataFrame, k: int) -> DataFrame:
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, query_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                p, q = (np.frombuffer(row[c], np.float64).reshape(-1 if row["size"] else len(i), row["size"]) for c, i in (("vectors", own), ("q_vectors", query_ids)))
                few = min(k, len(own))
                for i in range(0, len(query_ids), STEP):
                    scores = q[i : i + STEP] @ p.T
                    # all that reach the k-th best score; only these few are put in order
                    least = np.partition(scores, len(own) - few, axis=1)[:, len(own) - few]
                    r, c = np.nonzero(scores >= least[:, None])
                    order = np.lexsort((own[c], -scores[r, c], r))
                    r, c = r[order], c[order]
                    top = np.arange(len(r)) - np.searchsorted(r, r) < k
                    columns = query_ids[i + r[top]], own[c[top]], scores[r[top], c[top]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query_id", "id", "score"])

    return units.mapInArrow(best, "query_id bigint, id bigint, score double")


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def hits_with_cases(hits: DataFrame, cases: DataFrame) -> DataFrame:
    return hits.join(cases, "id")
