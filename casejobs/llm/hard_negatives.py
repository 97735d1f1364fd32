"""Hard negatives by windows of scores, in a multiway hyperplane tree (GNAT).

Vectors are floored to integers; a score is an inner product. With one more coordinate that makes all vectors as long as the
longest, a query's distance to a vector falls as the score rises, so a window of scores is an annulus of distances. A node
of the tree has some split points; a vector goes to the subtree of the nearest one, and for each split point the least
and greatest distance to the vectors of every sibling subtree are kept. A search goes down from the root: a subtree whose
range around any split point does not meet the range that the query's annulus has there is eliminated. What is left are
leaves, whose vectors are scored exactly.

The split points come from a bounded sample by a hash; all vectors are in the tree, and their ranges are of all vectors. A
leaf is cut into blocks, so one vector that a third of all rows have is spread over many. Each search has two steps: the
block that holds the anchor gives a first bound on its k-th best score, and that narrows the annulus for the tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import released
from .durable import checkpointed, written
from .sampling import hash_sample
from .topk import _exact

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LEAST_SHARE, MOST_SHARE = 30, 90
#: Split points of a node, and how many of the sample each is picked from.
BRANCHES, PICKED_FROM = 16, 4
#: Vectors that the tree is fitted on at most. A node with fewer of them than a few for each split point is a leaf.
SAMPLE_ROWS = 20_000
LEAST_SAMPLE = 2 * BRANCHES
#: Rows of a leaf that is not split further, rows of a block, and anchors that go down together.
LEAF_ROWS = 1024
BLOCK_ROWS = 4096
PACK = 512
#: Anchors whose scores a task holds at once.
STEP = 64
#: The numbers of blocks of the leaves are broadcast up to so many leaves (a fitted tree has fewer) and joined beyond.
MAX_BROADCAST_LEAVES = 100_000
#: Part of the greatest length that distances may be wrong by, in both directions; costs only elimination.
SLACK = 1e-6
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass
class Node:
    """Split points, the sum of squares that each lacks, its children (a node or the number of a leaf), and ranges[i, j]:
    least and greatest distance of split point i to the vectors of child j."""

    points: np.ndarray
    lacks: np.ndarray
    children: list
    low: np.ndarray = field(default=None)
    high: np.ndarray = field(default=None)


@dataclass
class Tree:
    """Of vectors of one length: greatest sum of squares, root (a node, or leaf 0) and the nodes by number."""

    most: float
    root: Node | int
    nodes: list[Node]


def _lacking(vectors: np.ndarray, most: float) -> np.ndarray:
    return np.maximum(0.0, most - np.einsum("ij,ij->i", vectors, vectors))


def _distances(vectors: np.ndarray, lacks: np.ndarray, node: Node, most: float) -> np.ndarray:
    """Of table vectors to a node's split points, all made equally long."""
    inner = vectors @ node.points.T + np.sqrt(lacks)[:, None] * np.sqrt(node.lacks)
    return np.sqrt(np.maximum(0.0, 2.0 * (most - inner)))


def fit(sample: np.ndarray, n_rows: int, most: float) -> Tree:
    """A tree over a sample of n_rows vectors; split points far from each other are picked in turn."""
    nodes: list[Node] = []
    leaves = 0
    all_lacks = _lacking(sample, most)

    def grow(at: np.ndarray) -> Node | int:
        nonlocal leaves
        if len(at) >= LEAST_SAMPLE and len(at) * n_rows > LEAF_ROWS * len(sample):
            from_ = at[:: max(1, len(at) // (BRANCHES * PICKED_FROM))]
            lacks = all_lacks[from_]
            picked = [0]
            far = np.full(len(from_), np.inf)
            while len(picked) < BRANCHES:
                last = picked[-1]
                inner = sample[from_] @ sample[from_[last]] + np.sqrt(lacks * lacks[last])
                far = np.minimum(far, np.maximum(0.0, most - inner))
                if far.max() <= SLACK * most:
                    break  # what is left equals a split point
                picked.append(int(far.argmax()))
            if len(picked) > 1:
                node = Node(sample[from_[picked]], lacks[picked], [])
                nodes.append(node)
                nearest = _distances(sample[at], all_lacks[at], node, most).argmin(axis=1)
                node.children = [grow(at[nearest == j]) for j in range(len(picked))]
                node.low = np.full((len(picked), len(picked)), np.inf)
                node.high = np.full((len(picked), len(picked)), -np.inf)
                return node
        leaves += 1
        return leaves - 1

    return Tree(most, grow(np.arange(len(sample))), nodes)


def route(tree: Tree, vectors: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Each vector's leaf, and of each node that has some: its number, and the ranges of its children over these vectors."""
    leaf, ranges = np.zeros(len(vectors), np.int64), []
    lacks = _lacking(vectors, tree.most)
    number = {id(n): i for i, n in enumerate(tree.nodes)}
    todo = [(tree.root, np.arange(len(vectors)))]
    while todo:
        node, at = todo.pop()
        if not isinstance(node, Node):
            leaf[at] = node
        elif len(at):
            d = _distances(vectors[at], lacks[at], node, tree.most)
            child = d.argmin(axis=1)
            own = [d[child == j] for j in range(len(node.children))]
            ranges.append((number[id(node)], *(np.stack([f(x, axis=0, initial=i) for x in own], axis=1) for f, i in ((np.min, np.inf), (np.max, -np.inf)))))
            todo += [(c, at[child == j]) for j, c in enumerate(node.children)]
    return leaf, ranges


def search(tree: Tree, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Leaves with the places of the queries that may have something there within any of their windows of scores.

    ``low`` and ``high``: (queries, windows); a window with low > high is empty.
    """
    squares = np.einsum("ij,ij->i", queries, queries)[:, None]
    slack = SLACK * np.sqrt(tree.most + squares)
    # a query has nothing in the added coordinate, so all vectors of the tree with one score are at one distance
    distance = lambda score: np.sqrt(np.maximum(0.0, squares + tree.most - 2.0 * score))
    inner, outer = distance(high.astype(np.float64)) - slack, distance(low.astype(np.float64)) + slack
    usable = low <= high
    todo = [(tree.root, np.flatnonzero(usable.any(axis=1)), None, None)]
    while todo:
        node, at, near, far = todo.pop()
        if not isinstance(node, Node):
            if len(at):
                yield node, at
            continue
        near, far = (np.zeros(len(at)), np.full(len(at), np.inf)) if near is None else (near, far)
        d = distance(queries @ node.points.T)[at]
        for j, child in enumerate(node.children):
            least = np.maximum(near, np.maximum(node.low[:, j] - d, d - node.high[:, j]).max(axis=1))
            most = np.minimum(far, (node.high[:, j] + d).min(axis=1))
            meets = (usable[at] & (least[:, None] <= outer[at]) & (most[:, None] >= inner[at])).any(axis=1)
            if meets.any():
                todo.append((child, at[meets], least[meets], most[meets]))


def usable(vectors: DataFrame, anchors: Column) -> DataFrame:
    """vec_id, label, v (components floored to 1 / 256), size and asked of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    floored = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), floored.alias("v"), F.size("embedding").alias("size"), F.coalesce(anchors, F.lit(False)).alias("asked"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """A list column of equal lengths as rows."""
    return np.asarray(column.flatten()).reshape(len(column), size)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = np.asarray(batch.column("size"))
    for size in np.unique(sizes):
        yield int(size), batch if (sizes == size).all() else batch.filter(pa.array(sizes == size))


class Index:
    """All usable rows in the leaves of the trees, one for each length of vectors.

    Lengths that the sample does not have are one leaf without a tree. To the driver come the sample, the ranges of the
    split points of the trees made from it, and nothing that grows with the table.
    """

    def __init__(self, vectors: DataFrame, anchors: Column):
        self.spark: SparkSession = vectors.sparkSession
        rows = written(usable(vectors, anchors))
        sample = hash_sample(rows.select("vec_id", "v", "size"), SAMPLE_ROWS, F.col("vec_id")).select("size", "v").toPandas()
        counts = rows.where(F.col("size").isin([int(s) for s in sample["size"].unique()])).groupBy("size").agg(F.count("*").alias("n"), F.max(_squares(F.col("v"))).alias("most"))
        self.trees: dict[int, Tree] = {}
        for size, n, most in counts.collect():  # lengths of the sample
            own = [list(v) for v in sample["v"][sample["size"] == size]]
            self.trees[size] = fit(np.array(own, np.float64).reshape(len(own), size), n, most)
        placed = self._routed(rows)
        sizes = placed.groupBy("size", "leaf").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("blocks"))
        self.sizes = checkpointed(sizes)
        few = F.broadcast(self.sizes) if self.sizes.count() <= MAX_BROADCAST_LEAVES else self.sizes
        # equal rows may be a large part of the table, so they are dealt by a number of their own
        self.rows = written(placed.join(few, ["size", "leaf"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "key"), F.col("blocks")).cast("int")).drop("blocks"))
        self.few = few
        self._keep_ranges()
        self.blocks = written(_packed(self.rows.drop("asked"), ["size", "leaf", "block"], ["vec_id", "label"]))

    def _routed(self, rows: DataFrame) -> DataFrame:
        shared = self.spark.sparkContext.broadcast(self.trees)

        @released
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for size, part in _by_size(batch):
                    tree = shared.value.get(size)
                    leaf = route(tree, _matrix(part.column("v"), size).astype(np.float64))[0] if tree else np.zeros(len(part), np.int64)
                    yield part.append_column("leaf", pa.array(leaf.astype(np.int32)))

        keyed = rows.withColumn("key", F.monotonically_increasing_id())
        return written(keyed.mapInArrow(work, "vec_id bigint, label bigint, v array<bigint>, size int, asked boolean, key bigint, leaf int"))

    def _keep_ranges(self) -> None:
        """Puts the ranges of all rows into the trees."""
        shared = self.spark.sparkContext.broadcast(self.trees)

        @released
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for size, part in _by_size(batch):
                    if size in shared.value:
                        for node, low, high in route(shared.value[size], _matrix(part.column("v"), size).astype(np.float64))[1]:
                            i, j = np.nonzero(low <= high)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), x, np.int32)) for x in (size, node)] + [pa.array(x) for x in (i.astype(np.int32), j.astype(np.int32), low[i, j], high[i, j])], ["size", "node", "i", "j", "low", "high"])

        found = self.rows.select("v", "size").mapInArrow(work, "size int, node int, i int, j int, low double, high double")
        for r in found.groupBy("size", "node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
            node = self.trees[r["size"]].nodes[r["node"]]
            node.low[r["i"], r["j"]], node.high[r["i"], r["j"]] = r["low"], r["high"]

    def packs(self, queries: DataFrame) -> DataFrame:
        """The leaves that the queries need: (size, leaf) with a pack of the queries that go there, near ones together."""
        shared = self.spark.sparkContext.broadcast(self.trees)

        @released
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), PACK):
                    for size, part in _by_size(batch.slice(at, PACK)):
                        tree = shared.value.get(size) or Tree(0.0, 0, [])
                        vectors = _matrix(part.column("v"), size)
                        low, high = (_matrix(part.column(x), -1) for x in ("low", "high"))
                        for leaf, own in search(tree, vectors.astype(np.float64), low, high):
                            pack = _pack_of(part.take(pa.array(own)), size, ["key", "vec_id", "label"], ["low", "high"])
                            yield pa.RecordBatch.from_pydict({"size": pa.array([size], pa.int32()), "leaf": pa.array([leaf], pa.int32()), **pack})

        dealt = queries.repartitionByRange("size", "leaf", "key").sortWithinPartitions("size", "leaf", "key")
        return dealt.mapInArrow(work, "size int, leaf int, key binary, vec_id binary, label binary, low binary, high binary, v binary, width int")


def _squares(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def _pack_of(rows: pa.RecordBatch | pa.Table, size: int, numbers: list[str], lists: list[str]) -> dict[str, pa.Array]:
    """Rows as one: columns of longs as bytes, and the vectors as bytes of the narrowest integers."""
    column = lambda c: rows.column(c).combine_chunks() if isinstance(rows, pa.Table) else rows.column(c)
    v = _matrix(column("v"), size)
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= v.min(initial=0) and v.max(initial=0) <= np.iinfo(t).max)
    out = {c: pa.array([np.asarray(column(c)).astype(np.int64).tobytes()], pa.binary()) for c in numbers}
    out |= {c: pa.array([np.asarray(column(c).flatten()).tobytes()], pa.binary()) for c in lists}
    return out | {"v": pa.array([v.astype(kind).tobytes()], pa.binary()), "width": pa.array([np.dtype(kind).itemsize], pa.int32())}


def _packed(rows: DataFrame, by: list[str], numbers: list[str], lists: list[str] = []) -> DataFrame:
    """One row for each group; a group has about ``BLOCK_ROWS`` rows at most."""

    def pack(table: pa.Table) -> pa.Table:
        size = table.column("size")[0].as_py()
        return pa.table({c: table.column(c)[:1].combine_chunks() for c in by} | _pack_of(table, size, numbers, lists))

    columns = [*(f"{c} int" for c in by), *(f"{c} binary" for c in (*numbers, *lists)), "v binary", "width int"]
    return rows.select(*by, *numbers, *lists, "v").groupBy(*by).applyInArrow(pack, ", ".join(columns))


_HITS = "key bigint, query_id bigint, place int, vec_id bigint, score bigint"


def hits(units: DataFrame, k: int, same: bool) -> DataFrame:
    """Of each pair of a pack of queries and a block, each query's k best rows of each window: its own label's or all other's."""

    @released
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                key, q_id, q_label, c_id, c_label = (np.frombuffer(row[c], np.int64) for c in ("key", "q_id", "q_label", "vec_id", "label"))
                q, c = (np.frombuffer(row[v], f"<i{row[w]}").reshape(n, row["size"]) for v, w, n in (("q_v", "q_width", len(key)), ("v", "width", len(c_id))))
                low, high = (np.frombuffer(row[x], np.int64).reshape(len(key), -1) for x in ("low", "high"))
                kind = _exact(q, c)
                turned = np.ascontiguousarray(c.T.astype(kind))
                for i in range(0, len(key), STEP):
                    score = (q[i : i + STEP].astype(kind) @ turned).astype(np.int64)
                    fits = (c_label == q_label[i : i + STEP, None]) == same
                    if same:
                        fits &= c_id != q_id[i : i + STEP, None]
                    for w in range(low.shape[1]):
                        r, at, found = _first(score, fits & (score >= low[i : i + STEP, w, None]) & (score <= high[i : i + STEP, w, None]), c_id, k)
                        columns = [pa.array(key[i + r]), pa.array(q_id[i + r]), pa.array(np.full(len(r), w, np.int32)), pa.array(c_id[at]), pa.array(found)]
                        yield pa.RecordBatch.from_arrays(columns, ["key", "query_id", "place", "vec_id", "score"])

    return units.mapInArrow(work, _HITS)


def _first(score: np.ndarray, fits: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, place and score of each query's k best fitting rows, ties to the smaller id."""
    n = score.shape[1]
    if n > k and fits.sum() > 4 * k * len(score):
        masked = np.where(fits, score, _LOW)
        fits &= score >= np.partition(masked, n - k, axis=1)[:, n - k, None]
    r, at = np.nonzero(fits)
    found = score[r, at]
    order = np.lexsort((ids[at], -found, r))
    r, at, found = r[order], at[order], found[order]
    top = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[top], at[top], found[top]


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query's window, with their rank."""
    order = Window.partitionBy("key", "place").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _hundredths(share: int) -> Column:
    """So many hundredths of the positive's score, rounded down, in whole numbers."""
    x = F.col("positive_score") * F.lit(share)
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))


def _named(packs: DataFrame) -> DataFrame:
    return packs.withColumnsRenamed({"vec_id": "q_id", "label": "q_label", "v": "q_v", "width": "q_width"})


def first_in_windows(index: Index, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """key, query_id, place, vec_id, score and rank of each query's k best rows in each of its windows.

    ``queries``: key, vec_id, label, v, size, leaf, block and the arrays low and high, a window of scores at each place.
    """
    # first each query's own block: where a window has k rows there, the k-th best is the least score that counts
    home = _named(_packed(queries, ["size", "leaf", "block"], ["key", "vec_id", "label"], ["low", "high"]))
    near = _best(hits(home.join(index.blocks, ["size", "leaf", "block"]), k, same), k).where(F.col("rank") == k).select("key", "place", "score")
    bounds = near.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("bounds"))
    low = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("bounds", i), x)))
    narrowed = queries.join(bounds, "key", "left").withColumn("low", F.when(F.col("bounds").isNull(), F.col("low")).otherwise(low)).drop("bounds")
    packs = _named(index.packs(written(narrowed)))
    units = packs.join(index.few, ["size", "leaf"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return _best(hits(units.join(index.blocks, ["size", "leaf", "block"]), k, same), k)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of the anchors' hard negatives.

    ``vectors``: vec_id, label, embedding. Rows with a null id, label or vector, or a null or non-finite component, take no
    part. Components are floored to 1 / 256, and scores are integer inner products, which must fit a long; only vectors of
    equal length are compared. An anchor's positives are its ``positives`` best rows with its label and another id, its negatives
    for each of them the ``negatives`` best rows of other labels whose score is 30 to 90 hundredths of the positive's; ties
    go to the smaller id, and where there are fewer rows all are returned. A window without rows, as that of a negative
    score, gives none. Rows that share an anchor's id are anchors of their own, and come out under the one id; several rows
    with one id are as many positives and negatives. No rows give no rows. Other columns are left out.
    """
    index = Index(vectors, anchors)
    asked = index.rows.where("asked").select("key", "vec_id", "label", "v", "size", "leaf", "block")
    whole = (F.array(F.lit(x).cast("bigint")).alias(c) for x, c in ((-(1 << 62), "low"), (1 << 62, "high")))
    found = first_in_windows(index, asked.select("*", *whole), positives, True)
    found = written(found.select("key", "query_id", (F.col("rank") - 1).alias("at"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    least, most = _hundredths(-LEAST_SHARE), _hundredths(MOST_SHARE)
    listed = found.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct((-least).alias("low"), most.alias("high"))))).alias("windows"))
    window = lambda c, empty: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.try_element_at("windows", i)[c], F.lit(empty).cast("bigint"))).alias(c)
    wanted = asked.join(listed, "key").select(*asked.columns, window("low", 1), window("high", 0))
    chosen = first_in_windows(index, written(wanted), negatives, False)
    chosen = chosen.select("key", F.col("place").alias("at"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return chosen.join(found, ["key", "at"]).select(F.col("query_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
