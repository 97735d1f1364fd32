"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

Shingles are windows of five words. A shingle weighs a damped count in the text times a rarity factor from 1 to 1.2 that
falls with its document frequency, counted over all documents in a fixed number of hash buckets. Consistent samples of
the weighted shingles agree with the probability of the weighted Jaccard similarity; three samples make a band.
A node is a text, known by a 64-bit hash. The shingles of all nodes that share a bucket are written once to the shared
folder, and the rest is read from there. What a text shares with no other text of all buckets bounds every similarity it
can have, so texts with much of their own, as far edited copies of one text have, drop out exactly. In each band's buckets
every node is paired with a leader (the node with the least of its own, or one by hash), the pairs are verified by exact
weighted Jaccard similarity, and linked nodes form classes. The nodes of buckets that still hold several classes are
banded again by 1024 more samples, ten to a band, so that a large bucket falls apart into small ones of very like texts;
these get leaders in the same way, and what then is still open is compared across the classes by one bit of each sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import Words, chunks, mix, released
from .durable import TEXT_ROWS, checkpointed, small_batches, written

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 14, 3
SAMPLES = BANDS * ROWS
#: Candidates agree in so many samples at least; at a similarity of 0.8, 33.6 of 42 are expected (deviation 2.6).
LEAST_AGREEMENT = 22
FREQUENCY_BITS = 18
#: A shingle found once weighs up to so much more than one that all documents have. Small, so that one common passage
#: does not count in full and yet a large group of near copies is not split over its rare differences.
RARITY = 0.2
#: A shingle found n times in a text counts 1 + DAMPING * ln(n).
DAMPING = 0.2
#: The second banding of nodes in open buckets: a pair at a similarity of 0.8 is missed by all bands with probability 1e-5.
#: One bit of each sample is kept, too, and so many of these bits may differ: 102 are expected (deviation 9.6).
FINE_SAMPLES, FINE_ROWS, MOST_DIFFERENT = 1024, 10, 141
FINE_BANDS = FINE_SAMPLES // FINE_ROWS
#: For sums of rounded weights.
SLACK = 1e-4
#: Nodes whose texts are looked up are broadcast up to this number, and joined by a shuffle beyond.
MAX_BROADCAST_IDS = 200_000
#: Rounds of the class search. Each one takes the class of the neighbours' class, so paths double and a chain of n links
#: takes about log2(n) of them.
MAX_ROUNDS = 100

_GRAM_BITS = 52


def _shingles(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) of the distinct shingles of a chunk, sorted. A text of 1 to 4 words is one shingle."""
    words = Words(raw, off)
    gram, doc = words.grams(SHINGLE)
    for n in range(1, SHINGLE):
        short = np.flatnonzero(np.diff(words.first) == n)
        if len(short):
            g, d = words.grams(n)
            keep = np.isin(d, short)
            gram, doc = np.concatenate([gram, g[keep]]), np.concatenate([doc, d[keep]])
    key, count = np.unique((doc.astype(np.uint64) << np.uint64(_GRAM_BITS)) | (gram >> np.uint64(64 - _GRAM_BITS)), return_counts=True)
    return (key >> np.uint64(_GRAM_BITS)).astype(np.int64), key & np.uint64((1 << _GRAM_BITS) - 1), count


def _bucket(gram: np.ndarray) -> np.ndarray:
    return (gram >> np.uint64(_GRAM_BITS - FREQUENCY_BITS)).astype(np.int64)


def _weights(gram: np.ndarray, count: np.ndarray, factor: np.ndarray) -> np.ndarray:
    return (1.0 + DAMPING * np.log(count)).astype(np.float32) * factor[_bucket(gram)]


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequency of each shingle bucket, over all documents, and the number of documents."""
    size = 1 << FREQUENCY_BITS

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, np.int64), 0
        for batch in batches:
            n += len(batch)
            for _, _, raw, off in chunks(batch, "text"):
                total += np.bincount(_bucket(_shingles(raw, off)[1]), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], n))], ["bucket", "n"])

    found = docs.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    bucket, n = found["bucket"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    frequency = np.zeros(size)
    frequency[bucket[bucket >= 0]] = n[bucket >= 0]
    return frequency, int(n[bucket < 0].sum())


def rarity(frequency: np.ndarray, n_docs: int) -> np.ndarray:
    """Rarity factor of each shingle bucket."""
    return (1.0 + RARITY * (1.0 - np.minimum(1.0, np.log1p(frequency) / np.log1p(max(1, n_docs))))).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling: for each sample, gamma and uniform variates by hashed shingle slot.

    A sample has its own hash to the slots; the tables of variates are used in turn. Shingles in one slot share their
    variates, which for the few thousand shingles of a text leaves the agreement as it is within its deviation.
    """

    def __init__(self, samples: int = SAMPLES, slot_bits: int = 15, tables: int = 14, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.n, self.slot_bits, size = samples, slot_bits, (tables, 1 << slot_bits)
        r, c, beta = rng.gamma(2.0, 1.0, size), rng.gamma(2.0, 1.0, size), rng.random(size)
        self.tables = [x.astype(np.float32) for x in (r, 1 / r, np.log(c), beta)]
        self.factors = rng.integers(1, 2**63, samples).astype(np.uint64) | np.uint64(1)

    def variates(self, k: int) -> tuple:
        """Slot factor, r, 1 / r, log c and beta of sample k."""
        return (self.factors[k], *(x[k % len(x)] for x in self.tables))

    def samples(self, doc: np.ndarray, gram: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
        """64-bit samples (documents, samples); rows of documents without shingles are 0."""
        out = np.zeros((n_docs, self.n), np.int64)
        if not len(doc):
            return out
        begin = np.flatnonzero(np.diff(doc, prepend=-1))
        own, size = doc[begin], np.diff(np.append(begin, len(doc)))
        log_w = np.log(weight).astype(np.float32)
        for k in range(self.n):
            factor, r, inverse, log_c, beta = self.variates(k)
            slot = ((gram * factor) >> np.uint64(64 - self.slot_bits)).astype(np.int64)
            b = beta[slot]
            t = np.floor(log_w * inverse[slot] + b)
            value = log_c[slot] - r[slot] * (t - b + np.float32(1))
            at = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, begin), size))
            first = at[np.searchsorted(at, begin)]
            out[own, k] = (gram[first] * np.uint64(0x9E3779B97F4A7C15) + t[first].astype(np.int64).astype(np.uint64)).view(np.int64)
        return out


def _text_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _node(text_hash: Column) -> Column:
    return F.xxhash64(text_hash)


def signatures(docs: DataFrame, factors: np.ndarray) -> DataFrame:
    """(doc_id, text_hash, samples, weight) of each row; samples are null for a text without words."""
    shared = docs.sparkSession.sparkContext.broadcast(factors)

    @released
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, factor = Sampler(), shared.value
        for batch in batches:
            for row, end, raw, off in chunks(batch, "text"):
                doc, gram, count = _shingles(raw, off)
                weight = _weights(gram, count, factor)
                found, total = sampler.samples(doc, gram, weight, end - row), np.bincount(doc, weights=weight, minlength=end - row).astype(np.float64)
                has = np.zeros(end - row, bool)
                has[doc] = True
                flat = pa.array(found[has].ravel())
                offsets = np.concatenate([[0], np.cumsum(np.where(has, SAMPLES, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array(~has))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row), lists, pa.array(total)], ["doc_id", "text_hash", "samples", "weight"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _text_hash(F.col("text")).alias("text_hash"), "text")
    return rows.mapInArrow(work, "doc_id bigint, text_hash string, samples array<bigint>, weight double")


def shingle_store(docs: DataFrame, nodes: DataFrame, n_nodes: int, factors: np.ndarray) -> DataFrame:
    """(node, grams, weights) of the nodes (node, doc_id), as bytes; a node's text is taken from the row with that id."""
    shared = docs.sparkSession.sparkContext.broadcast(factors)

    @released
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, raw, off in chunks(batch, "text"):
                doc, gram, count = _shingles(raw, off)
                weight = _weights(gram, count, shared.value)
                cut = np.searchsorted(doc, np.arange(end - row + 1))
                grams, weights = ([x[i:j].tobytes() for i, j in zip(cut, cut[1:])] for x in (gram, weight))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(grams, pa.binary()), pa.array(weights, pa.binary())], ["node", "grams", "weights"])

    wanted = checkpointed(nodes, n_nodes)
    if wanted.count() <= MAX_BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    rows = docs.select(_node(_text_hash(F.col("text"))).alias("node"), F.col("doc_id").cast("bigint").alias("id"), "text")
    found = rows.join(wanted, (rows["node"] == wanted["node"]) & rows["id"].eqNullSafe(wanted["doc_id"]), "left_semi")
    found = found.select("node", "text").mapInArrow(work, "node bigint, grams binary, weights binary")
    return found.groupBy("node").agg(F.min_by(F.struct("grams", "weights"), "grams").alias("x")).select("node", "x.*")


def _shingles_of(batch: pa.RecordBatch, side: str = "") -> list[tuple[np.ndarray, np.ndarray]]:
    """Shingles and weights of each row of a batch of the store."""
    grams, weights = (batch.column(batch.schema.get_field_index(side + x)) for x in ("grams", "weights"))
    return [(np.frombuffer(g.as_buffer(), np.uint64), np.frombuffer(w.as_buffer(), np.float32)) for g, w in zip(grams, weights)]


def agreement(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose samples agree often enough."""
    one = nodes.select(F.col("node").alias("a"), F.col("samples").alias("a_samples"))
    two = nodes.select(F.col("node").alias("b"), F.col("samples").alias("b_samples"))
    return pairs.join(one, "a").join(two, "b").where(agreement(F.col("a_samples"), F.col("b_samples")) >= LEAST_AGREEMENT).select("a", "b")


def weighted_jaccard(left: tuple, right: tuple) -> float:
    """Of two sorted arrays of shingles with their weights."""
    _, i, j = np.intersect1d(left[0], right[0], assume_unique=True, return_indices=True)
    low = np.minimum(left[1][i], right[1][j]).sum(dtype=np.float64)
    high = left[1].sum(dtype=np.float64) + right[1].sum(dtype=np.float64) - low
    return float(low / high) if high else 0.0


def verified(pairs: DataFrame, store: DataFrame) -> DataFrame:
    """Pairs (a written table) whose exact weighted Jaccard similarity is at least 0.8. Only the shingles of paired nodes
    move, and meet by shuffles."""

    @released
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [weighted_jaccard(x, y) >= SIMILARITY for x, y in zip(_shingles_of(batch, "a_"), _shingles_of(batch, "b_"))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    n_pairs = pairs.count()
    if 2 * n_pairs <= MAX_BROADCAST_IDS:
        store = store.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "node", "left_semi")
    one, two = (store.select(F.col("node").alias(x), F.col("grams").alias(f"{x}_grams"), F.col("weights").alias(f"{x}_weights")) for x in "ab")
    with small_batches(store.sparkSession):
        return checkpointed(pairs.join(one, "a").join(two, "b").mapInArrow(work, "a bigint, b bigint"), n_pairs, TEXT_ROWS)


def own_weight(store: DataFrame) -> DataFrame:
    """(node, own): the weight of each node's shingles that no other of these nodes has."""

    @released
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (gram, weight) in enumerate(_shingles_of(batch)):
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[row], len(gram)), pa.array(gram.view(np.int64)), pa.array(weight)], ["node", "gram", "weight"])

    grams = store.mapInArrow(work, "node bigint, gram bigint, weight float")
    alone = grams.groupBy("gram").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("weight").alias("weight")).where("n = 1")
    return alone.groupBy("node").agg(F.sum("weight").alias("own"))


def fine_samples(store: DataFrame, n_nodes: int) -> DataFrame:
    """(node, bits, keys): one bit of each of ``FINE_SAMPLES`` samples, in longs, and the keys of the second banding."""

    @released
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(FINE_SAMPLES, 12, 64, 11)
        lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64()))
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                own = _shingles_of(part)
                doc = np.repeat(np.arange(len(own)), [len(g) for g, _ in own])
                found = sampler.samples(doc, *(np.concatenate(x) for x in zip(*own)), len(own)).view(np.uint64)
                bits = np.packbits((mix(found) & np.uint64(1)).astype(bool), axis=1).view(np.int64)
                key = np.zeros((len(own), FINE_BANDS), np.uint64)
                for i in range(FINE_ROWS):
                    key = mix(key + found[:, i : FINE_BANDS * FINE_ROWS : FINE_ROWS])
                yield pa.RecordBatch.from_arrays([part.column(0), lists(bits), lists(key.view(np.int64))], ["node", "bits", "keys"])

    with small_batches(store.sparkSession):
        return written(store.mapInArrow(work, "node bigint, bits array<bigint>, keys array<bigint>"), n_nodes, TEXT_ROWS)


def _close(pairs: DataFrame, fine: DataFrame) -> DataFrame:
    """Pairs (a, b) whose bits differ in few places."""
    one, two = (fine.select(F.col("node").alias(x), F.col("bits").alias(f"{x}_bits")) for x in "ab")
    return pairs.join(one, "a").join(two, "b").where(_different(F.col("a_bits"), F.col("b_bits")) <= MOST_DIFFERENT).select("a", "b")


def _different(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _first_band(a: Column, b: Column) -> Column:
    """The first band in which two nodes agree, so that a pair is made in one of its buckets only."""
    return F.array_position(F.zip_with(a, b, lambda x, y: x == y), True) - 1


def components(edges: DataFrame, n_nodes: int) -> DataFrame:
    """(node, class) of all nodes of the edges (n at most); a class is the least node that is reached.

    Each round takes the least class among the neighbours and then that class's own class, until nothing changes.
    """
    both = edges.select("a", "b").union(edges.select("b", "a"))
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("class")), n_nodes)
    for _ in range(MAX_ROUNDS):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class").alias("other"))
        step = labels.join(near, "node").select("node", "class", F.least("class", "other").alias("next"))
        jump = step.join(labels.select(F.col("node").alias("next"), F.col("class").alias("far")), "next", "left")
        new = checkpointed(jump.select("node", F.least("next", F.coalesce("far", "next")).alias("class"), (F.least("next", F.coalesce("far", "next")) != F.col("class")).alias("changed")), n_nodes)
        labels = new.select("node", "class")
        if new.where("changed").isEmpty():
            return labels
    raise RuntimeError(f"classes still change after {MAX_ROUNDS} rounds")


def _open_buckets(placed: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several classes."""
    several = placed.groupBy("band", "key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("band", "key")
    return placed.join(several, ["band", "key"], "left_semi")


def _possible(left: str, right: str) -> Column:
    """Whether the weights that two texts have in common with others allow a similarity of 0.8."""
    least = F.least(f"{left}.common", f"{right}.common")
    return least >= (SIMILARITY - SLACK) * (F.col(f"{left}.weight") + F.col(f"{right}.weight") - least)


def _led_pairs(placed: DataFrame) -> DataFrame:
    """Pairs of a bucket's leader with the bucket's other nodes. In every other band it is the node with the least of its
    own, which is nearest to what all were copied from; in the others, one by hash."""
    order = F.struct(F.when(F.col("band") % 2 == 0, F.col("common") / F.col("weight")), F.xxhash64("node"))
    leaders = placed.groupBy("band", "key").agg(F.max_by(F.struct("node", "class", "weight", "common"), order).alias("r"))
    pairs = placed.select("band", "key", F.struct("node", "class", "weight", "common").alias("l")).join(leaders, ["band", "key"])
    pairs = pairs.where((F.col("l.class") != F.col("r.class")) & _possible("l", "r"))
    return pairs.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``class_id``, the least doc_id of its class.

    Equal texts with words, and texts linked by similarities of 0.8 or more, are in one class. A text without words
    (null or empty) is in no class with others: its class_id is its doc_id. Rows with the same id are one document, so
    the classes of their texts with words are one. A row without an id is in the class of its text; a class without any
    id has the class_id null. Other columns are left out.
    """
    return classes(docs).select("doc_id", "class_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class of ``near_duplicates``, with all columns: one with the class's id, if it has one.

    Texts without words stay. Of several rows with one id one stays (by the hash of its text, then of all columns); of a
    class without any id the row whose text has the least hash stays, and texts without words and id stay once each.
    """

    def name(doc_id: Column, text_hash: Column) -> Column:
        return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text_hash, F.lit("null")))

    found = classes(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    unique = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("class "), F.col("class").cast("string")), F.concat(F.lit(":"), "text_hash"), F.lit("null"))
    stays = found.groupBy(unique).agg(F.min(name(F.col("doc_id"), F.col("text_hash"))).alias("name")).select("name")
    named = docs.select(F.struct("*").alias("doc"), name(F.col("doc_id"), _text_hash(F.col("text"))).alias("name"))
    first = F.row_number().over(Window.partitionBy("name").orderBy(F.xxhash64("doc")))
    return named.join(stays, "name", "left_semi").withColumn("place", first).where("place = 1").select("doc.*")


def _same_id(rows: DataFrame) -> DataFrame:
    """Links between the texts of one id: each with the least."""
    known = rows.where("doc_id IS NOT NULL AND samples IS NOT NULL").select("doc_id", "node")
    several = known.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("doc_id", "a")
    return known.join(several, "doc_id").where("node > a").select("a", F.col("node").alias("b")).distinct()


def _classed(placed: DataFrame, labels: DataFrame) -> DataFrame:
    return placed.drop("class").join(labels, "node", "left").withColumn("class", F.coalesce("class", "node"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, class (the least node; null without words) and class_id of each row; see ``near_duplicates``."""
    with small_batches(docs.sparkSession, "16m"):
        frequency, n_docs = frequencies(docs)
        factors = rarity(frequency, n_docs)
        rows = written(signatures(docs, factors), n_docs, TEXT_ROWS)
    rows = rows.withColumn("node", _node(F.col("text_hash")))
    texts = rows.where(F.col("samples").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("samples").alias("samples"), F.min("weight").alias("weight"))
    texts = written(texts, n_docs)
    nodes, n_nodes = texts.select("node", "samples", "weight"), texts.count()
    keys = F.array(*[F.xxhash64(F.lit(i), F.slice("samples", 1 + ROWS * i, ROWS)) for i in range(BANDS)])
    members = nodes.select("node", F.posexplode(keys).alias("band", "key"))
    shared = members.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key")
    held = written(members.join(shared, ["band", "key"]), BANDS * n_nodes)
    n_held = held.count()
    candidates = held.select("node").distinct()
    with small_batches(docs.sparkSession):
        store = written(shingle_store(docs, texts.join(candidates, "node", "left_semi").select("node", "doc_id"), n_nodes, factors), n_nodes, TEXT_ROWS)
        bounds = candidates.join(own_weight(store), "node", "left").join(nodes.select("node", "weight"), "node")
        bounds = bounds.select("node", "weight", (F.col("weight") - F.coalesce("own", F.lit(0.0))).alias("common"))
        bounds = checkpointed(bounds.where(F.col("common") >= (SIMILARITY - SLACK) * F.col("weight")), n_nodes)
    viable = written(held.join(bounds, "node").select("node", "band", "key", "weight", "common", F.col("node").alias("class")), n_held)
    tested = checkpointed(plausible(_led_pairs(_open_buckets(viable)).distinct(), nodes), n_held)
    links = verified(tested, store)
    same_id = _same_id(rows)
    if not same_id.isEmpty():
        links = links.union(checkpointed(same_id, n_nodes))
    labels = components(links, n_nodes)

    still = checkpointed(_open_buckets(_classed(viable, labels)).select("node").distinct(), n_nodes)
    n_still = still.count()
    if n_still:
        fine = fine_samples(store.join(still, "node", "left_semi"), n_still)
        placed = bounds.join(fine, "node").select("node", "weight", "common", F.posexplode("keys").alias("band", "key"), F.col("node").alias("class"))
        placed = written(placed, FINE_BANDS * n_still)
        led = _led_pairs(_open_buckets(_classed(placed, labels))).distinct()
        led = checkpointed(_close(led, fine).join(tested, ["a", "b"], "left_anti"), FINE_BANDS * n_still)
        links = links.union(verified(led, store))
        labels = components(links, n_nodes)

        placed = checkpointed(_open_buckets(_classed(placed, labels)), FINE_BANDS * n_still)
        placed = placed.join(fine, "node")
        left, right = placed.alias("l"), placed.alias("r")
        across = left.join(right, (F.col("l.band") == F.col("r.band")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.class") < F.col("r.class")) & _possible("l", "r") & (_different(F.col("l.bits"), F.col("r.bits")) <= MOST_DIFFERENT) & (_first_band(F.col("l.keys"), F.col("r.keys")) == F.col("l.band")))
        across = across.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b"))
        more = checkpointed(across.join(tested.union(led), ["a", "b"], "left_anti"), FINE_BANDS * n_still)
        if not more.isEmpty():
            links = links.union(verified(more, store))
            labels = components(links, n_nodes)

    known = texts.select("node", "doc_id").join(labels, "node", "left").select("node", "doc_id", F.coalesce("class", "node").alias("class"))
    least = known.groupBy("class").agg(F.min("doc_id").alias("least"))
    known = known.join(least, "class").select("node", "class", "least")
    found = rows.select("doc_id", "text_hash", "samples", "node").join(known, "node", "left")
    has = F.col("samples").isNotNull()
    return found.select("doc_id", "text_hash", F.when(has, F.col("class")).alias("class"), F.when(has, F.col("least")).otherwise(F.col("doc_id")).alias("class_id"))
