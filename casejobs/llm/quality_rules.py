"""Quality rules: a hashed n-gram log-likelihood ratio between trusted target text and the raw corpus.

Word unigrams and bigrams are hashed to a fixed number of buckets. One multinomial is estimated from a trusted target
(*all* documents labelled good), one from *all* documents. A document's score is the mean over its n-grams of
log p_target - log p_raw; a document is kept if it passes the counting rules and its score reaches a threshold: the low
end of the trusted documents' scores, each one against the target without it, less a margin. In a small corpus unseen
text scores lower, and so do these, so one rule holds for any number of trusted documents. Nothing is drawn by chance, so
a rerun gives the same verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Words, chunks
from .durable import checkpointed

BUCKET_BITS = 16
#: Bits for each trusted id in the filter that texts pass before they move, and most bits (with 64 in a broadcast row).
BITS_EACH, MOST_BITS = 8, 1 << 26
#: Bins in which ratios are counted on the way to their quantile.
BINS = 4096
#: The threshold: this quantile of the trusted documents' ratios, less the margin.
LOW_QUANTILE, MARGIN = 0.005, 0.09
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_FEATURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def _buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and documents of all unigrams and bigrams."""
    two, doc = words.grams(2)
    shift = np.uint64(64 - BUCKET_BITS)
    return np.concatenate([words.hash >> shift, two >> shift]).astype(np.int64), np.concatenate([words.doc, doc])


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of every document whose labels all say quality 1."""
    labelled = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    return labelled.agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")


def may_be_trusted(docs: DataFrame, trusted: DataFrame, n: int) -> DataFrame:
    """(doc_id, text) of all rows with one of the ``n`` trusted ids, and by chance of a few others; nothing moves.

    Hashes of ids are looked up in a broadcast bitmap, which is bounded whatever the number of ids: beyond some ten million it
    lets ever more others pass.
    """
    at = F.pmod(F.xxhash64("doc_id"), F.lit(min(MOST_BITS, 1 << max(6, (BITS_EACH * n).bit_length()))))
    slot, bit = F.shiftright(at, 6), at.bitwiseAND(63).cast("int")
    bits = trusted.select(slot.alias("slot"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("slot", slot)
    found = F.when(F.getbit("bits", bit) == 1, F.col("doc_id"))  # of both sides, so that no later join is planned before this one
    return rows.join(F.broadcast(bits), "slot").select(found.alias("doc_id"), "text").where("doc_id IS NOT NULL")


def _of_trusted(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows with a trusted id, exactly; rows and ids meet by a shuffle, so that no task and no driver holds all ids."""
    return rows.join(trusted.hint("shuffle_hash"), "doc_id", "left_semi")


def _bucket_counts(docs: DataFrame) -> np.ndarray:
    """Counts of each bucket over all rows.

    Tasks count into fixed arrays and Spark sums the buckets, so what reaches the driver has a fixed size.
    """
    size = 1 << BUCKET_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, _, raw, off in chunks(batch, "text"):
                total += np.bincount(_buckets(Words(raw, off))[0], minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    summed = docs.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[summed["bucket"].to_numpy(np.int64)] = summed["n"].to_numpy(np.int64)
    return out


def gram_counts(docs: DataFrame, trusted: DataFrame, some: DataFrame | None = None) -> np.ndarray:
    """Counts of each bucket over all documents and over the trusted ones: an array (2, buckets).

    ``some``: rows of ``docs`` among which all trusted ones are; only these texts move between tasks.
    """
    some = may_be_trusted(docs, trusted, trusted.count()) if some is None else some
    return np.stack([_bucket_counts(docs), _bucket_counts(_of_trusted(some, trusted))])


def _logs(counts: np.ndarray, total: int | np.ndarray) -> np.ndarray:
    """Log shares of the buckets, with one added to each count."""
    return np.log(counts + 1.0) - np.log(total + float(1 << BUCKET_BITS))


def ratio_weights(counts: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of each bucket; zeros if there is no target."""
    raw, target = counts
    return _logs(target, target.sum()) - _logs(raw, raw.sum()) if target.any() else np.zeros(len(raw))


def ratios_left_out(words: Words, n_docs: int, counts: np.ndarray) -> np.ndarray:
    """Ratios of target documents, each against the target without its own n-grams; others get some number."""
    bucket, doc = _buckets(words)
    key, own = np.unique(doc << BUCKET_BITS | bucket, return_counts=True)
    doc, bucket = key >> BUCKET_BITS, key & ((1 << BUCKET_BITS) - 1)
    total = np.bincount(doc, weights=own, minlength=n_docs)
    rest = np.maximum(counts[1][bucket] - own, 0)
    one = _logs(rest, np.maximum(counts[1].sum() - total, 0)[doc]) - _logs(counts[0][bucket], counts[0].sum())
    return np.bincount(doc, weights=own * one, minlength=n_docs) / np.maximum(total, 1)


def _repeated(words: Words, n_docs: int) -> np.ndarray:
    """Words of each document that lie in a window of three words found twice or more in it."""
    gram, doc = words.grams(3)
    out = np.zeros(n_docs, np.int64)
    if not len(gram):
        return out
    order = np.lexsort((gram, doc))
    g, d = gram[order], doc[order]
    same = (g[1:] == g[:-1]) & (d[1:] == d[:-1])
    twice = np.zeros(len(g), bool)
    twice[1:] |= same
    twice[:-1] |= same
    size = len(words.hash) - 2
    at = np.flatnonzero(words.doc[:size] == words.doc[2:])[order[twice]]
    covered = np.zeros(len(words.hash), bool)
    for i in range(3):
        covered[at + i] = True
    return np.bincount(words.doc[covered], minlength=n_docs).astype(np.int64)


def _duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def _features(batch: pa.RecordBatch, weights: np.ndarray) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
    """(first row, end row, the counting features, ratio) of a batch, chunk by chunk."""
    texts = batch.column(batch.schema.get_field_index("text"))
    for row, end, raw, off in chunks(batch, "text"):
        n, words = end - row, Words(raw, off)
        owner = np.repeat(np.arange(n), np.diff(off))
        lead = words.inside & ((raw & 0xC0) != 0x80)
        bucket, doc = _buckets(words)
        total = np.bincount(doc, minlength=n)
        ratio = np.bincount(doc, weights=weights[bucket], minlength=n).astype(np.float64) / np.maximum(total, 1)
        lines = [_duplicate_lines(t.as_py() or "") for t in texts.slice(row, n)]
        found = [np.diff(words.first), np.bincount(owner[lead], minlength=n), np.bincount(owner[_SYMBOLS[raw]], minlength=n), np.array(lines), _repeated(words, n)]
        yield row, end, [x.astype(np.int64) for x in found], ratio


def quantile(rows: DataFrame, column: str, q: float) -> float | None:
    """The exact quantile, with numpy's linear interpolation; none of no rows.

    Each round counts the values in even bins between their ends and goes on in the bin that holds the two ranks, so that a
    bounded number of rows reaches the driver, and no task gets all values.
    """
    value = F.col(column)
    ends = [F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")]
    n, low, high = rows.agg(*ends).first()
    if not n:
        return None
    rank, below = int(q * (n - 1)), 0
    while low < high:
        place = F.floor((value - F.lit(low)) / F.lit(high - low) * BINS)
        bins = rows.where(value.between(low, high)).groupBy(place.alias("bin")).agg(*ends).orderBy("bin").collect()
        last = below + np.cumsum([x.n for x in bins])
        i, j = np.searchsorted(last, [rank, min(rank + 1, n - 1)], side="right")
        if i < j:
            return float(np.quantile([bins[i].high, bins[j].low], q * (n - 1) - rank))
        below, low, high = int(last[i]) - bins[i].n, bins[i].low, bins[i].high
    return float(low)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Weights of the buckets and the threshold; without trusted documents that pass the counting rules there is none.

    Of several rows with a trusted id the least ratio counts. Ratios are made where the texts are, and meet the ids after that.
    """
    trusted = trusted_ids(labels)
    n = trusted.count()
    if not n:
        return np.zeros(1 << BUCKET_BITS), -np.inf
    some = may_be_trusted(docs, trusted, n)
    counts = gram_counts(docs, trusted, some)

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, raw, off in chunks(batch, "text"):
                words = Words(raw, off)
                good = _passes(np.diff(words.first), _repeated(words, end - row))
                ratio = ratios_left_out(words, end - row, counts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row).filter(pa.array(good)), pa.array(ratio[good])], ["doc_id", "ratio"])

    found = _of_trusted(some.mapInArrow(ratios, "doc_id bigint, ratio double"), trusted)
    low = quantile(checkpointed(found.groupBy("doc_id").agg(F.min("ratio").alias("ratio")), n), "ratio", LOW_QUANTILE)
    return ratio_weights(counts), -np.inf if low is None else low - MARGIN


def _passes(n_words: np.ndarray, repeat: np.ndarray) -> np.ndarray:
    return (n_words >= MIN_WORDS) & (100 * repeat <= MAX_REPEAT_PERCENT * n_words)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): features, ``base_failed``, ``ratio`` and ``kept``.

    Words are runs outside 0x20 and 0x09-0x0D. Null and empty texts have no words, so they fail the counting rules.
    Rows with repeated or null ids are scored each for itself; other columns are left out. An id is trusted if all its
    labels say quality 1. Without trusted documents every ratio is 0.0 and the counting rules alone decide. Windows of
    three words are compared by 64-bit hashes within a document.
    """
    weights, least = fit(docs, labels)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, found, ratio in _features(batch, weights):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), *map(pa.array, found), pa.array(ratio)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, {_FEATURES}, ratio double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("ratio") >= least))


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns; only texts that may be trusted move between tasks."""
    weights, least = fit(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, (n_words, _, _, _, repeat), ratio in _features(batch, weights):
                yield batch.slice(row, end - row).filter(pa.array(_passes(n_words, repeat) & (ratio >= least)))

    return docs.mapInArrow(keep, docs.schema)
