"""Mixing sources to target weights, with DataFrame functions only.

Words are summed per source (partial sums in each task), targets and repetition rates follow from the sums, and each
document is taken floor(rate) times plus once more if a coin, seeded by a hash of its id and text, falls below the fraction.
Rows that have id, text and source in common share a coin, and are numbered: the coin and the number decide together, so that
of n such rows n times the fraction, rounded up or down, are taken once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import checkpointed, written

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order (null last), repeated.
WEIGHTS = (3, 1, 2)
#: The mix's size as a share of all words, and the most that a document is repeated.
TOTAL_SHARE = 1.5
MOST_REPEATS = 2
#: The per-source table is broadcast up to this many sources. Beyond, documents and sources meet by a shuffle in which
#: each source is dealt out in so many parts.
MAX_BROADCAST_SOURCES = 20_000
SALTS = 64
#: Keys of repeated rows are broadcast up to this number, and joined by a shuffle beyond.
MAX_BROADCAST_KEYS = 200_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _in_order(table: DataFrame, order: list[Column], sums: dict[str, str]) -> tuple[DataFrame, list[int]]:
    """The table with ``place`` (from 1) in the given order and running sums (name: column) up to the row before; and the
    whole sums.

    Rows are dealt into ranges of the order, each range counts for itself, and only one row for each range meets the
    others, so no task sees the whole table.
    """
    table = checkpointed(table.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    totals = table.groupBy("range").agg(F.count("*").alias("n"), *(F.sum(c).alias(f"all_{s}") for s, c in sums.items()))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("range", *(F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"before_{x}") for x in ("n", *(f"all_{s}" for s in sums))))
    within = Window.partitionBy("range").orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, -1)
    placed = table.join(F.broadcast(before), "range").select(
        *(c for c in table.columns if c != "range"),
        (F.col("before_n") + F.row_number().over(within)).alias("place"),
        *((F.col(f"before_all_{s}") + F.coalesce(F.sum(c).over(so_far), F.lit(0))).alias(s) for s, c in sums.items()),
    )
    whole = totals.agg(*(F.sum(f"all_{s}") for s in sums)).first() if sums else ()
    return placed, [x or 0 for x in whole]


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target and rate of each source, from rows (source, size).

    A target is its weight's share, at most ``MOST_REPEATS`` times the source's size; what is cut off is shared again
    by weight among the others. Sorted by size over weight, the sources that are cut off come first, so one running
    sum finds the level at which the rest share.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named, _ = _in_order(per_source, [F.col("source").asc_nulls_last()], {})
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int"))
    named = named.select("source", "source_size", weight.cast("bigint").alias("weight"))
    named = named.withColumn("edge", F.lit(float(MOST_REPEATS)) * F.col("source_size") / F.col("weight"))
    table, (all_sizes, all_weights) = _in_order(named, [F.col("edge").asc(), F.col("source").asc_nulls_last()], {"sizes": "source_size", "weights": "weight"})
    level = (F.lit(TOTAL_SHARE * all_sizes) - F.lit(float(MOST_REPEATS)) * F.col("sizes")) / (F.lit(all_weights) - F.col("weights"))
    table = checkpointed(table.select("source", "source_size", "weight", "edge", "place", level.alias("level")))
    shared = table.where(F.col("edge") >= F.col("level")).agg(F.min_by("level", "place")).first()[0]
    most = F.lit(float(MOST_REPEATS)) * F.col("source_size")
    target = F.least(most, F.coalesce(F.lit(shared).cast("double") * F.col("weight"), most))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return table.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def coin(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) that depends on the id and the text: the first 13 hexadecimal digits of an MD5."""
    seed = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(seed.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def numbered(rows: DataFrame) -> DataFrame:
    """The rows (doc, size) with ``number``: from 0 on among the rows with the same id, text and source.

    Only rows that come again are numbered in groups, each part of the table by itself, and what the earlier parts hold is
    added; so a group that is a large part of the table is in no task as a whole. They are written first, so that the parts stay.
    """
    keyed = rows.withColumn("key", F.xxhash64("doc.doc_id", "doc.text", "doc.source", F.col("doc.doc_id").isNull(), F.col("doc.text").isNull(), F.col("doc.source").isNull()))
    again = checkpointed(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    n = again.count()
    if not n:
        return rows.withColumn("number", F.lit(0).cast("bigint"))
    few = F.broadcast(again) if n <= MAX_BROADCAST_KEYS else again
    once = keyed.join(few, "key", "left_anti").select("doc", "size", F.lit(0).cast("bigint").alias("number"))
    repeated = written(keyed.join(few, "key", "left_semi").withColumn("part", F.spark_partition_id()))
    counts = repeated.groupBy("key", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("key", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("key", "part").orderBy("size")  # of equal rows, any order is the same
    number = F.col("before") + F.row_number().over(within) - 1
    return once.unionByName(repeated.join(before, ["key", "part"]).select("doc", "size", number.cast("bigint").alias("number")))


def mix(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc`` (a struct of its columns), size, source_size, target and copies.

    Null and empty texts have size 0 and are taken as often as the coin says; they add nothing. Null is a source of its
    own, the last in order. Of rows with one id, text and source so many are taken once more as their number times the
    fraction says, one more or less by their common coin; which of them is left open only as far as they are equal. Extra
    columns, whatever their names, stay in ``doc``.
    """
    rows = docs.select(F.struct("*").alias("doc"), word_count(F.col("text")).alias("size"))
    sizes = rows.select(F.col("doc.source").alias("source"), "size")
    table = checkpointed(source_targets(sizes))
    rows = numbered(rows)
    same = rows["doc"]["source"].eqNullSafe(table["source"])
    if table.count() <= MAX_BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(table), same)
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc.doc_id", "doc.text", "number"), F.lit(SALTS)).cast("int"))
        parts = table.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.join(parts, rows["doc"]["source"].eqNullSafe(parts["source"]) & (F.col("salt") == F.col("part")))
    own, fraction = coin(F.col("doc.doc_id"), F.col("doc.text")), F.col("rate") - F.floor("rate")
    # for the first row: one if the coin is below the fraction
    extra = F.ceil((F.col("number") + 1) * fraction - own) - F.ceil(F.col("number") * fraction - own)
    return joined.select("doc", "size", "source_size", "target", (F.floor("rate") + extra).cast("bigint").alias("copies"))


def emit(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs``, with its own columns, as often as it is taken."""
    taken = mix(docs).where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select("doc.*")
