"""Text search for many terms in an index of stretches of three characters, made once and read by term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch

SEARCHED = ("id", "title", "location")
GRAM = 3
_TABLES = {"rows": "number bigint, id string, title string, location string", "postings": "gram string, number bigint, part int", "counts": "gram string, n bigint"}
#: Postings are in so many parts by a hash of the stretch; terms read the parts of their own stretches only.
PARTS = 16
#: Rows of a file of the searched columns: short texts in few files would be read by few tasks.
FILE_ROWS = 50_000
#: A table with more rows than this is not copied to all tasks, however small its files are.
FEW = 5_000
#: What the terms that are looked up together have in common: a stretch, where in the term it begins (from 0), and the term's size.
_SHAPE = ("gram", "at", "size")
_ASKED = "term string, low string, size int, gram string, at int"


def _stretches(text: Column, size: int) -> Column:
    """The distinct stretches of so many characters in lower case; none of a shorter or null text."""
    low = F.lower(text)
    starts = F.sequence(F.lit(1), F.length(low) - size + 1)
    found = F.when(F.length(low) >= size, F.transform(starts, lambda i: F.substring(low, i, size)))
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def _of_row(size: int) -> Column:
    return F.array_distinct(F.concat(*(_stretches(F.col(c), size) for c in SEARCHED)))


def _part(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


def _read(spark: SparkSession, target: str, name: str) -> DataFrame:
    return spark.read.schema(_TABLES[name]).parquet(f"{target}/{name}")


def _around(low: Column) -> Column:
    """The distinct stretches of a text that are of the shape's size and have its stretch where the shape has it."""
    starts = F.sequence(F.lit(1), F.length(low) - F.col("size") + 1)
    hits = F.filter(starts, lambda i: F.substring(low, i + F.col("at"), GRAM) == F.col("gram"))
    found = F.when((F.length(low) >= F.col("size")) & F.contains(low, F.col("gram")), F.transform(hits, lambda i: F.substring(low, i, F.col("size"))))
    return F.coalesce(found, F.array().cast("array<string>"))


def _beside(df: DataFrame, rows: int) -> DataFrame:
    """The table as the smaller side of a join: few rows are copied to all tasks, more are dealt out by the key.

    Spark would judge by the size of the files, of which 10 MB can hold more rows than the driver has room for.
    """
    return F.broadcast(df) if rows <= FEW else df.hint("merge")


def write_index(catalog: DataFrame, target: str) -> None:
    """Writes the searched columns under numbers of their own, the postings (stretch, number) and how many each stretch has."""
    spark = catalog.sparkSession
    catalog.select(F.monotonically_increasing_id().alias("number"), *SEARCHED).write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{target}/rows")
    rows = _read(spark, target, "rows")
    postings = rows.select(F.explode(_of_row(GRAM)).alias("gram"), "number").withColumn("part", _part(F.col("gram")))
    # a stretch that all rows have is dealt over several tasks by the number, too
    dealt = postings.repartition("part", F.pmod("number", F.lit(8))).sortWithinPartitions("part", "gram")
    dealt.write.mode("overwrite").partitionBy("part").parquet(f"{target}/postings")
    stored = _read(spark, target, "postings")
    stored.groupBy("gram").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{target}/counts")


def _asked(spark: SparkSession, target: str, terms: DataFrame) -> DataFrame:
    """The distinct terms, each with the stretch it is looked up by and where that begins (null: shorter than a stretch).

    The rows of a stretch are read once for all terms of one shape, so a term takes the stretch with the fewest rows for each
    term that shares the shape. Terms with a stretch that no row has find nothing and are left out.
    """
    asked = terms.where("term IS NOT NULL").select("term", F.lower("term").alias("low")).distinct().withColumn("size", F.length("low"))
    starts = F.sequence(F.lit(1), F.col("size") - GRAM + 1)
    stretches = F.transform(starts, lambda i: F.substring("low", i, GRAM))
    grams = asked.where(F.col("size") >= GRAM).select("term", "low", "size", F.posexplode(stretches).alias("at", "gram"))
    shapes = grams.groupBy(*_SHAPE).agg(F.count("*").alias("sharing")).join(_read(spark, target, "counts").hint("merge"), "gram", "left")
    priced = grams.join(shapes.select(*_SHAPE, (F.coalesce("n", F.lit(0)) / F.col("sharing")).alias("price")).hint("merge"), [*_SHAPE])
    chosen = priced.groupBy("term", "low", "size").agg(F.min(F.struct("price", "gram", "at")).alias("by")).where("by.price > 0")
    path = scratch(spark, "asked")
    short = asked.where(F.col("size") < GRAM)
    chosen.select("term", "low", "size", "by.gram", "by.at").unionByName(short, allowMissingColumns=True).write.parquet(path)
    return spark.read.schema(_ASKED).parquet(path)


def search_many(spark: SparkSession, target: str, terms: DataFrame) -> DataFrame:
    """term, id, title and location of the rows that each distinct term (``terms``: term) finds, as ``search_cases`` finds them.

    A term of three characters or more is looked up by one of its stretches. Terms of one size that have the same stretch at
    the same place are looked up together: what stands around that stretch in a row meets the terms as a whole, so that rows
    don't meet terms that they only share the stretch with. Shorter ones meet the stretches of their own length of all rows;
    an empty one finds rows that have any of the columns. A null term finds nothing.
    """
    rows = _read(spark, target, "rows")
    asked = _asked(spark, target, terms)
    shapes = asked.where("gram IS NOT NULL").select(*_SHAPE).distinct()
    parts = dict(shapes.groupBy(_part(F.col("gram"))).count().collect())  # PARTS at most
    looked_up = _read(spark, target, "postings").where(F.col("part").isin(list(parts))).select("gram", "number")
    met = looked_up.join(_beside(shapes, sum(parts.values())), "gram").join(rows.hint("merge"), "number")
    lowered = met.select(*_SHAPE, *SEARCHED, *(F.lower(c).alias(f"low_{c}") for c in SEARCHED))
    around = F.array_distinct(F.concat(*(_around(F.col(f"low_{c}")) for c in SEARCHED)))
    whole = lowered.select("gram", "at", *SEARCHED, F.explode(around).alias("low"))
    # a term is met at its own shape only: once in a row
    found = whole.join(_beside(asked, asked.count()), ["low", "gram", "at"])
    for size in range(1, GRAM):
        short = asked.where(F.col("size") == size).select("term", F.col("low").alias("gram"))
        found = found.unionByName(rows.select("*", F.explode(_of_row(size)).alias("gram")).join(_beside(short, short.count()), "gram"), allowMissingColumns=True)
    some = " OR ".join(f"{c} <> ''" for c in SEARCHED)
    every = rows.where(some).join(F.broadcast(asked.where("size = 0").select("term")))  # one row at most
    return found.select("term", *SEARCHED).unionByName(every.select("term", *SEARCHED))
