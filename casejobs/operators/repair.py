"""Repair of titles and snippets by rules on the case id; the first rule that fits counts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C


def repair_fixed(cases: DataFrame, rules: tuple = C.REPAIR_RULES) -> DataFrame:
    """A few fixed rules, as one expression without a shuffle."""
    title, snippet = F.col("title"), F.col("translation_snippet")
    for pattern, new_title, new_snippet in reversed(rules):
        fits = F.coalesce(F.col("case_id").contains(pattern), F.lit(False))
        title, snippet = F.when(fits, new_title).otherwise(title), F.when(fits, new_snippet).otherwise(snippet)
    return cases.withColumns({"title": title, "translation_snippet": snippet})


#: So many rules at most are tried one by one on each case; more are looked up by parts of their patterns.
FEW_RULES = 64
#: Characters of such a part.
PART = 3
_RULE = ("priority", "pattern", "title", "translation_snippet")


def repair_by_rules(cases: DataFrame, rules: DataFrame) -> DataFrame:
    """Title and snippet of each case by the first rule (priority, pattern, title, translation_snippet) whose pattern its
    case_id contains; without one, or without an id, the case stays as it is.

    Rules of one priority come in the order of their patterns, titles and snippets. An empty pattern is in every id, a null one
    in none.
    """
    usable = rules.where("pattern IS NOT NULL").select(F.struct(*_RULE).alias("rule"))
    rows = _by_trying(cases, usable) if usable.count() <= FEW_RULES else _by_parts(cases, usable)
    return rows.withColumns({c: F.when(F.col("fit").isNotNull(), F.col(f"fit.{c}")).otherwise(F.col(c)) for c in ("title", "translation_snippet")}).drop("fit")


def _by_trying(cases: DataFrame, rules: DataFrame) -> DataFrame:
    """The few rules as one array beside each case; nothing moves."""
    ordered = rules.agg(F.array_sort(F.collect_list("rule")).alias("rules"))
    fit = F.get(F.filter("rules", lambda r: F.contains(F.col("case_id"), r["pattern"])), F.lit(0))
    return cases.join(F.broadcast(ordered)).withColumn("fit", fit).drop("rules")


def _parts(text: Column, size: Column) -> Column:
    """The distinct stretches of so many characters; null if the text is shorter."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size))))


def _by_parts(cases: DataFrame, rules: DataFrame) -> DataFrame:
    """Ids and patterns meet by an equi-join: a pattern is looked up by the one of its parts that the fewest ids have.

    Parts have ``PART`` characters, or a shorter pattern's own length. A pattern with a part that no id has drops out
    at once. Pairs that meet are verified, and each id keeps the first rule by a partial minimum.
    """
    size = F.least(F.lit(PART), F.length("rule.pattern"))
    sized = rules.where("rule.pattern <> ''").withColumn("size", size)
    sizes = [r[0] for r in sized.select("size").distinct().collect()]  # PART at most
    ids = cases.where("case_id IS NOT NULL").select("case_id").distinct()
    parts = F.concat(*(F.coalesce(_parts(F.col("case_id"), F.lit(s)), F.array().cast("array<string>")) for s in sizes)) if sizes else F.array().cast("array<string>")
    looked_up = ids.select("case_id", F.explode(parts).alias("part"))
    asked = sized.select("rule", F.explode(_parts(F.col("rule.pattern"), F.col("size"))).alias("part"))
    count = looked_up.groupBy("part").agg(F.count("*").alias("n"))
    counted = asked.join(count, "part", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy("rule").agg(F.min_by("part", F.struct("n", "part")).alias("part"), F.min("n").alias("n")).where("n > 0")
    met = looked_up.join(rarest.select("rule", "part"), "part").where(F.contains("case_id", F.col("rule.pattern")))
    fits = met.groupBy("case_id").agg(F.min("rule").alias("fit"))
    everywhere = rules.where("rule.pattern = ''").agg(F.min("rule").alias("always"))  # one row
    found = cases.join(fits, "case_id", "left").select(*cases.columns, "fit").join(F.broadcast(everywhere))
    always = F.when(F.col("case_id").isNotNull(), F.col("always"))
    return found.withColumn("fit", F.least("fit", always)).drop("always")
