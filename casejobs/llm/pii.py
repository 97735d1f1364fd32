"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Entities that follow a format (mail and network addresses, card and phone numbers) are the seeds, each as a whole. The
one to three words on either side of a seed, and the two words around it, are lexical patterns. A pattern that enough
different seeds stand in is looked for in all texts, where it has other instances: any words, with digits or without. The
graph of patterns and instances is scored in rounds: a pattern is as good as the share of its instances that are known, and
an instance is known if one of its patterns is good. What becomes known induces patterns in its turn, until nothing new
comes in. Words in good patterns are identifiers that no format describes.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import checkpointed, written

# The kinds in their order, their patterns, and what a text with a match must hold. Runs that cannot end
# elsewhere are possessive, so no text is tried again and again.
MAIL_CHARS = "[A-Za-z0-9._%+-]"
KINDS = {
    "email": (rf"(?:\G|(?<!{MAIL_CHARS})){MAIL_CHARS}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": (r"[0-9]++(?:[\x20-][0-9]++)*+", r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"

#: An instance outside the seeds has so many characters at least, without marks at its ends.
LEAST_CHARS = 4
#: A pattern of high confidence: the share of its instances that are known, with one more that is not, and how many
#: different ones. Patterns with less than half of that share at once are not followed.
CONFIDENCE = 0.9
SUPPORT = 5
FLOOR = CONFIDENCE / 2
#: Rounds go on until no pattern comes in and the mean confidence rises by no more than this.
STILL = 1e-9
#: Patterns, and documents with identifiers found by them, are broadcast up to this number; the keys of joins beyond it
#: are dealt out so many times.
MAX_BROADCAST = 200_000
SALTS = 16
#: Bits of a filter for each row of its table, and of any filter at most.
BITS_EACH, MOST_BITS = 32, 1 << 20
#: One in so many texts is looked at first, to rule patterns out.
PARTS = 16
#: Rounds of scoring, and of new patterns, at most: each round of either kind takes in something new, so it ends long before.
MAX_ROUNDS = 200

SPAN = "struct<kind:string,start:bigint,end:bigint>"

_HIT = "struct<start:bigint,end:bigint,hit:string,gap:string,next:string>"
#: Matches that one running sum goes over; the sums of these parts run on in an outer one, so that long lists of
#: matches are not copied for each match.
_PART_SIZE = 256
_ALL = 1_000_000_000


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, hit, gap, next) of all matches: positions in code points, the text before and after.

    The pieces between matches and the matches alternate, so a running sum of lengths gives every position.
    """
    gaps = F.split(text, pattern, -1)
    pieces = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.slice(gaps, 2, _ALL).alias("next"))
    n_parts = F.ceil((F.size(gaps)) / F.lit(_PART_SIZE)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n_parts - 1), lambda i: F.struct(i.alias("i")))
    # the pieces stand in an array of one, so that they are made once and not again for each part
    cut = F.flatten(F.transform(F.array(pieces), lambda p: F.transform(parts, lambda i: F.slice(p, i["i"] * _PART_SIZE + 1, _PART_SIZE))))

    def one(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        hit = F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("hit"), x["gap"].alias("gap"), x["next"].alias("next"))
        return F.struct(end.cast("bigint").alias("at"), F.concat(acc["out"], F.array(hit)).alias("out"))

    def part(acc: Column, pieces: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), F.array().cast(f"array<{_HIT}>").alias("out"))
        return F.aggregate(pieces, start, one, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<array<{_HIT}>>").alias("out"))
    found = F.aggregate(cut, start, part, lambda acc: F.flatten(acc["out"]))
    return F.filter(found, lambda m: m["hit"].isNotNull())


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(number)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    n = F.length(digits(hit))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits(hit))).otherwise(F.lit(False))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end) by kind as listed, then start."""
    none = F.array().cast(f"array<{SPAN}>")

    def of_kind(kind: str) -> Column:
        pattern, needs = KINDS[kind]
        hits = F.filter(matches(text, pattern), lambda m: valid(kind, m["hit"]))
        spans = F.transform(hits, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
        return F.when(text.contains(needs) if kind == "email" else text.rlike(needs), spans).otherwise(none)

    return F.concat(*map(of_kind, KINDS))


#: Characters of a piece of text: places are cut out of a few pieces, so that a long text is not walked for each.
_PIECE = 512


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """The characters from start to end of the text that was cut into ``pieces``."""
    first, last = F.floor(start / _PIECE).cast("int"), F.floor(end / _PIECE).cast("int")
    two = F.concat(F.coalesce(F.get(pieces, first), F.lit("")), F.coalesce(F.get(pieces, first + 1), F.lit("")))
    # a slice goes over all pieces
    some = F.when(last - first < 2, two).otherwise(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""))
    return F.substring(some, (start - first * _PIECE + 1).cast("int"), (end - start).cast("int"))


#: Stands for a seed in a text; the same character in a text itself is another one.
_MARK, _OTHER = "\x01", "\x02"
_PIECES = "array<struct<start:bigint,end:bigint,kind:string,before:bigint>>"


def _apart(base: Column) -> Column:
    """Base spans by start as (start, end, kind, before), each without what an earlier one covers; ``before`` is the
    place where the one before it ends."""
    by_start = F.array_sort(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    none = F.array().cast(_PIECES)

    def one(acc: Column, s: Column) -> Column:
        start = F.greatest(s["start"], acc["at"])
        new = F.array(F.struct(start.alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), acc["at"].alias("before")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["end"] > start, F.concat(acc["out"], new)).otherwise(acc["out"]).alias("out"))

    def part(acc: Column, spans: Column) -> Column:
        begin = F.struct(acc["at"].alias("at"), none.alias("out"))
        return F.aggregate(spans, begin, one, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    numbers = F.transform(F.sequence(F.lit(0), F.floor(F.size(base) / _PART_SIZE).cast("int")), lambda i: F.struct(i.alias("i")))
    cut = F.flatten(F.transform(F.array(by_start), lambda p: F.transform(numbers, lambda i: F.slice(p, i["i"] * _PART_SIZE + 1, _PART_SIZE))))
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{_PIECES}>").alias("out"))
    return F.aggregate(cut, begin, part, lambda acc: F.flatten(acc["out"]))


def _masked(text: Column, seeds: Column, mask: Callable[[Column, Column], Column]) -> Column:
    """The text with each seed (start, end, kind, before) replaced by what ``mask`` makes of it and its characters."""
    plain = F.replace(text, F.lit(_MARK), F.lit(_OTHER))

    def of(pieces: Column) -> Column:
        parts = F.transform(seeds, lambda s: F.concat(_cut(pieces, s["before"], s["start"]), mask(s, _cut(pieces, s["start"], s["end"]))))
        return F.concat(F.array_join(parts, ""), _cut(pieces, F.element_at(seeds, -1)["end"], F.length(text).cast("bigint")))

    # the pieces stand in an array of one, so that they are made once and not again for each seed
    pieces = F.array(F.regexp_extract_all(plain, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)))
    return F.when(F.size(seeds) > 0, F.element_at(F.transform(pieces, of), 1)).otherwise(plain)


def _with_values(text: Column, seeds: Column) -> Column:
    """Each seed as its value in one way of writing, between marks, as one word.

    Numbers count by their digits, so a number that stands elsewhere without its format is a known instance, too.
    """

    def value(s: Column, hit: Column) -> Column:
        plain = F.regexp_replace(hit, r"(?<![0-9])0+(?=[0-9])", "")
        own = F.when(s["kind"] == "email", F.lower(hit)).when(s["kind"] == "ip", plain).otherwise(digits(hit))
        return F.concat(F.lit(_MARK), own, F.lit(_MARK))

    return _masked(text, seeds, value)


def _with_blots(text: Column, seeds: Column) -> Column:
    """Each seed as so many marks, so that words have the same numbers as in ``_with_values`` and stand at their places."""
    return _masked(text, seeds, lambda s, _: F.repeat(F.lit(_MARK), (s["end"] - s["start"]).cast("int")))


_OUTER = r"^[^\p{L}\p{N}+]++|[^\p{L}\p{N}]++$"


def _bits(table: DataFrame, column: str, n: int) -> Callable[[Column], Column]:
    """Whether a hash may be in the column of a table of some ``n`` rows; one that is in it always may.

    A bitmap of 128 KB at most, whatever the table's size; what it lets pass is joined with the table itself.
    """
    bits = min(MOST_BITS, 1 << max(10, (BITS_EACH * n).bit_length()))

    def place(h: Column) -> tuple[Column, Column]:
        at = F.pmod(h, F.lit(bits))
        return F.shiftright(at, 6).cast("int"), at.bitwiseAND(63).cast("int")

    slot, bit = place(F.col(column))
    rows = table.select(slot.alias("slot"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("set"))
    longs = [0] * (bits // 64)
    for r in rows.collect():
        longs[r["slot"]] = r["set"]
    bitmap = F.split(F.lit(",".join(map(str, longs))), ",").cast("array<bigint>")  # folded to one literal

    def may(h: Column) -> Column:
        slot, bit = place(h)
        return F.getbit(F.get(bitmap, slot), bit) == 1

    return may


def word_contexts(rows: DataFrame, chosen: Callable[[Column], Column], steps: tuple[int, ...] = (0,)) -> DataFrame:
    """One row for each word of ``rows`` (doc_id, text_hash, words) that has a ``chosen`` word one of the ``steps`` away.

    ``at`` is its number (from 0), ``token`` its instance, ``seed`` whether it has one. ``patterns`` are the hashes of its
    patterns, each with ``near``, that of the neighbour it begins with. Words that aren't chosen never become rows.
    """
    names = ("l3", "l2", "l1", "w", "r1", "r2", "r3")

    def numbers(flags: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: functools.reduce(operator.or_, (F.get(flags, i + k) for k in steps)) & (F.get("words", i) != ""))

    # the flags stand in an array of one, so that they are made once and not again for each word
    at = F.element_at(F.transform(F.array(F.transform("words", chosen)), numbers), 1)
    around = F.transform(at, lambda i: F.struct(i.alias("at"), *(F.coalesce(F.get("words", i + k - 3), F.lit("")).alias(x) for k, x in enumerate(names))))
    # the outer form, since for the other Spark first looks which arrays are empty, and makes them twice for that
    each = rows.select("doc_id", "text_hash", F.explode_outer(around).alias("x")).where("x IS NOT NULL").select("doc_id", "text_hash", "x.*")

    def pattern(kind: str, *words: str) -> Column:
        there = F.col(words[0]) != "" if len(words) == 1 else (F.col(words[0]) != "") & (F.col(words[-1]) != "")
        return F.struct(F.when(there, F.xxhash64(F.lit(kind), *words)).alias("pattern"), F.xxhash64("l1" if "l1" in words else "r1").alias("near"))

    kinds = [("l1", "l1"), ("r1", "r1"), ("l2", "l2", "l1"), ("l3", "l3", "l2", "l1"), ("r2", "r1", "r2"), ("r3", "r1", "r2", "r3"), ("b", "l1", "r1")]
    patterns = F.filter(F.array(*(pattern(*k) for k in kinds)), lambda p: p["pattern"].isNotNull())
    return each.select("doc_id", "text_hash", "at", _token(F.col("w")).alias("token"), F.col("w").contains(_MARK).alias("seed"), patterns.alias("patterns")).where("token IS NOT NULL")


def _token(word: Column) -> Column:
    """A word's instance: the seed's value, or the word without marks at its ends; null if it is too short."""
    seed = F.regexp_extract(word, f"{_MARK}([^{_MARK}]+){_MARK}", 1)
    bare = F.regexp_replace(word, _OUTER, "")
    return F.when(word.contains(_MARK), seed).when(F.length(bare) >= LEAST_CHARS, bare)


def _small(table: DataFrame, n: int) -> DataFrame:
    return F.broadcast(table) if n <= MAX_BROADCAST else table


def _found_in(rows: DataFrame, table: DataFrame, key: str, n: int) -> DataFrame:
    """Rows whose key is in the table of ``n`` keys: by a broadcast, or by salted keys, so that a frequent one is many."""
    if n <= MAX_BROADCAST:
        return rows.join(F.broadcast(table.select(key)), key, "left_semi")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("text_hash", "at"), F.lit(SALTS)))
    each = table.select(key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    return salted.join(each, [key, "salt"], "left_semi").drop("salt")


def instances(rows: DataFrame, patterns: DataFrame, n: int) -> DataFrame:
    """(doc_id, text_hash, at, token, seed, pattern) of the words that stand in one of the ``n`` patterns (pattern, near)."""
    may, may_be = _bits(patterns, "near", n), _bits(patterns, "pattern", n)
    some = word_contexts(rows, lambda w: may(F.xxhash64(w)), (-1, 1)).withColumn("patterns", F.filter("patterns", lambda p: may_be(p["pattern"])))
    each = some.select("doc_id", "text_hash", "at", "token", "seed", F.explode_outer("patterns.pattern").alias("pattern"))
    return _found_in(each.where("pattern IS NOT NULL"), patterns, "pattern", n)


def score_graph(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Patterns with their confidence, from edges (pattern, token; n, how often) and known instances (token).

    Each round: confidence = known instances / (all instances + 1), by different instances or by how often they stand
    there, whichever is less, so that one word that stands there often counts; score of an instance = its best pattern's
    confidence, if that is high and enough different known instances support the pattern. Scores only rise from round to
    round, and the rounds end when nothing changes any more; ``MAX_ROUNDS`` without an end are an error.
    """
    edges = edges if "n" in edges.columns else edges.withColumn("n", F.lit(1))
    edges = checkpointed(edges.join(known.select("token", F.lit(1.0).alias("own")).distinct(), "token", "left"))
    scored, last = edges.withColumn("score", F.col("own")), (0, 0.0)
    for _ in range(MAX_ROUNDS):
        score = F.coalesce("score", F.lit(0.0))
        share = F.least(F.sum(score) / (F.count("*") + 1), F.sum(score * F.col("n")) / (F.sum("n") + 1))
        patterns = scored.groupBy("pattern").agg(share.alias("confidence"), F.count("score").alias("support"))
        good = checkpointed(patterns.where((F.col("confidence") >= CONFIDENCE) & (F.col("support") >= SUPPORT)))
        n, total = good.agg(F.count("*"), F.coalesce(F.sum("confidence"), F.lit(0.0))).first()
        if n == last[0] and total - last[1] <= STILL * n:
            return good
        last = n, total
        grown = edges.where("own IS NULL").join(good, "pattern").groupBy("token").agg(F.max("confidence").alias("grown"))
        scored = edges.join(grown, "token", "left").withColumn("score", F.coalesce("own", "grown"))
    raise RuntimeError(f"scores still rise after {MAX_ROUNDS} rounds")


def good_patterns(rows: DataFrame) -> tuple[DataFrame, int]:
    """Patterns (pattern, near) of high confidence with their number, by rounds over all ``rows`` (doc_id, text_hash, words).

    Each round takes the patterns that enough different known instances stand in, drops those whose instances are mostly
    unknown, scores the graph of the others, and ends if no instance becomes known that was not; ``MAX_ROUNDS`` without an
    end are an error. A pattern with too many unknown instances in a part of the texts has them in all, so a part is
    looked at first: frequent words fall there, and few words of all texts stand beside what is left.
    """
    each = "token", F.explode_outer("patterns").alias("x")
    of_seeds = word_contexts(rows.where("has_seeds"), lambda w: w.contains(_MARK))
    held = checkpointed(of_seeds.select(*each).select("x.*", "token").where("pattern IS NOT NULL").distinct())
    known = held.select("token").distinct()

    def likely(candidates: DataFrame, edges: DataFrame, n: int) -> DataFrame:
        """Candidates without those that these edges rule out."""
        of_all = edges.groupBy("pattern").agg(F.count("*").alias("n_all"))
        return candidates.join(_small(of_all, n), "pattern", "left").where(F.col("n_known") >= FLOOR * F.coalesce("n_all", F.lit(0))).drop("n_all")

    for _ in range(MAX_ROUNDS):
        candidates = checkpointed(held.groupBy("pattern").agg(F.min("near").alias("near"), F.count("*").alias("n_known")).where(F.col("n_known") >= SUPPORT))
        n = candidates.count()
        if n:
            part = rows.where(F.pmod("text_hash", F.lit(PARTS)) == 0)
            candidates = checkpointed(likely(candidates, instances(part, candidates, n).select("pattern", "token").distinct(), n))
            n = candidates.count()
        if not n:
            return candidates.select("pattern", "near"), 0
        edges = checkpointed(instances(rows, candidates, n).groupBy("pattern", "token").agg(F.count("*").alias("n")))
        candidates = checkpointed(likely(candidates, edges, n).select("pattern", "near"))
        edges = edges.join(_small(candidates.select("pattern"), n), "pattern", "left_semi")
        good = score_graph(edges, known).select("pattern")
        n = good.count()
        good = candidates.join(_small(good, n), "pattern", "left_semi")
        new = checkpointed(edges.join(_small(good.select("pattern"), n), "pattern", "left_semi").select("token").distinct().join(known, "token", "left_anti"))
        n_new = new.count()
        if not n_new:
            return good, n
        # patterns that the new instances stand in, wherever they do
        may = _bits(new.select(F.xxhash64("token").alias("hash")), "hash", n_new)
        named = _found_in(word_contexts(rows, lambda w: may(F.xxhash64(_token(w)))), new, "token", n_new)
        held = checkpointed(held.union(named.select(*each).select("x.*", "token").where("pattern IS NOT NULL")).distinct())
        known = checkpointed(known.union(new))
    raise RuntimeError(f"instances still become known after {MAX_ROUNDS} rounds")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``base`` and ``spans``, arrays of (kind, start, end).

    ``base`` has the formats' spans by kind, then start; ``spans`` has those and the ones found by context (kind
    ``context``), single words without marks at their ends, which never overlap a base span. Null texts count as empty.
    Repeated rows give repeated results; rows with the same id but other texts are told apart by their text's hash.
    Patterns are told apart by 64-bit hashes. Other columns are left out.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def split(seeds: Column) -> Column:
        return F.split(F.lower(F.btrim(_with_values(F.col("text"), seeds), F.lit(" \t\n\v\f\r"))), r"[\x20\x09-\x0D]+")

    # each step's result stands in an array of one, so that it is made once
    spans = F.transform(F.array(base_spans(F.col("text"))), lambda base: F.struct(base.alias("base"), _apart(base).alias("seeds")))
    made = F.transform(spans, lambda x: F.struct(x["base"].alias("base"), x["seeds"].alias("seeds"), split(x["seeds"]).alias("words")))
    found = written(texts.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.element_at(made, 1).alias("x")).select("doc_id", "text", "text_hash", "x.*"))
    words = found.select("doc_id", "text_hash", "words", (F.size("seeds") > 0).alias("has_seeds"))
    good, n = good_patterns(words)
    if not n:
        return found.select("doc_id", "base", F.col("base").alias("spans"))

    places = instances(words, good, n).where("NOT seed").groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("at"))
    places = checkpointed(places)
    n_places = places.count()
    here = (F.col("l.doc_id").eqNullSafe(F.col("r.doc_id"))) & (F.col("l.text_hash") == F.col("r.text_hash"))
    within = found.alias("l").join(_small(places, n_places).alias("r"), here).select("l.doc_id", "l.text_hash", "at", _with_blots(F.col("text"), F.col("seeds")).alias("text"))

    def span(m: Column) -> Column:
        begin = m["start"] + F.length(F.regexp_extract(m["hit"], r"^[^\p{L}\p{N}+]*+", 0))
        bare = F.regexp_replace(m["hit"], _OUTER, "")
        return F.struct(F.lit("context").alias("kind"), begin.cast("bigint").alias("start"), (begin + F.length(bare)).cast("bigint").alias("end"))

    hits = matches(F.col("text"), r"[^\x20\x09-\x0D]++")
    new = F.transform(F.array(hits), lambda h: F.transform("at", lambda i: span(F.get(h, i))))
    new = within.select("doc_id", "text_hash", F.array_sort(F.flatten(new)).alias("new")).groupBy("doc_id", "text_hash").agg(F.min("new").alias("new"))
    joined = found.select("doc_id", "text_hash", "base").alias("l").join(new.alias("r"), here, "left")
    return joined.select("l.doc_id", "base", F.concat("base", F.coalesce("new", F.array().cast(f"array<{SPAN}>"))).alias("spans"))


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
