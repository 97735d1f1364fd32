"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, license_scan, mixing, near_dedup, periodic_runs, pii, quality_nbsvm, quality_rules, secret_scan, sentencepiece_codec, simhash_dedup, suffix_dedup, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.sentencepiece_roundtrip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_scan(_table(spark, sf_dir, "documents"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"]))), ",")
    places = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["family"], x["line"].cast("string"))), ",")
    return found.select("doc_id", F.size("found").cast("bigint").alias("n_paragraphs"), names.alias("families"), places.alias("paragraphs"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_scan(_table(spark, sf_dir, "documents"))
    base = [r.kind for r in secret_scan.RULES if r.base]
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    counts = [pii.count_kind("spans", k).alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(pii.spans_text(own).cast("binary"), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_nbsvm.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(_table(spark, sf_dir, "documents"))
    base = pii.spans_text(F.col("base"))
    return found.select("doc_id", *(pii.count_kind("base", k).alias(f"n_{k}") for k in pii.KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def repeated_words(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word stands at each place: in every tenth document by a hash of its id, words from some place on repeat."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(_table(spark, sf_dir, "documents"), repeated_words)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    most = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), most.alias("most"), F.array_join(lines, "").alias("lines"), "collapsed")
    longest = {"start": -F.col("most.start"), "length": F.col("most.length"), "period": -F.col("most.period")}
    longest["exponent_milli"] = F.floor(F.lit(1000) * longest["length"] / longest["period"]).cast("bigint")
    digests = {f"{name}_sha256": F.sha2(F.col(c).cast("binary"), 256) for name, c in (("runs", "lines"), ("collapsed", "collapsed"))}
    return rows.select("doc_id", "n_runs", *(c.alias(n) for n, c in (longest | digests).items()))


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_mixing": op2_mixing,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_license_scan": op4_license_scan,
        "op5_secret_scan": op5_secret_scan,
        "op6_exact_topk": op6_exact_topk,
        "op7_quality_rules": op7_quality_rules,
        "op8_near_dedup": op8_near_dedup,
        "op9_quality_nbsvm": op9_quality_nbsvm,
        "op10_personal_data": op10_personal_data,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_simhash_dedup": op13_simhash_dedup,
    }


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
m AS (SELECT *, 2.0::DOUBLE * source_size AS most FROM w),
l AS (SELECT *, most / weight AS edge, row_number() OVER (ORDER BY most / weight, source COLLATE "C" ASC NULLS LAST) AS place,
    (1.5::DOUBLE * (SELECT sum(source_size)::BIGINT FROM m)
      - coalesce(sum(most) OVER (ORDER BY most / weight, source COLLATE "C" ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY most / weight, source COLLATE "C" ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM m),
v AS (SELECT level FROM l WHERE edge >= level ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, least(most, coalesce((SELECT level FROM v) * weight, most)) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t),
c AS (SELECT d.*, r.source_size, r.target, floor(r.rate) AS whole, r.rate - floor(r.rate) AS part,
    row_number() OVER (PARTITION BY d.doc_id, d.text, d.source) AS number,
    ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null') || ':' || coalesce(d.text, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS coin
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, size * (whole + ceil(number * part - coin) - ceil((number - 1) * part - coin))::BIGINT AS taken FROM c
"""


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INT AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON p.anchor_id = n.anchor_id AND NOT n.same AND 100 * n.score BETWEEN 30 * p.score AND 90 * p.score
QUALIFY rank <= 10
"""


#: Equal words at most a quarter of the text apart, put together where they follow each other at one distance. The table of
#: crc32 follows from its polynomial.
OP12_SQL = r"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) AS x(i))),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM documents, crc),
g AS (SELECT *, len(words)::BIGINT AS n, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
m AS (SELECT doc_id, n, CASE WHEN n > 0 AND h % 10 = 0 THEN list_transform(range(n), lambda i: words[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1]) ELSE words END AS words FROM p),
w AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(words) AS word FROM m),
e AS (SELECT x.doc_id, y.i - x.i AS q, x.i AS i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i AND y.i - x.i <= x.n // 4),
f AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM f GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY ALL),
o AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines, max({'length': length, 'start': -start, 'period': -period}) AS most FROM r GROUP BY doc_id),
k AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM w ANTI JOIN (SELECT doc_id, unnest(range(start + period, start + length)) AS i FROM r) z ON w.doc_id = z.doc_id AND w.i = z.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, -most.start AS start, most.length AS length, -most.period AS period, 1000 * most.length // -most.period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.words, '')) AS collapsed_sha256
FROM d LEFT JOIN o ON d.doc_id = o.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2_SQL, "op6_exact_topk": OP6_SQL, "op11_hard_negatives": OP11_SQL, "op12_periodic_runs": OP12_SQL}
