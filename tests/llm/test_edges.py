"""Every operator takes nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from casejobs.llm import license_scan, mixing, near_dedup, periodic_runs, pii, quality_nbsvm, quality_rules, secret_scan, sentencepiece_codec, simhash_dedup, suffix_dedup, topk

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")

ROWWISE = {
    "sentencepiece": lambda d, _: sentencepiece_codec.sentencepiece_roundtrip(d, MODEL),
    "mixing": lambda d, _: mixing.mix(d).select("doc.doc_id", "size", "source_size", "target", "copies"),
    "suffix": lambda d, _: suffix_dedup.remove_repeats(d),
    "license": lambda d, _: license_scan.license_scan(d),
    "secrets": lambda d, _: secret_scan.secret_scan(d),
    "rules": quality_rules.quality_rules,
    "near": lambda d, _: near_dedup.near_duplicates(d),
    "nbsvm": quality_nbsvm.quality_scores,
    "pii": lambda d, _: pii.personal_data(d),
    "runs": lambda d, _: periodic_runs.periodic_runs(d),
    "simhash": lambda d, _: simhash_dedup.near_duplicates(d),
}


@pytest.mark.parametrize("name", sorted(ROWWISE))
def test_one_result_for_each_row(name, edge, empty, labels):
    ids = sorted(str(r.doc_id) for r in edge.collect())
    assert sorted(str(r.doc_id) for r in ROWWISE[name](edge, labels).collect()) == ids
    assert ROWWISE[name](empty, labels).count() == 0
    assert ROWWISE[name](edge, labels.limit(0)).count() == len(ids)


@pytest.mark.parametrize("keep", [quality_rules.keep_quality, lambda d, _: near_dedup.one_of_each(d), lambda d, _: secret_scan.redact_secrets(d), lambda d, _: mixing.emit(d)])
def test_stages_keep_the_columns(keep, edge, empty, labels):
    out = keep(edge, labels)
    assert out.schema.names == edge.schema.names
    allowed = {tuple(r) for r in edge.collect()}
    assert {tuple(r) for r in out.collect()} <= allowed
    assert keep(empty, labels).count() == 0


def test_empty_texts(edge, labels):
    def of(df, doc_id):
        return next(r for r in df.collect() if r.doc_id == doc_id)

    coded = ROWWISE["sentencepiece"](edge, None)
    assert of(coded, 2).n_tokens == 1 and of(coded, 3).ids_sha256 == of(coded, 2).ids_sha256
    assert of(ROWWISE["suffix"](edge, None), 2).n_bytes == 0
    assert of(ROWWISE["rules"](edge, labels), 4).base_failed
    assert {of(ROWWISE["near"](edge, None), i).class_id for i in (2, 3, 4)} == {2, 3, 4}
    assert len({of(ROWWISE["nbsvm"](edge, labels), i).score for i in (2, 3)}) == 1
    mixed = mixing.mix(edge).select("doc.doc_id", "size", "copies").collect()
    assert {r.size for r in mixed if r.doc_id in (2, 3, 4)} == {0} and max(r.copies for r in mixed) <= 2


def test_topk_edges(spark):
    inf = float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [inf, 1.0]), (None, [1.0, 1.0]), (6, [1.0]), (7, []), (1, [1.0, 0.0]), (40, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({"rank": F.lit(1), "score": F.lit("x"), "c": F.lit(0)})
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 4096), (0, 2, 1, 4096), (20, 1, 0, 2048), (20, 2, 1, 2048), (40, 1, 7, 0)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_pipeline_takes_odd_tables(spark, edge, empty, labels, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns; and no rows at all."""
    for name, table in (("edge", edge), ("empty", empty)):
        folder = f"{tmp_path}/{name}"
        table.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        coded = corpus_pipeline.encode(spark, docs, folder)
        assert sorted(str(r.doc_id) for r in coded.collect()) == sorted(str(r.doc_id) for r in table.collect())
        assert {r.n_tokens for r in coded.collect() if r.doc_id in (2, 3)} <= {1}
        final = corpus_pipeline.run(spark, folder)
        assert final.columns[:2] == ["doc_id", "n_tokens"] and {r.doc_id for r in final.collect()} <= {r.doc_id for r in table.collect()}


def test_ids_at_the_border(spark):
    text = "the same sixty bytes stand in each of these documents, here! "
    rows = [(2**63 - 1, text), (-(2**63), text), (None, text), (None, text), (5, text + "more")]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == sorted([(str(2**63 - 1), 61), (str(-(2**63)), 0), ("None", 61), ("None", 61), ("5", 61)])


def test_training_on_repeated_ids(spark):
    """An id with several labels counts with the least, one with several texts with one of them."""
    docs = spark.createDataFrame([(i, f"good words {i} " * 5 if i % 2 else f"bad noise {i} " * 5) for i in range(60)] + [(1, "other text of the id")] * 50, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0), (None, 1)], "doc_id bigint, quality int")
    rows, known = quality_nbsvm.training_rows(docs, labels)
    again, _ = quality_nbsvm.training_rows(docs.repartition(7), labels.repartition(5))
    assert len(rows) == len(known) == len(again) < 60 and all((a == b).all() for a, b in zip(rows, again))
    few, _ = quality_nbsvm.training_rows(docs, labels, 10)
    assert 0 < len(few) <= 10
