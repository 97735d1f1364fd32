import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from casejobs.llm import quality_rules



def test_quality_stage_with_many_trusted(spark, tmp_path):
    """Trusted documents count however many there are: texts like the last 900 of 21,000, by a hash of the id, stay."""
    n, rng = 21_000, random.Random(6)
    place = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 31))
    late = {r.id for r in spark.range(n).orderBy(place.desc(), F.col("id").desc()).limit(900).collect()} | {n, n + 1}
    rows = [(i, " ".join(rng.choices([f"{'ab'[i in late]}{j}" for j in range(9)], k=60))) for i in range(n + 4)]
    spark.createDataFrame([(i, 1) for i in range(n)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8, "doc_id")
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()}
    assert kept == {r.doc_id for r in quality_rules.quality_rules(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).where("kept").collect()}
    assert {n, n + 1, n + 2, n + 3} <= kept and len(late - kept) < 20


@pytest.mark.usefixtures("compiled")
def test_pipeline_against_single_steps(spark, data, docs, texts):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "secret scan", "mixing", "sentencepiece"]
    kept, stage = docs, {}
    for name, f in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(f(spark, kept, data).collect(), docs.schema)
        assert kept.columns == docs.columns
        stage[name] = Counter(r.doc_id for r in kept.collect())
        last = {r.doc_id: r for r in kept.collect()}
        if name == "secret scan":
            assert any("[SECRET]" in r.text for r in last.values()) == any("[SECRET]" not in t and last[i].text != t for i, t in texts.items() if i in last)
            assert all(r.n_chars == len(r.text) for r in last.values())
    verdict = quality_rules.quality_rules(docs, spark.read.parquet(f"{data}/labels.parquet"))
    assert set(stage["quality rules"]) == {r.doc_id for r in verdict.where(F.col("kept")).collect()}
    assert max(stage["near-dedup"].values()) == 1 and set(stage["near-dedup"]) <= set(stage["quality rules"])
    assert stage["secret scan"] == stage["near-dedup"] and max(stage["mixing"].values()) <= 2
    final = corpus_pipeline.run(spark, data).collect()
    assert Counter(r.doc_id for r in final) == stage["mixing"]
    assert all(r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() and r.n_tokens == len(r.ids) for r in final)
