import pytest

EDGE = "doc_id bigint, text string, lang string, source string, n_chars bigint, n int, key string, block int, node bigint, size string, doc string"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and blank texts, a very long text and a very long word, repeated rows and ids, clashing columns."""
    rows = [
        (1, "a plain text of some words " * 20, "en", "s1"), (1, "a plain text of some words " * 20, "en", "s1"), (1, "another text with the same id " * 9, "en", "s1"),
        (2, None, None, None), (3, "", "en", "s2"), (4, " \n\t ", "en", None), (None, "no id here, but words " * 8, "en", "s2"), (None, None, None, "s2"),
        (5, "w" * 70_000, "en", "s3"), (6, " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000)), "en", "s1"), (7, "tiny", "en", "s9"), (8, "é中𓀀 \x00 ▁ ﻿", "xx", "s9"),
    ]
    return spark.createDataFrame([(*r, 1, 5, "k", 2, 9, "x", "d") for r in rows], EDGE)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], EDGE)


@pytest.fixture(scope="session")
def labels(spark, data):
    return spark.read.parquet(f"{data}/labels.parquet")


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture
def compiled(spark):
    """Whole-stage compiling, as in production; the other tests go without, since it takes longer than their small tables."""
    name = "spark.sql.codegen.wholeStage"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    yield
    spark.conf.set(name, before)
