"""A text of some megabytes, one of a single word of that size, and short ones beside them, through operators over texts."""

from __future__ import annotations

import random

import public_tokenizers
import pytest

from quillstone.llm import bestfit, packing, phrases, quality, simhash, toxicity, variants

TOKENS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(3000)]
    long = " ".join(rng.choices(words, k=400_000))  # 2.6 MB
    return [(1, long), (2, "y" * 1_000_000), (3, "a short one"), (4, None), (5, "a short one")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2)


def test_packing(docs):
    total = {r.doc_id: r.n for r in packing.digest(packing.pack(docs, TOKENS)).groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    best = {r.doc_id: r.n for r in bestfit.pack(docs, TOKENS, with_ids=False).groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert total == best and total[1] > 400_000 and total[4] == 1


def test_classifiers(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        got = {r.doc_id: r.score for r in module.classify(docs, labels).collect()}
        assert set(got) == {1, 2, 3, 4, 5} and all(0 <= s <= 1 for s in got.values()) and got[3] == got[5]


def test_copies(docs):
    got = {r.doc_id: r.component_id for r in simhash.result(simhash.near_duplicates(docs)).collect()}
    assert got[3] == got[5] == 3 and got[1] == 1


def test_words(docs):
    found = {r.phrase: r.a for r in phrases.phrases(docs.selectExpr("text", "cast(null as string) lang"), least=2).where("words = 3").collect()}
    assert found["a short one"] == 2
    assert variants.variants(docs).where("length(word) > 100").count() == 0
