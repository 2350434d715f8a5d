"""N-grams counted within rows; patterns behind plain strings."""

from pyspark.sql import functions as F

from quillstone.functions import text
from quillstone.operators import scoring

ROWS = [(1, "the cat the cat the"), (2, None), (3, ""), (4, "é"), (5, "ab"), (None, "ab cd"), (7, "ab cd ab"), (7, "ab cd"), (None, "ab cd")]


def test_counts_within_rows_need_no_shuffle_of_grams(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    pairs = {(r.doc_id, r.gram): r.n for r in scoring.word_pairs(docs, "doc_id").collect()}
    assert pairs == {(1, "the cat"): 2, (1, "cat the"): 2, (None, "ab cd"): 2, (7, "ab cd"): 2, (7, "cd ab"): 1}
    threes = {(r.doc_id, r.gram): r.n for r in scoring.character_threes(docs, "doc_id").collect()}
    want = docs.select("doc_id", F.explode(text.char_ngrams(F.col("text"), 3, 3)).alias("gram")).groupBy("doc_id", "gram").count()
    assert threes == {(r.doc_id, r.gram): r["count"] for r in want.collect()}
    plan = scoring.word_pairs(docs.where("doc_id < 6"), "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" not in plan and "hashpartitioning(gram" not in plan


def test_lists_are_cut_by_their_elements(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([["a"] * 4, None, [], ["b"] * 9, ["c"], ["d"]])], ["k", "w"])
    parts = list(scoring._sliced(batch, 5))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1, 2], [3], [4, 5]]


def test_weak_categories_are_those_of_the_patterns_alone(spark):
    import re

    lines = ["what's up", "whats", "somewhat s", "why didn't you", "whyever", "I didnt ever\ntest", "i didn't TEST", "docs", "doc", "do cs", "stop it, doing", "stop\ndoing", "guilty", "a ui", "the bathe", "bathe", "THE", ""]
    rows = spark.createDataFrame([(x,) for x in lines], "t string").select("t", text.weak_categories(F.col("t")).alias("c"), text.matched_words(F.col("t"), ["the", "up", "up"]).alias("m")).collect()
    for r in rows:
        low = r.t.lower()
        assert r.c == [k for k, ps in text.WEAK_CATEGORIES.items() if any(re.search(p, low) for p in ps)], r.t
        assert r.m == sorted(set(re.findall("[a-z]+", low)) & {"the", "up"})
    plan = rows and spark.range(1).select(text.weak_categories(F.lit("x").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert "Contains" in plan or "contains" in plan
