import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import mtree


def brute(rows, k=5, every=50):
    clean = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        clean.append((i, [math.floor(256 * float(x)) for x in v]))
    out = []
    for place, (q, v) in enumerate(clean):
        if q % every == 0:
            scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))), i) for other, (i, w) in enumerate(clean) if other != place)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(frame, every=50):
    return sorted(tuple(r) for r in mtree.top_k(mtree.integers(frame), F.col("vec_id") % every == 0).collect())


@pytest.mark.parametrize("rows", [32768, 90])
def test_embeddings_against_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(mtree, "ROWS", rows)
    monkeypatch.setattr(mtree, "QUERIES", 4)
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert run(frame) == brute([(r.vec_id, r.embedding) for r in frame.collect()])


def test_pages_are_skipped():
    rng = np.random.default_rng(3)
    centres = rng.integers(-500, 500, (30, 8))
    vectors = (np.repeat(centres, 100, 0) + rng.integers(-5, 6, (3000, 8))).astype(np.int16)
    tree = mtree.MTree(np.arange(3000), vectors)
    seen = 0
    for own in range(0, 3000, 100):
        q = vectors[own].astype(np.int64)
        best, computed = tree.best(q, own, 5)
        scores = vectors.astype(np.int64) @ q
        want = sorted((-int(s), i) for i, s in enumerate(scores) if i != own)[:5]
        assert best == want
        seen += computed
    assert seen < 30 * 3000 / 3


def test_odd_vectors(spark):
    rows = [(0, [0.5, 0.25]), (50, [0.5, 0.25]), (50, [0.5, 0.25]), (1, [0.5, 0.25]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (100, []), (6, [1.0]), (7, [0.0, 0.0]), (None, [1.0, 1.0]), (8, [-1e30, 1.0])]
    frame = spark.createDataFrame(rows[:-1], "vec_id long, embedding array<double>").selectExpr("*", "1 as v", "2 as block", "3 as row", "4 as part")
    assert run(frame) == brute(rows[:-1])
    assert run(frame.limit(0)) == []
    assert run(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == brute(rows)
    same = spark.createDataFrame([(i, [0.1, 0.2]) for i in range(700)], "vec_id long, embedding array<double>")
    assert run(same, 350) == brute([(i, [0.1, 0.2]) for i in range(700)], every=350)


def test_one_id_with_a_third_of_all_rows(spark, monkeypatch):
    for name, value in (("ROWS", 60), ("FEW", 30), ("QUERIES", 7)):
        monkeypatch.setattr(mtree, name, value)
    rng = np.random.default_rng(1)
    rows = [(100 if i % 3 == 0 else i, rng.normal(size=4).round(2).tolist()) for i in range(240)]
    assert run(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)) == brute(rows)


def test_scores_beyond_doubles(spark):
    rows = [(i, [2.0**20 + i % 7, 3.0 + i]) for i in range(60)]
    assert run(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == brute(rows)
