"""Gates over pairs of thresholds and grids of models against plain forms."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from quillstone.operators import gates, metrics, training, tuning


def test_gates_against_counting(spark):
    rng = random.Random(1)
    rows = [(rng.choice("xyz"), rng.choice([None, round(rng.random(), 2)]), round(rng.random(), 2), rng.choice([True, False, None])) for _ in range(400)]
    frame = spark.createDataFrame(rows, "g string, a double, b double, label boolean").repartition(5)
    grid = [0.25, 0.5, 0.75]
    got = {(r.g, r.a_threshold, r.b_threshold): (r.tp, r.fp, r.fn, r.tn) for r in gates.grid(frame, "a", "b", grid, grid, by=["g"]).collect()}
    want = {}
    for g in "xyz":
        for s in grid:
            for t in grid:
                passed = [(a is not None and a >= s and b >= t, bool(y)) for h, a, b, y in rows if h == g]
                want[g, s, t] = tuple(passed.count(c) for c in ((True, True), (True, False), (False, True), (False, False)))
    assert got == want
    assert gates.grid(frame.limit(0), "a", "b", grid, grid).where("tp is not null").count() == 0


def test_fold_gate(spark):
    rows = [("f", True, 0.9, 0.9, True), ("f", True, 0.9, 0.1, False), ("f", True, 0.2, 0.9, False), ("f", False, 0.8, 0.8, True), ("f", False, 0.8, 0.2, True), ("f", False, 0.9, 0.9, False)]
    frame = spark.createDataFrame(rows, "fold string, train boolean, a double, b double, label boolean")
    r = gates.fold_gate(frame, "a", "b", [0.1, 0.5], "fold", "train", 0.9).first()
    assert (r.a_threshold, r.b_threshold, r.tp, r.fp, r.fn, r.tn) == (0.5, 0.5, 1, 1, 1, 0)


@pytest.fixture
def corpus(spark):
    rng = random.Random(3)
    docs, votes = [], []
    for i in range(150):
        y = rng.random() < 0.4
        docs.append((f"d{i}", [rng.choice("abcdefgh") for _ in range(20)] + [rng.choice("pq" if y else "rs") for _ in range(rng.randint(0, 3))]))
        for name in rng.sample(["one.jsonl", "two.jsonl", "extra-1.jsonl", "extra-2.jsonl"], 2):
            votes.append((f"d{i}", name, y if rng.random() < 0.9 else not y))
    return spark.createDataFrame(docs, "id string, words array<string>").coalesce(1), spark.createDataFrame(votes, "record_id string, label_file string, should_wake boolean")


def alone(spark, docs, votes, setting, test_files, thresholds):
    """One setting and one held-out group with the library's own trainer."""
    found = tuning.features(docs, ["words"])
    held = [r[0] for r in votes.where(F.col("label_file").isin(test_files)).select("record_id").distinct().collect()]
    gold = votes.groupBy("record_id").agg((F.count_if("should_wake") >= F.count_if(~F.col("should_wake"))).cast("double").alias("label"))
    rows = []
    for r in found.rows.join(gold.withColumnRenamed("record_id", "id"), "id").collect():
        at, value = np.array(r["at"], int), np.array(r["value"]) * found.idf[np.array(r["at"], int)]
        if setting.size is not None:
            at, value = at[at < setting.size], value[at < setting.size]
        order = np.argsort(at)
        rows.append((r["id"], r["label"], Vectors.sparse(len(found.idf), at[order].tolist(), (value / max(np.linalg.norm(value), 1e-300))[order].tolist())))
    frame = spark.createDataFrame(rows, ["id", "label", "features"])
    train = frame.where(~F.col("id").isin(held))
    if setting.balanced:
        train = training.balanced(train)
        total = train.agg(F.sum("weight")).first()[0]
        model = training.logistic(setting.strength, total, "weight").setMaxIter(300).setTol(1e-10).fit(train)
    else:
        model = training.logistic(setting.strength, train.count()).setMaxIter(300).setTol(1e-10).fit(train)
    out = model.transform(frame.where(F.col("id").isin(held))).select("id", vector_to_array("probability")[1].alias("score"))
    return {r.id: r.score for r in out.collect()}


def test_grid_equals_fitting_one_by_one(spark, corpus):
    docs, votes = corpus
    choices = [tuning.Setting(1.0), tuning.Setting(4.0, True), tuning.Setting(4.0, False, 9)]
    grid = [round(x / 20, 2) for x in range(1, 20)]
    best, scores = tuning.search(docs, votes, ["words"], choices, grid, 0.8, {"extra": ["extra-*.jsonl"], "one": ["one.jsonl"]}, at_once=4)
    got = {}
    for r in scores.collect():
        got[r.setting, r.held_group, r.id] = r.score
    plain = []
    for s in choices:
        for group, files in (("extra", ["extra-1.jsonl", "extra-2.jsonl"]), ("one", ["one.jsonl"])):
            want = alone(spark, docs, votes, s, files, grid)
            assert {k[2] for k in got if k[:2] == (s.name, group)} == set(want)
            assert max(abs(got[s.name, group, i] - x) for i, x in want.items()) < 2e-3
            plain += [(s.name, want[r.record_id], r.should_wake) for r in votes.where(F.col("label_file").isin(files)).collect()]
    frame = spark.createDataFrame(plain, "setting string, score double, label boolean")
    swept = metrics.best_at_precision(metrics.sweep(frame, "score", grid, by=["setting"]), 0.8, ["setting"])
    want = [r.setting for r in swept.orderBy(*metrics.ranked(swept, 0.8, "setting")).collect()]
    assert [r.setting for r in best.orderBy("rank").collect()] == want
    assert sum(best.select(F.sum(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).first()) == len(plain)


def test_settings_and_extra_rows(spark, corpus):
    docs, votes = corpus
    assert [s.name for s in tuning.settings([1.0], (False, True), (5, None))] == ["c=1,none,5", "c=1,balanced,5", "c=1,none,all", "c=1,balanced,all"]
    more = spark.createDataFrame([("d0", 1.0, 0.5), ("x1", 1.0, 0.5)], "id string, label double, weight double")
    docs = docs.unionByName(spark.createDataFrame([("x1", ["p", "q"])], docs.schema))
    best, scores = tuning.search(docs, votes, ["words"], [tuning.Setting(1.0)], [0.5], 0.5, extra=more)
    assert scores.select("held_group").distinct().count() == 4 and best.count() == 1 and scores.where("id = 'x1'").count() == 0
