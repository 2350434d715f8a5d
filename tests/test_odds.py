"""Cadence, dashboards, labels' folders, public rows, swaps that were cut off, models that no query runs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import cadence, labels, store, training
from quillstone.operators import events as ops
from quillstone.sources import jsonl, public, sinks
from quillstone.streaming import events as streaming
from quillstone.streaming.worker import PROVIDER


def test_cadence_stream_agrees_with_replay(spark, tmp_path):
    rng = random.Random(4)
    at, rows = 1_700_000_000, []
    for i in range(120):
        at += rng.choice([30, 300, 1500])
        rows.append((rng.choice(["a", "b"]), at, f"{i:03}", rng.choice(["stop", "stop", "start"]), rng.choice(["", "g1", "g2"]), rng.random() < 0.7, rng.random() < 0.05))
    frame = spark.createDataFrame(rows, "host string, at long, event_id string, kind string, generation string, changed boolean, force boolean").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    want = sorted(map(str, cadence.replayed(frame.repartition(3)).collect()))
    assert len(want) == 120 and any("ran=True" in w for w in want) and len({w.split("reason=")[1].split(",")[0] for w in want}) >= 4
    got = []
    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        for k, part in enumerate((rows[:50], rows[50:])):  # a restart between
            ids = [r[2] for r in part]
            frame.where(F.col("event_id").isin(ids)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
            streaming.drained(cadence.stream(stream), lambda b, _: got.extend(map(str, b.collect())), str(tmp_path / "c"), idle_batches=False)
    finally:
        spark.conf.set(PROVIDER[0], before)
    assert sorted(got) == want


def test_dashboard(spark, tmp_path):
    rows = spark.createDataFrame([("v1", True), ("v1", False), ("v2", False)], "version string, triggered boolean")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    streaming.dashboard(stream, str(tmp_path / "board"), str(tmp_path / "c"), available_now=True).awaitTermination()
    assert [r.value for r in spark.read.text(str(tmp_path / "board")).collect()][-2:] == ["| v1 | 2 | 1 | 0.5000 |", "| v2 | 1 | 0 | 0.0000 |"]


def test_swap_that_was_cut_off(spark, tmp_path):
    path = tmp_path / "out"
    sinks.replace(spark.range(3), str(path))
    path.rename(tmp_path / "out.old")  # between the two renames, the new one not complete
    (tmp_path / "out.new").mkdir()
    assert sinks.restored(spark, str(path)) and spark.read.json(str(path)).count() == 3
    spark.range(5).write.json(str(tmp_path / "out.new"), mode="overwrite")
    path.rename(tmp_path / "out.old")  # again, with a complete new one
    assert sinks.restored(spark, str(path)) and spark.read.json(str(path)).count() == 5
    sinks.replace(spark.range(2), str(path))
    assert spark.read.json(str(path)).count() == 2 and not sinks.restored(spark, str(path))


def test_report_says_that_it_is_cut(spark, tmp_path):
    sinks.report(spark.range(5), str(tmp_path / "r"), "Rows", 3)
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()][-1] == "The first 3 rows; there are more."


def test_label_folder_and_counters(spark, tmp_path):
    schema = "record_id string, label_file string, should_wake boolean, error string"
    hard = spark.createDataFrame([("a", "h", True, None), ("b", "h", False, None)], schema)
    teacher = spark.createDataFrame([("a", "t", True, None), ("c", "t", True, None), ("d", "t", True, "timeout"), ("e", "t", False, None), ("f", "t", False, None)], schema)
    corpus = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("f",)], "id string")
    rows = labels.student_labels(hard, teacher, corpus, spark.createDataFrame([("f",)], "record_id string"))
    told = {(r.origin, r.reason): r.n for r in sinks.label_folder(rows, str(tmp_path / "labels")).collect()}
    assert told == {("hard", None): 2, ("teacher", None): 1, ("teacher", "hard_label"): 1, ("teacher", "error"): 1, ("teacher", "missing_corpus"): 1, ("teacher", "holdout"): 1}
    assert sorted((r.record_id, r.label_file) for r in spark.read.json(str(tmp_path / "labels")).collect()) == [("a", "h"), ("b", "h"), ("c", "t")]


def test_auxiliary_rows(spark):
    schema = "record_id string, should_wake boolean, confidence double, error string, seq int"
    rows = spark.createDataFrame([("a", True, 0.9, None, 2), ("a", False, 0.9, None, 1), ("b", True, 0.2, None, 1), ("c", True, 0.9, None, 1), ("d", True, 0.9, "x", 1), ("g", True, 0.9, None, 1), ("z", True, 0.9, None, 1)], schema)
    corpus, gold = spark.createDataFrame([(x,) for x in "abcdg"], "id string"), spark.createDataFrame([("g",)], "id string")
    assert sorted(map(tuple, labels.auxiliary(corpus, rows, gold, 0.3, 0.5).collect())) == [("a", 0.0, 0.3), ("c", 1.0, 0.3)]
    assert [r.id for r in labels.auxiliary(corpus, rows, gold, 0.3, 0.5, negatives=False).collect()] == ["c"]


def test_order_and_index_violations(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "n int, id string"), spark.createDataFrame([(1, "x"), (2, "z")], "n int, id string")
    assert sorted(map(tuple, labels.order_violations(b, a, "id", "n").collect())) == [(2, "y", "z"), (3, "z", None)]
    entries = spark.createDataFrame([("ok-1", "active", "/a", ["go"], "fine"), ("Bad", "old", "/b", [], "fine"), ("two", "draft", "/a", ["x", " "], "has TODO here"), ("two", "draft", "/a", ["x"], None)], "id string, status string, path string, triggers array<string>, body string")
    got = sorted(map(tuple, labels.index_violations(entries, spark.createDataFrame([("/a",)], "path string"), ["todo"]).collect()))
    assert got == [("Bad", "id"), ("Bad", "path"), ("Bad", "status"), ("Bad", "triggers"), ("two", "forbidden"), ("two", "triggers"), ("two", "unique"), ("two", "unique")]


def test_public_rows(spark):
    rows = spark.createDataFrame([(0, " bad\nday ", "negative", "x"), (1, "fine", "POSITIVE", "x"), (2, "?", "MIXED", "x"), (3, " ", "NEUTRAL", "x"), (4, "so", None, "x")], "row_idx long, content_text string, sentiment_label string, agent string")
    got = [(r.id, r.text, r.label, r.agent) for r in public.sentiments(rows, "d", "c", "train", "row_idx").orderBy("row_idx").collect()]
    assert got == [("hf:d:c:train:0", "bad day", 1, "x"), ("hf:d:c:train:1", "fine", 0, "x")]
    seen = public.viewer_rows(spark.createDataFrame([("s", 5, " a  b ", "h"), ("s", 6, "", "h")], "split string, row_idx long, prompt string, harness string"), "d", "c", 3).collect()
    assert [(r.id, r.text, r.weak_label, r.harness) for r in seen] == [("hf:d:c:s:5", "a b", "hf_agent_trace_prompt", "h")]
    corpus = spark.createDataFrame([("a", None, None), ("b", "s", "t")], "id string, source string, text string")
    told = public.external_rows(corpus, spark.createDataFrame([("a", True), ("z", True)], "record_id string, label boolean"), "dev").collect()
    assert [tuple(r) for r in told] == [("a", "unknown", "", 1, "dev")]


def test_assistant_turns_rules(spark, tmp_path):
    import json

    rows = [{"type": "assistant", "message": {"role": "assistant", "content": t}} for t in ("a longer answer of mine", "a longer answer of mine", "one that is barred here", "{\"x\": \"looks like data\"}", "short", "another  answer\nof mine")]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, rows)))
    found = jsonl.assistant_turns(jsonl.lines(spark, str(tmp_path)), exclude="BARRED")
    assert [r.text for r in found.collect()] == ["another answer of mine", "a longer answer of mine"]
    files = public.newest_per_root(spark.createDataFrame([("r", "/1", 1), ("r", "/2", 2), ("q", "/3", 0)], "root string, path string, modified int"), "root", 1)
    assert sorted(r.path for r in files.collect()) == ["/2", "/3"]


def test_sums_in_chunks(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", None]), rng.randint(0, 99), i, rng.randint(0, 5)) for i in range(500)]
    frame = spark.createDataFrame(rows, "k string, at int, id int, v int").withColumn("chunk", F.floor(F.col("at") / 10)).repartition(7)
    got = {r.id: r.s for r in store.summed(frame, ["k"], "chunk", ["at", "id"], "v", "s").collect()}
    want, run = {}, {}
    for k, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        run[k] = run.get(k, 0) + v
        want[i] = run[k]
    assert got == want


@pytest.fixture
def examples(spark):
    rng = random.Random(2)
    rows = [(f"r{i}", float(y := i % 3 == 0), i % 3 if i % 2 else (i + 1) % 3, f"file-{i % 4}", " ".join(rng.choices("alpha beta gamma delta".split(), k=8) + (["wrong", "broken"] if y and rng.random() < 0.8 else ["fine"]))) for i in range(90)]
    return spark.createDataFrame(rows, "id string, label double, fold int, label_file string, text string").coalesce(1).cache()


def auc(scores):
    from quillstone.operators import metrics

    return metrics.ranking(scores.withColumn("label", F.col("label") == 1), "score").first().auc


def test_models_that_no_query_runs(spark, examples):
    """Calibrated machines, weighted and balanced fits, groups left out, glob holdouts, stacks out of fold, distillation."""
    machine = training.fit_text(examples.where("fold <> 0"), kind="svc")
    margins = training.text_scores(machine, examples)
    curve = training.calibrated(training.out_of_fold(examples, lambda r: training.fit_text(r, kind="svc"), training.text_scores), margins)
    assert curve.where("score between 0 and 1").count() == 90 and abs(auc(curve) - auc(margins)) < 1e-9  # a monotone curve
    weights = {r.label: r.weight for r in training.balanced(examples).select("label", "weight").distinct().collect()}
    assert weights == {1.0: 90 / 60, 0.0: 90 / 120}
    assert auc(training.text_scores(training.fit_text(training.balanced(examples), weight="weight"), examples)) > 0.8
    train, test = training.glob_holdout(examples, ["file-[01]"])
    assert {r.label_file for r in test.select("label_file").distinct().collect()} == {"file-0", "file-1"} and train.count() + test.count() == 90
    out = training.leave_groups_out(examples, ["file-0", "file-1"], training.fit_text, training.text_scores)
    assert out.count() == examples.where("label_file in ('file-0', 'file-1')").count() and auc(out) > 0.7
    base = {"a": (training.fit_text, training.text_scores), "b": (lambda r: training.fit_text(r, kind="bayes"), training.text_scores)}
    stack, scores = training.stacked_out_of_fold(examples, base)
    told = training.vector_scores(stack, training.stack_features(scores, ["a", "b"]))
    assert scores.count() == 90 and auc(told) > 0.7
    teacher = examples.select("id", "text", F.when(F.col("label") == 1, 0.9).otherwise(0.1).alias("teacher"))
    assert auc(training.text_scores(training.distilled(examples.limit(12), teacher, 0.5), examples)) > 0.8


def test_embeddings_with_groups_left_out(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(1 if i % 2 else -1, 1.5) for _ in range(4)], f"f{i % 3}") for i in range(120)]
    frame = spark.createDataFrame(rows, "id long, embedding array<float>, label_file string")
    vectors = training.vectors(frame, "id", F.col("id") % 2).join(frame.select("id", "label_file"), "id")
    best = training.vector_groups_out(vectors, ["f0", "f1", "f2"], [0.1, 1.0], [x / 20 for x in range(1, 20)], 0.8).collect()
    assert [r.strength for r in best] == [0.1, 1.0] and all(r.tp + r.fp + r.fn + r.tn == 120 and r.precision >= 0.8 and r.recall > 0.5 for r in best)


def test_latest_processed(spark):
    at = lambda s: f"2024-01-01 00:00:{s:02}"
    told = spark.createDataFrame([("p", 1, at(1)), ("p", 2, at(9))], "path string, line long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    logged = spark.createDataFrame([(1, "scan", "p", 2, at(5), False), (2, "scan", "p", 2, at(5), True), (3, "hook", "p", 2, at(4), False)], "event_id long, source string, transcript_path string, transcript_line long, ts string, triggered boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    r = ops.latest_processed(told, logged, "scan").first()
    assert (r.line, r.processed, r.triggered, r.behind) == (2, True, True, 4)
    assert ops.latest_processed(told, logged.limit(0), "scan").first().processed is False and ops.latest_processed(told.limit(0), logged, "scan").count() == 0
