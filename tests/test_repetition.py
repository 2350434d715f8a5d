import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import repetition
from quillstone.streaming import events as streaming

P1 = "you ignored the failing integration tests and did not read the docs again"
P2 = "again you ignored the failing integration tests and never read the docs"
SCHEMA = "event_id string, ts double, observed_at double, prompt string, session_id string, cwd string, transcript_path string, message_locator string, score double, review boolean, triggered boolean"
SETTINGS = repetition.Settings(window=600, duplicate=60)


def rows(*events):
    return [(f"e{i}", float(t), None, p, s, c, "/t/x.jsonl", None, 0.5, True, False) for i, (t, p, s, c) in enumerate(events)]


CASES = {
    "same session": (rows((0, P1, "s", "/w"), (5, P2, "s", "/w"), (6, "go on", "s", "/w")), {"e0": (1, False), "e1": (2, True)}),
    "other session, same project": (rows((0, P1, "s", "/w"), (5, P2, "r", "/w")), {"e0": (1, False), "e1": (2, True)}),
    "other project": (rows((0, P1, "s", "/w"), (5, P2, "s", "/v")), {"e0": (1, False), "e1": (1, False)}),
    "same text in another session": (rows((0, P1, "s", "/w"), (5, P1, "r", "/w")), {"e0": (1, False), "e1": (2, True)}),
    "seen twice": (rows((0, P1, "s", "/w"), (5, P1, "s", "/w")), {"e0": (1, False), "e1": (1, False)}),
    "outside the window": (rows((0, P1, "s", "/w"), (700, P2, "s", "/w")), {"e0": (1, False), "e1": (1, False)}),
}


@pytest.mark.parametrize("case", CASES)
def test_batch(spark, case):
    events, want = CASES[case]
    got = {r.event_id: (r.repeat_count, r.triggered) for r in repetition.batch(spark.createDataFrame(events, SCHEMA), "ts", SETTINGS).collect()}
    assert got == want


def test_reasons(spark):
    events = [("a", 0.0, None, "keep going", "s", "/w", "", None, 0.5, True, False), ("b", 0.0, None, "too short", "s", "/w", "", None, 0.5, True, False), ("c", 0.0, None, P1, "s", "/w", "", None, 0.1, False, False), ("d", 0.0, None, P1, "s", "", "", None, 0.5, True, False), ("e", 0.0, None, P1, "s", "/w", "", None, None, True, False), ("f", 0.0, None, "<instructions> " + P1, "s", "/w", "", None, 0.5, True, False)]
    got = {r.event_id: r.suppressed for r in repetition.prepared(spark.createDataFrame(events, SCHEMA)).collect()}
    assert got == {"a": "control_phrase", "b": "too_short", "c": "below_review_threshold", "d": "project_scope_unavailable", "e": "classifier_unavailable", "f": "pasted_context"}


def test_stream_agrees_with_batch(spark, tmp_path):
    events = [(f"{k}-{e[0]}", *e[1:5], e[5] + k, *e[6:]) for k, c in CASES.items() for e in c[0]]
    frame = spark.createDataFrame(events, SCHEMA)
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    got = []
    streaming.drained(streaming.repeated(stream, SETTINGS), lambda b, _: got.extend(map(tuple, b.collect())), str(tmp_path / "c"), idle_batches=False)
    want = [tuple(r) for r in repetition.batch(frame, "ts", SETTINGS).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_stream_collapses_and_counts(spark, tmp_path):
    frame = spark.createDataFrame([(1, "2024-01-01 00:00:00", "s", "/w", "x", "v", True), (2, "2024-01-01 00:00:01", "s", "/w", "x", "v", True), (3, "2024-01-01 00:03:00", "s", "/w", "x", "v", False)], "event_id long, ts string, session_id string, cwd string, snippet string, version string, triggered boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    streaming.drained(streaming.collapsed(stream), lambda b, _: got.extend(r.event_id for r in b.collect()), str(tmp_path / "c"))
    assert sorted(got) == [1, 3] or sorted(got) == [2, 3]


def test_joins_agree_with_the_replay(spark):
    """One hot scope with many sessions and repeats, small ones, windows that end, more entries than are kept."""
    rng = random.Random(8)
    words = "ignored failing integration tests docs again never read build broken output wrong file reverted change twice".split()
    events, at = [], 0.0
    for i in range(900):
        at += rng.choice([1, 2, 3, 40]) if i % 300 else 2000
        prompt = rng.choice([P1, P2, " ".join(rng.sample(words, 7))])
        events.append((f"e{i:04}", at, rng.choice([None, at]), prompt, f"s{rng.randint(0, 40)}", "/hot" if rng.random() < 0.7 else f"/w{rng.randint(0, 9)}", "/t/x", rng.choice([None, None, f"m{rng.randint(0, 30)}"]), 0.5, True, rng.random() < 0.2))
    frame = spark.createDataFrame(events, SCHEMA).repartition(5)
    settings = repetition.Settings(window=600, duplicate=60, similarity=0.3)
    want = sorted(map(tuple, repetition.batch(frame, "ts", settings).collect()))
    got = sorted(map(tuple, repetition.joined(frame, "ts", settings).collect()))
    assert [g for g, w in zip(got, want) if g != w][:3] == [] and len(got) == len(want)
    assert sum(g[2] for g in got) > 10 and max(g[3] for g in got) > 20
