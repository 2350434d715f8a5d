"""Outbox with acknowledgements, teacher's labels with retries and resume."""

from __future__ import annotations

import json

import pytest

from quillstone.operators import teacher
from quillstone.sources.outbox import Outbox
from quillstone.streaming.events import drained


def test_every_third_group_is_refused(spark, tmp_path):
    """Each event is accepted once, over two flushes, though a third of the groups is refused at first."""
    log = tmp_path / "log"
    log.mkdir()
    rows = spark.range(95).selectExpr("concat('e', id) AS insert_id", "id AS value").coalesce(1)
    box = Outbox(spark, str(tmp_path / "box"), "insert_id string, value long")
    box.add(rows)
    box.add(rows.limit(3))  # delivered twice
    where = str(log)

    def post(group):
        import os

        n = len(os.listdir(where))
        with open(f"{where}/{n}", "w") as f:
            refused = n % 3 == 2
            json.dump({"refused": refused, "ids": [r["insert_id"] for r in group]}, f)
        if n == 5:
            raise OSError("no answer")
        return not refused

    first = {r.accepted: r.n for r in box.flush(post, 1, limit=10).collect()}
    assert first[True] + first[False] == 95 and first[False] > 0
    assert box.status().first().waiting == first[False] and box.status().first().last_state == "partial"
    number = 2
    while box.waiting().count():
        box.flush(post, number, limit=10)
        number += 1
    accepted = [i for f in log.iterdir() for x in [json.loads(f.read_text())] if not x["refused"] for i in x["ids"]]
    assert sorted(accepted) == sorted(f"e{i}" for i in range(95))
    assert box.acks().where("error like 'OSError%'").count() > 0
    assert tuple(box.status().first())[:2] == (0, "ok")


def test_stream_into_an_outbox(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"insert_id": "a", "value": 1}\n{"insert_id": "b", "value": 2}\n')
    box = Outbox(spark, str(tmp_path / "box"), "insert_id string, value long")
    stream = spark.readStream.schema(box.schema).json(str(source))
    drained(stream, box.sink(lambda rows: rows[0]["insert_id"] != "a", 1), str(tmp_path / "checkpoint"))
    assert [r.insert_id for r in box.waiting().collect()] == ["a"]
    (source / "2.json").write_text('{"insert_id": "c", "value": 3}\n')
    drained(stream, box.sink(lambda rows: True, 1), str(tmp_path / "checkpoint"))
    assert box.waiting().count() == 0


def test_one_row_a_record_and_resume(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(23)], "id long, text string").repartition(3)
    calls = tmp_path / "calls"
    calls.mkdir()
    where = str(calls)

    def ask(records, broken=True):
        import uuid

        with open(f"{where}/{uuid.uuid4()}", "w") as f:
            json.dump([r["record_id"] for r in records], f)
        if broken and any(int(r["record_id"]) % 5 == 0 for r in records):
            raise TimeoutError("busy")
        return json.dumps({"labels": [{"record_id": r["record_id"], "wake_probability": 0.9} for r in records]})

    path = str(tmp_path / "labels")
    first = teacher.labelled(docs, ask, path, 1, attempts=2, backoff=0.0).collect()
    assert sorted(int(r.record_id) for r in first) == list(range(23))
    assert {int(r.record_id): r.attempts for r in first if r.error} == {i: 2 for i in range(0, 23, 5)}
    good = next(r for r in first if r.record_id == "1")
    assert (good.should_wake, good.wake_probability, good.confidence, good.error, good.attempts) == (True, 0.9, 0.9, None, 1)
    for f in calls.iterdir():
        f.unlink()
    second = teacher.labelled(docs, lambda records: ask(records, False), path, 2, attempts=2, backoff=0.0).collect()
    assert sorted(int(r.record_id) for r in second) == list(range(0, 23, 5)) and not any(r.error for r in second)
    assert sorted(i for f in calls.iterdir() for i in json.loads(f.read_text())) == sorted(map(str, range(0, 23, 5)))
    assert teacher.labelled(docs, ask, path, 3).count() == 0
    from pyspark.sql import functions as F

    all_runs = spark.read.parquet(path)
    assert teacher.settled(all_runs, F.col("run")).where("error is null").count() == 23


def test_batches_fail_as_a_whole(spark):
    docs = spark.createDataFrame([(str(i), "x") for i in range(4)], "id string, text string").coalesce(1)

    def ask(records):
        return [{"record_id": r["record_id"], "should_wake": False} for r in records if r["record_id"] != "3"]

    got = {r.record_id: (r.should_wake, r.error) for r in teacher.normalised(teacher.asked(docs, ask, size=2, attempts=1)).collect()}
    assert got == {"0": (False, None), "1": (False, None), "2": (None, "ValueError: missing label for 3"), "3": (None, "ValueError: missing label for 3")}


@pytest.mark.parametrize("body, n", [('```json\n{"labels": [{"record_id": "1"}]}\n```', 1), ('so: {"should_wake": true} then', 1), ([{"a": 1}, {"b": 2}, 3], 2), ({"records": [{"x": 1}]}, 1)])
def test_answers(body, n):
    assert len(teacher.answers_of(body)) == n


@pytest.mark.parametrize("body", ["nothing here", [], "[]", "} {"])
def test_no_answers(body):
    with pytest.raises(ValueError):
        teacher.answers_of(body)
