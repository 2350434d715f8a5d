"""Line numbers over splits, growing files, the incremental scan, requests and pages."""

from __future__ import annotations

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quillstone.sources import jsonl, live
from quillstone.streaming import scan
from quillstone.streaming.events import drained
from quillstone.streaming.worker import PROVIDER


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    yield
    spark.conf.set(PROVIDER[0], before)


def item(content, at="2024-01-01T00:00:00Z", role="user"):
    return json.dumps({"timestamp": at, "type": "response_item", "payload": {"type": "message", "role": role, "content": content}})


def test_numbers_of_lines_in_splits(spark, tmp_path):
    rng = random.Random(2)
    want = {}
    for name in ("a.jsonl", "b.jsonl", "deep/c.jsonl"):
        rows = [rng.choice(["", "  ", json.dumps({"x": "y" * rng.randint(0, 200)}), "{bad", "é" * 30]) for _ in range(3000)]
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"".join(r.encode() + rng.choice([b"\n", b"\r\n"]) for r in rows) + b"no end")
        want |= {(name, i): r for i, r in enumerate([*rows, "no end"], 1) if r.strip()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        found = jsonl.lines(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 20
        got = {(r.path.split(f"{tmp_path.name}/")[1], r.line): r.value for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want
    assert jsonl.lines(spark, str(tmp_path / "none"), missing_ok=True).count() == 0


def test_strict_lines_name_the_place(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n[1]\n')
    with pytest.raises(Exception, match=r"x\.jsonl:3: no JSON object"):
        jsonl.strict_lines(jsonl.lines(spark, str(tmp_path))).collect()


def test_snapshot_rules(spark, tmp_path):
    for name in ("top.md", "one/a.md", "one/two/b.md", "one/skip/c.md", "one/d.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name * 10)
    (tmp_path / "large.md").write_text("x" * 101)
    got = jsonl.snapshot(spark, str(tmp_path), head=4, depth=1, skipped=["skip"], names=["%.md"], most_bytes=100).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in got) == ["a.md", "top.md"]
    same = jsonl.snapshot(spark, str(tmp_path), head=4, names=["a.md"]).first()
    assert same["head"] == hashlib.sha256(b"one/").hexdigest()


def test_scheduled_scan_gives_events_once(spark, tmp_path):
    source, state, out = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "out")
    source.mkdir()
    meta = json.dumps({"type": "session_meta", "payload": {"id": "s", "cwd": "/w"}})
    (source / "one.jsonl").write_text("\n".join([meta, item("first"), item("old", "2023-01-01T00:00:00Z"), item("<environment_context> x"), item("answer", role="assistant"), item("second")]) + "\n")
    (source / "two.jsonl").write_text(json.dumps({"type": "user", "sessionId": "c", "cwd": "/v", "timestamp": "2024-01-01T00:00:01Z", "message": {"role": "user", "content": "other kind"}}) + "\n")
    first = scan.scan(spark, str(source), state, out, "2024-01-01 00:10:00")
    assert sorted((r.prompt, r.session_id, r.source) for r in first.collect()) == [("first", "s", "codex_transcript_scan"), ("second", "s", "codex_transcript_scan")]
    assert scan.scan(spark, str(source), state, out, "2024-01-01 00:11:00").count() == 0
    with open(source / "one.jsonl", "a") as file:
        file.write(item("third") + "\n")
    assert [r.prompt for r in scan.scan(spark, str(source), state, out, "2024-01-01 00:12:00", most_keys=2).collect()] == ["third"]
    again = scan.scan(spark, str(source), state, out, "2024-01-01 00:13:00")  # an evicted key returns
    assert again.count() == 1
    back = scan.scan(spark, str(source), state, out, "2024-01-01 00:14:00", minutes=10_000_000, backfill=True)
    assert sorted((r.prompt, r.source) for r in back.collect()) == [("old", "codex_transcript_backfill"), ("other kind", "claude_transcript_backfill")]
    assert sorted(os.listdir(out)) == ["mode=backfill", "mode=incremental"]


def test_tail_goes_on_after_a_restart(spark, tmp_path):
    source, got = tmp_path / "in", []
    source.mkdir()

    def go():
        drained(live.tail(spark, str(source)), lambda batch, _: got.extend((os.path.basename(r.path), r.line, r.value) for r in batch.collect()), str(tmp_path / "checkpoint"))

    (source / "a.jsonl").write_text("one\n\ntwo\nunfinish")
    go()
    assert sorted(got) == [("a.jsonl", 1, "one"), ("a.jsonl", 3, "two")]
    with open(source / "a.jsonl", "a") as file:
        file.write("ed\r\nfour\n")
    (source / "b.jsonl").write_text("new\n")
    go()
    go()
    assert sorted(got) == [("a.jsonl", 1, "one"), ("a.jsonl", 3, "two"), ("a.jsonl", 4, "unfinished"), ("a.jsonl", 5, "four"), ("b.jsonl", 1, "new")]


@pytest.mark.parametrize("size", [1, 3, 7, 64])
def test_ranges_of_a_file(tmp_path, monkeypatch, size):
    rng = random.Random(size)
    rows = ["x" * rng.randint(0, 9) for _ in range(60)]
    (tmp_path / "a.jsonl").write_text("".join(r + "\n" for r in rows))
    monkeypatch.setattr(live, "RANGE", size)
    monkeypatch.setattr(live, "BLOCK", 4)
    reader = live.TailReader({"path": str(tmp_path)})
    end = reader.latestOffset()
    got = [tuple(r.values()) for p in reader.partitions({}, end) for batch in reader.read(p) for r in batch.to_pylist()]
    assert [(n, v) for _, n, v in got] == [(i, r) for i, r in enumerate(rows, 1) if r]


def test_stream_of_messages_once(spark, tmp_path, rocks):
    """The same lines delivered twice are events once; beyond the bound the oldest key returns."""
    source, got = tmp_path / "in", []
    source.mkdir()
    schema = "path string, line long, value string"

    def deliver(name, rows):
        (source / name).write_text("".join(json.dumps({"path": p, "line": n, "value": v}) + "\n" for p, n, v in rows))
        lines = spark.readStream.schema(schema).json(str(source))
        rows = jsonl.lenient(lines).where(jsonl.get("$.type") == "response_item").select(
            F.lit("codex").alias("source"), "path", "line", jsonl.get("$.timestamp").alias("timestamp"), F.lit("s").alias("session_id"), F.lit("/w").alias("cwd"), jsonl.content("$.payload.content").alias("text"))
        before = len(got)
        drained(scan.once(scan.events(rows), minutes=100_000_000, most_keys=3), lambda batch, _: got.extend((r.path, r.prompt) for r in batch.collect()), str(tmp_path / "checkpoint"), idle_batches=False)
        return sorted(got[before:])

    rows = [("p", i, item(f"m{i}")) for i in range(1, 4)] + [("q", 1, item("m1"))]
    assert deliver("1.json", rows) == [("p", "m1"), ("p", "m2"), ("p", "m3"), ("q", "m1")]
    assert deliver("2.json", rows) == []
    assert deliver("3.json", [("p", 4, item("m4"))]) == [("p", "m4")]
    assert deliver("4.json", rows[:3]) == [("p", "m1")]  # the oldest of p had gone


def test_requests(spark):
    rows = spark.createDataFrame([('{"prompt": "fix it", "session_id": "s", "extra": 1}',), ("{bad",), ('{"prompt": ""}',), ('{"prompt": "<environment_context> x"}',), ("[1]",), ("",), (None,)], "value string")
    assert [(r.prompt, r.session_id, r.cwd) for r in live.requests(rows).collect()] == [("fix it", "s", None)]


def test_pages(spark):
    """Served from rows of ``pages``: short page ends, an unreachable first page, a limit."""
    served = {s: [{"page_id": i, "url": f"{s}/{i}"} for i in range(n)] for s, n in (("a", 25), ("b", 7), ("c", 20))}

    def fetch(split, offset, n):
        if split == "b":
            raise OSError("no such page")
        return served[split][offset : offset + n], False

    spark.dataSource.register(live.paged("served", fetch, lambda split: served[split][:5], ["a", "b", "c"], 40, 10))
    pages = spark.read.format("served").load()
    with pytest.raises(Exception, match="no such page"):
        pages.collect()

    def gentle(split, offset, n):
        if split == "b" and offset == 0:
            raise OSError("no such page")
        return served[split][offset : offset + n], False

    spark.dataSource.register(live.paged("served", gentle, lambda split: served[split][:5], ["a", "b", "c"], 40, 10))
    rows = live.page_rows(spark.read.format("served").load(), "page_id long, url string", 40).collect()
    assert [r.url for r in rows] == [f"a/{i}" for i in range(25)] + [f"b/{i}" for i in range(5)] + [f"c/{i}" for i in range(10)]
