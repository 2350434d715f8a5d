import datetime as dt
import json

from pyspark.sql import functions as F

from quillstone.operators import events as ops
from quillstone.sources import jsonl, sinks


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def item(role, content, at="2024-01-01T00:00:00Z"):
    return {"timestamp": at, "type": "response_item", "payload": {"type": "message", "role": role, "content": content}}


def test_codex_transcripts(spark, tmp_path):
    write(tmp_path / "a" / "one.jsonl", [
        {"type": "session_meta", "payload": {"id": "s1", "cwd": "/w"}}, item("user", [{"type": "input_text", "text": "first"}, {"type": "x", "text": "second"}]),
        "", "{broken", "[1, 2]", item("assistant", "no"), item("user", "<environment_context> x"), {"type": "session_meta", "payload": {"id": "s2", "cwd": "/v"}}, item("user", "plain"), {"payload": None},
    ])
    rows = jsonl.lines(spark, str(tmp_path))
    got = [(r.line, r.session_id, r.cwd, r.text) for r in jsonl.codex_messages(rows).orderBy("line").collect()]
    assert got == [(2, "s1", "/w", "first\nsecond"), (9, "s2", "/v", "plain")]
    assert [r.line for r in jsonl.located_errors(rows).orderBy("line").collect()] == [4, 5]
    assert jsonl.first_session(jsonl.lenient(rows)).first().session_id == "s1"
    assert jsonl.newest_files(spark, str(tmp_path), 1).count() == 1 and len(jsonl.snapshot(spark, str(tmp_path)).first()["head"]) == 64


def test_claude_transcripts(spark, tmp_path):
    write(tmp_path / "p" / "s.jsonl", [
        {"type": "user", "sessionId": "c", "cwd": "/w", "message": {"role": "user", "content": "hello there"}}, {"type": "user", "isSidechain": True, "message": {"content": "side"}},
        {"type": "queue-operation", "operation": "enqueue", "content": "later"}, {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "a longer answer of mine"}]}},
    ])
    write(tmp_path / "p" / "subagents" / "s.jsonl", [{"type": "user", "message": {"content": "hidden"}}])
    rows = jsonl.lines(spark, str(tmp_path))
    assert [r.text for r in jsonl.claude_messages(rows).orderBy("line").collect()] == ["hello there", "later"]
    assert [r.text for r in jsonl.assistant_turns(rows).collect()] == ["a longer answer of mine"]


def test_labels_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", True), ("b", False)], "record_id string, should_wake boolean")
    assert sinks.counted(rows, str(tmp_path / "out")) == 2
    write(tmp_path / "labels" / "x.jsonl", [{"record_id": "a", "should_wake": True}])
    assert jsonl.labels(spark, str(tmp_path / "labels"), "record_id string, should_wake boolean").first().label_file == "x.jsonl"
    sinks.labelled_text(spark.createDataFrame([("wake", "a  b\nc")], "label string, text string"), str(tmp_path / "ft"))
    assert spark.read.text(str(tmp_path / "ft")).first().value == "__label__wake a b c"
    assert jsonl.front_matter.__doc__ and spark.range(1).select(jsonl.front_matter(F.lit("---\nname: x\nkind: a:b\n---\nbody")).alias("m")).first().m == {"name": "x", "kind": "a:b"}


def test_scoreboard_of_double_observations(spark):
    schema = "event_id long, version string, triggered boolean, source string, role string, ts timestamp, snippet string, prompt_hash string, session_id string, cwd string"
    at = lambda s: dt.datetime(2025, 3, 9, 8, 0, s)
    rows = [
        (11, "v7", False, "scan", "user", at(20), "is it done yet", "h1", "s", "/a"),
        (12, "v7", True, "hook", None, at(21), "is it done yet", "h1", "s", "/a"),  # the same message, seen later
        (13, "v7", True, "hook", "", at(22), "is it done yet", "h1", "s", "/b"),  # another folder
        (14, "v7", True, "scan", "assistant", at(23), "not yet", "h2", "s", "/a"),
        (15, "v7", True, "hook", "user", at(24), "  <turn_aborted> by hand", "h3", "s", "/a"),
        (16, "v8", False, "hook", "USER ", at(25), "thanks", "h4", "s", "/a"),
        (17, "v8", False, "hook", "user", at(26), "thanks", "", "s", "/a"),  # hashed by its text
    ]
    board = {r.version: (r.messages, r.triggers, r.rate) for r in ops.scoreboard(ops.collapsed(spark.createDataFrame(rows, schema))).collect()}
    assert board == {"v7": (2, 1, 0.5), "v8": (2, 0, 0.0)}


def test_replace_swaps_and_keeps_a_backup(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.replace(spark.range(3), path)
    sinks.replace(spark.read.json(path).where("id > 0"), path)
    assert sorted(r.id for r in spark.read.json(path).collect()) == [1, 2]
    sinks.replace(spark.range(1), path, backup=str(tmp_path / "kept"))
    assert spark.read.json(path).count() == 1 and spark.read.json(str(tmp_path / "kept")).count() == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["kept", "out"]


def test_model_and_report(spark, tmp_path):
    rows = spark.createDataFrame([("word", "a", 1.0, 0.5), ("word", "b", 1.0, 0.0)], "section string, term string, idf double, coef double")
    sinks.model(rows, str(tmp_path / "m"))
    assert [r.term for r in jsonl.model(spark, str(tmp_path / "m")).collect()] == ["a"]
    sinks.report(rows.select("term", "coef"), str(tmp_path / "r"), "Terms")
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()][-2:] == ["| a | 0.5000 |", "| b | 0.0000 |"]
