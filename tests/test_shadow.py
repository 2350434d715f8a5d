"""Families of models and the backfill of their scores."""

from __future__ import annotations

import json
import math

from quillstone.operators import scoring, shadow

def words():
    return {"word": scoring.word_section()}

MODELS = [("m", "word", "bad", 1.0, 2.0), ("m", "word", "good", 2.0, -1.0), ("n", "word", "bad", 1.0, 1.0), ("x", "word", "bad", 1.0, float("inf"))]


def models(spark):
    return spark.createDataFrame(MODELS, "model string, section string, term string, idf double, coef double")


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def test_scores_of_a_family(spark):
    docs = spark.createDataFrame([(1, "bad bad good other"), (2, "nothing known"), (3, "")], "id long, text string")
    got = {(r.id, r.model): r for r in scoring.family_scores(docs, "id", words(), models(spark), {"m": 0.5, "n": -1.0, "x": 0.0, "gone": 0.0, "none": None}).collect()}
    assert len(got) == 15
    bad, good = 1 + math.log(2), 2.0
    norm = math.hypot(bad, good)
    assert abs(got[1, "m"].score - sigmoid(0.5 + (2 * bad - good) / norm)) < 1e-12 and abs(got[1, "n"].score - sigmoid(-1 + 1)) < 1e-12
    assert [(e.term, round(e.contribution, 6)) for e in got[1, "m"].explanations] == [("bad", round(2 * bad / norm, 6))]
    assert abs(got[2, "m"].score - sigmoid(0.5)) < 1e-12 and got[3, "n"].error is None
    assert {m: got[1, m].error for m in ("x", "gone", "none")} == {"x": "1 weights are no numbers", "gone": "no weights", "none": "no intercept"}
    assert got[1, "x"].score is None


def test_backfill(spark, tmp_path):
    lines = [
        json.dumps({"prompt": "bad day", "classifier": {"score": 0.1}, "ü": [1, {"a": None}]}, ensure_ascii=False), "{broken", json.dumps({"prompt": "bad", "no": "classifier"}),
        json.dumps({"snippet": "good one", "classifier": {"score": 0.2, "alternates": {"m": {"score": 0.9}}}}), json.dumps({"prompt": "bad", "classifier": {"score": 0.3, "alternates": {"m": {"score": 1}, "n": {"score": 1}}}}),
        '{"classifier":   {"score": 0.4}}', json.dumps({"prompt": "", "transcript_path": "t", "transcript_line": 3, "classifier": {"score": 0.5}}),
    ]
    (tmp_path / "events.jsonl").write_text("\n".join(lines) + "\n")
    told = spark.createDataFrame([("t", 3, "a bad line")], "path string, line long, text string")
    got = shadow.backfill(spark, str(tmp_path), str(tmp_path / "out"), words(), models(spark), {"m": 0.0, "n": 0.0}, "now", transcripts=told).first().asDict()
    assert got == {"rows": 7, "classifier_scored": 5, "already_had_alternates": 1, "missing_text": 1, "backfilled": 3, "from_prompt": 1, "from_transcript": 1, "from_snippet": 1, "from_missing": 1}
    out = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert [out[i] for i in (1, 2, 4, 5)] == [lines[i] for i in (1, 2, 4, 5)]  # untouched, to the byte
    first, fourth, last = json.loads(out[0]), json.loads(out[3]), json.loads(out[6])
    assert first["ü"] == [1, {"a": None}] and set(first["classifier"]["alternates"]) == {"m", "n"} and first["classifier"]["alternates_prompt_source"] == "prompt"
    assert fourth["classifier"]["alternates"]["m"] == {"score": 0.9} and abs(fourth["classifier"]["alternates"]["n"]["score"] - 0.5) < 1e-12
    assert last["classifier"]["alternates_prompt_source"] == "transcript"


def test_large_models_agree_with_small_ones(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "bad bad good other"), (2, "nothing known"), (3, ""), (4, None), (5, "good " * 40 + "bad"), (6, "bad " * 9 + "good")], "id long, text string").repartition(2)
    ask = lambda: sorted((r.id, r.model, r.score, str(r.explanations), r.error) for r in scoring.family_scores(docs, "id", words(), models(spark), {"m": 0.5, "n": -1.0, "x": 0.0}).collect())
    small = ask()
    monkeypatch.setattr(scoring, "SMALL_MODEL", 0)
    monkeypatch.setattr(scoring, "BLOCK", 4)
    assert ask() == small and len(small) == 18


def test_a_long_text_costs_its_length(spark):
    """Its norm was worked out anew for each of its terms: 60,000 distinct ones took many minutes."""
    import time

    terms = [f"t{i}" for i in range(60_000)]
    model = spark.createDataFrame([("word", t, 1.0, 1.0) for t in terms], "section string, term string, idf double, coef double")
    docs = spark.createDataFrame([(1, " ".join(terms))], "id long, text string")
    began = time.monotonic()
    assert abs(scoring.scores(docs, "id", words(), model, 0.0).first().score - sigmoid(math.sqrt(60_000))) < 1e-9
    assert abs(scoring.contributions(docs, "id", words(), model).groupBy().sum("contribution").first()[0] - math.sqrt(60_000)) < 1e-6
    assert time.monotonic() - began < 100
