"""The filter of control messages against its SQL on texts that the tables don't hold, and the fuller rules beside it."""

import duckdb
from pyspark.sql import functions as F

from quillstone.functions import text
from quillstone.plans import registry

AGENTS, TAG = "# AGENTS.md instructions", "<environment_context>"
HEADS = ["", " ", "\t", "\n", "\u00a0", "\u3000 ", " \n", "\u200b", "\x1c", "\u0085", "\u2028", "\ufeff", "x"]
BODIES = [
    "", "plain", AGENTS, AGENTS.lower(), AGENTS.upper(), AGENTS.upper().replace("I", "\u0130"), AGENTS.replace("s", "\u017f"), AGENTS[:-1], AGENTS + "\u0130",
    TAG, TAG.upper(), TAG[:-1], "<a cwd>", "<user_instructions>", "<instructions>", "<turn_aborted>", "We need answer", "# files mentioned by the user:",
]


def test_filter_is_its_sql(spark, tmp_path):
    texts = [None] + [h + b for h in HEADS for b in BODIES]
    rows = [(12 * k + m, t) for k, t in enumerate(texts) for m in (0, 1, 4, 6)] + [(None, t) for t in texts] + [(-5 - 12 * k, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(registry.ORACLES["control_message_filter"]).fetchall()
    got = [tuple(r) for r in registry.QUERIES["control_message_filter"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and {r[1] for r in got} == {r[2] for r in got} == {True, False, None}


def test_filter_row_by_row(spark, tmp_path):
    texts = {1: None, 2: "", 3: "\t" + AGENTS, 5: "\u00a0" + AGENTS.upper(), 7: "<user_instructions>", 9: TAG.upper(), 11: "\u2003" + TAG, 12: "plain", 13: "plain"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.control, r.corpus_control) for r in registry.QUERIES["control_message_filter"](spark, str(tmp_path)).collect()}
    no, yes = (False, False), (True, True)
    assert got == {1: (None, None), 2: no, 3: no, 5: (True, False), 7: no, 9: no, 11: yes, 12: yes, 13: no}


def test_fuller_rules(spark):
    """What other queries and the readers of transcripts drop."""
    want = {
        None: (False, True), "": (False, True), "\n": (False, True), "plain": (False, False), "\t" + AGENTS: (True, True), AGENTS.upper(): (True, False), "\u2028" + TAG: (True, True),
        "<turn_aborted>": (True, False), "<user_instructions>": (False, True), " We need answer": (False, True), "we need answer": (False, False), "<a cwd>\n": (False, True), "<a cwd> b": (False, False),
    }
    rows = spark.createDataFrame([(t,) for t in want], "t string").select("t", text.is_control(F.col("t")).alias("a"), text.is_corpus_control(F.col("t")).alias("b"))
    assert {r.t: (r.a, r.b) for r in rows.collect()} == want
