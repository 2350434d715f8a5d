"""Queries over families of models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import scoring, shadow
from quillstone.operators.store import durable
from quillstone.plans.tables import EVENTS, corpus, events
from quillstone.sources import jsonl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _models(docs: DataFrame, grams) -> DataFrame:
    """Three models over the terms of the corpus itself: those in 2 documents or more, weighted by length and first letter; the third is broken."""
    known = scoring.weighed(scoring.document_frequency(docs, grams), docs.count()).where("df >= 2")
    known = durable(known)  # asked for its state, its size and its weights
    coef = {"long": (F.length("term") - 6) / 4.0, "vowel": F.when(F.substring("term", 1, 1).isin("a", "e", "i", "o", "u"), 1.0).otherwise(-1.0), "broken": F.lit(float("nan"))}
    return known.select(F.explode(F.array(*[F.struct(F.lit(n).alias("model"), c.cast("double").alias("coef")) for n, c in coef.items()])).alias("m"), "term", "idf").select("m.model", F.lit("word").alias("section"), "term", "idf", "m.coef")


INTERCEPTS = {"long": -0.5, "vowel": 0.25, "broken": 0.0, "absent": 0.0}


@query(r"""WITH tok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]{2,}')) AS term FROM documents),
  c AS (SELECT id, term, count(*) AS n FROM tok GROUP BY ALL),
  known AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf FROM c GROUP BY term HAVING count(*) >= 2),
  v AS (SELECT id, term, (1 + ln(n)) * idf AS v FROM c JOIN known USING (term)),
  n AS (SELECT id, sqrt(sum(v * v)) AS norm, sum(v * (length(term) - 6) / 4.0) AS x, sum(v * CASE WHEN left(term, 1) IN ('a', 'e', 'i', 'o', 'u') THEN 1 ELSE -1 END) AS y FROM v GROUP BY id)
  SELECT doc_id AS id, model, CASE model WHEN 'long' THEN round(1 / (1 + exp(-(-0.5 + coalesce(x / norm, 0)))), 6) WHEN 'vowel' THEN round(1 / (1 + exp(-(0.25 + coalesce(y / norm, 0)))), 6) END AS score,
    CASE model WHEN 'broken' THEN (SELECT count(*) FROM known) || ' weights are no numbers' WHEN 'absent' THEN 'no weights' END AS error
  FROM documents LEFT JOIN n ON n.id = doc_id, (SELECT unnest(['long', 'vowel', 'broken', 'absent']) AS model)""")
def shadow_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    found = scoring.family_scores(docs, "id", {"word": scoring.word_section()}, _models(docs, scoring.word_section()), INTERCEPTS, explain=0)
    return found.select("id", "model", F.round("score", 6).alias("score"), "error")


@query(f"""WITH {EVENTS}, e AS (SELECT event_id, triggered AS has_prompt, snippet, event_id % 7 <> 0 AS scored, event_id % 5 = 0 AS done, event_id % 13 = 0 AS bare FROM ev)
  SELECT count(*) AS rows, count(*) FILTER (scored) AS classifier_scored, count(*) FILTER (scored AND done) AS already_had_alternates, count(*) FILTER (scored AND NOT done AND NOT has_prompt AND bare) AS missing_text,
    count(*) FILTER (scored AND NOT done AND (has_prompt OR NOT bare)) AS backfilled, count(*) FILTER (scored AND NOT done AND has_prompt) AS from_prompt, CAST(0 AS BIGINT) AS from_transcript,
    count(*) FILTER (scored AND NOT done AND NOT has_prompt AND NOT bare) AS from_snippet, count(*) FILTER (scored AND NOT done AND NOT has_prompt AND bare) AS from_missing FROM e""")
def shadow_backfill_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged events as JSON lines, some with a score, some with all alternates already."""
    e = events(spark, sf_dir)
    score = F.named_struct(F.lit("score"), F.col("score"))
    each = F.named_struct(F.lit("long"), score, F.lit("vowel"), score, F.lit("absent"), score, F.lit("broken"), score)
    classifier = F.when(F.col("event_id") % 7 != 0, F.struct("score", F.when(F.col("event_id") % 5 == 0, each).alias("alternates")))
    line = F.to_json(F.struct("event_id", F.when(F.col("triggered"), F.col("snippet")).alias("prompt"), F.when(F.col("event_id") % 13 != 0, F.col("snippet")).alias("snippet"), classifier.alias("classifier")))
    rows = e.select(F.lit("events").alias("path"), F.col("event_id").alias("line"), line.alias("value"))
    words = {"word": scoring.word_section()}
    models = _models(e.select("snippet"), scoring.word_section("snippet"))
    return shadow.counters(shadow.backfilled(jsonl.preserving(rows), words, models, INTERCEPTS, "2024-01-01T00:00:00+00:00"))
