"""Queries over gates of two scores and grids of models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import gates, scoring, sparse, tuning
from quillstone.plans.tables import SCORED, corpus, scored, votes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: 50 thresholds from 0.02 on.
FINE = [round(x / 100, 2) for x in range(2, 101, 2)]


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


RATES = "coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall, coalesce((tp + fp) / nullif(tp + fp + fn + tn, 0), 0.0) AS wake_rate"
COUNTS = """count(*) FILTER (p AND label) AS tp, count(*) FILTER (p AND NOT label) AS fp, count(*) FILTER (NOT p AND label) AS fn, count(*) FILTER (NOT p AND NOT label) AS tn"""
GRID = SCORED + f""", grid AS (SELECT CAST(round(i / 50.0, 2) AS DOUBLE) AS t FROM range(1, 51) AS r(i)), passed AS (
  SELECT grp, x.t AS a_threshold, y.t AS b_threshold, label, a >= x.t AND b >= y.t AS p FROM scored, grid x, grid y)"""
ORDER = "(precision >= 0.7 AND tp > 0) DESC, CASE WHEN precision >= 0.7 AND tp > 0 THEN recall ELSE precision END DESC, CASE WHEN precision >= 0.7 AND tp > 0 THEN precision ELSE recall END DESC, wake_rate, a_threshold, b_threshold"


@query(f"WITH {GRID}, found AS (SELECT a_threshold, b_threshold, {COUNTS} FROM passed GROUP BY ALL) SELECT *, {RATES} FROM found")
def gate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.grid(scored(spark, sf_dir), "a", "b", FINE, FINE)


@query(f"WITH {GRID}, found AS (SELECT a_threshold, b_threshold, {COUNTS} FROM passed GROUP BY ALL), rated AS (SELECT *, {RATES} FROM found) SELECT * FROM rated ORDER BY {ORDER} LIMIT 1")
def gate_best_at_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.best(gates.grid(scored(spark, sf_dir), "a", "b", FINE, FINE), 0.7)


@query(f"""WITH {GRID}, own AS (SELECT grp, a_threshold, b_threshold, {COUNTS} FROM passed GROUP BY ALL), rest AS (
  SELECT g.grp, o.a_threshold, o.b_threshold, CAST(sum(o.tp) AS BIGINT) AS tp, CAST(sum(o.fp) AS BIGINT) AS fp, CAST(sum(o.fn) AS BIGINT) AS fn, CAST(sum(o.tn) AS BIGINT) AS tn
  FROM (SELECT DISTINCT grp FROM own) g JOIN own o ON o.grp <> g.grp GROUP BY ALL), rated AS (SELECT *, {RATES} FROM rest), chosen AS (
  SELECT grp, a_threshold, b_threshold FROM rated QUALIFY row_number() OVER (PARTITION BY grp ORDER BY {ORDER}) = 1)
SELECT o.*, {RATES} FROM own o JOIN chosen c USING (grp, a_threshold, b_threshold)""")
def gate_leave_one_group_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.leave_one_group_out(scored(spark, sf_dir), "a", "b", FINE, "grp", 0.7)


@query()
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six settings, each of the three label files held out in turn."""
    docs = corpus(spark, sf_dir).select("id", scoring.word_section().alias("words"))
    voted = votes(spark, sf_dir).where("error is null")
    found, _ = tuning.search(docs, voted, {"words": sparse.word_grams(1, 2)}, tuning.settings([0.5, 2.0, 8.0]), FINE, 0.6)
    return found
