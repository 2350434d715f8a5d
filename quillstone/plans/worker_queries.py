"""Queries over a worker's runs and scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import diff
from quillstone.operators import cadence, worker
from quillstone.operators import events as ev
from quillstone.plans.tables import EVENTS, TWICE, events, messages, table, twice

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH RECURSIVE {TWICE}, claimed AS (
  SELECT event_id, cwd, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM one WHERE triggered
), arrived AS (SELECT DISTINCT cwd, sec FROM claimed), fires(cwd, f) AS (
  SELECT cwd, min(sec) FROM arrived GROUP BY cwd
  UNION ALL
  SELECT cwd, f FROM (
    SELECT r.cwd, least(min(a.sec) FILTER (a.sec >= r.f + 60), CASE WHEN count(*) FILTER (a.sec < r.f + 60) > 0 THEN r.f + 61 END) AS f
    FROM fires r JOIN arrived a ON a.cwd = r.cwd AND a.sec > r.f GROUP BY r.cwd, r.f)
), numbered AS (SELECT cwd, f, row_number() OVER (PARTITION BY cwd ORDER BY f) AS run FROM fires)
SELECT c.event_id, c.cwd, n.run, n.f AS fired_at FROM claimed c ASOF JOIN numbered n ON c.cwd = n.cwd AND c.sec <= n.f""")
def cooldown_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    claimed = ev.collapsed(twice(events(spark, sf_dir)).where("triggered"))
    return worker.batches(claimed, worker="cwd").select("event_id", "cwd", "run", "fired_at")


@query(f"""WITH RECURSIVE {EVENTS}, s AS (
  SELECT cwd AS host, event_id, epoch(ts) AS sec, 'g' || k AS gen, review_triggered AS changed, row_number() OVER (PARTITION BY cwd ORDER BY ts, event_id) AS i FROM ev
), walk AS (
  SELECT host, event_id, i, sec, gen, 1 AS turns, CAST(NULL AS DOUBLE) AS minutes, CASE WHEN 1 < 3 THEN 'cadence needs 3 completed turns' WHEN NOT changed THEN 'no changed transcripts' ELSE '' END AS reason, CAST(NULL AS DOUBLE) AS last_run, 1 AS kept FROM s WHERE i = 1
  UNION ALL
  SELECT n.host, n.event_id, n.i, n.sec, n.gen, n.turns, n.minutes, n.reason, CASE WHEN n.reason = '' THEN n.sec ELSE n.last_run END, CASE WHEN n.reason = '' THEN 0 ELSE n.turns END FROM (
    SELECT s.host, s.event_id, s.i, s.sec, s.gen, w.kept + 1 AS turns, (s.sec - w.last_run) / 60 AS minutes, w.last_run,
      CASE WHEN s.gen = w.gen THEN 'generation already processed' WHEN w.kept + 1 < 3 THEN 'cadence needs 3 completed turns' WHEN (s.sec - w.last_run) / 60 < 30 THEN 'cadence needs 30 minutes since last run' WHEN NOT s.changed THEN 'no changed transcripts' ELSE '' END AS reason
    FROM walk w JOIN s ON s.host = w.host AND s.i = w.i + 1) n)
SELECT host, CAST(event_id AS VARCHAR) AS event_id, CAST(turns AS INT) AS turns, round(minutes, 6) AS minutes, reason, reason = '' AS ran FROM walk""")
def cadence_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a completed turn of its folder's host."""
    e = events(spark, sf_dir)
    rows = e.select(F.col("cwd").alias("host"), "ts", "event_id", F.lit("stop").alias("kind"), F.concat(F.lit("g"), "k").alias("generation"), F.col("review_triggered").alias("changed"), F.lit(False).alias("force"))
    return cadence.replayed(rows).withColumn("minutes", F.round("minutes", 6))


@query(f"""WITH {EVENTS}, last AS (SELECT conv_id, arg_max(text, turn) AS prompt, max(turn + 1) AS line FROM conversations WHERE role = 'user' GROUP BY conv_id),
  snap AS (SELECT DISTINCT conv_id FROM conversations)
  SELECT 'manual:r1:' || s.conv_id || ':/t/' || s.conv_id || ':' || coalesce(line, 0) AS event_id, 's' || s.conv_id AS session_id, '/t/' || s.conv_id AS transcript_path, line AS transcript_line,
    CASE WHEN coalesce(prompt, '') <> '' THEN sha256(prompt) END AS prompt_hash, coalesce(left(prompt, 300), '') AS snippet FROM snap s LEFT JOIN last USING (conv_id)""")
def manual_run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).withColumn("path", F.concat(F.lit("/t/"), F.col("file").cast("string")))
    snapshots = m.select("path", F.col("file").alias("nth")).distinct()
    sessions = m.select("path", F.concat(F.lit("s"), F.col("file").cast("string")).alias("session_id"), F.lit("").alias("cwd")).distinct()
    found = ev.manual_events(snapshots, m.where("role = 'user'").select("path", "line", "text"), sessions, "r1", "2024-01-01", "v1")
    return found.select("event_id", "session_id", "transcript_path", "transcript_line", "prompt_hash", "snippet")


@query(f"""WITH {EVENTS}, l AS (SELECT cwd AS path, event_id AS line, ts FROM ev ORDER BY ts DESC, cwd DESC, event_id DESC LIMIT 1)
  SELECT path, line, l.ts, triggered IS NOT NULL AS processed, triggered, CASE WHEN epoch(l.ts)::BIGINT - epoch(m)::BIGINT > 0 THEN floor(epoch(l.ts))::BIGINT - floor(epoch(m))::BIGINT END AS behind
  FROM l, (SELECT max(ts) AS m FROM ev WHERE triggered) LEFT JOIN ev ON cwd = path AND event_id = line AND triggered""")
def latest_message_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event as a message, against the triggered ones as what was logged."""
    e = events(spark, sf_dir)
    told = e.select(F.col("cwd").alias("path"), F.col("event_id").alias("line"), "ts")
    logged = e.where("triggered").withColumnsRenamed({"cwd": "transcript_path"}).withColumn("transcript_line", F.col("event_id"))
    return ev.latest_processed(told, logged, "hook")


@query()
def neighbour_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line diffs of every document to the one with the next id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("after")), "doc_id")
    return diff.unified(pairs, "doc_id", "text", "after")
