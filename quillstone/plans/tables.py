"""The input tables in the shapes that the operators take, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged events; the text is the type with its properties."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    return e.select(
        "event_id", "ts", F.lit("hook").alias("source"), F.when(F.col("event_id") % 11 == 0, "assistant").when(F.col("event_id") % 3 == 0, "user").alias("role"),
        F.concat(F.lit("v"), (k % 5).cast("string")).alias("version"), (F.col("event_type") == "error").alias("triggered"),
        F.col("event_type").isin("error", "purchase").alias("review_triggered"), F.col("user_id").cast("string").alias("session_id"),
        F.concat(F.lit("/work/p"), (F.col("user_id") % 7).cast("string")).alias("cwd"), F.lit("").alias("prompt_hash"),
        F.concat_ws(" ", "event_type", "props").alias("snippet"), (F.col("value") / (F.col("value") + 25)).alias("score"), "event_type", k.alias("k"),
    )


#: The same as a common table expression.
EVENTS = """ev AS (
  SELECT event_id, ts, 'hook' AS source, CASE WHEN event_id % 11 = 0 THEN 'assistant' WHEN event_id % 3 = 0 THEN 'user' END AS role,
         'v' || (CAST(regexp_extract(props, '(\\d+)', 1) AS INT) % 5) AS version, event_type = 'error' AS triggered,
         event_type IN ('error', 'purchase') AS review_triggered, CAST(user_id AS VARCHAR) AS session_id,
         '/work/p' || (user_id % 7) AS cwd, '' AS prompt_hash, event_type || ' ' || props AS snippet,
         value / (value + 25) AS score, event_type, CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS k
  FROM events)"""


def twice(e: DataFrame) -> DataFrame:
    """Every event as seen by a hook and, a second later, by a scanner."""
    later = e.withColumns({"event_id": F.col("event_id") + 10_000_000, "ts": (F.col("ts").cast("timestamp") + F.expr("interval 1 second")).cast("timestamp_ntz"), "source": F.lit("scan")})
    return e.unionByName(later)


TWICE = EVENTS + """, tw AS (
  SELECT * FROM ev UNION ALL
  SELECT * REPLACE (event_id + 10000000 AS event_id, ts + INTERVAL 1 SECOND AS ts, 'scan' AS source) FROM ev
), direct AS (
  SELECT *, floor(epoch(ts) / 120) AS bucket FROM tw WHERE coalesce(role, '') IN ('', 'user')
), one AS (
  SELECT * FROM direct QUALIFY row_number() OVER (PARTITION BY session_id, cwd, snippet, bucket ORDER BY event_id) = 1
)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as transcript rows."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("file"), (F.col("turn") + 1).alias("line"), "role", "text")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text", "lang")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three voters per label: two repeat its halves, the third errs on every fifth document."""
    base = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("record_id"), (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t"))
    one = base.select("record_id", F.lit("a").alias("label_file"), F.col("t").alias("should_wake"))
    two = base.where("record_id % 2 = 0").select("record_id", F.lit("b").alias("label_file"), (F.col("t") | ~F.col("q")).alias("should_wake"))
    three = base.where("record_id % 3 = 0").select("record_id", F.lit("c").alias("label_file"), F.when(F.col("record_id") % 5 == 0, ~F.col("t")).otherwise(F.col("t")).alias("should_wake"))
    confidence = F.round(0.5 + (F.col("record_id") % 50) / 100, 2)
    return one.unionByName(two).unionByName(three).select("record_id", "label_file", "should_wake", confidence.alias("confidence"), F.when(F.col("record_id") % 17 == 0, "timeout").alias("error"))


VOTES = """base AS (SELECT doc_id AS record_id, quality = 1 AS q, toxic = 1 AS t FROM labels), votes AS (
  SELECT *, round(0.5 + CAST(record_id % 50 AS DOUBLE) / 100, 2) AS confidence, CASE WHEN record_id % 17 = 0 THEN 'timeout' END AS error FROM (
    SELECT record_id, 'a' AS label_file, t AS should_wake FROM base
    UNION ALL SELECT record_id, 'b', t OR NOT q FROM base WHERE record_id % 2 = 0
    UNION ALL SELECT record_id, 'c', CASE WHEN record_id % 5 = 0 THEN NOT t ELSE t END FROM base WHERE record_id % 3 = 0))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with two scores: ``id, label, grp, a, b``."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("toxic") == 1).alias("label"))
    a = ((F.col("id") * 37) % 101) / 101.0 * 0.6 + F.when(F.col("label"), 0.35).otherwise(0.0)
    b = ((F.col("id") * 53) % 97) / 97.0 * 0.7 + F.when(F.col("label"), 0.25).otherwise(0.0)
    return labels.select("id", "label", F.concat(F.lit("g"), (F.col("id") % 4).cast("string")).alias("grp"), F.round(a, 3).alias("a"), F.round(b, 3).alias("b"))


SCORED = """scored AS (
  SELECT doc_id AS id, toxic = 1 AS label, 'g' || (doc_id % 4) AS grp,
         round(((doc_id * 37) % 101) / CAST(101.0 AS DOUBLE) * CAST(0.6 AS DOUBLE) + CASE WHEN toxic = 1 THEN CAST(0.35 AS DOUBLE) ELSE 0 END, 3) AS a,
         round(((doc_id * 53) % 97) / CAST(97.0 AS DOUBLE) * CAST(0.7 AS DOUBLE) + CASE WHEN toxic = 1 THEN CAST(0.25 AS DOUBLE) ELSE 0 END, 3) AS b
  FROM labels)"""
