"""Queries over n-grams, transcripts, trained models and repeated complaints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text
from quillstone.operators import labels as label_ops
from quillstone.operators import metrics, repetition, scoring, training
from quillstone.plans.tables import corpus, scored, table
from quillstone.sources import jsonl

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")
def transcript_message_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    parts = F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"), F.col("role").alias("role"))
    plain = F.struct(F.col("text").alias("content"), F.col("role").alias("role"))
    value = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(parts.alias("message")))).otherwise(F.to_json(F.struct(plain.alias("message"))))
    rows = jsonl.lenient(c.select("conv_id", "turn", value.alias("value")))
    return rows.where(jsonl.get("$.message.role") == "user").select("conv_id", "turn", jsonl.content("$.message.content").alias("text"))


@query("SELECT doc_id, strip_accents(text) AS plain FROM documents")
def accents_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.strip_accents(F.col("text")).alias("plain"))


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]{2,}') AS w FROM documents),
  g AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM t) SELECT doc_id, gram, count(*) AS n FROM g GROUP BY doc_id, gram""")
def word_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.word_pairs(table(spark, sf_dir, "documents"), "doc_id")


@query("""WITH w AS (SELECT doc_id, ' ' || unnest(regexp_extract_all(lower(text), '\\S+')) || ' ' AS p FROM documents),
  g AS (SELECT doc_id, unnest(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))) AS gram FROM w) SELECT doc_id, gram, count(*) AS n FROM g GROUP BY doc_id, gram""")
def char_trigrams_within_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.character_threes(table(spark, sf_dir, "documents"), "doc_id")


@query("""SELECT o_orderpriority AS version, count(*) AS n, CAST(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS BIGINT) AS building
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def version_dim_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    subjects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("version"), F.col("c_mktsegment").alias("subject"))
    told = label_ops.with_subject(table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_custkey").alias("version")), subjects, "version", "subject")
    return told.groupBy(F.col("o_orderpriority").alias("version")).agg(F.count("*").alias("n"), F.count_if(F.col("subject") == "BUILDING").alias("building"))


STOPPED = ", ".join(f"'{w}'" for w in repetition.STOPWORDS)


@query(rf"""WITH said AS (
  SELECT conv_id || '-' || turn AS event_id, conv_id * 30 + turn * 10 AS ts, text, conv_id, conv_id % 5 AS place FROM conversations WHERE role = 'user'
), words AS (
  SELECT *, list_filter(list_transform(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_'']*'), lambda w: rtrim(w, '''')), lambda w: length(w) >= 2 AND w NOT IN ({STOPPED})) AS ws FROM said
), stems AS (
  SELECT *, list_transform(ws, lambda w: CASE WHEN w LIKE '%ing' AND length(w) >= 6 THEN left(w, -3) WHEN w LIKE '%ed' AND length(w) >= 5 THEN left(w, -2)
    WHEN w LIKE '%es' AND length(w) >= 5 THEN left(w, -2) WHEN w LIKE '%s' AND length(w) >= 5 THEN left(w, -1) ELSE w END) AS st FROM words
), features AS (
  SELECT *, list_distinct(list_concat(list_transform(st, lambda w: 'w:' || w),
    list_transform(range(1, len(st)), lambda i: 'b:' || st[i] || ' ' || st[i + 1]),
    list_transform(range(1, length(array_to_string(st, ' ')) - 2), lambda i: 'c:' || substr(array_to_string(st, ' '), i, 4)))) AS f FROM stems
), ok AS (
  SELECT *, EXISTS (SELECT 1 FROM said o WHERE o.conv_id = e.conv_id AND o.text = e.text AND o.ts < e.ts AND o.ts >= e.ts - 600) AS twice
  FROM features e WHERE length(trim(regexp_replace(text, '\s+', ' ', 'g'))) >= 24 AND len(ws) >= 4 AND len(f) >= 4
), kept AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY ts, event_id) AS nth FROM ok WHERE NOT twice
), pairs AS (
  SELECT e.event_id, o.event_id AS other, o.nth, len(list_intersect(e.f, o.f)) / CAST(len(e.f) + len(o.f) - len(list_intersect(e.f, o.f)) AS DOUBLE) AS share
  FROM kept e JOIN kept o ON e.place = o.place AND o.nth < e.nth AND o.nth >= e.nth - 75 AND o.ts >= e.ts - 1800
), likes AS (
  SELECT event_id, count(*) AS n, max(share) AS top, list(other ORDER BY share DESC, nth)[1:5] AS alike FROM pairs WHERE share >= 0.2 GROUP BY event_id
)
SELECT o.event_id, o.place, twice AS duplicate, CAST(1 + coalesce(n, 0) AS INT) AS repeat_count, coalesce(round(top, 4), 0.0) AS similarity, NOT twice AND coalesce(n, 0) >= 1 AS triggered, coalesce(alike, []) AS "similar"
FROM ok o LEFT JOIN likes USING (event_id)""")
def repetition_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    events = c.select(
        F.concat_ws("-", "conv_id", "turn").alias("event_id"), (F.col("conv_id") * 30 + F.col("turn") * 10).cast("double").alias("ts"), F.lit(None).cast("double").alias("observed_at"),
        F.col("text").alias("prompt"), F.col("conv_id").cast("string").alias("session_id"), F.concat(F.lit("/w/"), (F.col("conv_id") % 5).cast("string")).alias("cwd"),
        F.lit("").alias("transcript_path"), F.lit("").alias("message_locator"), F.lit(0.5).alias("score"), F.lit(True).alias("review"), F.lit(False).alias("triggered"),
    )
    found = repetition.joined(events, "ts", repetition.Settings(similarity=0.2))
    return found.select("event_id", (F.split("event_id", "-")[0].cast("long") % 5).alias("place"), "duplicate", "repeat_count", "similarity", "triggered", "similar")


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("label"))
    return label_ops.stratified_folds(corpus(spark, sf_dir).select("id", "text").join(labels, "id"), "id", "label", 4)


@query(r"""WITH d AS (SELECT doc_id AS id, text, quality = 1 AS y FROM documents JOIN labels USING (doc_id)),
  tok AS (SELECT id, y, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]{2,}')) AS term FROM d),
  c AS (SELECT id, y, term, count(*) AS n FROM tok GROUP BY ALL),
  f AS (SELECT term, ln((1.0 + (SELECT count(*) FROM d)) / (1.0 + count(*))) + 1 AS idf FROM c GROUP BY term),
  v AS (SELECT id, y, term, idf, (1 + ln(n)) * idf AS v FROM c JOIN f USING (term)),
  w AS (SELECT y, term, idf, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM v),
  k AS (SELECT greatest(count(*) FILTER (y), 1) AS p, greatest(count(*) FILTER (NOT y), 1) AS m FROM (SELECT DISTINCT id, y FROM tok)),
  s AS (SELECT term, any_value(idf) AS idf, coalesce(sum(v) FILTER (y), 0) / any_value(p) - coalesce(sum(v) FILTER (NOT y), 0) / any_value(m) AS diff FROM w, k GROUP BY term)
  SELECT 'word' AS section, term, round(idf, 6) AS idf, round(diff * 52.0, 6) AS coef FROM s WHERE abs(diff) >= 2e-5""")
def centroid_difference_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms whose difference reaches the least one."""
    docs = _training(spark, sf_dir).withColumn("label", F.col("label") == 1)
    found = scoring.centroid_model(docs, "id", "label", scoring.word_section(), "word", 1 << 30, 52.0)
    return found.withColumns({"idf": F.round("idf", 6), "coef": F.round("coef", 6)})


def _text_metrics(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = _training(spark, sf_dir)
    model = training.fit_text(rows.where("fold <> 0"), kind=kind)
    found = training.text_scores(model, rows.where("fold = 0"))
    return metrics.ranking(found.withColumn("label", F.col("label") == 1), "score")


@query()
def tfidf_logistic_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_metrics(spark, sf_dir, "logistic")


@query()
def complement_bayes_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_metrics(spark, sf_dir, "bayes")


@query()
def embedding_logistic_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training.vectors(table(spark, sf_dir, "embeddings"), "vec_id", F.col("label") % 2)
    model = training.fit_vectors(rows.where("id % 4 <> 0"), scaled=True)
    return metrics.ranking(training.vector_scores(model, rows.where("id % 4 = 0")).withColumn("label", F.col("label") == 1), "score")


@query()
def stacked_scores_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("y", F.col("label")).withColumn("label", F.col("label").cast("double"))
    model = training.stacked(rows.where("grp <> 'g0'"), ["a", "b"])
    found = training.vector_scores(model, training.stack_features(rows.where("grp = 'g0'"), ["a", "b"]))
    return metrics.ranking(found.withColumn("label", F.col("label") == 1), "score")
