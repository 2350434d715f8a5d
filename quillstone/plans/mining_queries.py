"""Queries over mined examples, evaluation by group, matched answers and worker state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import records, text
from quillstone.operators import labels as ops
from quillstone.operators import metrics, mining
from quillstone.plans.tables import EVENTS, SCORED, VOTES, events, messages, scored, table, votes

QUERIES, ORACLES = {}, {}
GRID = [round(x / 1000, 3) for x in range(200, 951, 50)]


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


COUNTS = """count(*) FILTER (p AND label) AS tp, count(*) FILTER (p AND NOT label) AS fp, count(*) FILTER (NOT p AND label) AS fn, count(*) FILTER (NOT p AND NOT label) AS tn"""
RATES = """coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall"""
MATRIX = SCORED + f""", said AS (SELECT 'a' AS model, grp, label, a >= 0.6 AS p FROM scored UNION ALL SELECT 'b', grp, label, b >= 0.5 FROM scored),
  matrix AS (SELECT *, {RATES} FROM (SELECT model, grp, {COUNTS} FROM said GROUP BY ALL))"""


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.model_matrix(scored(spark, sf_dir), {"a": F.col("a") >= 0.6, "b": F.col("b") >= 0.5}, "grp")


@query(f"WITH {MATRIX} SELECT model, grp, tp, fp, fn, tn, precision, recall FROM matrix")
def model_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir).select("model", "grp", "tp", "fp", "fn", "tn", "precision", "recall")


@query(f"WITH {MATRIX} SELECT model, count(*) AS groups, avg(precision) AS mean_precision, avg(recall) AS mean_recall, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM matrix GROUP BY 1")
def macro_mean_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.macro_means(_matrix(spark, sf_dir))


@query(f"""WITH {SCORED}, placed AS (SELECT grp, threshold, label, a >= threshold AS p FROM scored, (SELECT unnest(CAST({GRID} AS DOUBLE[])) AS threshold)),
  sweep AS (SELECT *, {RATES} FROM (SELECT grp, threshold, {COUNTS} FROM placed GROUP BY ALL))
  SELECT grp, threshold, precision, recall FROM sweep WHERE precision >= 0.2 AND recall >= 0.3 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY recall DESC, precision DESC, threshold) = 1""")
def best_with_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweep = metrics.sweep(scored(spark, sf_dir), "a", GRID, by=["grp"])
    return mining.best_with(sweep, 0.2, 0.3, ["grp"]).select("grp", "threshold", "precision", "recall")


@query(f"WITH {SCORED} SELECT id, a FROM scored WHERE label AND a < 0.8 ORDER BY a DESC, id LIMIT 40")
def misses_top40(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.misses(scored(spark, sf_dir), "a", 0.8).select("id", "a")


@query(f"""WITH {SCORED} SELECT * FROM (SELECT id, a, 'fp' AS error FROM scored WHERE NOT label AND a >= 0.5 ORDER BY a DESC, id LIMIT 8)
  UNION ALL SELECT * FROM (SELECT id, a, 'fn' FROM scored WHERE label AND a < 0.5 ORDER BY a DESC, id LIMIT 8)""")
def worst_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.worst_errors(scored(spark, sf_dir), "a", 0.5).select("id", "a", "error")


@query(f"WITH {SCORED} SELECT a >= 0.5 AS gate, b >= 0.5 AS base, label, count(*) AS n FROM scored GROUP BY ALL")
def two_score_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.two_score_confusion(scored(spark, sf_dir), F.col("a") >= 0.5, F.col("b") >= 0.5)


@query(f"""WITH {SCORED} SELECT grp, count(*) AS rows, count(*) FILTER (d.doc_id IS NULL) AS missing, count(*) FILTER (d.doc_id IS NOT NULL AND (a >= 0.5) = label) AS "right",
  count(*) FILTER (d.doc_id IS NOT NULL AND (a >= 0.5) <> label) AS wrong FROM scored LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0) d ON d.doc_id = id GROUP BY grp""")
def scored_with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = table(spark, sf_dir, "documents").where("doc_id % 7 <> 0").select(F.col("doc_id").alias("id"))
    return mining.scored_with_missing(scored(spark, sf_dir), corpus, F.col("a") >= 0.5, "grp")


@query("""WITH b AS (SELECT doc_id AS id, CASE WHEN source = 'src3' THEN 1 WHEN source = 'src5' THEN 2 ELSE 3 END AS bucket FROM documents),
  r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY id) AS rn FROM b)
  SELECT id, bucket, CAST(row_number() OVER (ORDER BY rn, bucket) AS INTEGER) AS position FROM r QUALIFY position <= 120""")
def source_balanced_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return mining.source_balanced(docs, "source", ["src3", "src5"], [F.col("id")], 120).select("id", "bucket", "position")


@query(f"""WITH {SCORED}, b AS (SELECT id, CASE WHEN a >= 0.3 AND a < 0.5 THEN 0 WHEN a >= 0.5 AND a < 0.675 THEN 1 WHEN a >= 0.675 AND a < 0.901 THEN 2 END AS bucket FROM scored),
  r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY id) AS rn FROM b WHERE bucket IS NOT NULL)
  SELECT id, bucket, CAST(row_number() OVER (ORDER BY rn, bucket) AS INTEGER) AS position FROM r QUALIFY position <= 90""")
def band_stratified_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = [(0.3, 0.5), (0.5, 0.675), (0.675, 0.901)]
    return mining.band_stratified(scored(spark, sf_dir), "a", bands, [F.col("id")], 90).select("id", "bucket", "position")


def _sql(pattern: str) -> str:
    """The pattern as SQL's literal; its word boundaries know ASCII only, so those at both ends are written out."""
    if pattern.startswith(r"\b"):
        pattern = r"(?:^|[^\p{L}\p{N}_])" + pattern[2:-2] + r"(?:$|[^\p{L}\p{N}_])"
    return pattern.replace("'", "''")


def _slice_sql(name: str) -> str:
    low, high, wanted, barred = mining.SLICES[name]
    tests = [f"regexp_matches(body, '(?i){_sql(mining.KINDS[k])}')" for k in wanted] + [f"NOT regexp_matches(body, '(?i){_sql(mining.KINDS[k])}')" for k in barred]
    return f"SELECT doc_id AS id, '{name}' AS slice FROM d WHERE score BETWEEN {low} AND {high} AND NOT regexp_matches(body, '{_sql(mining.QUOTED)}') AND {' AND '.join(tests)}"


#: Complaints that are put before the texts, which hold none themselves.
OPENINGS = ("The build is broken.", "Please revert to the original.", "Why is it so?", "Keep going now.", "You guessed.", "Why didn't you test the api error?")
_OPENED = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{_sql(o)}'" for i, o in enumerate(OPENINGS)) + " ELSE '' END"


@query(f"WITH d AS (SELECT doc_id, {_OPENED} || ' ' || coalesce(text, '') AS body, CAST(doc_id % 100 AS DOUBLE) / 100 AS score FROM documents) " + " UNION ALL ".join(_slice_sql(n) for n in mining.SLICES))
def pattern_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    opening = F.get(F.array(*map(F.lit, OPENINGS)), (F.col("doc_id") % 7).cast("int"))
    body = F.concat_ws(" ", F.coalesce(opening, F.lit("")), F.coalesce("text", F.lit("")))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), body.alias("body"), ((F.col("doc_id") % 100).cast("double") / 100).alias("score"))
    return mining.pattern_slices(d, "body", "score").select("id", "slice")


_ORDERS = "CASE slice WHEN 'agent_control_low_mid' THEN CAST(score >= 0.30 AS INT) WHEN 'method_tool_low_miss' THEN CAST(score >= 0.35 AS INT) ELSE abs(score - 0.675) END, CASE slice WHEN 'agent_control_low_mid' THEN abs(score - 0.30) WHEN 'method_tool_low_miss' THEN -score ELSE 0 END, id"


@query(f"WITH d AS (SELECT doc_id, {_OPENED} || ' ' || coalesce(text, '') || CASE WHEN doc_id % 9 = 0 THEN chr(10) || '> quoted' ELSE '' END AS body, CAST(doc_id % 100 AS DOUBLE) / 100 AS score FROM documents), s AS (" + " UNION ALL ".join(_slice_sql(n) for n in mining.SLICES)
       + f" UNION ALL SELECT doc_id, 'quoted_context_hard_negatives' FROM d WHERE regexp_matches(body, '{_sql(mining.QUOTED)}') AND (score >= 0.25 OR doc_id % 5 = 0)"
       + f"), r AS (SELECT s.id, slice, score FROM s JOIN d ON d.doc_id = s.id) SELECT id, slice, CAST(row_number() OVER (PARTITION BY slice ORDER BY {_ORDERS}) AS INT) AS rank FROM r QUALIFY row_number() OVER (PARTITION BY slice ORDER BY {_ORDERS}) <= 40")
def ranked_pattern_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    opening = F.get(F.array(*map(F.lit, OPENINGS)), (F.col("doc_id") % 7).cast("int"))
    body = F.concat(F.concat_ws(" ", F.coalesce(opening, F.lit("")), F.coalesce("text", F.lit(""))), F.when(F.col("doc_id") % 9 == 0, "\n> quoted").otherwise(""))
    label = F.when(F.col("doc_id") % 5 == 0, "quoted_or_pasted_context")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), body.alias("body"), ((F.col("doc_id") % 100).cast("double") / 100).alias("score"), label.alias("teacher"))
    return mining.ranked_slices(d, "id", "body", "score", "teacher", 40).select("id", "slice", "rank")


@query("SELECT coalesce(source, 'unknown') AS source, count(*) AS n FROM documents GROUP BY 1")
def dataset_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.mix(table(spark, sf_dir, "documents"), "source")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS per_row FROM events GROUP BY 1")
def elapsed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mining.elapsed(table(spark, sf_dir, "events"), "value", ["event_type"])
    return found.withColumns({"total": F.round("total", 4), "per_row": F.round("per_row", 6)})


@query("""WITH i AS (SELECT doc_id AS line, doc_id AS k FROM documents), a AS (SELECT doc_id AS line, CASE WHEN doc_id % 9 = 0 THEN doc_id + 1 ELSE doc_id END AS k FROM labels WHERE doc_id % 10 <> 3)
  SELECT line, i.k AS input_key, a.k AS answer_key, i.k IS NOT DISTINCT FROM a.k AS same FROM i FULL JOIN a USING (line)""")
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line"), F.col("doc_id").alias("k"))
    a = table(spark, sf_dir, "labels").where("doc_id % 10 <> 3").select(F.col("doc_id").alias("line"), F.expr("if(doc_id % 9 = 0, doc_id + 1, doc_id)").alias("k"))
    return mining.positional(i, a, "line", "k")


#: Batches of eight documents, every fifth of one; each eleventh id is answered under another.
REQUESTS = "SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 1000000 + doc_id ELSE doc_id DIV 8 END AS batch FROM labels"


@query(f"""WITH r AS ({REQUESTS.replace('DIV', '//')}), an AS (SELECT batch, CASE WHEN id % 11 = 0 THEN -1 ELSE id END AS id, id % 2 = 0 AS answer, id AS n FROM r),
  la AS (SELECT batch, id, answer FROM an QUALIFY row_number() OVER (PARTITION BY batch, id ORDER BY n DESC) = 1),
  c AS (SELECT batch, count(*) AS m, max(answer) AS sole FROM an GROUP BY 1), q AS (SELECT batch, count(*) AS k FROM r GROUP BY 1),
  j AS (SELECT r.batch, r.id, CASE WHEN la.answer IS NOT NULL THEN la.answer WHEN k = 1 AND m = 1 THEN sole END AS answer FROM r LEFT JOIN la USING (batch, id) LEFT JOIN c USING (batch) JOIN q USING (batch)),
  o AS (SELECT *, bool_and(answer IS NOT NULL) OVER (PARTITION BY batch) AS ok FROM j)
  SELECT batch, id, ok, CASE WHEN ok THEN answer END AS answer FROM o""")
def batch_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "labels").selectExpr("doc_id AS id", "CASE WHEN doc_id % 5 = 0 THEN 1000000 + doc_id ELSE doc_id DIV 8 END AS batch")
    a = r.selectExpr("batch", "if(id % 11 = 0, -1, id) AS record_id", "id % 2 = 0 AS answer", "id AS n")
    return mining.batch_answers(r, a, "n")


@query("""WITH x AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE toxic = 1 END AS s, CASE doc_id % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN '1.7' WHEN 2 THEN '0.31' END AS p, CASE WHEN doc_id % 5 = 0 THEN '0.9' END AS c FROM labels),
  y AS (SELECT *, CASE WHEN TRY_CAST(p AS DOUBLE) IS NOT NULL THEN least(greatest(TRY_CAST(p AS DOUBLE), 0), 1) END AS n FROM x), z AS (SELECT *, coalesce(s, coalesce(n, 0.5) >= 0.5) AS should_wake, coalesce(n, CASE WHEN s THEN 0.85 WHEN NOT s THEN 0.15 ELSE 0.5 END) AS wake_probability FROM y)
  SELECT id, should_wake, CAST(wake_probability AS DOUBLE) AS wake_probability, CAST(coalesce(TRY_CAST(c AS DOUBLE), greatest(wake_probability, 1 - wake_probability)) AS DOUBLE) AS confidence FROM z""")
def label_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "labels").selectExpr("doc_id AS id", "if(doc_id % 3 = 0, null, toxic = 1) AS s", "CASE doc_id % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN '1.7' WHEN 2 THEN '0.31' END AS p", "if(doc_id % 5 = 0, '0.9', null) AS c")
    return x.select("id", records.normalised_label(F.col("s"), F.col("p"), F.col("c")).alias("r")).select("id", "r.*")


@query(f"""WITH {EVENTS} SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type WHEN event_id % 4 = 1 THEN cwd WHEN event_id % 4 = 2 THEN snippet ELSE '' END AS text,
  CASE event_id % 4 WHEN 0 THEN 'prompt' WHEN 1 THEN 'transcript' WHEN 2 THEN 'snippet' ELSE 'missing' END AS provenance FROM ev""")
def text_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("event_id") % 4
    found = records.resolved_text(F.when(m == 0, F.col("event_type")).otherwise(" "), F.when(m == 1, F.col("cwd")), F.when(m != 3, F.col("snippet")))
    return events(spark, sf_dir).select("event_id", found.alias("r")).select("event_id", "r.*")


@query(f"""WITH {EVENTS}, i AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'starting' ELSE 'completed' END AS s, event_id % 5 AS pid, event_id % 2 = 0 AS alive, CASE WHEN event_id % 7 < 3 THEN event_id % 7 END AS code FROM ev)
  SELECT event_id, CASE WHEN s = 'completed' OR (pid <> 0 AND alive) THEN s WHEN code = 0 THEN 'completed' WHEN code IS NOT NULL THEN 'failed' WHEN pid <> 0 THEN 'stale' ELSE s END AS status,
  CASE WHEN s <> 'completed' AND NOT (pid <> 0 AND alive) AND (code IS NOT NULL OR pid <> 0) THEN s END AS reported_status,
  CASE WHEN s = 'completed' OR NOT (pid <> 0 AND alive) THEN code END AS exit_code, CASE WHEN s <> 'completed' AND pid <> 0 AND alive THEN code END AS stale_exit_code FROM i""")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = events(spark, sf_dir).selectExpr("event_id", "CASE event_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'starting' ELSE 'completed' END AS s", "event_id % 5 AS pid", "event_id % 2 = 0 AS alive", "CASE WHEN event_id % 7 < 3 THEN event_id % 7 END AS code")
    return i.select("event_id", records.settled_status(F.col("s"), F.col("pid"), F.col("alive"), F.col("code")).alias("r")).select("event_id", "r.*")


@query("""WITH p AS (SELECT page_id, '/home/u/' || CASE page_id % 4 WHEN 0 THEN 'skills/a.md' WHEN 1 THEN '.claude/rules/b.md' WHEN 2 THEN 'x/SKILL.md' ELSE 'myskills/c.md' END AS path FROM pages)
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'skill' WHEN 1 THEN 'agent_rule' WHEN 2 THEN 'skill' ELSE 'agent_file' END AS kind, '~' || substr(path, 8) AS shown, regexp_replace(path, '/[^/]*$', '') AS parent FROM p""")
def path_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").selectExpr("page_id", "concat('/home/u/', CASE page_id % 4 WHEN 0 THEN 'skills/a.md' WHEN 1 THEN '.claude/rules/b.md' WHEN 2 THEN 'x/SKILL.md' ELSE 'myskills/c.md' END) AS path")
    return p.select("page_id", records.surface_kind(F.col("path")).alias("kind"), records.display_path(F.col("path"), "/home/u").alias("shown"), records.parent(F.col("path")).alias("parent"))


@query(f"""WITH {EVENTS} SELECT session_id, count(*) FILTER (event_id > coalesce(r, -1)) AS turns_since_run, any_value(r) AS last_run
  FROM (SELECT *, max(event_id) FILTER (event_type = 'purchase') OVER (PARTITION BY session_id) AS r FROM ev) GROUP BY session_id""")
def cadence_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = events(spark, sf_dir).withColumn("ran", F.col("event_type") == "purchase")
    return mining.turns_since_run(turns, "session_id", "event_id", "ran")


@query(f"""WITH {EVENTS} SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'generation already processed' WHEN k % 10 < 3 THEN 'cadence needs 3 completed turns'
  WHEN event_id % 4 <> 0 AND k < 30 THEN 'cadence needs 30 minutes since last run' WHEN NOT triggered THEN 'no changed transcripts' ELSE '' END AS reason FROM ev""")
def cadence_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    reason = records.skip_reason(F.lit("g"), F.when(F.col("event_id") % 6 == 0, "g"), F.col("k") % 10, F.when(F.col("event_id") % 4 != 0, F.col("k")), F.col("triggered"), 3, 30)
    return e.select("event_id", reason.alias("reason"))


@query(f"""WITH {EVENTS}, w AS (SELECT event_id, k, greatest(60 - k, 0) AS wait FROM ev)
  SELECT event_id, wait, CASE WHEN wait > 0 AND event_id % 3 <> 0 THEN least(greatest(wait + 1, 1), 60) END AS delay FROM w""")
def cooldown_and_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    wait = records.cooldown_wait(F.timestamp_seconds(F.unix_timestamp(now) - F.col("k")), now)
    outstanding = F.when(F.col("event_id") % 3 == 0, F.timestamp_seconds(F.unix_timestamp(now) + 5))
    return events(spark, sf_dir).select("event_id", wait.alias("wait"), records.retry_delay(wait, outstanding, now).alias("delay"))


@query(f"WITH {EVENTS} SELECT snippet, min(event_id) AS event_id FROM ev WHERE coalesce(role, '') <> 'assistant' GROUP BY snippet")
def queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    run, _ = mining.claimed(events(spark, sf_dir), "snippet", "event_id", F.coalesce("role", F.lit("")) != "assistant", F.lit(None).cast("timestamp"), now)
    return run.select("snippet", "event_id")


@query(f"WITH {EVENTS} SELECT session_id, max(CASE WHEN event_id % 5 = 0 THEN 0 ELSE k END) AS most FROM ev GROUP BY 1")
def most_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("attempts", F.when(F.col("event_id") % 5 == 0, "none").otherwise(F.col("k").cast("string")))
    return mining.most_attempts(e, "attempts", ["session_id"])


@query("SELECT DISTINCT word FROM (SELECT unnest(string_split(text, ' ')) AS word FROM conversations)")
def distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.distinct_words(messages(spark, sf_dir).select(F.split("text", " ").alias("words")), "words")


@query(f"WITH {EVENTS} SELECT cwd AS root, min(event_id) AS first_seen FROM ev GROUP BY 1")
def scan_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.scan_roots(events(spark, sf_dir), "cwd", "event_id")


@query(f"""WITH {EVENTS} SELECT session_id, max(event_id) AS latest, arg_max(list_slice([event_type, version, cwd, snippet], 1, 3), event_id) AS changes FROM ev GROUP BY 1""")
def latest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("changes", F.array("event_type", "version", "cwd", "snippet"))
    return mining.latest_changes(e, "session_id", "event_id", "changes")


@query(f"""WITH {EVENTS} SELECT (SELECT count(*) FROM ev WHERE triggered) AS waiting, (SELECT arg_max(event_type, event_id) FROM ev WHERE NOT triggered) AS last_state, (SELECT max(event_id) FROM ev WHERE NOT triggered) AS last_flush""")
def outbox_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return mining.outbox_status(e.where("triggered"), e.where("not triggered").withColumn("state", F.col("event_type")), "event_id")


@query(f"WITH {VOTES} SELECT record_id AS id, arg_max(confidence, label_file) AS score FROM votes WHERE NOT (label_file = 'c' AND record_id % 4 = 0) GROUP BY 1")
def score_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = votes(spark, sf_dir)
    bad = (F.col("label_file") == "c") & (F.col("record_id") % 4 == 0)
    rows = v.select(F.when(F.col("record_id") % 2 == 0, F.col("record_id")).alias("id"), "record_id", "label_file", F.when(bad, "bad").otherwise(F.col("confidence").cast("string")).alias("score"))
    return mining.score_lookup(rows, "label_file")


@query(f"""WITH {SCORED}, {VOTES}, t AS (SELECT record_id, should_wake AS teacher FROM votes WHERE label_file = 'b')
  SELECT d.doc_id AS id, d.lang, s.a AS a_score, CASE WHEN s.id % 2 = 0 THEN s.b END AS b_score, teacher FROM documents d LEFT JOIN scored s ON s.id = d.doc_id LEFT JOIN t ON t.record_id = d.doc_id""")
def mining_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    long = s.select("id", F.lit("a").alias("model"), F.col("a").alias("score")).unionByName(s.where("id % 2 = 0").select("id", F.lit("b").alias("model"), F.col("b").alias("score")))
    teacher = votes(spark, sf_dir).where("label_file = 'b'").select(F.col("record_id").alias("id"), F.col("should_wake").alias("teacher"))
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    return mining.mining_payload(docs, ["id", "lang"], long, ["a", "b"], teacher)


@query(f"""WITH {SCORED} SELECT s.id, s.a, CASE WHEN d.doc_id IS NOT NULL THEN d.source ELSE s.grp END AS tag, coalesce(d.lang, '') AS lang FROM scored s LEFT JOIN (SELECT * FROM documents WHERE doc_id % 3 <> 0) d ON d.doc_id = s.id""")
def scores_with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), F.col("source").alias("tag"), "lang")
    return mining.with_defaults(scored(spark, sf_dir).withColumnRenamed("grp", "tag"), sample, "id", ["tag"], ["lang"]).select("id", "a", "tag", "lang")


@query("SELECT doc_id AS id, 'source: ' || coalesce(source, 'unknown') || chr(10) || substr(coalesce(text, ''), 1, 200) AS text FROM documents")
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), records.embedding_text(F.col("text"), 200, F.col("source")).alias("text"))


@query("""WITH w AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS f FROM conversations)
  SELECT conv_id, turn, list_sort(list(substr(sha256('v1' || chr(0) || f), 1, 20))) AS hashed FROM w GROUP BY ALL""")
def hashed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), 0))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.hashed_features(words, "v1").alias("hashed")).where(F.size("hashed") > 0)


@query(f"WITH {VOTES} SELECT record_id, should_wake FROM votes WHERE error IS NULL QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY label_file DESC) = 1")
def variant_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.variant_labels(votes(spark, sf_dir), ["label_file"])
