"""Queries over labels, corpora, metrics and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import scalars, text
from quillstone.operators import labels as ops
from quillstone.operators import metrics, scoring
from quillstone.plans.tables import SCORED, VOTES, corpus, scored, table, votes

QUERIES, ORACLES = {}, {}
GRID = [round(x / 1000, 3) for x in range(200, 951, 50)]


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


MAJORITY = VOTES + """, resolved AS (SELECT record_id, count(*) FILTER (should_wake) >= count(*) FILTER (NOT should_wake) AS label FROM votes GROUP BY record_id)"""


@query(f"WITH {MAJORITY} SELECT record_id, label FROM resolved")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.majority(votes(spark, sf_dir))


@query(f"""WITH {VOTES} SELECT record_id, count(*) AS votes, count(*) FILTER (should_wake) AS true_votes, count(*) FILTER (NOT should_wake) AS false_votes,
  count(*) FILTER (should_wake) >= count(*) FILTER (NOT should_wake) AS label FROM votes GROUP BY record_id""")
def vote_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.vote_counts(votes(spark, sf_dir))


@query(f"WITH {VOTES} SELECT record_id, label_file, should_wake, confidence, error FROM votes QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY label_file DESC) = 1")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.last_write(votes(spark, sf_dir), "record_id", ["label_file"])


@query(f"""WITH {VOTES}, e AS (SELECT * REPLACE (CASE WHEN label_file = 'a' AND record_id % 2 = 0 THEN 'boom' ELSE NULL END AS error) FROM votes)
  SELECT record_id, label_file, error FROM e QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY error IS NOT NULL, label_file) = 1""")
def prefer_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = votes(spark, sf_dir).withColumn("error", F.when((F.col("label_file") == "a") & (F.col("record_id") % 2 == 0), "boom"))
    return ops.prefer_success(v, "record_id", ["label_file"]).select("record_id", "label_file", "error")


@query(f"""WITH {VOTES} SELECT record_id, round(avg(greatest(0.01, least(0.99, CASE WHEN should_wake THEN confidence ELSE 1 - confidence END))), 9) AS teacher, count(*) AS n FROM votes GROUP BY record_id""")
def teacher_mean_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.teacher_mean(votes(spark, sf_dir)).withColumn("teacher", F.round("teacher", 9))


@query(f"""WITH {VOTES}, t AS (SELECT record_id, avg(greatest(0.01, least(0.99, CASE WHEN should_wake THEN confidence ELSE 1 - confidence END))) AS p FROM votes GROUP BY record_id)
  SELECT record_id, y, round(CASE WHEN y = 1 THEN p ELSE 1 - p END * CAST(0.05 AS DOUBLE), 9) AS w FROM t, (VALUES (0), (1)) v(y)""")
def soft_label_duplication(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.soft_copies(ops.teacher_mean(votes(spark, sf_dir)), 0.05).withColumn("w", F.round("w", 9))


@query(f"WITH {MAJORITY} SELECT d.doc_id AS id, d.source, label FROM documents d JOIN resolved r ON r.record_id = d.doc_id")
def corpus_labels_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.labelled(corpus(spark, sf_dir).select("id", "source"), votes(spark, sf_dir))


@query(f"WITH {MAJORITY} SELECT d.doc_id AS id, d.source, label FROM documents d LEFT JOIN resolved r ON r.record_id = d.doc_id")
def corpus_labels_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.labelled(corpus(spark, sf_dir).select("id", "source"), votes(spark, sf_dir), "left")


@query("SELECT doc_id AS id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.labelled(corpus(spark, sf_dir).select("id", "source"), votes(spark, sf_dir), "left_anti")


@query("SELECT doc_id AS id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.labelled(corpus(spark, sf_dir).select("id", "source"), votes(spark, sf_dir), "left_semi")


@query(f"WITH {VOTES} SELECT record_id FROM votes GROUP BY record_id HAVING count(DISTINCT label_file) = (SELECT count(DISTINCT label_file) FROM votes)")
def nway_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.in_all_files(votes(spark, sf_dir))


@query(f"WITH {VOTES} SELECT record_id, bool_or(should_wake) AS any_vote, bool_and(should_wake) AS all_votes, count(*) FILTER (should_wake) * 2 > count(*) AS most_votes FROM votes GROUP BY record_id")
def variant_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.combined(votes(spark, sf_dir))


@query(f"""WITH {VOTES}, t AS (SELECT record_id, should_wake AS teacher FROM votes WHERE label_file = 'b')
  SELECT label_file, count(*) AS rows, count(*) FILTER (teacher IS NULL) AS missing, count(*) FILTER (should_wake = teacher) AS agree,
  count(*) FILTER (teacher AND NOT should_wake) AS teacher_only, count(*) FILTER (NOT teacher AND should_wake) AS label_only
  FROM votes LEFT JOIN t USING (record_id) GROUP BY ROLLUP (label_file)""")
def per_file_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = votes(spark, sf_dir)
    return ops.agreement(v, v.where("label_file = 'b'"))


@query(f"WITH {VOTES} SELECT record_id, label_file, should_wake FROM votes WHERE label_file <> 'c' AND record_id NOT IN (SELECT record_id FROM votes WHERE label_file = 'c')")
def holdout_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.isolated_split(votes(spark, sf_dir), "c")[0].select("record_id", "label_file", "should_wake")


@query(f"WITH {VOTES} SELECT record_id, label_file, confidence FROM votes WHERE error IS NULL AND confidence >= 0.7")
def confidence_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.clean(votes(spark, sf_dir), 0.7).select("record_id", "label_file", "confidence")


@query("SELECT source, sha256(text) AS text_hash, min(doc_id) AS id FROM documents GROUP BY 1, 2")
def corpus_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.deduplicated(corpus(spark, sf_dir), ["id"]).select("source", "text_hash", "id")


@query("""SELECT id, tag FROM (SELECT doc_id AS id, 'new' AS tag FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'old' FROM documents WHERE doc_id % 2 <> 0)""")
def fresh_corpus_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = corpus(spark, sf_dir).select("id")
    return ops.merged([ids.withColumn("tag", F.lit("old")), ids.where("id % 2 = 0").withColumn("tag", F.lit("new"))])


@query("""SELECT doc_id AS id, lang AS bucket FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256(text), doc_id) <= 20""")
def stratified_sample_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.top_per_bucket(corpus(spark, sf_dir), F.col("lang"), [F.sha2("text", 256), F.col("id")], 20).select("id", "bucket")


@query("""WITH r AS (SELECT doc_id AS id, lang AS bucket, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents)
  SELECT id, bucket, CAST(row_number() OVER (ORDER BY rn, bucket) AS INTEGER) AS position FROM r QUALIFY position <= 50""")
def round_robin_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.interleaved(corpus(spark, sf_dir), F.col("lang"), [F.sha2(F.col("id").cast("string"), 256), F.col("id")], 50).select("id", "bucket", "position")


@query("SELECT doc_id AS id FROM documents ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def hash_order_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.hash_sample(corpus(spark, sf_dir).select("id"), "id", 100)


@query(f"""WITH {SCORED}, s1 AS (SELECT *, 'sure' AS slice FROM scored WHERE a >= 0.6 ORDER BY a DESC, id LIMIT 20),
  s2 AS (SELECT *, 'near' AS slice FROM scored WHERE id NOT IN (SELECT id FROM s1) AND a BETWEEN 0.4 AND 0.8 ORDER BY abs(a - 0.675), id LIMIT 30),
  s3 AS (SELECT *, 'split' AS slice FROM scored WHERE id NOT IN (SELECT id FROM s1) AND id NOT IN (SELECT id FROM s2) AND abs(a - b) >= 0.2 ORDER BY abs(a - b) DESC, id LIMIT 30)
  SELECT id, slice FROM s1 UNION ALL SELECT id, slice FROM s2 UNION ALL SELECT id, slice FROM s3""")
def priority_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    parts = [
        ("sure", a >= 0.6, [F.desc("a")], 20),
        ("near", a.between(0.4, 0.8), [F.abs(a - 0.675)], 30),
        ("split", F.abs(a - b) >= 0.2, [F.desc(F.abs(a - b))], 30),
    ]
    return ops.slices(scored(spark, sf_dir), "id", parts).select("id", "slice")


@query(f"""WITH {SCORED} SELECT id, CASE WHEN a >= 0.2 AND a < 0.4 THEN 'low' WHEN a >= 0.4 AND a < 0.675 THEN 'mid' WHEN a >= 0.675 THEN 'high' END AS band FROM scored WHERE a >= 0.2""")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("a")
    band = ops.bands(a, [("low", 0.2, 0.4), ("mid", 0.4, 0.675), ("high", 0.675, float("inf"))])
    return scored(spark, sf_dir).select("id", band.alias("band")).where("band is not null")


@query("SELECT conv_id, turn, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 3) AS INTEGER) AS batch FROM conversations")
def fixed_size_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.batches(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "turn", 3, "conv_id")


@query(f"WITH {SCORED} SELECT id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY sha256(CAST(id AS VARCHAR)), id) - 1) % 5 AS INTEGER) AS fold FROM scored")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.stratified_folds(scored(spark, sf_dir), "id", "label", 5).select("id", "label", "fold")


@query("""SELECT 'id' AS rule, count(*) FILTER (doc_id IS NULL) AS bad FROM documents UNION ALL SELECT 'long', count(*) FILTER (n_chars < 200) FROM documents
  UNION ALL SELECT 'english', count(*) FILTER (lang <> 'en') FROM documents""")
def label_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ops.violations(docs, {"id": F.col("doc_id").isNotNull(), "long": F.col("n_chars") >= 200, "english": F.col("lang") == "en"})


@query("SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.dropped_duplicates(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h")), "h")


@query("""WITH b AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0), a AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 3 <> 0)
  SELECT doc_id, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'deleted' ELSE 'modified' END AS change, b.h AS before, a.h AS after
  FROM b FULL OUTER JOIN a USING (doc_id) WHERE b.h IS DISTINCT FROM a.h""")
def snapshot_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    after = docs.where("doc_id % 3 <> 0").withColumn("h", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("h")))
    return ops.snapshot_diff(docs.where("doc_id % 5 <> 0"), after, "doc_id", "h")


@query("""SELECT doc_id, n_chars FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0""")
def index_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    index = docs.where("doc_id % 5 <> 0").withColumn("n_chars", F.when(F.col("doc_id") % 7 == 0, 0).otherwise(F.col("n_chars")))
    return ops.changed_since(docs, index, "doc_id", ["n_chars"])


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY GROUPING SETS ((source), (lang))")
def corpus_summary_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    return docs.groupingSets([[docs["source"]], [docs["lang"]]], docs["source"], docs["lang"]).agg(F.count("*").alias("n"))


_CONFUSION = """CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS recall,
  CAST(tp + fp AS DOUBLE) / (tp + fp + fn + tn) AS wake_rate, tp, fp, fn, tn"""


@query(f"""WITH {SCORED}, c AS (SELECT grp, count(*) FILTER (a >= 0.5 AND label) AS tp, count(*) FILTER (a >= 0.5 AND NOT label) AS fp, count(*) FILTER (NOT coalesce(a >= 0.5, false) AND label) AS fn,
  count(*) FILTER (NOT coalesce(a >= 0.5, false) AND NOT label) AS tn, count(*) FILTER (a IS NULL) AS invalid FROM (SELECT * REPLACE (CASE WHEN id % 13 = 0 THEN NULL ELSE a END AS a) FROM scored) GROUP BY grp)
  SELECT grp, {_CONFUSION}, invalid FROM c""")
def confusion_with_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("a", F.when(F.col("id") % 13 != 0, F.col("a")))
    return metrics.confusion(rows, F.col("a") >= 0.5, by=["grp"])


_SWEEP = f"""{SCORED}, g AS (SELECT CAST(round(0.2 + 0.05 * i, 3) AS DOUBLE) AS threshold FROM range(16) t(i)),
  c AS (SELECT threshold, count(*) FILTER (a >= threshold AND label) AS tp, count(*) FILTER (a >= threshold AND NOT label) AS fp, count(*) FILTER (a < threshold AND label) AS fn,
  count(*) FILTER (a < threshold AND NOT label) AS tn FROM scored, g GROUP BY threshold), sweep AS (SELECT threshold, {_CONFUSION} FROM c)"""


@query(f"WITH {_SWEEP} SELECT * FROM sweep")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sweep(scored(spark, sf_dir), "a", GRID)


@query(f"""WITH {_SWEEP} SELECT * FROM sweep ORDER BY precision >= 0.6 AND tp > 0 DESC, CASE WHEN precision >= 0.6 AND tp > 0 THEN recall ELSE precision END DESC,
  CASE WHEN precision >= 0.6 AND tp > 0 THEN precision ELSE recall END DESC, CASE WHEN precision >= 0.6 AND tp > 0 THEN wake_rate ELSE 0 END, threshold LIMIT 1""")
def best_at_precision_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_at_precision(metrics.sweep(scored(spark, sf_dir), "a", GRID), 0.6)


@query(f"""WITH {SCORED}, t AS (SELECT a, count(*) FILTER (label) AS p, count(*) FILTER (NOT label) AS n FROM scored GROUP BY a),
  r AS (SELECT *, sum(p) OVER (ORDER BY a DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(n) OVER (ORDER BY a DESC ROWS UNBOUNDED PRECEDING) AS fp FROM t)
  SELECT round(sum(n * (tp - CAST(p AS DOUBLE) / 2)) / (sum(p) * sum(n)), 9) AS auc, round(sum(p * CAST(tp AS DOUBLE) / (tp + fp)) / sum(p), 9) AS average_precision,
  CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives FROM r""")
def exact_auc_and_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ranking(scored(spark, sf_dir), "a").withColumns({"auc": F.round("auc", 9), "average_precision": F.round("average_precision", 9)})


@query("""SELECT q, value FROM (SELECT n_chars AS value, row_number() OVER (ORDER BY n_chars) AS rn, count(*) OVER () AS n FROM documents), (VALUES (0.0), (0.5), (0.9), (0.99)) t(q) WHERE rn = floor(CAST(q AS DOUBLE) * (n - 1)) + 1""".replace("SELECT q, value", "SELECT CAST(q AS DOUBLE) AS q, value"))
def nearest_rank_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.nearest_rank(table(spark, sf_dir, "documents"), "n_chars", [0.0, 0.5, 0.9, 0.99])


@query("""SELECT 0 AS i, quantile_cont(n_chars, 0.25) AS value FROM documents UNION ALL SELECT 1, quantile_cont(n_chars, 0.5) FROM documents UNION ALL SELECT 2, quantile_cont(n_chars, 0.95) FROM documents""")
def interpolated_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.interpolated(table(spark, sf_dir, "documents"), "n_chars", [0.25, 0.5, 0.95])


@query(f"""WITH {SCORED} SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (b >= t) AS wakes, CAST(count(*) FILTER (b >= t) AS DOUBLE) / count(*) AS rate FROM scored, (VALUES (0.3), (0.5), (0.64), (0.8)) v(t) GROUP BY t""")
def wake_counts_at_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.wakes_at(scored(spark, sf_dir), "b", [0.3, 0.5, 0.64, 0.8])


@query(f"""WITH {SCORED}, g AS (SELECT CAST(t AS DOUBLE) AS t FROM (VALUES (0.4), (0.6)) v(t)), r AS (
  SELECT 'single(a;' || format('{{:.3f}}', t) || ')' AS rule, label, a >= t AS hit FROM scored, g UNION ALL SELECT 'single(b;' || format('{{:.3f}}', t) || ')', label, b >= t FROM scored, g
  UNION ALL SELECT 'mean(a,b;' || format('{{:.3f}}', t) || ')', label, (a + b) / 2 >= t FROM scored, g UNION ALL SELECT 'max(a,b;' || format('{{:.3f}}', t) || ')', label, greatest(a, b) >= t FROM scored, g
  UNION ALL SELECT 'min(a,b;' || format('{{:.3f}}', t) || ')', label, least(a, b) >= t FROM scored, g
  UNION ALL SELECT 'and(a,b;' || format('{{:.3f}}', g.t) || ',' || format('{{:.3f}}', h.t) || ')', label, a >= g.t AND b >= h.t FROM scored, g, g h
  UNION ALL SELECT 'or(a,b;' || format('{{:.3f}}', g.t) || ',' || format('{{:.3f}}', h.t) || ')', label, a >= g.t OR b >= h.t FROM scored, g, g h),
  c AS (SELECT rule, count(*) FILTER (hit AND label) AS tp, count(*) FILTER (hit AND NOT label) AS fp, count(*) FILTER (NOT hit AND label) AS fn, count(*) FILTER (NOT hit AND NOT label) AS tn FROM r GROUP BY rule)
  SELECT rule, {_CONFUSION} FROM c""")
def ensemble_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.evaluated(scored(spark, sf_dir), metrics.rules(["a", "b"], [0.4, 0.6]))


@query(f"""WITH {SCORED}, rules AS (SELECT CAST(t AS DOUBLE) AS t FROM (VALUES (0.3), (0.4), (0.5), (0.6)) v(t)),
  c AS (SELECT grp, 'single(a;' || format('{{:.3f}}', t) || ')' AS rule, count(*) FILTER (a >= t AND label) AS tp, count(*) FILTER (a >= t AND NOT label) AS fp, count(*) FILTER (a < t AND label) AS fn, count(*) FILTER (a < t AND NOT label) AS tn FROM scored, rules GROUP BY grp, t),
  o AS (SELECT c.*, d.tp AS otp, d.fp AS ofp, d.fn AS ofn, d.tn AS otn FROM c JOIN (SELECT x.grp, x.rule, sum(y.tp) AS tp, sum(y.fp) AS fp, sum(y.fn) AS fn, sum(y.tn) AS tn FROM c x JOIN c y ON x.rule = y.rule AND x.grp <> y.grp GROUP BY 1, 2) d USING (grp, rule)),
  p AS (SELECT *, CASE WHEN otp + ofp > 0 THEN CAST(otp AS DOUBLE) / (otp + ofp) ELSE 0 END AS precision, CASE WHEN otp + ofn > 0 THEN CAST(otp AS DOUBLE) / (otp + ofn) ELSE 0 END AS recall, CAST(otp + ofp AS DOUBLE) / (otp + ofp + ofn + otn) AS wake_rate FROM o)
  SELECT grp, rule, tp, fp, fn, tn FROM p QUALIFY row_number() OVER (PARTITION BY grp ORDER BY precision >= 0.5 DESC, CASE WHEN precision >= 0.5 THEN recall ELSE precision END DESC, CASE WHEN precision >= 0.5 THEN precision ELSE recall END DESC, wake_rate, rule) = 1""")
def leave_one_group_out_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = {f"single(a;{t:.3f})": F.col("a") >= t for t in (0.3, 0.4, 0.5, 0.6)}
    return metrics.leave_one_group_out(scored(spark, sf_dir), candidates, "grp", 0.5)


@query(f"""WITH {SCORED} SELECT id, [a, b, least(a, b), greatest(a, b), round((a + b) / 2, 9), round(greatest(a, b) - least(a, b), 9)] AS features FROM scored""")
def score_vector_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scalars.score_features(F.array("a", "b"))
    return scored(spark, sf_dir).select("id", F.transform(f, lambda x: F.round(x, 9)).alias("features"))


@query(f"""WITH {SCORED} SELECT id, greatest(a, 0) AS best_wanted, CASE WHEN b > a THEN 'y' ELSE 'x' END AS top_label FROM scored""")
def candidate_label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.array(F.struct(F.lit("x").alias("label"), F.col("a").alias("score")), F.struct(F.lit("y").alias("label"), F.col("b").alias("score")))
    rows = scored(spark, sf_dir).withColumn("c", c)
    return rows.select("id", scoring.best_label(F.col("c"), ["x", "z"]).alias("best_wanted"), scoring.argmax_label(F.col("c")).alias("top_label"))


@query("""WITH tok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]{2,}')) AS term FROM documents) SELECT id, 'word' AS section, term, count(*) AS count FROM tok GROUP BY id, term""")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.terms(corpus(spark, sf_dir), "id", scoring.word_section())


@query("""WITH tok AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]{2,}')) AS term FROM documents)
  SELECT term, count(*) AS df, round(ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1, 9) AS idf FROM tok GROUP BY term""")
def document_frequency_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    return scoring.weighed(scoring.document_frequency(docs, scoring.word_section()), docs.count()).withColumn("idf", F.round("idf", 9))


_MODEL = [("the", 1.5, 0.8), ("and", 1.7, -0.4), ("der", 2.0, 0.6), ("que", 2.2, -0.7), ("stupid", 4.0, 2.5), ("trash", 4.1, 2.2)]


def _model(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("word", *t) for t in _MODEL], "section string, term string, idf double, coef double")


@query("""WITH model(term, idf, coef) AS (VALUES ('the', 1.5, 0.8), ('and', 1.7, -0.4), ('der', 2.0, 0.6), ('que', 2.2, -0.7), ('stupid', 4.0, 2.5), ('trash', 4.1, 2.2)),
  tok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]{2,}')) AS term FROM documents),
  v AS (SELECT id, term, (1 + ln(count(*))) * CAST(any_value(idf) AS DOUBLE) AS v, CAST(any_value(coef) AS DOUBLE) AS coef FROM tok JOIN model USING (term) GROUP BY id, term),
  x AS (SELECT id, sum(v * coef) / sqrt(sum(v * v)) AS x FROM v GROUP BY id)
  SELECT doc_id AS id, round(1 / (1 + exp(-(CAST(-0.5 AS DOUBLE) + coalesce(x, 0)))), 9) AS score FROM documents LEFT JOIN x ON x.id = doc_id""")
def weighted_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.scores(corpus(spark, sf_dir), "id", {"word": scoring.word_section()}, _model(spark), -0.5)
    return found.select("id", F.round("score", 9).alias("score"))


@query("""WITH model(term, idf, coef) AS (VALUES ('the', 1.5, 0.8), ('and', 1.7, -0.4), ('der', 2.0, 0.6), ('que', 2.2, -0.7), ('stupid', 4.0, 2.5), ('trash', 4.1, 2.2)),
  tok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]{2,}')) AS term FROM documents),
  v AS (SELECT id, term, (1 + ln(count(*))) * CAST(any_value(idf) AS DOUBLE) AS v, CAST(any_value(coef) AS DOUBLE) AS coef FROM tok JOIN model USING (term) GROUP BY id, term)
  SELECT id, 'word' AS section, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)) * coef, 9) AS contribution FROM v""")
def feature_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = scoring.contributions(corpus(spark, sf_dir), "id", {"word": scoring.word_section()}, _model(spark))
    return parts.withColumn("contribution", F.round("contribution", 9))


@query("""SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS compact, len(regexp_extract_all(text, '\\S+')) AS words, length(text) - length(replace(text, chr(10), '')) + 1 AS lines, sha256(text) AS h FROM documents""")
def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.compact(t).alias("compact"), text.word_count(t).cast("bigint").alias("words"), text.line_count(t).cast("bigint").alias("lines"), F.sha2(t, 256).alias("h"))


@query("""WITH b AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations)
  SELECT x.conv_id, x.turn, round(CASE WHEN len(x.w) = 0 OR len(y.w) = 0 THEN 0 ELSE CAST(len(list_intersect(x.w, y.w)) AS DOUBLE) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))) END, 9) AS similarity
  FROM b x JOIN b y ON x.conv_id = y.conv_id AND y.turn = x.turn - 1""")
def jaccard_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))
    b = table(spark, sf_dir, "conversations").select("conv_id", "turn", w.alias("w"))
    before = b.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("p"))
    return b.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(text.jaccard(F.col("w"), F.col("p")), 9).alias("similarity"))


def _weak_sql() -> str:
    """Categories and label of every document's whole text, with the whole bank of patterns.
    DuckDB's word boundaries are those of ASCII, hence other letters become an underscore."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    found = ", ".join(f"CASE WHEN {' OR '.join(f'regexp_matches(t, {quote(p)})' for p in patterns)} THEN {quote(name)} END" for name, patterns in text.WEAK_CATEGORIES.items())
    failures = ", ".join(map(quote, text.FAILURE_CATEGORIES))
    return f"""WITH t AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\\x00-\\x7F\\p{{P}}\\p{{S}}\\p{{Z}}\\p{{C}}]', '_', 'g') AS t FROM documents),
  c AS (SELECT doc_id, list_contains(regexp_extract_all(t, '[a-z]+'), 'the') AS hit, list_filter([{found}], lambda k: k IS NOT NULL) AS categories FROM t)
  SELECT doc_id, categories, CASE WHEN list_has_any(categories, [{failures}]) THEN 'agent_failure_candidate'
    WHEN hit AND list_contains(categories, 'question_confusion') THEN 'needs_review' WHEN hit THEN 'trigger_only' ELSE 'ordinary' END AS weak_label FROM c"""


@query(_weak_sql())
def weak_categories_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.matched_words(t, ["the"]).alias("m"), text.weak_categories(t).alias("categories"))
    return rows.select("doc_id", "categories", text.weak_label(F.col("categories"), F.col("m")).alias("weak_label"))


@query(f"""WITH {VOTES}, hard AS (SELECT * FROM votes WHERE label_file = 'c' AND error IS NULL), held AS (SELECT DISTINCT record_id FROM votes WHERE label_file = 'b' AND record_id % 10 = 0),
  told AS (SELECT v.*, CASE WHEN error IS NOT NULL THEN 'error' WHEN record_id IN (SELECT record_id FROM held) THEN 'holdout' WHEN record_id IN (SELECT record_id FROM hard) THEN 'hard_label'
    WHEN record_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'fr') THEN 'missing_corpus' END AS reason FROM votes v WHERE label_file = 'a')
  SELECT origin, reason, count(*) AS n FROM (SELECT 'hard' AS origin, NULL AS reason FROM hard UNION ALL SELECT 'teacher', reason FROM told) GROUP BY ALL""")
def student_label_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = votes(spark, sf_dir)
    hard = v.where("label_file = 'c' and error is null")
    held = v.where("label_file = 'b' and record_id % 10 = 0").select("record_id")
    rows = ops.student_labels(hard, v.where("label_file = 'a'"), corpus(spark, sf_dir).where("lang <> 'fr'"), held)
    return rows.groupBy("origin", "reason").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT CAST(doc_id AS VARCHAR) AS id, source AS path, lang, text FROM documents)
  SELECT id, unnest(list_filter(['status', 'triggers', 'path', 'forbidden'], lambda r: CASE r WHEN 'status' THEN lang NOT IN ('active', 'draft', 'deprecated') WHEN 'triggers' THEN coalesce(trim(left(text, 1)), '') = ''
    WHEN 'path' THEN path = 'src1' ELSE contains(lower(text), 'the th') END)) AS rule FROM e""")
def index_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries of an index: the language is the status, which none of the known ones is."""
    docs = table(spark, sf_dir, "documents")
    entries = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("status"), F.col("source").alias("path"), F.array(F.substring("text", 1, 1)).alias("triggers"), F.col("text").alias("body"))
    return ops.index_violations(entries, docs.where("source <> 'src1'").select(F.col("source").alias("path")).distinct(), ["the TH"])


@query(f"""WITH {VOTES}, {SCORED}, t AS (SELECT record_id, avg(greatest(0.01, least(0.99, CASE WHEN should_wake THEN confidence ELSE 1 - confidence END))) AS l FROM votes WHERE record_id % 2 = 1 GROUP BY 1)
  SELECT coalesce(record_id, id) AS record_id, round(coalesce(l, greatest(0.01, least(0.99, a))), 9) AS teacher, CASE WHEN l IS NULL THEN 'scores' ELSE 'labels' END AS origin FROM t FULL JOIN scored ON id = record_id""")
def teacher_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of odd records stand before scores."""
    scores = scored(spark, sf_dir).select(F.col("id").alias("record_id"), F.col("a").alias("score"))
    return ops.teacher_scores(scores, votes(spark, sf_dir).where("record_id % 2 = 1")).withColumn("teacher", F.round("teacher", 9))


@query(f"""WITH {VOTES}, {SCORED}, m AS (SELECT record_id, count(*) FILTER (should_wake) >= count(*) FILTER (NOT should_wake) AS label FROM votes WHERE error IS NULL AND confidence >= 0.6 GROUP BY 1)
  SELECT id, a AS score, m.label FROM scored JOIN m ON record_id = id""")
def scores_of_clean_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.scored_labels(scored(spark, sf_dir).select("id", F.col("a").alias("score")), votes(spark, sf_dir), 0.6)


@query("SELECT doc_id AS id FROM documents ORDER BY sha256('17:' || doc_id), doc_id LIMIT 100")
def seeded_order_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.seeded_sample(corpus(spark, sf_dir).select("id"), "id", 17, 100)
