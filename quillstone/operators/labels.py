"""Operators over labels and corpora: votes, joins, samples, slices, merges.

Label rows have ``record_id, label_file, should_wake`` and optionally ``confidence, error``; ``seq``
columns give the order of arrival.  Build sides are made unique before joins, so rows never fan out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import scalars
from quillstone.operators.store import durable, summed


def clean(labels: DataFrame, least_confidence: float = 0.0) -> DataFrame:
    """Rows without an error and with enough confidence."""
    return labels.where(F.col("error").isNull() & (F.coalesce("confidence", F.lit(0.0)) >= least_confidence))


def vote_counts(labels: DataFrame, key: str = "record_id") -> DataFrame:
    """Votes per record; a tie counts as true."""
    yes, no = F.count_if("should_wake"), F.count_if(~F.col("should_wake"))
    return labels.groupBy(key).agg(F.count("should_wake").alias("votes"), yes.alias("true_votes"), no.alias("false_votes"), (yes >= no).alias("label"))


def variant_labels(labels: DataFrame, seq: list[str]) -> DataFrame:
    """``record_id, should_wake`` of a variant: rows with an error go, the last of the rest stays."""
    return last_write(clean(labels), "record_id", seq).select("record_id", "should_wake")


def majority(labels: DataFrame, key: str = "record_id") -> DataFrame:
    return vote_counts(labels, key).select(key, "label")


def last_write(rows: DataFrame, key: str, seq: list[str]) -> DataFrame:
    """The last row of each key in the given order."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("r")).select(key, "r.*").select(*rows.columns)


def prefer_success(rows: DataFrame, key: str, seq: list[str]) -> DataFrame:
    """The first row of each key, but a success before any error."""
    rest = [c for c in rows.columns if c != key]
    order = F.struct(F.col("error").isNotNull(), *[F.col(c) for c in seq])
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*").select(*rows.columns)


def teacher_mean(labels: DataFrame) -> DataFrame:
    """Mean over a record's rows of the probability that it should wake, each within [0.01, 0.99]."""
    p = scalars.teacher_probability(F.lit(None).cast("double"), F.col("confidence"), F.col("should_wake"))
    return labels.groupBy("record_id").agg(F.avg(p).alias("teacher"), F.count("*").alias("n"))


def teacher_scores(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """``record_id, teacher, origin``: the mean probability of a record's labels where it has any, else of its scores
    (``record_id, score``), each within [0.01, 0.99]."""
    told = teacher_mean(labels).select("record_id", F.col("teacher").alias("_label"))
    given = scores.where("score is not null").groupBy("record_id").agg(F.avg(scalars.clamp(F.col("score"))).alias("_score"))
    both = told.join(given, "record_id", "full_outer")
    return both.select("record_id", F.coalesce("_label", "_score").alias("teacher"), F.when(F.col("_label").isNotNull(), "labels").otherwise("scores").alias("origin"))


def scored_labels(scores: DataFrame, labels: DataFrame, least_confidence: float = 0.0) -> DataFrame:
    """``id, score, label``: scores (``id, score``) of the records that clean labels decide on."""
    return labelled(scores, clean(labels, least_confidence)).select("id", "score", "label")


def soft_copies(teacher: DataFrame, weight: float) -> DataFrame:
    """Each record as a positive and a negative example, weighted by its probability."""
    pairs = F.array(F.struct(F.lit(1).alias("y"), (F.col("teacher") * weight).alias("w")), F.struct(F.lit(0).alias("y"), ((1 - F.col("teacher")) * weight).alias("w")))
    return teacher.select("record_id", F.explode(pairs).alias("c")).select("record_id", "c.y", "c.w").where("w > 0")


def labelled(corpus: DataFrame, labels: DataFrame, how: str = "inner") -> DataFrame:
    """Corpus rows with their resolved label: inner, left, left_semi or left_anti."""
    right = majority(labels).withColumnRenamed("record_id", "id")
    return corpus.join(right, "id", how)


def in_all_files(labels: DataFrame) -> DataFrame:
    """Records that every label file has."""
    files = labels.select("label_file").distinct().count()
    return labels.groupBy("record_id").agg(F.countDistinct("label_file").alias("files")).where(F.col("files") == files).select("record_id")


def combined(labels: DataFrame) -> DataFrame:
    """Any, all and majority over a record's files."""
    v = F.col("should_wake")
    return labels.groupBy("record_id").agg(F.bool_or(v).alias("any_vote"), F.bool_and(v).alias("all_votes"), (F.count_if(v) * 2 > F.count("*")).alias("most_votes"))


def agreement(labels: DataFrame, teacher: DataFrame) -> DataFrame:
    """Per label file, and over all (null): rows the teacher lacks, agrees and disagrees on."""
    t = majority(teacher).select("record_id", F.col("label").alias("teacher"))
    joined = labels.join(t, "record_id", "left")
    same = F.col("should_wake") == F.col("teacher")
    return joined.rollup("label_file").agg(
        F.count("*").alias("rows"), F.count_if(F.col("teacher").isNull()).alias("missing"), F.count_if(same).alias("agree"),
        F.count_if(F.col("teacher") & ~F.col("should_wake")).alias("teacher_only"), F.count_if(~F.col("teacher") & F.col("should_wake")).alias("label_only"),
    )


def isolated_split(labels: DataFrame, held_out_file: str) -> tuple[DataFrame, DataFrame]:
    """Training and test labels: a file is held out, and with it its records in all other files."""
    test = labels.where(F.col("label_file") == held_out_file)
    return labels.where(F.col("label_file") != held_out_file).join(test.select("record_id").distinct(), "record_id", "left_anti"), test


def deduplicated(corpus: DataFrame, order: list[str]) -> DataFrame:
    """The first row per source and text, by the text's hash."""
    rest = [c for c in corpus.columns if c != "source"]
    return corpus.groupBy("source", F.sha2("text", 256).alias("text_hash")).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select("source", "text_hash", "r.*")


def merged(corpora: list[DataFrame], key: str = "id") -> DataFrame:
    """Several corpora of one shape; a later one's row replaces an earlier one's."""
    out = None
    for i, c in enumerate(corpora):
        c = c.withColumn("_ord", F.lit(i))
        out = c if out is None else out.unionByName(c)
    return last_write(out, key, ["_ord"]).drop("_ord")


def top_per_bucket(rows: DataFrame, bucket: Column, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each bucket (the rank limit is applied before the shuffle)."""
    w = Window.partitionBy("_bucket").orderBy(*order)
    return rows.withColumn("_bucket", bucket).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank").withColumnRenamed("_bucket", "bucket")


def interleaved(rows: DataFrame, bucket: Column, order: list[Column], n: int) -> DataFrame:
    """Round robin over the buckets in their order: ``position`` and at most n rows.  No bucket can
    give more than n, so only so many of each are ranked together."""
    best = top_per_bucket(rows, bucket, order, n)
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*order))
    ranked = best.withColumn("_rank", rank).orderBy("_rank", "bucket").limit(n)
    return ranked.withColumn("position", F.row_number().over(Window.orderBy("_rank", "bucket"))).drop("_rank")


def hash_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """n rows in the order of their key's SHA-256: repeatable, and random enough."""
    return rows.orderBy(F.sha2(F.col(key).cast("string"), 256), key).limit(n)


#: Keys that earlier slices have claimed, up to which they are broadcast.
CLAIMED = 100_000


def seeded_sample(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows of a shuffle that the seed decides: in the order of the hash of seed and key."""
    return rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key).limit(n)


def slices(rows: DataFrame, key: str, parts: list[tuple[str, Column, list[Column], int]]) -> DataFrame:
    """Priority slices: each takes its first rows among those that no slice before it has taken.

    The loop is over the slices.  A slice is written down once; what slices have claimed is at most the sum of their
    limits, and is broadcast to the next ones' scans while that is small."""
    out, limits = None, 0
    for name, condition, order, limit in parts:
        left = rows
        if out is not None:
            claimed = out.select(F.col(key).alias("_claimed"))
            left = rows.join(F.broadcast(claimed) if limits <= CLAIMED else claimed, F.col(key) == F.col("_claimed"), "left_anti")
        mine = left.where(condition).orderBy(*order, key).limit(limit).withColumn("slice", F.lit(name))
        mine = mine if len(parts) == 1 else durable(mine)
        out = mine if out is None else out.unionByName(mine)
        limits += limit
    return out


def batches(rows: DataFrame, order: str, size: int, group: str) -> DataFrame:
    """``batch``: numbers of chunks of fixed size in each group."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) / size).cast("int"))


def stratified_folds(rows: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """``fold``: rows of a class are dealt out in the order of their hash, whose first two digits cut a class into parts."""
    hashed = rows.withColumn("_h", F.sha2(F.col(key).cast("string"), 256)).withColumns({"_part": F.substring("_h", 1, 2), "_one": F.lit(1)})
    return summed(hashed, [label], "_part", ["_h", key], "_one", "fold").withColumn("fold", ((F.col("fold") - 1) % k).cast("int")).drop("_h", "_part", "_one")


def bands(score: Column, cuts: list[tuple[str, float, float]]) -> Column:
    """The name of the band [low, high) that holds a score; null outside all."""
    return F.coalesce(*[F.when((score >= low) & (score < high), name) for name, low, high in cuts])


def with_subject(rows: DataFrame, subjects: DataFrame, version: str, subject: str, most: int = 100_000) -> DataFrame:
    """Rows with the subject of their version; one that isn't known has an empty one.  The dimension is unique by version (the least
    subject of repeated ones) and broadcast up to ``most`` versions."""
    dimension = subjects.groupBy(F.col(version).alias("_version")).agg(F.min(subject).alias("_subject"))
    small = subjects.limit(most + 1).count() <= most
    found = rows.join(F.broadcast(dimension) if small else dimension, F.col(version) == F.col("_version"), "left")
    return found.withColumn(subject, F.coalesce("_subject", F.lit(""))).drop("_version", "_subject")


def auxiliary(corpus: DataFrame, labels: DataFrame, gold: DataFrame, weight: float, least_confidence: float = 0.0, positives: bool = True, negatives: bool = True, seq: str = "seq") -> DataFrame:
    """``id, label, weight`` of training rows beside the gold ones: clean labels with enough confidence, the first of each record,
    of the wanted classes, none of a gold record (``id``), and only records that the corpus has."""
    first = clean(labels, least_confidence).groupBy("record_id").agg(F.min_by("should_wake", seq).alias("label"))
    wanted = (F.col("label") & F.lit(positives)) | (~F.col("label") & F.lit(negatives))
    rows = first.where(wanted).select(F.col("record_id").alias("id"), F.col("label").cast("double").alias("label"), F.lit(weight).alias("weight"))
    return rows.join(gold.select("id"), "id", "left_anti").join(corpus.select("id"), "id", "left_semi")


def student_labels(hard: DataFrame, teacher: DataFrame, corpus: DataFrame, holdout: DataFrame) -> DataFrame:
    """Label rows of a student: all hard ones, and teacher's for records that the corpus has and that neither a hard label nor the
    holdout (``record_id``) has; ``reason`` says why a teacher's row is left out (null: it is in)."""
    def seen(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.select(F.col(key).alias("record_id")).distinct().withColumn(name, F.lit(True))

    rows = teacher.join(seen(corpus, "id", "_known"), "record_id", "left").join(seen(hard, "record_id", "_hard"), "record_id", "left").join(seen(holdout, "record_id", "_held"), "record_id", "left")
    reason = F.when(F.col("error").isNotNull(), "error").when(F.col("_held").isNotNull(), "holdout").when(F.col("_hard").isNotNull(), "hard_label").when(F.col("_known").isNull(), "missing_corpus")
    told = rows.withColumn("reason", reason).select(*teacher.columns, "reason").withColumn("origin", F.lit("teacher"))
    return hard.withColumns({"reason": F.lit(None).cast("string"), "origin": F.lit("hard")}).unionByName(told, allowMissingColumns=True)


def order_violations(rows: DataFrame, wanted: DataFrame, key: str, place: str) -> DataFrame:
    """``place, wanted, found`` where the keys of two sequences differ, and where one ends early."""
    a, b = wanted.select(F.col(place).alias("place"), F.col(key).alias("wanted")), rows.select(F.col(place).alias("place"), F.col(key).alias("found"))
    return a.join(b, "place", "full_outer").where(~F.equal_null("wanted", "found"))


# The states of an entry of an index, and how its name is spelt.
STATUSES = ("active", "draft", "deprecated")
ENTRY_ID = "^[a-z0-9]+(-[a-z0-9]+)*$"


def index_violations(entries: DataFrame, files: DataFrame, forbidden: list[str] = ()) -> DataFrame:
    """``id, rule`` for each rule that an entry (``id, status, path, triggers array<string>, body``) breaks: the spelling and
    uniqueness of its id, its status, that its triggers are a list of non-empty strings, that its path is among ``files``
    (``path``), and that its text holds none of the ``forbidden`` phrases."""
    twice = entries.groupBy("id").agg((F.count("*") > 1).alias("_twice"))
    there = files.select("path").distinct().withColumn("_there", F.lit(True))
    rows = entries.join(twice.where("_twice"), "id", "left").join(there, "path", "left")
    body = F.lower(F.coalesce("body", F.lit("")))
    holds = F.lit(False)
    for phrase in forbidden:
        holds = holds | F.contains(body, F.lit(phrase.lower()))
    bad = {
        "id": ~F.coalesce(F.col("id").rlike(ENTRY_ID), F.lit(False)), "unique": F.coalesce("_twice", F.lit(False)), "status": ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)),
        "triggers": F.coalesce(F.size("triggers") < 1, F.lit(True)) | F.coalesce(F.exists("triggers", lambda t: F.trim(F.coalesce(t, F.lit(""))) == ""), F.lit(True)),
        "path": F.col("_there").isNull(), "forbidden": holds}
    broken = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in bad.items()]), lambda r: r.isNotNull())
    return rows.select("id", F.explode(broken).alias("rule"))


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rule, bad``: how many rows break each rule (null counts as broken)."""
    counted = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("bad")) for n in rules])).alias("r")).select("r.*")


def dropped_duplicates(rows: DataFrame, key: str) -> DataFrame:
    """``key, n`` of keys that occur more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """``change``: added, deleted, modified; unchanged keys are left out."""
    b, a = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    both = b.withColumn("_b", F.lit(True)).join(a.withColumn("_a", F.lit(True)), key, "full_outer")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "deleted").when(~F.equal_null("before", "after"), "modified")
    return both.select(key, change.alias("change"), "before", "after").where("change is not null")


def changed_since(snapshot: DataFrame, index: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Rows of a snapshot that the index lacks or has with other values."""
    old = index.select(key, *[F.col(v).alias(f"_{v}") for v in values], F.lit(True).alias("_known"))
    differs = F.col("_known").isNull()
    for v in values:
        differs = differs | ~F.equal_null(v, f"_{v}")
    return snapshot.join(old, key, "left").where(differs).select(*snapshot.columns)
