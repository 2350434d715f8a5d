"""Operators that mine examples, evaluate models by group, match answers and feed a worker.

Models are scored on groups by exploding a small array of predictions in each row: one aggregation,
no join.  Lists of the worst rows are top-k sorts, which keep k rows a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.records import cooldown_wait
from quillstone.operators import labels as ops
from quillstone.operators import metrics


# What kinds of complaint are told by, and the slices that combine them: the range of
# scores, the kind that must occur and the kinds that must not.
KINDS = {
    "process": r"\b(why (did|didn|dont|don't|are|aren)['’]?t? you|did you not|you (didn['’]?t|dont|don't|ignored|missed|failed|stopped|lied|guessed|changed|broke|forgot)|wrong (tool|file|repo|approach|thing)|not what i asked|stop asking|are you sure|read (it|the|this|properly)|what are you doing|why.*stop|why.*ask|should have|should've|use subagents|keep going.*why|why.*keep going)\b",
    "noun": r"\b(app|ui|build|test|api|server|repo|code|model|classifier|database|frontend|backend|component|hook)\b",
    "failure": r"\b(broken|wrong|bug|error|crash|not working|doesn['’]?t work|failing|failed|regression|issue)\b",
    "correction": r"\b(undo|revert|rollback|i said|i never said|don['’]?t change|don['’]?t touch|instead of|original)\b",
    "confusion": r"\b(why (are|is|would|not)|wdym|i['’]?m confused|what are you doing|should we|what do you think)\b",
    "control": r"\b(stop asking|don['’]?t ask|don['’]?t wait|use the tools|read the (thread|chat|docs|code)|continue|keep going|figure it out)\b",
    "method": r"\b(wrong (tool|file|repo|approach)|didn['’]?t (read|use|test|verify)|asked for (confirmation|approval)|captcha|assumed|guessed|made up|source of truth)\b",
    "why_you": r"\bwhy (did|didn|dont|don't)['’]?t? you\b",
}
QUOTED = r"(?m)(<[A-Z_]+>|<codex_internal_context|<environment_context|<INSTRUCTIONS>|```|^# |^diff --git|^@@|\n> )"
SLICES = {
    "product_code_failure_not_agent": (0.30, 0.90, ["noun", "failure"], ["process"]),
    "correction_rollback_boundary": (0.15, 0.80, ["correction"], []),
    "why_confusion_task_vs_agent": (0.15, 0.85, ["confusion"], ["why_you"]),
    "agent_control_low_mid": (0.05, 0.55, ["control"], ["process"]),
    "method_tool_low_miss": (0.05, 0.675, ["method"], []),
}


def pattern_slices(rows: DataFrame, text: str, score: str, slices: dict[str, tuple[float, float, list[str], list[str]]] = SLICES) -> DataFrame:
    """A row for every slice that a row is in: score in its range, all its kinds, none of the barred ones,
    and no quotation.  Null texts and scores are in none."""
    def holds(low: float, high: float, wanted: list[str], barred: list[str]) -> Column:
        out = F.col(score).between(low, high) & ~F.col(text).rlike(QUOTED)
        for kind in wanted:
            out = out & F.col(text).rlike("(?iU)" + KINDS[kind])
        for kind in barred:
            out = out & ~F.col(text).rlike("(?iU)" + KINDS[kind])
        return out

    within = F.filter(F.array(*[F.when(holds(*s), F.lit(name)) for name, s in slices.items()]), lambda c: c.isNotNull())
    return rows.withColumn("slice", F.explode(within))


def quoted_slice(rows: DataFrame, text: str, score: str, label: str, least: float = 0.25, wanted: str = "quoted_or_pasted_context") -> DataFrame:
    """Rows that quote something and score high, or that the teacher (``label``) calls quoted."""
    return rows.where(F.coalesce(F.col(text).rlike(QUOTED), F.lit(False)) & (F.coalesce(F.col(score) >= least, F.lit(False)) | F.equal_null(F.col(label), F.lit(wanted)))).withColumn("slice", F.lit("quoted_context_hard_negatives"))


#: A slice's rows by distance to the threshold; two slices in an order of their own.
THRESHOLD = 0.675


def slice_order(name: str, score: Column) -> list[Column]:
    """How the rows of a slice are ranked."""
    if name == "agent_control_low_mid":
        return [score >= 0.30, F.abs(score - 0.30)]
    if name == "method_tool_low_miss":
        return [score >= 0.35, -score]
    return [F.abs(score - THRESHOLD)]


def ranked_slices(rows: DataFrame, key: str, text: str, score: str, label: str, n: int) -> DataFrame:
    """The first n rows of every slice with their ``rank`` in its order; ties by key."""
    own = pattern_slices(rows, text, score).unionByName(quoted_slice(rows, text, score, label))
    orders = {name: slice_order(name, F.col(score)) for name in (*SLICES, "quoted_context_hard_negatives")}
    places = [F.lit(None).cast("double"), F.lit(None).cast("double")]
    for name, order in orders.items():
        here = F.col("slice") == name
        places = [F.when(here, (order[i] if i < len(order) else F.lit(0.0)).cast("double")).otherwise(p) for i, p in enumerate(places)]
    nth = F.row_number().over(Window.partitionBy("slice").orderBy(*places, key))
    return own.withColumn("rank", nth).where(F.col("rank") <= n)


def source_balanced(rows: DataFrame, source: str, names: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows in turns of the named sources and, last, all others together."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.lower(source)), F.lit(0))
    return ops.interleaved(rows, F.when(place == 0, len(names) + 1).otherwise(place).cast("int"), order, n)


def band_stratified(rows: DataFrame, score: str, bands: list[tuple[float, float]], order: list[Column], n: int) -> DataFrame:
    """The first n rows in turns of the score bands [low, high); rows outside all bands go."""
    band = F.coalesce(*[F.when((F.col(score) >= low) & (F.col(score) < high), i) for i, (low, high) in enumerate(bands)])
    return ops.interleaved(rows.where(band.isNotNull()), band, order, n)


def score_lookup(rows: DataFrame, seq: str, score: str = "score") -> DataFrame:
    """``id, score``: by ``id`` or else ``record_id``; what is no number is skipped, the last one stays."""
    named = rows.select(F.coalesce("id", "record_id").alias("id"), F.col(score).try_cast("double").alias("score"), seq)
    return named.where("id is not null and score is not null").groupBy("id").agg(F.max_by("score", seq).alias("score"))


def mining_payload(rows: DataFrame, columns: list[str], scores: DataFrame, models: list[str], teacher: DataFrame) -> DataFrame:
    """A record's columns with a ``<model>_score`` of each model and the teacher's columns, null where missing.

    Scores are ``id, model, score``; both sides are unique by id before they are joined."""
    wide = scores.groupBy("id").agg(*[F.max(F.when(F.col("model") == m, F.col("score"))).alias(f"{m}_score") for m in models])
    return rows.select(*columns).join(wide, "id", "left").join(teacher, "id", "left")


def with_defaults(scores: DataFrame, sample: DataFrame, key: str, shared: list[str], blank: list[str]) -> DataFrame:
    """Score rows with a sample's columns: where the sample lacks the key, ``shared`` ones fall back to
    the score row's own and ``blank`` ones are empty.  The sample is unique by key."""
    right = sample.select(key, F.lit(True).alias("_found"), *[F.col(c).alias(f"_{c}") for c in shared + blank])
    joined = scores.join(right, key, "left")
    out = {c: F.when(F.col("_found"), F.col(f"_{c}")).otherwise(F.col(c)) for c in shared} | {c: F.coalesce(f"_{c}", F.lit("")) for c in blank}
    return joined.withColumns(out).drop("_found", *[f"_{c}" for c in shared + blank])


def model_matrix(rows: DataFrame, models: dict[str, Column], group: str, label: str = "label") -> DataFrame:
    """Counts and rates of every model's predictions on every group."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), p.alias("p")) for name, p in models.items()]))
    return metrics.confusion(rows.select(group, label, each.alias("m")).select(group, label, "m.*"), F.col("p"), label, ["model", group])


def macro_means(matrix: DataFrame) -> DataFrame:
    """Per model: mean precision and recall over its groups, and summed counts."""
    return matrix.groupBy("model").agg(
        F.count("*").alias("groups"), F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"),
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")],
    )


def best_with(sweep: DataFrame, min_precision: float = 0.0, min_recall: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """The sweep row with most recall, then precision, among those that reach both minima; none otherwise."""
    by = by or []
    rest = [c for c in sweep.columns if c not in by]
    good = sweep.where((F.col("precision") >= min_precision) & (F.col("recall") >= min_recall))
    return good.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("recall", "precision", -F.col("threshold"))).alias("r")).where("r is not null").select(*by, "r.*")


def misses(rows: DataFrame, score: str, threshold: float, n: int = 40, label: str = "label") -> DataFrame:
    """Positives below the threshold, those nearest to it first."""
    return rows.where(F.col(label) & (F.col(score) < threshold)).orderBy(F.desc(score), "id").limit(n)


def worst_errors(rows: DataFrame, score: str, threshold: float, n: int = 8, label: str = "label") -> DataFrame:
    """``error``: the n highest false positives and the n highest false negatives."""
    false_positives = rows.where(~F.col(label) & (F.col(score) >= threshold)).orderBy(F.desc(score), "id").limit(n)
    return false_positives.withColumn("error", F.lit("fp")).unionByName(misses(rows, score, threshold, n, label).withColumn("error", F.lit("fn")))


def scored_with_missing(labels: DataFrame, corpus: DataFrame, predicted: Column, group: str) -> DataFrame:
    """Per group: labels without a corpus row are counted as missing, the rest as right or wrong."""
    joined = labels.join(corpus.withColumn("_found", F.lit(True)), "id", "left")
    found = F.col("_found").isNotNull()
    same = F.equal_null(predicted, F.col("label"))
    return joined.groupBy(group).agg(F.count("*").alias("rows"), F.count_if(~found).alias("missing"), F.count_if(found & same).alias("right"), F.count_if(found & ~same).alias("wrong"))


def two_score_confusion(rows: DataFrame, gate: Column, base: Column, label: str = "label") -> DataFrame:
    """Rows by what gate and base score say and the label is."""
    return rows.groupBy(gate.alias("gate"), base.alias("base"), F.col(label).alias("label")).agg(F.count("*").alias("n"))


def mix(rows: DataFrame, column: str) -> DataFrame:
    """Values by their number of rows; null counts as unknown."""
    return rows.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias(column)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def elapsed(rows: DataFrame, seconds: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(seconds).alias("total"), F.avg(seconds).alias("per_row"))


def positional(inputs: DataFrame, answers: DataFrame, position: str, key: str) -> DataFrame:
    """Rows of both sides by position, and whether their keys agree; a side that ends early gives null keys."""
    left, right = inputs.select(position, F.col(key).alias("input_key")), answers.select(position, F.col(key).alias("answer_key"))
    return left.join(right, position, "full_outer").withColumn("same", F.equal_null("input_key", "answer_key"))


def batch_answers(requests: DataFrame, answers: DataFrame, seq: str) -> DataFrame:
    """``batch, id, answer, ok``: answers by batch and record id (the last of repeated ones); a batch of one
    takes a sole answer whatever its id; a batch with any miss fails as a whole and gives no answers."""
    last = answers.groupBy("batch", F.col("record_id").alias("id")).agg(F.max_by("answer", seq).alias("answer"))
    sole = answers.groupBy("batch").agg(F.count("*").alias("_answers"), F.max("answer").alias("_sole"))
    joined = requests.join(last, ["batch", "id"], "left")
    summary = joined.groupBy("batch").agg(F.count("*").alias("_asked"), F.bool_and(F.col("answer").isNotNull()).alias("_all"))
    each = joined.join(summary.join(sole, "batch", "left"), "batch")
    takes_sole = F.coalesce((F.col("_asked") == 1) & (F.col("_answers") == 1), F.lit(False))
    ok = F.col("_all") | (takes_sole & F.col("_sole").isNotNull())
    return each.select("batch", "id", F.when(ok, F.coalesce("answer", F.when(takes_sole, F.col("_sole")))).alias("answer"), ok.alias("ok"))


def distinct_words(rows: DataFrame, words: str) -> DataFrame:
    """All words of all rows once, without regard to case in their order (the least spelling of each stays apart)."""
    return rows.select(F.explode(words).alias("word")).distinct().orderBy(F.lower("word"), "word")


def most_attempts(rows: DataFrame, attempts: str, by: list[str] | None = None) -> DataFrame:
    """The largest number of attempts; what is no number counts as none."""
    return rows.groupBy(*(by or [])).agg(F.coalesce(F.max(F.coalesce(F.col(attempts).try_cast("int"), F.lit(0))), F.lit(0)).alias("most"))


def claimed(queue: DataFrame, key: str, seq: str, keep: Column, last_run: Column, now: Column, seconds: int = 60) -> tuple[DataFrame, DataFrame]:
    """A claim of the queue: what to run and what goes back.

    Events that aren't kept go, of repeated keys the first stays; within the global cooldown all of
    it goes back.  Streaming callers claim a micro-batch: its checkpoint is the atomic rename."""
    rest = [c for c in queue.columns if c != key]
    once = queue.where(keep).groupBy(key).agg(F.min_by(F.struct(*rest), seq).alias("r")).select(key, "r.*")
    free = cooldown_wait(last_run, now, seconds) == 0
    return once.where(free), once.where(~free)


def turns_since_run(turns: DataFrame, key: str, order: str, ran: str) -> DataFrame:
    """Per key: completed turns after its last run, and that run's place (null without any)."""
    last = turns.where(ran).groupBy(key).agg(F.max(order).alias("last_run"))
    joined = turns.join(last, key, "left")
    after = F.col("last_run").isNull() | (F.col(order) > F.col("last_run"))
    return joined.groupBy(key).agg(F.count_if(after).alias("turns_since_run"), F.first("last_run").alias("last_run"))


def minutes_since_previous(runs: DataFrame, key: str, ts: str) -> DataFrame:
    """``minutes`` since the run before of the same key, null for the first; rows of one time in the order of ``event_id``."""
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(ts, "event_id"))
    return runs.withColumn("minutes", (F.unix_timestamp(F.col(ts).cast("timestamp")) - F.unix_timestamp(before.cast("timestamp"))) / 60)


def scan_roots(events: DataFrame, path: str, order: str) -> DataFrame:
    """Distinct roots with the place where each was first seen."""
    return events.where(F.coalesce(F.col(path), F.lit("")) != "").groupBy(F.col(path).alias("root")).agg(F.min(order).alias("first_seen"))


def latest_changes(diffs: DataFrame, group: str, order: str, changes: str, n: int = 3) -> DataFrame:
    """The newest diff of each group with its first n changes."""
    return diffs.groupBy(group).agg(F.max(order).alias("latest"), F.max_by(F.slice(changes, 1, n), order).alias("changes"))


def outbox_status(outbox: DataFrame, flushes: DataFrame, order: str) -> DataFrame:
    """The number of waiting rows and the state of the last flush (null before the first)."""
    state = flushes.select(F.lit(0).alias("_w"), F.col("state"), F.col(order).alias("_at"))
    both = state.unionByName(outbox.select(F.lit(1).alias("_w")), allowMissingColumns=True)
    return both.agg(F.coalesce(F.sum("_w"), F.lit(0)).alias("waiting"), F.max_by("state", "_at").alias("last_state"), F.max("_at").alias("last_flush"))
