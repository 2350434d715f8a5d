"""Operators over logged events: filters, collapsing of double observations, scoreboards, trends.

An event has ``event_id, ts, source, role, version, triggered, review_triggered, session_id, cwd,
prompt_hash, snippet, score`` and an arrival order (``event_id`` unless stated).  Aggregations are
by key and combine before their shuffle; nothing is gathered but top-k results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import scalars, text


def event_text(events: DataFrame) -> Column:
    """The prompt, else the snippet, else empty."""
    parts = [F.col(c) for c in ("prompt", "snippet") if c in events.columns]
    return text.first_of(*parts) if parts else F.lit("")


def direct_user(events: DataFrame) -> DataFrame:
    """Events whose role is null, empty or user and whose text is no control message."""
    role = F.lower(text.compact(F.col("role")))
    return events.where(role.isin("", "user") & ~text.is_control(event_text(events)))


def count_key(events: DataFrame, bucket_seconds: int = 120) -> Column:
    """Key of one message seen by several observers: session, folder, text and a fixed time bucket.
    Without a prompt hash the text's own is taken; without text the event's id."""
    given = text.compact(F.col("prompt_hash"))
    own = event_text(events)
    hashed = F.when(given != "", given).when(own != "", F.sha2(own, 256)).otherwise("")
    bucket = F.coalesce(scalars.time_bucket(F.col("ts"), bucket_seconds), F.lit(0)).cast("string")
    joined = text.key_hash(text.compact(F.col("session_id")), text.compact(F.col("cwd")), hashed, bucket)
    return F.when((hashed == "") & (text.compact(F.col("event_id").cast("string")) != ""), text.key_hash(F.col("event_id"))).otherwise(joined)


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order.  Written as an aggregation over structs rather
    than a window: it combines before the shuffle, so a key with a third of all rows is no burden."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return first.select(*keys, "_row.*").select(*rows.columns)


def collapsed(events: DataFrame, bucket_seconds: int = 120, order: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Direct events, one per count key; with ``columns`` only these go through the shuffle and come out."""
    order = order or ["event_id"]
    keyed = direct_user(events).withColumn("_key", count_key(events, bucket_seconds))
    if columns is not None:
        keyed = keyed.select("_key", *dict.fromkeys([*order, *columns]))
    first = first_per_key(keyed, ["_key"], order).drop("_key")
    return first if columns is None else first.select(*columns)


def scoreboard(events: DataFrame, order: str = "event_id") -> DataFrame:
    """Per version: messages, triggers, their share, first and last time in the order of arrival."""
    n, hits = F.count("*"), F.count_if("triggered")
    return events.groupBy("version").agg(
        n.alias("messages"), hits.alias("triggers"), scalars.ratio(hits, n).alias("rate"),
        F.min_by("ts", order).alias("first_ts"), F.max_by("ts", order).alias("last_ts"), F.min(order).alias("first_seen"),
    )


def best_version(board: DataFrame, least: int = 5) -> DataFrame:
    """The version with the lowest rate among those with enough messages; the first seen wins ties."""
    return board.where((F.col("version") != "unknown") & (F.col("messages") >= least)).orderBy("rate", "first_seen").limit(1)


def signal_summary(events: DataFrame) -> DataFrame:
    woke = F.col("triggered")
    return events.agg(
        F.count("*").alias("total"), F.count_if(woke).alias("woke"), F.count_if(~woke & F.col("review_triggered")).alias("review_only"),
        F.count_if(F.col("source").endswith("backfill")).alias("backfilled"), F.count_if(F.col("role") == "assistant").alias("assistant"),
    )


def daily_trend(events: DataFrame, last_day: str, days: int = 7) -> DataFrame:
    """Counts per UTC day for the days up to ``last_day``, with zeros for days without events."""
    end = F.lit(last_day).cast("date")
    frame = events.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    day = F.to_date("ts")
    counts = events.where(day.between(F.date_sub(end, days - 1), end)).groupBy(day.alias("day")).agg(
        F.count_if("triggered").alias("woke"), F.count_if(~F.col("triggered") & F.col("review_triggered")).alias("review"), F.count("*").alias("total")
    )
    return frame.join(F.broadcast(counts), "day", "left").na.fill(0)  # at most ``days`` rows


def score_histogram(events: DataFrame) -> DataFrame:
    return events.where("score is not null").groupBy(scalars.bucket5(F.col("score")).alias("bin")).agg(F.count("*").alias("n"))


def mean_score_trend(events: DataFrame, days: int, last_day: str, dead_zone: float = 0.003) -> DataFrame:
    """Mean score of the second half of a span of days minus that of the first, and its sign."""
    daily = events.where(F.to_date("ts").between(F.date_sub(F.lit(last_day).cast("date"), days - 1), F.lit(last_day).cast("date"))).groupBy(F.to_date("ts").alias("day")).agg(F.avg("score").alias("mean"))
    half = F.date_sub(F.lit(last_day).cast("date"), days // 2 - 1)
    delta = F.avg(F.when(F.col("day") >= half, F.col("mean"))) - F.avg(F.when(F.col("day") < half, F.col("mean")))
    return daily.agg(F.count("*").alias("days"), delta.alias("delta")).withColumn("direction", F.when(F.col("delta") > dead_zone, "up").when(F.col("delta") < -dead_zone, "down").otherwise("flat"))


def top_values(rows: DataFrame, values: str, k: int = 8) -> DataFrame:
    """The k most frequent elements of an array column; ties go to the smaller value."""
    return rows.select(F.explode(values).alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def latest(events: DataFrame, by: list[str]) -> DataFrame:
    """The one event that comes last."""
    return events.agg(F.max_by(F.struct(*events.columns), F.struct(*by)).alias("e")).select("e.*")


def latest_processed(messages: DataFrame, events: DataFrame, source: str) -> DataFrame:
    """The latest message (``path, line, ts``) and what became of it: ``processed``, ``triggered`` of the last event of that source for
    its path and line, and ``behind``, seconds since the latest event if that is older.  One row; none without messages."""
    newest = messages.where("ts is not null").agg(F.max_by(F.struct("path", "line", "ts"), F.struct("ts", "path", "line")).alias("m")).where("m is not null").select("m.*")
    own = events.where(F.col("source") == source).select(F.col("transcript_path").alias("path"), F.col("transcript_line").alias("line"), "event_id", "triggered")
    seen = own.join(F.broadcast(newest.select("path", "line")), ["path", "line"], "left_semi").groupBy("path", "line").agg(F.max_by("triggered", "event_id").alias("triggered"), F.lit(True).alias("processed"))
    last = events.agg(F.max("ts").alias("_last"))
    found = newest.join(seen, ["path", "line"], "left").crossJoin(last)  # one row each
    gap = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("_last").cast("timestamp"))
    return found.select("path", "line", "ts", F.coalesce("processed", F.lit(False)).alias("processed"), "triggered", F.when(gap > 0, gap).alias("behind"))


def manual_events(snapshots: DataFrame, messages: DataFrame, sessions: DataFrame, run_id: str, now: str, version: str, session_id: str = "", cwd: str = "") -> DataFrame:
    """An event for each changed snapshot (``path, nth``): its last user message (``path, line, text``), its session (``path, session_id,
    cwd``), marked as a manual run.  A file without a message gives an event without text."""
    last = messages.groupBy("path").agg(F.max("line").alias("line"), F.max_by("text", "line").alias("prompt"))
    rows = snapshots.join(last, "path", "left").join(sessions.select("path", F.col("session_id").alias("_s"), F.col("cwd").alias("_c")), "path", "left")
    told = F.coalesce("prompt", F.lit("")) != ""
    event_id = F.concat(F.lit(f"manual:{run_id}:"), F.col("nth").cast("string"), F.lit(":"), F.col("path"), F.lit(":"), F.coalesce("line", F.lit(0)).cast("string"))
    return rows.select(
        event_id.alias("event_id"), F.lit(now).cast("timestamp").alias("ts"), F.lit("manual_run").alias("source"), F.lit(version).alias("version"), F.lit(True).alias("triggered"),
        F.lit("manual").alias("wake_reason"), F.lit(True).alias("review_triggered"), text.first_of(F.lit(session_id), F.col("_s")).alias("session_id"), text.first_of(F.col("_c"), F.lit(cwd)).alias("cwd"),
        F.col("path").alias("transcript_path"), F.col("line").alias("transcript_line"), F.concat_ws(":", "path", "line").alias("message_locator"), event_id.alias("dedupe_key"),
        F.when(told, F.sha2("prompt", 256)).alias("prompt_hash"), F.when(told, F.substring("prompt", 1, 4000)).alias("prompt"), F.coalesce(F.substring("prompt", 1, 300), F.lit("")).alias("snippet"))


def usage_leader(events: DataFrame, host: str, preference: list[str]) -> DataFrame:
    """The host with most events; then the latest, then the one named earlier in ``preference``."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, preference)), F.col(host)), F.lit(0))
    used = events.groupBy(host).agg(F.count("*").alias("n"), F.max("ts").alias("latest"))
    return used.orderBy(F.desc("n"), F.desc("latest"), F.when(rank == 0, len(preference) + 1).otherwise(rank), host).limit(1)


def run_summary(runs: DataFrame, order: str, by: list[str] | None = None, last: int = 4) -> DataFrame:
    """Counts of runs, and the last ones in ``order``, latest first (the rank limit is applied before the shuffle)."""
    found = runs.groupBy(*(by or [])).agg(F.count("*").alias("runs"), F.sum("event_count").alias("events"), F.count_if("dry_run").alias("dry_runs"))
    rank = F.row_number().over(Window.partitionBy(*(by or [])).orderBy(F.desc(order)))
    kept = runs.withColumn("_rank", rank).where(F.col("_rank") <= last).groupBy(*(by or [])).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", order))), lambda x: x[order]).alias("last_runs"))
    return found.join(kept, by) if by else found.crossJoin(kept)  # one row each


def status_summary(events: DataFrame, floor: float = 0.4) -> DataFrame:
    """Raw, direct and triggered events, those with a main score and with any of another model, distinct versions and
    models (``alternates``: a map of model to score), and whether any score reaches ``floor``."""
    direct = F.lower(text.compact(F.col("role"))).isin("", "user") & ~text.is_control(event_text(events))
    models = F.map_keys("alternates")
    return events.agg(
        F.count("*").alias("raw"), F.count_if(direct).alias("direct"), F.count_if(direct & F.col("triggered")).alias("triggered"), F.count("score").alias("scored"),
        F.count_if(F.size(models) > 0).alias("shadow_scored"), F.countDistinct("version").alias("versions"), F.max(F.col("score") >= floor).alias("any_reaches_floor"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(models)))).alias("models"))


def tail(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last n rows, in order."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def within(events: DataFrame, now: str, seconds: int) -> DataFrame:
    """Events no older than a span before ``now``; without a time they count as now."""
    return events.where(F.coalesce(F.col("ts").cast("timestamp"), F.lit(now).cast("timestamp")) >= F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds)))


def newest_first(rows: DataFrame, limit: int, newest: str, order: list[str]) -> DataFrame:
    """At most ``limit`` rows, those of the newest files first (a bounded backfill)."""
    return rows.orderBy(F.desc(newest), *order).limit(limit)


def cooldown(events: DataFrame, last_runs: DataFrame, key: str, now: str, seconds: int = 60) -> DataFrame:
    """Events with ``eligible`` and ``wait`` seconds, by the last run of their key (one row per key)."""
    elapsed = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("last_run").cast("timestamp"))
    wait = F.greatest(F.lit(0), seconds - elapsed)
    return events.join(last_runs, key, "left").withColumn("wait", F.coalesce(wait, F.lit(0))).withColumn("eligible", F.col("wait") == 0)


def debounced(events: DataFrame, key: str, seconds: int = 75) -> DataFrame:
    """Batches of events of a key that follow each other within ``seconds``."""
    return events.groupBy(key, F.session_window(F.col("ts").cast("timestamp"), f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event")).select(key, F.col("w.start").alias("started"), "n", "first_event")


def carried_forward(rows: DataFrame, value: Column, file: str, line: str) -> Column:
    """The last non-null value at or above a row of its file."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(file).orderBy(line).rowsBetween(Window.unboundedPreceding, 0))


def retries(events: DataFrame, most: int = 2) -> DataFrame:
    """Failed events with one more attempt, without those that have had ``most``."""
    attempts = F.coalesce(F.col("attempts").try_cast("int"), F.lit(0)) + 1
    return events.withColumn("attempts", attempts).where(F.col("attempts") < most)


def feedback_event(events: DataFrame, snippet: int = 300) -> DataFrame:
    """The logged form: a snippet only where something matched or fired, and the reason to wake."""
    loud = (F.size("matched") > 0) | F.col("triggered") | F.col("review_triggered")
    reason = F.when(F.col("triggered"), "classifier").when(F.col("review_triggered"), "review").otherwise("")
    return events.withColumns({"snippet": F.when(loud, text.compact(F.col("prompt"), snippet)).otherwise(""), "wake_reason": reason, "prompt_hash": F.sha2("prompt", 256)})


def telemetry(events: DataFrame, salt: str) -> DataFrame:
    """Properties for transmission: hashes instead of names, nulls and empties dropped."""
    properties = F.map_from_arrays(
        F.array(*map(F.lit, ("event_id", "source", "version", "triggered", "session_hash", "cwd_hash", "snippet_sha256", "snippet_length"))),
        F.array(
            F.col("event_id").cast("string"), F.col("source"), F.col("version"), F.col("triggered").cast("string"), text.salted_digest(F.col("session_id").cast("string"), salt),
            text.salted_digest(F.col("cwd"), salt), text.salted_digest(F.col("snippet"), salt), F.length("snippet").cast("string"),
        ),
    )
    return events.select(F.col("event_id"), F.map_filter(properties, lambda k, v: v.isNotNull() & (v != "")).alias("properties"))
