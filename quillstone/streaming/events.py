"""Streaming forms: exactly-once messages, collapsed observations, repetition, cooldowns, batches.

Checkpoints take the place of lock files, claimed queues and lists of processed keys.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillstone.functions import scalars, text
from quillstone.operators import repetition
from quillstone.sources import sinks


def transcript_lines(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """``value, path``: new lines of a folder of JSON Lines files."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", most_files).option("recursiveFileLookup", "true").load(folder).select("value", F.col("_metadata.file_path").alias("path"))


def once(rows: DataFrame, key: list[str], ts: str, delay: str = "15 minutes") -> DataFrame:
    """Each key once within the delay; the state forgets older ones."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def collapsed(events: DataFrame, bucket_seconds: int = 120, delay: str = "10 minutes") -> DataFrame:
    """One event per session, folder, text and fixed time bucket."""
    bucket = F.floor(F.unix_timestamp("ts") / bucket_seconds)
    keyed = events.withColumn("_key", text.key_hash(F.col("session_id"), F.col("cwd"), F.sha2("snippet", 256), bucket))
    return once(keyed, ["_key"], "ts", delay).drop("_key")


def per_minute(events: DataFrame, delay: str = "10 minutes", window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Counts per sliding window and version; late events are taken in until the watermark passes."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window, slide), "version").agg(F.count("*").alias("n"), F.count_if("triggered").alias("woke"))


def repeated(events: DataFrame, settings: repetition.Settings = repetition.Settings()) -> DataFrame:
    """Repetition pressure with each scope's state in the state store.  Rows of a micro-batch are
    judged in the order of ``ts, event_id``; a scope silent for a window is forgotten."""
    rows = repetition.prepared(events, settings).where("suppressed is null").withColumn("seq", F.col("ts")).withColumn("event_id", F.col("event_id").cast("string"))

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = pickle.loads(state.get[0]) if state.exists else repetition.State()
        frames = [f for f in frames]
        out = []
        for event in pd.concat(frames).sort_values(["seq", "event_id"]).to_dict("records"):
            event["observed_at"] = None if pd.isna(event["observed_at"]) else event["observed_at"]
            out.append({"event_id": event["event_id"], "scope": key[0], **repetition.step(own, event, settings)})
        state.update((pickle.dumps(own),))
        state.setTimeoutDuration(1000 * max(settings.window, settings.duplicate))
        yield pd.DataFrame(out, columns=["event_id", "scope", "duplicate", "repeat_count", "similarity", "triggered", "similar"])

    return rows.select(*repetition._COLUMNS).groupBy("scope").applyInPandasWithState(judge, repetition.RESULT, "state binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


def cooled(events: DataFrame, key: str = "session_id", seconds: int = 60) -> DataFrame:
    """Batches of a key's events: the first goes at once, later ones wait until the key has been
    silent for ``seconds``, or go with the first event after that.  ``key, n, event_ids``."""

    def gate(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = (state.get[0], list(state.get[1])) if state.exists else (-1e18, [])
        if state.hasTimedOut:
            if waiting:
                yield pd.DataFrame({key: [group[0]], "n": [len(waiting)], "event_ids": [waiting]})
            state.remove()
            return
        for frame in frames:
            for ts, event in sorted(zip(frame["ts"], frame["event_id"])):
                waiting.append(str(event))
                if ts - last >= seconds:
                    yield pd.DataFrame({key: [group[0]], "n": [len(waiting)], "event_ids": [waiting]})
                    last, waiting = ts, []
        state.update((last, waiting))
        state.setTimeoutDuration(1000 * seconds)

    return events.groupBy(key).applyInPandasWithState(gate, f"{key} string, n int, event_ids array<string>", "last double, waiting array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def dashboard(events: DataFrame, path: str, checkpoint: str, title: str = "Scoreboard", available_now: bool = False):
    """The scoreboard of all events so far as a Markdown file that every micro-batch writes anew."""
    board = events.groupBy("version").agg(F.count("*").alias("messages"), F.count_if("triggered").alias("triggers"))

    def render(batch: DataFrame, _: int) -> None:
        sinks.report(batch.withColumn("rate", scalars.ratio(F.col("triggers"), F.col("messages"))).orderBy("version"), path, title)

    writer = board.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(render)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def drained(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", idle_batches: bool = True) -> None:
    """Runs a stream over all that is there and stops (a scheduled batch).  Streams whose state has
    processing-time timeouts ask for batches without data for ever; run them without such."""
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    conf.set(key, str(idle_batches).lower())
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
        query.awaitTermination()
    finally:
        conf.set(key, before)


def continuous(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "60 seconds", mode: str = "append"):
    """Runs a stream until stopped, once per period at most."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(sink).start()
