"""The incremental scan: every message of a set of growing transcripts becomes an event once.

A message is known by the hash of its path, line, time and text.  Each path keeps at most ``most_keys`` keys with the
time when they were processed; beyond that the oldest go (a bound on the count, not on time), and a message whose key
has gone is an event again if it is delivered again.  Messages older than the cutoff, by the clock of the run, are left out.
The same rule is a stateful operator on a stream, and a batch over a table of keys for a scheduled scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillstone.functions import records, scalars, text
from quillstone.operators.events import first_per_key
from quillstone.sources import jsonl, sinks

EVENT = "key string, path string, line long, timestamp string, ts timestamp, source string, role string, session_id string, cwd string, prompt string, prompt_hash string"
_EVENT = [c.split()[0] for c in EVENT.split(", ")]
STATE = "path string, key string, processed_at timestamp"


def events(messages: DataFrame, backfill: bool = False, now: Column | None = None) -> DataFrame:
    """``EVENT`` rows of ``jsonl`` messages.  Without ``backfill`` only sources with separate metadata rows count.
    What has no readable time gets the run's."""
    now = F.current_timestamp() if now is None else now
    rows = messages.withColumn("prompt", F.btrim("text")).where((F.col("prompt") != "") & ~text.is_control(F.col("prompt")))
    if not backfill:
        rows = rows.where(F.col("source") == "codex")
    return rows.select(
        text.key_hash(F.col("path"), F.col("line"), F.col("timestamp"), F.col("prompt")).alias("key"), "path", "line", "timestamp", F.coalesce(scalars.timestamp(F.col("timestamp")), now).alias("ts"),
        records.source_name(F.col("source"), F.lit(backfill)).alias("source"), F.lit("user").alias("role"), "session_id", "cwd", "prompt", F.sha2("prompt", 256).alias("prompt_hash"))


class Seen(StatefulProcessor):
    """A path's keys in a map state, with the number of the batch's time and an order of arrival."""

    def __init__(self, most_keys: int):
        self.most_keys = most_keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.keys = handle.getMapState("keys", "key string", "nth long")
        self.count = handle.getValueState("count", "n long, nth long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, nth = self.count.get() if self.count.exists() else (0, 0)
        for frame in rows:
            new = []
            for place, (k, _) in enumerate(sorted(zip(frame["key"], range(len(frame))), key=lambda x: (frame["line"].iloc[x[1]], x[0]))):
                if not self.keys.containsKey((k,)):
                    nth += 1
                    n += 1
                    self.keys.updateValue((k,), (nth,))
                    new.append(_)
            if new:
                yield frame.iloc[new][_EVENT]
        if n > self.most_keys:
            for (k,), (at,) in list(self.keys.iterator()):
                if at <= nth - self.most_keys:  # numbers have no gaps: what is left are the newest
                    self.keys.removeKey((k,))
            n = self.most_keys
        self.count.update((n, nth))

    def close(self) -> None:
        pass


def once(rows: DataFrame, minutes: int | None = None, most_keys: int = 5000) -> DataFrame:
    """A stream of ``EVENT`` rows with each event once.  Needs the RocksDB state store."""
    if minutes is not None:
        rows = rows.where(F.col("ts") >= F.current_timestamp() - F.make_interval(mins=F.lit(minutes)))
    return rows.select(*_EVENT).groupBy("path").transformWithStateInPandas(Seen(most_keys), EVENT, "Append", "ProcessingTime")


def fresh(rows: DataFrame, state: DataFrame, cutoff: Column, most_events: int | None = None, newest: DataFrame | None = None) -> DataFrame:
    """Events after the cutoff whose keys aren't in the state; with ``most_events`` the first of them, newest files
    (``path, modified``) first."""
    known = state.select("path", "key").distinct()
    rows = first_per_key(rows.where(F.col("ts") >= cutoff), ["key"], ["path", "line"]).join(known, ["path", "key"], "left_anti")
    if most_events is None:
        return rows
    order = [F.col("path"), F.col("line")]
    if newest is not None:
        rows, order = rows.join(newest.select("path", F.col("modified").alias("_modified")), "path", "left"), [F.desc("_modified"), *order]
    return rows.orderBy(*order).limit(most_events).drop("_modified")


def trimmed(state: DataFrame, most_keys: int = 5000) -> DataFrame:
    """The newest keys of every path."""
    nth = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("processed_at"), "key"))
    return state.withColumn("_nth", nth).where(F.col("_nth") <= most_keys).drop("_nth")


def scan(spark: SparkSession, folder: str, state: str, out: str, now: str, minutes: int = 60, backfill: bool = False, most_events: int = 500, most_keys: int = 5000) -> DataFrame:
    """A scheduled scan: new events are appended to ``out`` (a backfill's to ``out``'s own partition), the table of keys at
    ``state`` is replaced, and the new events are returned.  ``now`` is the run's time.

    The events go out first, so a run that fails between the two repeats some and loses none."""
    files = spark._jvm.org.apache.hadoop.fs
    at = files.Path(state)
    exists = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    known = spark.read.schema(STATE).json(state) if exists else spark.createDataFrame([], STATE)
    time = F.lit(now).cast("timestamp")
    rows = jsonl.lines(spark, folder, missing_ok=True)
    found = fresh(events(jsonl.messages(rows), backfill, time), known, time - F.make_interval(mins=F.lit(minutes)), most_events if backfill else None, rows.select("path", "modified").distinct())
    run = now.replace(" ", "T").replace(":", "")
    sinks.append(found, f"{out}/mode={'backfill' if backfill else 'incremental'}/run={run}")
    new = spark.read.schema(EVENT).json(f"{out}/mode={'backfill' if backfill else 'incremental'}/run={run}")
    sinks.replace(trimmed(known.unionByName(new.select("path", "key", time.alias("processed_at"))), most_keys), state)
    return new
