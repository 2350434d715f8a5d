"""When a host's turns lead to a run: enough completed turns and minutes since the last run, a new generation, changed files.

``Cadence`` is one host's state; ``replayed`` streams a host's rows through it in order and ``stream`` keeps it in a state store.
A stop is a completed turn.  What isn't skipped runs and sets the turns back; a forced one always does.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

RESULT = "host string, event_id string, turns int, minutes double, reason string, ran boolean"
COLUMNS = ["host", "event_id", "turns", "minutes", "reason", "ran"]
_INPUT = ["host", "ts", "event_id", "kind", "generation", "changed", "force"]


@dataclass
class Cadence:
    min_turns: int = 3
    min_minutes: float = 30.0
    turns: int = 0
    generation: str = ""
    last_run: float | None = None

    def observe(self, ts: float, kind: str, generation: str, changed: bool, force: bool) -> tuple[int, float | None, str, bool]:
        """Turns since the last run, minutes since it, why this is skipped (empty if it isn't), and whether it runs."""
        stop = kind == "stop"
        self.turns += stop
        minutes = None if self.last_run is None else (ts - self.last_run) / 60
        reason = ""
        if stop and not force:
            if generation and generation == self.generation:
                reason = "generation already processed"
            elif self.turns < self.min_turns:
                reason = f"cadence needs {self.min_turns} completed turns"
            elif minutes is not None and minutes < self.min_minutes:
                reason = f"cadence needs {self.min_minutes:g} minutes since last run"
            elif not changed:
                reason = "no changed transcripts"
        turns = self.turns
        self.generation = generation or self.generation
        if not reason:
            self.last_run, self.turns = ts, 0
        return turns, minutes, reason, not reason


def prepared(rows: DataFrame) -> DataFrame:
    """``host, ts`` (epoch seconds)``, event_id, kind, generation, changed, force`` without nulls; rows without host or time go."""
    return rows.where("host is not null and ts is not null").select(
        "host", F.col("ts").cast("timestamp").cast("double").alias("ts"), F.col("event_id").cast("string").alias("event_id"), F.coalesce("kind", F.lit("")).alias("kind"),
        F.coalesce("generation", F.lit("")).alias("generation"), F.coalesce("changed", F.lit(False)).alias("changed"), F.coalesce("force", F.lit(False)).alias("force"))


def replayed(rows: DataFrame, min_turns: int = 3, min_minutes: float = 30.0) -> DataFrame:
    """``RESULT`` of every row in the order of ``ts, event_id``.  A host is one sequence; its state is three values."""
    sorted_rows = prepared(rows).repartition("host").sortWithinPartitions("host", "ts", "event_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, state = None, Cadence(min_turns, min_minutes)
        for frame in frames:
            out = []
            for name, ts, event_id, kind, generation, changed, force in frame.itertuples(index=False):
                if name != host:
                    host, state = name, Cadence(min_turns, min_minutes)
                out.append((name, event_id, *state.observe(ts, kind, generation, changed, force)))
            yield pd.DataFrame(out, columns=COLUMNS)

    return sorted_rows.mapInPandas(run, RESULT)


class Kept(StatefulProcessor):
    def __init__(self, min_turns: int, min_minutes: float):
        self.fresh = (min_turns, min_minutes)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cadence", "state binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = pickle.loads(self.state.get()[0]) if self.state.exists() else Cadence(*self.fresh)
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])  # a host's turns of one micro-batch
        out = [(r.host, r.event_id, *state.observe(r.ts, r.kind, r.generation, r.changed, r.force)) for r in frame.itertuples(index=False)]
        self.state.update((pickle.dumps(state),))
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def stream(rows: DataFrame, min_turns: int = 3, min_minutes: float = 30.0) -> DataFrame:
    """``RESULT`` of a stream; micro-batches come in the order of time.  Needs the RocksDB state store."""
    return prepared(rows).select(*_INPUT).groupBy("host").transformWithStateInPandas(Kept(min_turns, min_minutes), RESULT, "Append", "ProcessingTime")
