"""The worker's gate as a stream: state and event-time timers instead of a queue file, a lock and sleeping processes.

A worker's state is its gate; arrivals wait in it until the watermark has passed them, so the result does not depend
on how they were cut into micro-batches.  One timer is registered, for what happens next.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillstone.operators import worker

#: The state store that stateful processors need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Runs(StatefulProcessor):
    def __init__(self, settings: worker.Settings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.gate = handle.getValueState("gate", "state binary")

    def _load(self) -> worker.Gate:
        return pickle.loads(self.gate.get()[0]) if self.gate.exists() else worker.Gate(self.settings)

    def _save(self, gate: worker.Gate) -> None:
        self.gate.update((pickle.dumps(gate),))
        wanted = None if gate.due() is None else 1000 * (gate.due() + 1)  # when that second is over
        for timer in list(self.handle.listTimers()):
            if timer == wanted:
                wanted = None
            else:
                self.handle.deleteTimer(timer)
        if wanted is not None:
            self.handle.registerTimer(wanted)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        gate = self._load()
        for frame in rows:
            for session, at, fails in zip(frame["session_id"], frame["at"], frame["fails"]):
                gate.arrive(session, int(at), int(fails))
        self._save(gate)
        yield pd.DataFrame([], columns=worker.COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        gate = self._load()
        passed = timerValues.getCurrentWatermarkInMs() // 1000 - 1  # the last second that is over
        out = [(key[0], *row) for row in gate.advance(passed)]
        self._save(gate)
        yield pd.DataFrame(out, columns=worker.COLUMNS)

    def close(self) -> None:
        pass


def runs(events: DataFrame, settings: worker.Settings = worker.Settings(), delay: str = "0 seconds") -> DataFrame:
    """A stream of ``worker, session_id, ts`` (and ``fails``) as rows of ``worker.RESULT``, as their runs fire.

    ``ts`` gets the watermark.  The session's state store must be RocksDB (``PROVIDER``)."""
    fails = F.coalesce("fails", F.lit(0)).cast("int") if "fails" in events.columns else F.lit(0)
    rows = events.where("ts is not null").withWatermark("ts", delay).select(
        F.coalesce("worker", F.lit("")).alias("worker"), F.coalesce("session_id", F.lit("unknown")).alias("session_id"), F.unix_timestamp("ts").alias("at"), fails.alias("fails"), "ts")
    return rows.groupBy("worker").transformWithStateInPandas(Runs(settings), worker.RESULT, "Append", "EventTime")
