"""From triggered events to a worker's runs: debounce, cooldowns, requeueing, one scheduled retry, attempts.

``Gate`` is the rule for one worker, over rows in the order of time.  It keeps what waits and the times
of the last runs, and no more; ``replayed`` streams sorted rows through it, and
``quillstone.streaming.worker`` keeps it in a state store with timers.  Both see the same rows in the
same order, so they agree.

An arrival, or the scheduled retry, asks for a claim; one made after ``debounce`` seconds takes all that
has arrived until then.  Within the global cooldown of the last run everything goes back and one retry is
scheduled, unless one is outstanding.  Else the sessions that ran within their own cooldown go back and the others run.
A run fails while one of its events says so (``fails`` attempts); its events go back with one attempt more, and are
dropped when that reaches ``attempts``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "worker string, session_id string, at long, run long, fired_at long, attempts int, requeued int, outcome string"
COLUMNS = ["worker", "session_id", "at", "run", "fired_at", "attempts", "requeued", "outcome"]


@dataclass(frozen=True)
class Settings:
    """Seconds, and failed attempts until a batch is dropped."""

    cooldown: int = 60
    session_cooldown: int = 60
    debounce: int = 0
    attempts: int = 2


@dataclass
class Gate:
    """One worker's state: what waits as ``[session, at, fails, attempts, requeued]``, arrivals ahead, last runs."""

    settings: Settings = Settings()
    waiting: list[list] = field(default_factory=list)
    ahead: list[tuple] = field(default_factory=list)
    fails: dict[tuple, int] = field(default_factory=dict)  # of what is ahead, by second and session
    sessions: dict[str, int] = field(default_factory=dict)
    last_run: int | None = None
    claim_at: int | None = None
    retry_at: int | None = None
    runs: int = 0

    def arrive(self, session: str, at: int, fails: int = 0) -> None:
        if (at, session) not in self.fails:
            heapq.heappush(self.ahead, (at, session))
        self.fails[at, session] = max(fails, self.fails.get((at, session), 0))

    def due(self) -> int | None:
        """When something happens next."""
        times = [t for t in (self.claim_at, self.retry_at, self.ahead[0][0] if self.ahead else None) if t is not None]
        return min(times) if times else None

    def advance(self, upto: int | None) -> Iterator[tuple]:
        """What happens until ``upto`` (to the end, without): rows ``session, at, run, fired_at, attempts, requeued, outcome``.
        At one moment arrivals come first, then the retry, then the claim."""
        while (now := self.due()) is not None and (upto is None or now <= upto):
            asked = False
            while self.ahead and self.ahead[0][0] == now:
                at, session = heapq.heappop(self.ahead)
                self.waiting.append([session, at, self.fails.pop((at, session)), 0, 0])
                asked = True
            if self.retry_at == now:
                self.retry_at, asked = None, True
            if asked and self.claim_at is None:
                self.claim_at = now + self.settings.debounce
            if self.claim_at == now:
                self.claim_at = None
                yield from self._claim(now)

    def _schedule(self, delay: int, now: int) -> None:
        if delay > 0 and self.retry_at is None:
            self.retry_at = now + min(max(delay + 1, 1), max(self.settings.cooldown, self.settings.session_cooldown, 60))

    def _claim(self, now: int) -> Iterator[tuple]:
        if not self.waiting:
            self.retry_at = None
            return
        rest = 0 if self.last_run is None else self.last_run + self.settings.cooldown - now
        if rest > 0:
            for event in self.waiting:
                event[4] += 1
            self._schedule(rest, now)
            return
        window = self.settings.session_cooldown
        self.sessions = {s: t for s, t in self.sessions.items() if t + window > now}  # the others block nothing any more
        free = [e for e in self.waiting if e[0] not in self.sessions]
        self.waiting = [e for e in self.waiting if e[0] in self.sessions]
        for event in self.waiting:
            event[4] += 1
        wait = min((self.sessions[e[0]] + window - now for e in self.waiting), default=0)
        if not free:
            self._schedule(wait, now)
            return
        failed = any(e[3] < e[2] for e in free)
        self.runs += 1
        for event in free:
            event[3] += 1
        if failed and max(e[3] for e in free) < self.settings.attempts:
            for event in free:
                event[4] += 1
            self.waiting += free
            self._schedule(self.settings.cooldown, now)
            return
        self.last_run, self.retry_at = now, None
        self.sessions.update((e[0], now) for e in free)
        for session, at, _, attempts, requeued in free:
            yield session, at, self.runs, now, attempts, requeued, "dropped" if failed else "done"
        if self.waiting:
            self._schedule(max(self.settings.cooldown, wait), now)


def arrivals(events: DataFrame, worker: str = "worker", session: str = "session_id", ts: str = "ts", fails: str | None = None) -> DataFrame:
    """``worker, session_id, at, fails``: a row for each worker, session and second with any event.  Events of a session
    and second share their fate, so this is all a gate needs, however many they are."""
    count = F.max(F.coalesce(F.col(fails), F.lit(0))) if fails else F.lit(0)
    at = F.unix_timestamp(F.col(ts).cast("timestamp"))
    return events.where(F.col(ts).isNotNull()).groupBy(F.coalesce(F.col(worker), F.lit("")).alias("worker"), F.coalesce(F.col(session), F.lit("unknown")).alias("session_id"), at.alias("at")).agg(count.cast("int").alias("fails"))


def replayed(events: DataFrame, settings: Settings = Settings(), worker: str = "worker", session: str = "session_id", ts: str = "ts", fails: str | None = None) -> DataFrame:
    """Every session and second with events: the run that took it, when it fired, attempts, times it went back,
    and whether it was done or dropped.

    A worker is one sequence by nature; its rows pass through a task in order, and memory holds what waits."""
    rows = arrivals(events, worker, session, ts, fails).repartition("worker").sortWithinPartitions("worker", "at", "session_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, gate = None, Gate(settings)

        def told(rows: Iterator[tuple]) -> Iterator[tuple]:
            return ((name, *r) for r in rows)

        for frame in frames:
            out = []
            for who, session_id, at, count in frame.itertuples(index=False):
                if who != name:
                    out.extend(told(gate.advance(None)))
                    name, gate = who, Gate(settings)
                out.extend(told(gate.advance(at - 1)))
                gate.arrive(session_id, at, count)
            yield pd.DataFrame(out, columns=COLUMNS)
        yield pd.DataFrame(list(told(gate.advance(None))), columns=COLUMNS)

    return rows.mapInPandas(run, RESULT)


def batches(events: DataFrame, settings: Settings = Settings(), worker: str = "worker", session: str = "session_id", ts: str = "ts", fails: str | None = None) -> DataFrame:
    """Claimed events (``events.collapsed`` and triggered) with ``run, fired_at, attempts, requeued, outcome`` of the run that took them."""
    found = replayed(events, settings, worker, session, ts, fails).withColumnsRenamed({"worker": "_worker", "session_id": "_session"})
    at = F.unix_timestamp(F.col(ts).cast("timestamp"))
    on = (F.coalesce(F.col(worker), F.lit("")) == F.col("_worker")) & (F.coalesce(F.col(session), F.lit("unknown")) == F.col("_session")) & (at == F.col("at"))
    return events.join(found, on).drop("_worker", "_session", "at")
