"""Cooldowns, requeueing, the scheduled retry and attempts: the gate, its batch replay and its stream."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest

from quillstone.operators import worker
from quillstone.streaming import worker as streamed
from quillstone.streaming.events import drained


def plain(rows: list[tuple], cooldown: int, session_cooldown: int, debounce: int, attempts: int) -> list[tuple]:
    """The same rule second by second."""
    queue, out, last, sessions, retry, claim, runs = [], [], None, {}, None, None, 0
    by_time: dict = {}
    for session, at, fails in rows:
        seen = by_time.setdefault(at, {})
        seen[session] = max(fails, seen.get(session, 0))
    now, end = min(by_time), max(by_time) + 100_000

    def schedule(delay):
        nonlocal retry
        if delay > 0 and retry is None:
            retry = now + min(delay + 1, max(cooldown, session_cooldown, 60))

    while now <= end and (now <= max(by_time) or retry is not None or claim is not None):
        asked = now in by_time
        queue += [{"s": s, "at": now, "fails": f, "n": 0, "back": 0} for s, f in sorted(by_time.get(now, {}).items())]
        if retry == now:
            retry, asked = None, True
        if asked and claim is None:
            claim = now + debounce
        if claim == now:
            claim = None
            if not queue:
                retry = None
            elif last is not None and now - last < cooldown:
                for e in queue:
                    e["back"] += 1
                schedule(last + cooldown - now)
            else:
                blocked = [e for e in queue if e["s"] in sessions and now - sessions[e["s"]] < session_cooldown]
                free = [e for e in queue if e not in blocked]
                for e in blocked:
                    e["back"] += 1
                wait = min((sessions[e["s"]] + session_cooldown - now for e in blocked), default=0)
                queue = blocked
                if not free:
                    schedule(wait)
                else:
                    failed = any(e["n"] < e["fails"] for e in free)
                    runs += 1
                    for e in free:
                        e["n"] += 1
                    if failed and max(e["n"] for e in free) < attempts:
                        for e in free:
                            e["back"] += 1
                        queue = blocked + free
                        schedule(cooldown)
                    else:
                        last, retry = now, None
                        for e in free:
                            sessions[e["s"]] = now
                            out.append((e["s"], e["at"], runs, now, e["n"], e["back"], "dropped" if failed else "done"))
                        if blocked:
                            schedule(max(cooldown, wait))
        now += 1
    return out


def made(seed: int, n: int = 200) -> list[tuple]:
    rng = random.Random(seed)
    at, rows = 1_700_000_000, []
    for _ in range(n):
        at += rng.choice([0, 0, 1, 2, 5, 20, 59, 60, 61, 200])
        rows.append((rng.choice("abc"), at, rng.choice([0] * 12 + [1, 2])))
    return rows


@pytest.mark.parametrize("settings", [(60, 60, 0, 2), (60, 150, 0, 2), (30, 0, 75, 2), (0, 0, 0, 1), (60, 90, 10, 3)])
@pytest.mark.parametrize("seed", range(4))
def test_gate(settings, seed):
    rows = made(seed)
    gate = worker.Gate(worker.Settings(*settings))
    got = []
    for session, at, fails in rows:
        got += gate.advance(at - 1)
        gate.arrive(session, at, fails)
    got += gate.advance(None)
    want = plain(rows, *settings)
    assert sorted(got) == sorted(want)
    assert len({(s, at) for s, at, *_ in got}) == len(got) == len({(s, at) for s, at, _ in rows})  # nothing lost, nothing twice


def table(spark, workers: dict[str, list[tuple]]):
    rows = [(w, s, dt.datetime.fromtimestamp(at, dt.timezone.utc), f) for w, found in workers.items() for s, at, f in found]
    return spark.createDataFrame(rows, "worker string, session_id string, ts timestamp, fails int")


def test_replayed(spark):
    workers = {"one": made(1), "two": made(2), "three": made(3, 7)}
    settings = worker.Settings(60, 90, 5, 2)
    got = [tuple(r) for r in worker.replayed(table(spark, workers).repartition(7), settings, fails="fails").collect()]
    assert sorted(got) == sorted((w, *r) for w, rows in workers.items() for r in plain(rows, 60, 90, 5, 2))
    assert worker.replayed(table(spark, workers).limit(0)).count() == 0


def test_stream_agrees_and_survives_a_restart(spark, tmp_path):
    """Arrivals in files, drained in three goes from one checkpoint: what waits and the timers are in the state."""
    workers = {"one": made(5, 60), "two": made(6, 40)}
    settings = worker.Settings(60, 90, 5, 2)
    rows = sorted((at, w, s, f) for w, found in workers.items() for s, at, f in found)
    source, got = tmp_path / "in", []
    source.mkdir()
    before = spark.conf.get(streamed.PROVIDER[0])
    spark.conf.set(*streamed.PROVIDER)
    try:
        for part in (rows[:30], rows[30:55], rows[55:], [(rows[-1][0] + 100_000, "end", "x", 0)], [(rows[-1][0] + 100_100, "end", "x", 0)]):
            frame = pd.DataFrame(part, columns=["at", "worker", "session_id", "fails"])
            frame["ts"] = pd.to_datetime(frame["at"], unit="s").dt.strftime("%Y-%m-%dT%H:%M:%SZ")
            frame.drop(columns="at").to_json(source / f"{frame['ts'][0].replace(':', '')}.json", orient="records", lines=True)
            stream = spark.readStream.schema("worker string, session_id string, ts timestamp, fails int").json(str(source))
            drained(streamed.runs(stream, settings), lambda batch, _: got.extend(tuple(r) for r in batch.collect()), str(tmp_path / "checkpoint"))
    finally:
        spark.conf.set(streamed.PROVIDER[0], before)
    assert sorted(r for r in got if r[0] != "end") == sorted((w, *r) for w, found in workers.items() for r in plain(found, 60, 90, 5, 2))
