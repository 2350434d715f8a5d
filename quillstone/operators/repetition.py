"""Repetition pressure: repeated complaints in one project within a time window.

``step`` is the rule for one observation against its scope's state; ``batch`` replays it over each
scope in order of arrival, the streaming form keeps the state in a state store.  A scope's state is
bounded (``MOST`` entries and ``SEEN`` keys).  ``joined`` is the same rule over logged events as joins, for
any scope size: a scope is dealt out by place in its order, since an event only looks back on the ``MOST`` before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text
from quillstone.operators.store import summed

# The version that keys are hashed with, and words that carry no meaning.
VERSION = "repetition-pressure-v2"
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "i", "in", "is", "it", "me", "my", "of", "on", "or", "our",
    "that", "the", "this", "to", "u", "we", "what", "with", "you", "your",
)
#: Entries of a scope and keys seen that are kept.
MOST, SEEN = 75, 5000


@dataclass
class Settings:
    window: int = 1800
    duplicate: int = 600
    similarity: float = 0.46
    repeats: int = 2
    chars: int = 24
    terms: int = 4
    review: float = 0.30


@dataclass
class State:
    """``entries``: (event, ts, observed, hash, scope of duplicates, features); ``seen``: key to time."""

    entries: list = field(default_factory=list)
    seen: dict = field(default_factory=dict)


def prepared(events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds ``scope_kind, scope, features, prompt_hash, dup_scope, observation`` and ``suppressed``,
    the first reason against an event in the order of the rule, or null.

    Events have ``event_id, ts, observed_at`` (epoch seconds), ``prompt, session_id, cwd,
    transcript_path, message_locator, score, review, triggered``, and may have a ``dedupe_key``."""
    c = lambda name: text.compact(F.col(name))
    tokens = text.repetition_tokens(F.coalesce("prompt", F.lit("")), list(STOPWORDS))
    parent = F.regexp_extract(c("transcript_path"), r"^(.*)/[^/]*$", 1)
    kind = F.when(c("cwd") != "", "project").when(c("transcript_path") != "", "transcript_parent")
    place = F.when(c("cwd") != "", c("cwd")).otherwise(parent)
    rows = events.withColumns({
        "_tokens": tokens, "scope_kind": kind, "scope": F.when(kind.isNotNull(), text.key_hash(F.lit(VERSION), kind, place, length=20)),
        "prompt_hash": F.sha2(F.coalesce("prompt", F.lit("")), 256),
        "dup_scope": text.key_hash(F.when(c("session_id") != "", c("session_id")).otherwise(c("transcript_path")), c("cwd"), length=20),
    })
    message = F.concat(F.lit("prompt_hash:"), F.col("prompt_hash"))
    for name in ("event_id", "dedupe_key", "message_locator"):
        if name in events.columns:
            message = F.when(c(name) != "", F.concat(F.lit(f"{name}:"), c(name))).otherwise(message)
    rows = rows.withColumns({"features": text.hashed_features(text.repetition_features(F.col("_tokens")), VERSION), "observation": text.key_hash(F.col("dup_scope"), message, length=32)})
    prompt = F.coalesce("prompt", F.lit(""))
    review = F.coalesce("review", F.lit(False)) | (F.col("score") >= settings.review)
    suppressed = (
        F.when(F.col("score").isNull(), "classifier_unavailable").when(text.is_control_phrase(prompt), "control_phrase").when(text.is_pasted(prompt), "pasted_context")
        .when((F.length(text.compact(prompt)) < settings.chars) | (F.size("_tokens") < settings.terms), "too_short").when(~review, "below_review_threshold")
        .when(kind.isNull(), "project_scope_unavailable").when(F.size("features") < settings.terms, "too_few_features")
    )
    return rows.withColumn("suppressed", suppressed).drop("_tokens")


def step(state: State, event: dict, settings: Settings) -> dict:
    """Judges one eligible event and adds it to the state."""
    now = event["observed_at"] if event["observed_at"] is not None else event["ts"]
    state.entries = [e for e in state.entries if e[1] >= now - settings.window][-MOST:]
    oldest = now - max(settings.window, settings.duplicate)
    if len(state.seen) > SEEN or any(t < oldest for t in state.seen.values()):
        kept = sorted(((t, k) for k, t in state.seen.items() if t >= oldest), key=lambda x: -x[0])[:SEEN]
        state.seen = {k: t for t, k in kept}
    twice = any(e[3] == event["prompt_hash"] and e[4] == event["dup_scope"] and e[2] >= now - settings.duplicate for e in state.entries)
    if event["observation"] in state.seen or twice:
        return {"duplicate": True, "repeat_count": 1, "similarity": 0.0, "triggered": False, "similar": []}
    own = set(event["features"])
    like = []
    for e in state.entries:
        both = len(own & e[5])
        share = both / (len(own) + len(e[5]) - both) if own and e[5] else 0.0
        if share >= settings.similarity:
            like.append((share, e[0]))
    like.sort(key=lambda x: -x[0])
    fired = 1 + len(like) >= settings.repeats and not event["triggered"]
    state.entries = [*state.entries, (event["event_id"], event["ts"], now, event["prompt_hash"], event["dup_scope"], own)][-MOST:]
    state.seen[event["observation"]] = now
    return {"duplicate": False, "repeat_count": 1 + len(like), "similarity": round(like[0][0], 4) if like else 0.0, "triggered": fired, "similar": [i for _, i in like[:5]]}


RESULT = "event_id string, scope string, duplicate boolean, repeat_count int, similarity double, triggered boolean, similar array<string>"
_COLUMNS = ("scope", "seq", "event_id", "ts", "observed_at", "prompt_hash", "dup_scope", "observation", "features", "triggered")


def batch(events: DataFrame, seq: str, settings: Settings = Settings()) -> DataFrame:
    """One row per eligible event, judged in the order of ``seq`` within its scope."""
    rows = prepared(events, settings).where("suppressed is null").withColumn("seq", F.col(seq)).withColumn("event_id", F.col("event_id").cast("string"))
    rows = rows.select(*_COLUMNS).repartition("scope").sortWithinPartitions("scope", "seq")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scope, state = None, State()
        for frame in frames:
            out = []
            for event in frame.to_dict("records"):
                if event["scope"] != scope:
                    scope, state = event["scope"], State()
                event["observed_at"] = None if pd.isna(event["observed_at"]) else event["observed_at"]
                out.append({"event_id": event["event_id"], "scope": scope, **step(state, event, settings)})
            yield pd.DataFrame(out, columns=["event_id", "scope", "duplicate", "repeat_count", "similarity", "triggered", "similar"])

    return rows.mapInPandas(run, RESULT)


def _told(rows: DataFrame, settings: Settings) -> DataFrame:
    """Rows with ``first``, the event that each repeats (by its observation or its text), or null for those that count.

    Whether an event counts depends on those of its session before it only, so a session is one narrow stream."""
    kind = "scope string, dup_scope string, seq double, event_id string, first string"
    narrow = rows.select("scope", "dup_scope", "seq", "event_id", "now", "prompt_hash", "observation")
    keep = max(settings.window, settings.duplicate)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, seen, said = None, {}, {}
        for frame in frames:
            out = []
            for scope, dup_scope, seq, event_id, now, prompt_hash, observation in frame.itertuples(index=False):
                if (scope, dup_scope) != at:
                    at, seen, said = (scope, dup_scope), {}, {}
                first = None
                if observation in seen and seen[observation][0] >= now - keep:
                    first = seen[observation][1]
                elif prompt_hash in said and said[prompt_hash][0] >= now - settings.duplicate:
                    first = said[prompt_hash][1]
                else:
                    seen[observation] = said[prompt_hash] = (now, event_id)
                    if len(seen) > 2 * SEEN:
                        seen = {k: v for k, v in seen.items() if v[0] >= now - keep}
                        said = {k: v for k, v in said.items() if v[0] >= now - settings.duplicate}
                out.append((scope, dup_scope, seq, event_id, first))
            yield pd.DataFrame(out, columns=["scope", "dup_scope", "seq", "event_id", "first"])

    told = narrow.repartition("scope", "dup_scope").sortWithinPartitions("scope", "dup_scope", "seq", "event_id").mapInPandas(run, kind)
    return rows.join(told, ["scope", "dup_scope", "seq", "event_id"])


def joined(events: DataFrame, seq: str, settings: Settings = Settings()) -> DataFrame:
    """``batch`` as joins.  ``seq, event_id`` is the order and must be that of time (``observed_at``, or else ``ts``); event ids are unique.

    Events that count are numbered within their scope; an event meets those of its own block of ``MOST`` numbers and of
    the block before, at most ``MOST`` of which come within its reach: rows grow with the events, not with a
    scope's square, and a scope is as many join keys as it has blocks.  Events that repeat one of their session count as such
    within the duplicate window, however many entries of other sessions lie between."""
    rows = prepared(events, settings).where("suppressed is null").withColumn("seq", F.col(seq).cast("double")).withColumn("event_id", F.col("event_id").cast("string"))
    rows = rows.withColumn("now", F.coalesce("observed_at", "ts")).select("scope", "seq", "event_id", "ts", "now", "prompt_hash", "dup_scope", "observation", "features", "triggered")
    told = _told(rows, settings)
    counts = told.where("first is null").withColumns({"_one": F.lit(1), "_chunk": F.floor("seq")})
    counts = summed(counts, ["scope"], "_chunk", ["seq", "event_id"], "_one", "nth").drop("_one", "_chunk").withColumn("_block", F.floor(F.col("nth") / MOST))
    earlier = counts.select("scope", F.explode(F.array("_block", F.col("_block") + 1)).alias("_block"), F.col("nth").alias("_nth"), F.col("ts").alias("_ts"), F.col("event_id").alias("_id"), F.col("features").alias("_features"))
    share = text.jaccard(F.col("features"), F.col("_features"))
    near = (F.col("_nth") < F.col("nth")) & (F.col("_nth") >= F.col("nth") - MOST) & (F.col("_ts") >= F.col("now") - settings.window)
    sized = F.least(F.size("features"), F.size("_features")) >= settings.similarity * F.greatest(F.size("features"), F.size("_features"))
    met = counts.join(earlier, ["scope", "_block"]).where(near & sized).select("scope", "event_id", "_nth", "_id", share.alias("share")).where(F.col("share") >= settings.similarity)
    like = met.groupBy("scope", "event_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("s"), F.col("_nth").alias("n"), F.col("_id").alias("id")))).alias("like"))
    found = told.select("scope", "event_id", "first", "triggered").join(like, ["scope", "event_id"], "left")
    number = F.when(F.col("first").isNull(), F.coalesce(F.array_size("like"), F.lit(0))).otherwise(0)
    return found.select(
        "event_id", "scope", F.col("first").isNotNull().alias("duplicate"), (1 + number).cast("int").alias("repeat_count"), F.coalesce(F.round(-F.col("like")[0]["s"], 4), F.lit(0.0)).alias("similarity"),
        (F.col("first").isNull() & (1 + number >= settings.repeats) & ~F.coalesce("triggered", F.lit(False))).alias("triggered"), F.coalesce(F.transform(F.slice("like", 1, 5), lambda x: x["id"]), F.array().cast("array<string>")).alias("similar"))
