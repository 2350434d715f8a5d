"""Column expressions over records: label normalisation, source and path names, states, views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of transcript sources by kind, plain and for a backfill.
SOURCE_NAMES = {"claude": ("claude_transcript_scan", "claude_transcript_backfill"), "codex": ("codex_transcript_scan", "codex_transcript_backfill")}


def bounded_probability(value: Column, fallback: Column) -> Column:
    """A number within [0, 1]; the fallback for what is no number."""
    number = value.try_cast("double")
    return F.least(F.greatest(F.when(number.isNull() | F.isnan(number), fallback).otherwise(number), F.lit(0.0)), F.lit(1.0))


def normalised_label(should_wake: Column, probability: Column, confidence: Column) -> Column:
    """``should_wake, wake_probability, confidence`` of an answer that may lack any of them.

    Without a decision the probability decides, without a probability the decision gives one."""
    stated = bounded_probability(probability, F.lit(0.5))
    fallback = F.when(should_wake.isNull(), stated).otherwise(F.when(should_wake, 0.85).otherwise(0.15))
    p = bounded_probability(probability, fallback)
    return F.struct(
        F.coalesce(should_wake, stated >= 0.5).alias("should_wake"), p.alias("wake_probability"),
        bounded_probability(confidence, F.greatest(p, 1 - p)).alias("confidence"),
    )


def resolved_text(prompt: Column, transcript: Column, snippet: Column, allow_snippet: bool = True) -> Column:
    """``text, provenance``: the first of prompt, transcript and snippet that isn't blank."""
    def filled(c: Column) -> Column:
        return F.length(F.trim(F.coalesce(c, F.lit("")))) > 0

    last = filled(snippet) & F.lit(allow_snippet)
    return F.struct(
        F.when(filled(prompt), prompt).when(filled(transcript), transcript).when(last, snippet).otherwise("").alias("text"),
        F.when(filled(prompt), "prompt").when(filled(transcript), "transcript").when(last, "snippet").otherwise("missing").alias("provenance"),
    )


def source_name(kind: Column, backfill: Column) -> Column:
    """The source's name; a kind that isn't known counts as the second."""
    def name(pair: tuple[str, str]) -> Column:
        return F.when(backfill, pair[1]).otherwise(pair[0])

    return F.when(kind == "claude", name(SOURCE_NAMES["claude"])).otherwise(name(SOURCE_NAMES["codex"]))


def scorer_source(source: Column, path: Column) -> Column:
    """The kind that a scorer knows an event's source by; a hook's is told from its transcript's path."""
    by_path = F.when(F.contains(F.lower(F.coalesce(path, F.lit(""))), F.lit("codex")), "codex").otherwise("claude")
    return F.when(source == SOURCE_NAMES["codex"][0], "codex").when(source == "hook", by_path).when(F.coalesce(source, F.lit("")) == "", "unknown").otherwise(source)


def settled_status(status: Column, pid: Column, alive: Column, exit_code: Column) -> Column:
    """``status, reported_status, exit_code, stale_exit_code`` of an invocation.

    What still says it runs is completed or failed by its exit code, stale if its process is gone;
    an exit code beside a living process is a stale one."""
    has_pid = F.coalesce(pid, F.lit(0)) != 0
    open_ = F.coalesce(status, F.lit("")).isin("starting", "running")
    living = open_ & has_pid & F.coalesce(alive, F.lit(False))
    ended = open_ & ~living & (exit_code.isNotNull() | has_pid)
    settled = F.when(exit_code == 0, "completed").when(exit_code.isNotNull(), "failed").otherwise("stale")
    return F.struct(
        F.when(ended, settled).otherwise(status).alias("status"), F.when(ended, status).alias("reported_status"),
        F.when(~living, exit_code).alias("exit_code"), F.when(living, exit_code).alias("stale_exit_code"),
    )


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def parent(path: Column) -> Column:
    """The folder of an absolute path; the root's is the root."""
    up = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(up == "", "/").otherwise(up)


def contains_parts(path: Column, parts: list[str]) -> Column:
    """Whether the parts follow each other somewhere in a path."""
    return F.contains(F.concat(F.lit("/"), F.array_join(path_parts(path), "/"), F.lit("/")), F.lit("/" + "/".join(parts) + "/"))


def surface_kind(path: Column) -> Column:
    is_skill = (F.element_at(path_parts(path), -1) == "SKILL.md") | contains_parts(path, ["skills"])
    return F.when(is_skill, "skill").when(contains_parts(path, [".claude", "rules"]), "agent_rule").otherwise("agent_file")


def display_path(path: Column, home: str) -> Column:
    """A path with the home folder as a tilde."""
    return F.when(path == home, "~").when(F.startswith(path, F.lit(home + "/")), F.concat(F.lit("~"), F.substring(path, F.lit(len(home) + 1), F.length(path)))).otherwise(path)


def skip_reason(generation: Column, last_generation: Column, turns: Column, minutes: Column, changed: Column, min_turns: int, min_minutes: int) -> Column:
    """Why a run is skipped, empty if it isn't: the gates in the order of their checks."""
    seen = (F.coalesce(generation, F.lit("")) != "") & F.equal_null(generation, last_generation)
    return (
        F.when(seen, "generation already processed").when(turns < min_turns, f"cadence needs {min_turns} completed turns")
        .when(minutes < min_minutes, f"cadence needs {min_minutes} minutes since last run")
        .when(~F.coalesce(changed, F.lit(False)), "no changed transcripts").otherwise("")
    )


def cooldown_wait(last_run: Column, now: Column, seconds: int = 60) -> Column:
    """Seconds until a run is allowed again; 0 without an earlier one."""
    return F.greatest(F.coalesce(seconds - (F.unix_timestamp(now) - F.unix_timestamp(last_run)), F.lit(0)), F.lit(0))


def retry_delay(wait: Column, outstanding: Column, now: Column, most: int = 60) -> Column:
    """Whole seconds to a scheduled retry, from 1 to ``most``; null if none is needed or one is outstanding."""
    clamped = F.least(F.greatest(F.floor(wait) + 1, F.lit(1)), F.lit(most))
    return F.when((wait > 0) & ~F.coalesce(outstanding > now, F.lit(False)), clamped)


def mentions(text: Column, markers: list[str]) -> Column:
    """Whether any marker occurs."""
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(F.coalesce(text, F.lit("")), m))


def in_categories(categories: Column, names: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(categories, F.array(*map(F.lit, names))), F.lit(False))


def short_unquoted(text: Column, quote: str, most: int = 4000) -> Column:
    """At most so many characters, and no quotation by its pattern."""
    return (F.length(text) <= most) & ~text.rlike(quote)


def bar(value: Column, largest: Column, width: int = 20) -> Column:
    """A bar of text in proportion to the largest value; any positive value shows."""
    n = F.when(value <= 0, 0).otherwise(F.greatest(F.lit(1), F.round(value * width / largest))).cast("int")
    return F.repeat(F.lit("#"), n)


def embedding_text(text: Column, most: int, source: Column | None = None) -> Column:
    """A text's beginning, after its source's name if that is wanted."""
    cut = F.substring(F.coalesce(text, F.lit("")), 1, most)
    return cut if source is None else F.concat(F.lit("source: "), F.coalesce(source, F.lit("unknown")), F.lit("\n"), cut)


def prompt_view(fields: list[str]) -> Column:
    """The visible fields of an event as one JSON line; nulls are left out."""
    return F.to_json(F.struct(*fields))
