"""Numbers, times, modes and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wake thresholds of the sensitivities, and the words for yes and no.
SENSITIVITY = {"sensitive": 0.40, "quiet": 0.80}
YES, NO = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clamp(x: Column, low: float = 0.01, high: float = 0.99) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def wake_threshold(mode: Column, model: Column, custom: Column) -> Column:
    out = F.when(mode == "custom", clamp(F.coalesce(custom, model)))
    for name, value in SENSITIVITY.items():
        out = out.when(mode == name, F.lit(value))
    return out.otherwise(model)


def timestamp(text: Column) -> Column:
    """ISO-8601 text as a timestamp, null if it is none; without an offset it is UTC."""
    return F.try_to_timestamp(text)


def timestamp_or(text: Column, now: Column) -> Column:
    """The time that a text states, or else the run's."""
    return F.coalesce(timestamp(text), now)


def iso(ts: Column) -> Column:
    """A timestamp as ISO-8601 text in UTC to the second, with its offset (the session's zone must be UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def minutes_since(ts: Column, now: Column) -> Column:
    """Minutes from a time to now; null without it."""
    return (now.cast("timestamp").cast("double") - ts.cast("timestamp").cast("double")) / 60


def age(minutes: Column) -> Column:
    """An age in words: minutes up to two hours, hours up to two days, days beyond; ``never`` for a null."""
    whole = F.floor(minutes)
    return F.when(minutes.isNull(), "never").when(minutes < 120, F.concat(whole.cast("string"), F.lit("m ago"))).when(minutes < 2880, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d ago")))


def finite(text: Column) -> Column:
    """A finite double, else null."""
    x = text.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def boolean(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin(*YES), True).when(t.isin(*NO), False)


def teacher_probability(probability: Column, confidence: Column, label: Column) -> Column:
    """The stated probability, else the confidence turned by the label; within [0.01, 0.99]."""
    return clamp(F.coalesce(probability, F.when(label, confidence).otherwise(1 - confidence)))


def bucket5(score: Column) -> Column:
    """One of five equal bins of [0, 1]; the last holds 1."""
    return F.least(F.greatest(F.floor(score * 5), F.lit(0)), F.lit(4)).cast("int")


def time_bucket(ts: Column, seconds: int = 120) -> Column:
    return F.floor(F.unix_timestamp(ts.cast("timestamp")) / seconds)


def score_features(scores: Column) -> Column:
    """The scores and their least, largest, mean and spread."""
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    return F.concat(scores, F.array(F.array_min(scores), F.array_max(scores), mean, F.array_max(scores) - F.array_min(scores)))
