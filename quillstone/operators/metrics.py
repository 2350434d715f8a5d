"""Classifier metrics: confusion counts, threshold sweeps, exact AUC and average precision, rules.

A sweep doesn't multiply rows by thresholds.  Every score falls between two thresholds, so rows are
counted by that place and label (at most one row per threshold and label leaves a task), and the
counts above a threshold are sums over this small table.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.scalars import ratio
from quillstone.operators.store import durable


def confusion(rows: DataFrame, predicted: Column, label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Counts and rates; a null prediction counts as invalid and as false."""
    p, y = F.coalesce(predicted, F.lit(False)), F.col(label)
    tp, fp, fn, tn = F.count_if(p & y), F.count_if(p & ~y), F.count_if(~p & y), F.count_if(~p & ~y)
    return rows.groupBy(*(by or [])).agg(
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tp + fp, F.count("*")).alias("wake_rate"),
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), F.count_if(predicted.isNull()).alias("invalid"),
    )


def sweep(rows: DataFrame, score: str, thresholds: list[float], label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Counts and rates at every threshold (ascending), per group."""
    by = by or []
    grid = F.array(*map(F.lit, thresholds))
    place = F.aggregate(grid, F.lit(0), lambda n, t: n + F.when(F.col(score) >= t, 1).otherwise(0))
    counts = rows.groupBy(*by, place.alias("_place")).agg(F.count_if(label).alias("_pos"), F.count_if(~F.col(label)).alias("_neg"))
    totals = counts.groupBy(*by).agg(F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"), F.collect_list(F.struct("_place", "_pos", "_neg")).alias("_c"))
    at = totals.select(*by, "_p", "_n", "_c", F.posexplode(grid).alias("_i", "threshold"))
    above = F.filter("_c", lambda c: c["_place"] > F.col("_i"))
    tp = F.aggregate(above, F.lit(0).cast("long"), lambda s, c: s + c["_pos"])
    fp = F.aggregate(above, F.lit(0).cast("long"), lambda s, c: s + c["_neg"])
    at = at.withColumns({"tp": tp, "fp": fp}).withColumns({"fn": F.col("_p") - F.col("tp"), "tn": F.col("_n") - F.col("fp")})
    return at.select(
        *by, "threshold", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("_p")).alias("recall"),
        ratio(F.col("tp") + F.col("fp"), F.col("_p") + F.col("_n")).alias("wake_rate"), "tp", "fp", "fn", "tn",
    )


def best_at_precision(rows: DataFrame, floor: float, by: list[str] | None = None) -> DataFrame:
    """The sweep row with most recall at the precision floor; if none reaches it, most precision."""
    good = (F.col("precision") >= floor) & (F.col("tp") > 0)
    zero = F.lit(0.0)
    rank = F.struct(
        good.cast("int"), F.when(good, F.col("recall")).otherwise(F.col("precision")), F.when(good, F.col("precision")).otherwise(F.col("recall")),
        F.when(good, -F.col("wake_rate")).otherwise(zero), -F.col("threshold"),
    )
    return rows.groupBy(*(by or [])).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (by or [])]), rank).alias("r")).select(*(by or []), "r.*")


def running(rows: DataFrame, value: str, sums: dict[str, str], descending: bool = False, ranges: int = 256) -> DataFrame:
    """``sums``: new column to the column that it totals up to and with each row, in the order of ``value``.

    Rows are dealt to about ``ranges`` ranges of the value (by approximate quantiles, one job); the ranges'
    totals are at most one row a range, so they are broadcast as offsets of the windows inside ranges."""
    cuts = sorted(set(rows.stat.approxQuantile(value, [i / ranges for i in range(1, ranges)], 0.001)))
    grid = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
    placed = rows.withColumn("_range", F.aggregate(grid, F.lit(0), lambda n, c: n + F.when(F.col(value) >= c, 1).otherwise(0)))
    order = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    totals = placed.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums.values()])
    before = Window.orderBy(order("_range")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums.values()])
    inside = Window.partitionBy("_range").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(F.broadcast(offsets), "_range")
    return joined.withColumns({name: F.col(f"_o_{c}") + F.sum(c).over(inside) for name, c in sums.items()}).drop("_range", *[f"_o_{c}" for c in sums.values()])


def ranking(rows: DataFrame, score: str, label: str = "label") -> DataFrame:
    """Exact ROC AUC and average precision; null unless both classes are there.

    Equal scores are merged first, once; running counts are made by ranges of scores."""
    ties = durable(rows.groupBy(score).agg(F.count_if(label).alias("p"), F.count_if(~F.col(label)).alias("n")))
    run = running(ties, score, {"tp": "p", "fp": "n"}, descending=True)
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2))
    precision = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    both = (F.sum("p") > 0) & (F.sum("n") > 0)
    return run.agg(F.when(both, F.try_divide(area, F.sum("p") * F.sum("n"))).alias("auc"), F.when(both, F.try_divide(precision, F.sum("p"))).alias("average_precision"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))


def _counted(rows: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """Distinct values with their count ``c`` and running count ``upto``, and the total ``n``."""
    counts = durable(rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("c")))
    return running(counts, "value", {"upto": "c"}), counts.agg(F.sum("c").alias("n"))


def _holds(place: str) -> Column:
    return (F.col(place) < F.col("upto")) & (F.col(place) >= F.col("upto") - F.col("c"))


def nearest_rank(rows: DataFrame, value: str, quantiles: list[float]) -> DataFrame:
    """``q, value``: the element at floor(q (n - 1)) of the sorted values."""
    run, total = _counted(rows, value)
    wanted = total.select(F.explode(F.array(*map(F.lit, quantiles))).alias("q"), "n").withColumn("at", F.floor(F.col("q") * (F.col("n") - 1)))
    return run.join(F.broadcast(wanted), _holds("at")).select("q", "value")  # one row per quantile


def interpolated(rows: DataFrame, value: str, quantiles: list[float]) -> DataFrame:
    """``i, value``: between the elements around q (n - 1), by the distance to them; null without rows."""
    run, total = _counted(rows, value)
    wanted = total.select(F.posexplode(F.array(*map(F.lit, quantiles))).alias("i", "q"), (F.col("n") - 1).alias("last"))
    wanted = wanted.withColumn("at", F.col("q") * F.col("last")).withColumns({"low": F.floor("at"), "high": F.ceil("at")})
    near = run.join(F.broadcast(wanted), _holds("low") | _holds("high"), "right")
    ends = near.groupBy("i", "at", "low").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    return ends.select("i", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.col("low"))).alias("value"))


def wakes_at(rows: DataFrame, score: str, thresholds: list[float]) -> DataFrame:
    """``threshold, wakes, rate``."""
    t = rows.agg(F.count("*").alias("n"), *[F.count_if(F.col(score) >= x).alias(f"t{i}") for i, x in enumerate(thresholds)])
    return t.select(F.explode(F.array(*[F.struct(F.lit(x).alias("threshold"), F.col(f"t{i}").alias("wakes"), ratio(F.col(f"t{i}"), F.col("n")).alias("rate")) for i, x in enumerate(thresholds)])).alias("r")).select("r.*")


def rules(models: list[str], thresholds: list[float]) -> dict[str, Column]:
    """All rules over one or two models: single, mean, max, min at a threshold, and, or at two."""
    out = {f"single({m};{t:.3f})": F.col(m) >= t for m in models for t in thresholds}
    for a, b in itertools.combinations(models, 2):
        for t in thresholds:
            out[f"mean({a},{b};{t:.3f})"] = (F.col(a) + F.col(b)) / 2 >= t
            out[f"max({a},{b};{t:.3f})"] = F.greatest(a, b) >= t
            out[f"min({a},{b};{t:.3f})"] = F.least(a, b) >= t
        for s, t in itertools.product(thresholds, repeat=2):
            out[f"and({a},{b};{s:.3f},{t:.3f})"] = (F.col(a) >= s) & (F.col(b) >= t)
            out[f"or({a},{b};{s:.3f},{t:.3f})"] = (F.col(a) >= s) | (F.col(b) >= t)
    return out


def evaluated(rows: DataFrame, candidates: dict[str, Column], label: str = "label", by: list[str] | None = None) -> DataFrame:
    """``rule`` and its counts and rates, all in one pass over the rows: every rule is two counters."""
    by = by or []
    y = F.col(label)
    counters = [c for i, rule in enumerate(candidates.values()) for c in (F.count_if(rule & y).alias(f"tp{i}"), F.count_if(rule & ~y).alias(f"fp{i}"))]
    one = rows.groupBy(*by).agg(F.count_if(y).alias("_p"), F.count_if(~y).alias("_n"), *counters)
    each = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, name in enumerate(candidates)])
    r = one.select(*by, "_p", "_n", F.explode(each).alias("r")).select(*by, "_p", "_n", "r.*")
    return r.select(
        *by, "rule", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("_p")).alias("recall"),
        ratio(F.col("tp") + F.col("fp"), F.col("_p") + F.col("_n")).alias("wake_rate"), "tp", "fp", (F.col("_p") - F.col("tp")).alias("fn"), (F.col("_n") - F.col("fp")).alias("tn"),
    )


def ranked(results: DataFrame, floor: float, name: str = "rule") -> list[Column]:
    """Order of results: those at the precision floor by recall, the others by precision."""
    good = F.col("precision") >= floor
    return [F.desc(good), F.desc(F.when(good, F.col("recall")).otherwise(F.col("precision"))), F.desc(F.when(good, F.col("precision")).otherwise(F.col("recall"))), F.asc("wake_rate"), F.asc(name)]


def leave_one_group_out(rows: DataFrame, candidates: dict[str, Column], group: str, floor: float, label: str = "label") -> DataFrame:
    """For each group the rule that is best on the others, with its counts on the group.

    Counts are additive, so the others' are the total minus the group's: one pass over the rows."""
    own = evaluated(rows, candidates, label, [group]).select(group, "rule", "tp", "fp", "fn", "tn")
    w = Window.partitionBy("rule")  # a row per group each
    rest = own.withColumns({f"o_{c}": F.sum(c).over(w) - F.col(c) for c in ("tp", "fp", "fn", "tn")})
    rest = rest.withColumns({
        "precision": ratio(F.col("o_tp"), F.col("o_tp") + F.col("o_fp")), "recall": ratio(F.col("o_tp"), F.col("o_tp") + F.col("o_fn")),
        "wake_rate": ratio(F.col("o_tp") + F.col("o_fp"), F.col("o_tp") + F.col("o_fp") + F.col("o_fn") + F.col("o_tn")),
    })
    best = F.row_number().over(Window.partitionBy(group).orderBy(*ranked(rest, floor)))
    return rest.withColumn("_r", best).where("_r = 1").select(group, "rule", "tp", "fp", "fn", "tn")
