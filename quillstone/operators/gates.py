"""Gates over two scores: every pair of thresholds at once.

Rows are counted by the places of both scores in their grids (one aggregation, which leaves at most a row a task
for each cell and group), and what an AND gate passes is the sum of the cells above its corner: a summed-area table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.scalars import ratio

COUNTS = ("tp", "fp", "fn", "tn")


def _place(score: str, thresholds: list[float]) -> Column:
    """How many of the ascending thresholds a score reaches; none for a null."""
    return F.aggregate(F.array(*map(F.lit, thresholds)), F.lit(0), lambda n, t: n + F.when(F.col(score) >= t, 1).otherwise(0))


def _rates(rows: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rows.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "wake_rate": ratio(tp + fp, tp + fp + fn + F.col("tn"))})


def counts(rows: DataFrame, a: str, b: str, a_thresholds: list[float], b_thresholds: list[float], label: str = "label", by: list[str] | None = None) -> DataFrame:
    """``by, a_threshold, b_threshold, tp, fp, fn, tn`` of the gate ``a >= a_threshold and b >= b_threshold``, for all pairs.

    Thresholds ascend; null scores pass no gate, null labels count as negative."""
    by = by or []
    y = F.coalesce(F.col(label), F.lit(False))
    cells = rows.groupBy(*by, _place(a, a_thresholds).alias("_i"), _place(b, b_thresholds).alias("_j")).agg(F.count_if(y).alias("_pos"), F.count_if(~y).alias("_neg"))
    totals = cells.groupBy(*by).agg(F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n")).where("_p is not null")  # no rows, no pairs
    grid = totals.select(*by, "_p", "_n", F.posexplode(F.array(*map(F.lit, a_thresholds))).alias("_i", "a_threshold"))
    grid = grid.select("*", F.posexplode(F.array(*map(F.lit, b_thresholds))).alias("_j", "b_threshold")).withColumns({"_i": F.col("_i") + 1, "_j": F.col("_j") + 1})
    full = grid.join(cells, [*by, "_i", "_j"], "left").fillna(0, ["_pos", "_neg"])
    along = Window.partitionBy(*by, "_j").orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*by, "_i").orderBy(F.desc("_j")).rowsBetween(Window.unboundedPreceding, 0)
    area = full.withColumns({c: F.sum(c).over(along) for c in ("_pos", "_neg")}).withColumns({"tp": F.sum("_pos").over(across), "fp": F.sum("_neg").over(across)})
    return area.select(*by, "a_threshold", "b_threshold", "tp", "fp", (F.col("_p") - F.col("tp")).alias("fn"), (F.col("_n") - F.col("fp")).alias("tn"))


def grid(rows: DataFrame, a: str, b: str, a_thresholds: list[float], b_thresholds: list[float], label: str = "label", by: list[str] | None = None) -> DataFrame:
    """``counts`` with precision, recall and wake rate."""
    return _rates(counts(rows, a, b, a_thresholds, b_thresholds, label, by))


def best(pairs: DataFrame, floor: float, by: list[str] | None = None) -> DataFrame:
    """The pair with most recall at the precision floor, if it finds anything; else the one with most precision.  Ties go to
    the smaller thresholds."""
    by = by or []
    good = (F.col("precision") >= floor) & (F.col("tp") > 0)
    rank = F.struct(
        good.cast("int"), F.when(good, F.col("recall")).otherwise(F.col("precision")), F.when(good, F.col("precision")).otherwise(F.col("recall")),
        -F.col("wake_rate"), -F.col("a_threshold"), -F.col("b_threshold"))
    return pairs.groupBy(*by).agg(F.max_by(F.struct(*[c for c in pairs.columns if c not in by]), rank).alias("r")).where("r is not null").select(*by, "r.*")


def leave_one_group_out(rows: DataFrame, a: str, b: str, thresholds: list[float], group: str, floor: float, label: str = "label") -> DataFrame:
    """For each group the pair that is best on all others, with its counts and rates on the group.

    Counts add up, so the others' are the total minus the group's: the rows are read once."""
    own = counts(rows, a, b, thresholds, thresholds, label, [group])
    pair = Window.partitionBy("a_threshold", "b_threshold")  # a row for each group
    rest = own.select(group, "a_threshold", "b_threshold", *[F.col(c).alias(f"_{c}") for c in COUNTS], *[(F.sum(c).over(pair) - F.col(c)).alias(c) for c in COUNTS])
    chosen = best(_rates(rest), floor, [group])
    return _rates(chosen.select(group, "a_threshold", "b_threshold", *[F.col(f"_{c}").alias(c) for c in COUNTS]))


def fold_gate(scores: DataFrame, a: str, b: str, thresholds: list[float], fold: str, train: str, floor: float, label: str = "label") -> DataFrame:
    """Gates of models fitted fold by fold: ``scores`` holds each fold's rows, scored by its own models, with ``train`` true
    for those that they were fitted on.  The pair is chosen there and counted on the others."""
    chosen = best(grid(scores.where(F.col(train)), a, b, thresholds, thresholds, label, [fold]), floor, [fold]).select(fold, "a_threshold", "b_threshold")
    tested = scores.where(~F.col(train)).join(F.broadcast(chosen), fold)  # a row a fold
    y, p = F.coalesce(F.col(label), F.lit(False)), F.coalesce((F.col(a) >= F.col("a_threshold")) & (F.col(b) >= F.col("b_threshold")), F.lit(False))
    found = tested.groupBy(fold, "a_threshold", "b_threshold").agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    return _rates(found)
