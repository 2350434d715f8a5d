"""Quality scores by a sparse ensemble of rules (Friedman and Popescu's RuleFit).

Statistics of a text are Spark columns.  On the driver, shallow trees are grown on random halves of
a bounded sample of labelled rows; every path in them is a conjunction of bounds on statistics; a
lasso-penalised logistic regression keeps few of these rules.  The kept rules and weights are
compiled into one Spark expression, so scoring runs on the JVM in a single pass over the texts.

The sample holds at most ``train_rows`` labelled rows outside the held-out fold (those with the
least hash of the id); only their statistics reach the driver.

Cases: null, empty and wordless text has all statistics zero; a text of any length counts whole;
repeated rows score alike; a null id is not held out, and no label is learnt by it; without
labels of both kinds every score is the share of good labels (0.5 without labels); an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm import common

STATISTICS = tuple("_q_" + s for s in ("words", "distinct", "again", "word_length", "upper", "symbols", "bars", "shouts", "digits", "lines"))


def statistics(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` and a column for each of ``STATISTICS`` of a text column."""
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    rows = rows.withColumn("_q_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = rows.withColumns({"_q_w": F.filter(F.split("_q_text", r"[ \t\n\x0B\f\r]+"), lambda w: w != ""), "_q_n": F.length("_q_text")})
    w, n, chars = F.col("_q_w"), F.size("_q_w"), F.col("_q_n")
    pairs = F.zip_with(F.slice(w, 1, F.greatest(n - 1, F.lit(0))), F.slice(w, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a == b)
    dropped = lambda marks: chars - F.length(F.translate("_q_text", marks, ""))
    values = (
        F.log1p(n.cast("double")),
        share(F.size(F.array_distinct(w)), n),
        share(F.size(F.filter(pairs, lambda x: x)), n),
        share(chars, n),
        share(F.regexp_count("_q_text", F.lit(r"\p{Lu}")), chars),
        share(dropped("#$%&*@^~<>{}[]=+"), n),
        share(dropped("|"), n),
        share(dropped("!"), n),
        share(dropped("0123456789"), chars),
        share(dropped("\n"), n),
    )
    return rows.withColumns(dict(zip(STATISTICS, values, strict=True))).drop("_q_w", "_q_n", "_q_text")


@dataclass(frozen=True, order=True)
class Bound:
    """``statistic <= at``, or ``>`` if ``above``."""

    statistic: int
    above: bool
    at: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return (x[:, self.statistic] > self.at) == self.above

    def column(self) -> Column:
        c = F.col(STATISTICS[self.statistic])
        return c > self.at if self.above else c <= self.at


Rule = tuple[Bound, ...]


def _grow(x: np.ndarray, y: np.ndarray, rows: np.ndarray, path: Rule, depth: int, cuts: list[np.ndarray], rng: np.random.Generator, found: set[Rule]) -> None:
    """Adds the paths below a node; splits lessen the squared error most among random statistics."""
    if depth == 0 or len(rows) < 10 or y[rows].min() == y[rows].max():
        return
    best = None
    for f in rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False):
        for at in cuts[f]:
            left = x[rows, f] <= at
            n = int(left.sum())
            if 3 <= n <= len(rows) - 3:
                a, b = y[rows[left]], y[rows[~left]]
                gain = len(a) * a.mean() ** 2 + len(b) * b.mean() ** 2
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, int(f), float(at), left)
    if best is None:
        return
    _, f, at, left = best
    for above, part in ((False, rows[left]), (True, rows[~left])):
        rule = tuple(sorted({*path, Bound(f, above, at)}))
        found.add(rule)
        _grow(x, y, part, rule, depth - 1, cuts, rng, found)


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 1500) -> tuple[float, np.ndarray]:
    """Logistic regression with an absolute penalty, by accelerated proximal gradient steps."""
    n, k = z.shape
    size = np.linalg.norm(np.column_stack([np.ones(n), z]), 2) ** 2 / (4 * n)
    w = v = np.zeros(k + 1)
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(v[0] + z @ v[1:], -30, 30)))
        u = v - np.concatenate([[(p - y).mean()], z.T @ (p - y) / n]) / size
        u[1:] = np.sign(u[1:]) * np.maximum(0, np.abs(u[1:]) - penalty / size)
        t, s = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        w, v = u, u + (s - 1) / t * (u - w)
    return float(w[0]), w[1:]


@dataclass
class Ensemble:
    constant: float
    rules: list[tuple[Rule, float]]

    def column(self) -> Column:
        """The score over columns named by ``STATISTICS``."""
        x = F.lit(self.constant)
        for rule, weight in self.rules:
            holds = rule[0].column()
            for bound in rule[1:]:
                holds &= bound.column()
            x = x + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-x))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.constant)
        for rule, weight in self.rules:
            total = total + weight * np.logical_and.reduce([b.holds(x) for b in rule])
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 0.002, seed: int = 8) -> Ensemble:
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-9, 1 - 1e-9)) if len(y) else 0.5
        return Ensemble(math.log(share / (1 - share)), [])
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.concatenate([np.quantile(x[y == k, f], np.linspace(0, 1, 17)) for k in (0, 1)])) for f in range(x.shape[1])]
    found: set[Rule] = set()
    for _ in range(trees):
        part = rng.choice(len(y), max(1, len(y) // 2), replace=False)
        _grow(x, y.astype(float), part, (), depth, cuts, rng, found)
    rules = sorted(found)
    z = np.array([np.logical_and.reduce([b.holds(x) for b in r]) for r in rules], float).T.reshape(len(y), len(rules))
    fresh = np.unique(z, axis=1, return_index=True)[1]  # rules that hold for the same rows count once
    rules, z = [rules[i] for i in fresh], z[:, fresh]
    constant, weights = _lasso(z, y.astype(float), penalty)
    return Ensemble(constant, [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6])


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = 6000) -> Ensemble:
    sample = statistics(common.training_rows(docs, labels, "quality", train_rows)).select("doc_id", "y", *STATISTICS).orderBy("doc_id").collect()
    x = np.array([r[2:] for r in sample], float).reshape(-1, len(STATISTICS))
    return fit(x, np.array([r[1] for r in sample], int))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, train_rows: int = 6000) -> DataFrame:
    """``doc_id, held_out, score, predicted``."""
    found = statistics(common.texts(docs)).select("doc_id", learn(docs, labels, train_rows).column().alias("score"))
    return found.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_poor(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, train_rows: int = 6000) -> DataFrame:
    """The rows of ``docs`` at or above the threshold, with all their columns."""
    return statistics(common.whole(docs), "row.text").where(learn(docs, labels, train_rows).column() >= threshold).select("row.*")
