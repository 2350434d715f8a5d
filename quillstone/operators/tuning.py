"""Grid search: many logistic models in the same passes over the rows.

Every setting (penalty, class weight, number of features) crossed with every held-out group is one problem.  Features are
made once.  A pass evaluates loss and gradient of all problems at their current points: a task adds up its rows' shares,
what leaves it is one vector a problem, and a second stage adds these up by problem.  The driver moves the points
(limited-memory BFGS with backtracking); it holds some vectors of as many numbers as there are features for
each of ``at_once`` problems, and no rows.
"""

from __future__ import annotations

import fnmatch
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.operators import labels as label_ops
from quillstone.operators import metrics, sparse

SUMS = pa.schema([("problem", pa.int32()), ("loss", pa.float64()), ("gradient", pa.binary())])
_SUMS = "problem int, loss double, gradient binary"
CELLS = 4_000_000  # of a product of a batch's values with the problems' weights


@dataclass(frozen=True)
class Setting:
    """``strength``: inverse penalty; ``balanced``: classes weigh the same; ``size``: the most frequent features of each section (None: all)."""

    strength: float = 1.0
    balanced: bool = False
    size: int | None = None

    @property
    def name(self) -> str:
        return f"c={self.strength:g},{'balanced' if self.balanced else 'none'},{'all' if self.size is None else self.size}"


def settings(strengths: list[float], balanced: tuple[bool, ...] = (False, True), sizes: tuple[int | None, ...] = (None,)) -> list[Setting]:
    return [Setting(c, w, s) for s, c, w in itertools.product(sizes, strengths, balanced)]


@dataclass
class Features:
    """``rows`` with ``at, value`` (places and logarithmic counts), the idf of every place, and where each section begins."""

    rows: DataFrame
    idf: np.ndarray
    begins: list[int]


def features(rows: DataFrame, sections: list[str] | dict[str, sparse.Cut], most: int = 40_000, least: float = 2) -> Features:
    """N-grams of the array columns ``sections`` (with the way to cut each of them, if they hold words): each section's most frequent
    first, so a smaller model's features are the first ones.  Places are ints, and vocabularies have at most ``most`` terms."""
    cuts = sections if isinstance(sections, dict) else dict.fromkeys(sections, sparse.given)
    known = sparse.vocabulary(rows, cuts, most, least)

    def finish(n: int, row: np.ndarray, at: np.ndarray, count: np.ndarray) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(sparse.offsets(n, row), v) for v in (pa.array(at.astype(np.int32)), pa.array(1 + np.log(count)))]

    fields = [T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.DoubleType()))]
    return Features(sparse.placed(rows, cuts, known, finish, fields), known.idf + 1, known.begins)


@dataclass
class Walk:
    """One problem's way to its minimum, told loss and gradient where it asks."""

    x: np.ndarray
    steps: list = field(default_factory=list)
    loss: float = np.inf
    gradient: np.ndarray | None = None
    way: np.ndarray | None = None
    length: float = 1.0
    done: bool = False
    memory: int = 6

    def point(self) -> np.ndarray:
        return self.x if self.way is None else self.x + self.length * self.way

    def tell(self, loss: float, gradient: np.ndarray, tolerance: float) -> None:
        if self.way is not None:
            if not loss <= self.loss + 1e-4 * self.length * float(self.gradient @ self.way):
                self.length /= 2
                self.done = self.length < 1e-10
                return
            step, change = self.length * self.way, gradient - self.gradient
            if float(step @ change) > 1e-12:
                self.steps = [*self.steps, (step, change)][-self.memory :]
            self.x = self.x + step
        self.done = self.loss - loss <= tolerance * max(1.0, abs(loss)) if np.isfinite(self.loss) else False
        self.loss, self.gradient = loss, gradient
        d, kept = -gradient, []
        for step, change in reversed(self.steps):
            a = float(step @ d) / float(step @ change)
            d = d - a * change
            kept.append(a)
        if self.steps:
            step, change = self.steps[-1]
            d = d * (float(step @ change) / float(change @ change))
        for (step, change), a in zip(self.steps, reversed(kept)):
            d = d + (a - float(change @ d) / float(step @ change)) * step
        self.way, self.length = d, 1.0 if self.steps else min(1.0, 1 / max(1e-12, float(np.linalg.norm(gradient))))


def _design(batch: pa.RecordBatch, idf: np.ndarray, begins: list[int], sizes: list[int | None]) -> dict:
    """Per number of features: rows, places and values (idf applied, each section of unit length) of a batch."""
    counts = batch.column("at").value_lengths().to_numpy()
    at = batch.column("at").flatten().to_numpy()
    value = batch.column("value").flatten().to_numpy() * idf[at]
    row = np.repeat(np.arange(len(counts)), counts)
    section = np.searchsorted(begins, at, "right") - 1 if len(begins) > 2 else np.zeros(len(at), np.int64)
    found = {}
    for size in set(sizes):
        r, a, v, s = row, at, value, section
        if size is not None:
            keep = at - np.asarray(begins)[section] < size
            r, a, v, s = row[keep], at[keep], value[keep], section[keep]
        norm = np.sqrt(np.bincount(r * len(begins) + s, v * v, len(counts) * len(begins)))
        found[size] = r, a, v / np.maximum(norm[r * len(begins) + s], 1e-300)
    return found


def _margins(design: tuple, n: int, weights: np.ndarray) -> np.ndarray:
    """Rows by problems; ``weights`` is problems by places, the intercept last."""
    r, a, v = design
    out = np.tile(weights[:, -1], (n, 1))
    part = max(1, CELLS // max(1, len(v)))
    for p in range(0, len(weights), part):
        for q in range(p, min(p + part, len(weights))):
            out[:, q] += np.bincount(r, v * weights[q, a], n)
    return out


def fit(found: Features, problems: list[tuple[Setting, int]], class_weights: dict[tuple[int, int], float], tolerance: float = 1e-7, passes: int = 150) -> np.ndarray:
    """Weights (problems by places, the intercept last) of the problems ``(setting, held)``: rows ``label, weight, held``
    (an array of booleans), those whose ``held`` is true at the problem's place left out.

    Minimises half the squared weights (without the intercept) plus ``strength`` times the sum of weighted losses."""
    d = len(found.idf) + 1
    walks = [Walk(np.zeros(d)) for _ in problems]
    spark = found.rows.sparkSession
    rows = found.rows.select("label", "weight", "held", "at", "value")
    sizes = [s.size for s, _ in problems]
    balance = np.array([[class_weights[h, y] if s.balanced else 1.0 for y in (0, 1)] for s, h in problems])
    held_at = [h for _, h in problems]
    for _ in range(passes):
        active = [k for k, w in enumerate(walks) if not w.done]
        if not active:
            break
        sent = spark.sparkContext.broadcast((active, np.stack([walks[k].point() for k in active])))

        def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            active, weights = sent.value
            loss, gradient = np.zeros(len(active)), np.zeros_like(weights)
            for batch in batches:
                n = len(batch)
                if not n:
                    continue
                y = batch.column("label").to_numpy()
                base = batch.column("weight").to_numpy()
                held = batch.column("held").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                designs = _design(batch, found_idf, begins, [sizes[k] for k in active])
                for size, design in designs.items():
                    own = [j for j, k in enumerate(active) if sizes[k] == size]
                    r, a, v = design
                    margins = _margins(design, n, weights[own])
                    for m, j in zip(margins.T, own):
                        k = active[j]
                        w = base * balance[k][y.astype(int)] * ~held[:, held_at[k]]
                        sign = 2 * y - 1
                        loss[j] += float(np.sum(w * np.logaddexp(0, -sign * m)))
                        pull = -w * sign / (1 + np.exp(np.minimum(sign * m, 700)))
                        gradient[j, :-1] += np.bincount(a, v * pull[r], d - 1)
                        gradient[j, -1] += pull.sum()
            yield pa.RecordBatch.from_arrays([pa.array(active, pa.int32()), pa.array(loss), pa.array([g.tobytes() for g in gradient], pa.binary())], schema=SUMS)

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for k, loss, raw in zip(*(c.to_pylist() for c in batch.columns)):
                    own = sums.setdefault(k, [0.0, np.zeros(d)])
                    own[0] += loss
                    own[1] += np.frombuffer(raw)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s[0] for s in sums.values()], pa.float64()), pa.array([s[1].tobytes() for s in sums.values()], pa.binary())], schema=SUMS)

        found_idf, begins = found.idf, found.begins
        shares = rows.mapInArrow(share, _SUMS).repartition(len(active), "problem").mapInArrow(total, _SUMS)
        for k, loss, raw in zip(*(c.to_pylist() for c in shares.toArrow().columns)):
            setting = problems[k][0]
            x = walks[k].point().copy()
            x[-1] = 0
            walks[k].tell(setting.strength * loss + 0.5 * float(x @ x), setting.strength * np.frombuffer(raw) + x, tolerance)
        sent.unpersist()
    return np.stack([w.x for w in walks])


def scored(found: Features, problems: list[tuple[Setting, int]], weights: np.ndarray, only_held: bool = True) -> DataFrame:
    """``id, setting, held_group, score`` of every row and problem, by default where the row is held out."""
    sent = found.rows.sparkSession.sparkContext.broadcast(weights)
    sizes, idf, begins = [s.size for s, _ in problems], found.idf, found.begins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            held = batch.column("held").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            for size, design in _design(batch, idf, begins, sizes).items():
                own = [k for k, s in enumerate(sizes) if s == size]
                for m, k in zip(_margins(design, n, sent.value[own]).T, own):
                    use = np.flatnonzero(held[:, problems[k][1]]) if only_held else np.arange(n)
                    if len(use):
                        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(use)), pa.array([problems[k][0].name] * len(use)), pa.array([problems[k][1]] * len(use), pa.int32()), pa.array(1 / (1 + np.exp(-np.clip(m[use], -700, 700))))], ["id", "setting", "held_group", "score"])

    kind = found.rows.schema["id"].dataType.simpleString()
    return found.rows.select("id", "held", "at", "value").mapInArrow(run, f"id {kind}, setting string, held_group int, score double")


def search(docs: DataFrame, votes: DataFrame, sections: list[str] | dict[str, sparse.Cut], choices: list[Setting], thresholds: list[float], floor: float, holdouts: dict[str, list[str]] | None = None, most: int = 40_000, least: float = 2, at_once: int = 24, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The settings ranked by what held-out groups show, and the held-out scores ``id, setting, held_group, score, label``.

    ``docs``: ``id`` and the n-gram columns.  ``votes``: ``record_id, label_file, should_wake``; training takes a record's
    majority, evaluation each file's own labels.  ``holdouts``: names to glob patterns of label files; without them every
    label file is held out in turn (one problem for each setting and file: their number is bounded by the caller).  Records of a held-out
    file are in no training set of its problem, whatever other files say of them.  ``extra``: further training rows
    ``id, label, weight`` of other sources, used where the record isn't held out."""
    if holdouts is None:
        holdouts = {r[0]: [r[0].replace("[", "[[]").replace("*", "[*]").replace("?", "[?]")] for r in votes.select("label_file").distinct().orderBy("label_file").collect()}
    patterns = [[fnmatch.translate(p) for p in some] for some in holdouts.values()]

    def matches(name: Column, some: list[str]) -> Column:
        out = F.lit(False)
        for p in some:
            out = out | name.rlike("^" + p)
        return out

    files = votes.groupBy(F.col("record_id").alias("id")).agg(F.collect_set("label_file").alias("_files"))
    gold = label_ops.majority(votes).select(F.col("record_id").alias("id"), F.col("label").cast("double").alias("label"), F.lit(1.0).alias("weight"))
    if extra is not None:
        gold = gold.unionByName(extra.join(gold.select("id"), "id", "left_anti").select("id", F.col("label").cast("double").alias("label"), "weight"))
    names = F.coalesce("_files", F.array().cast("array<string>"))
    held = F.array(*[F.exists(names, (lambda some: lambda name: matches(name, some))(some)) for some in patterns])
    rows = docs.join(gold, "id").join(files, "id", "left").withColumn("held", held).drop("_files")
    found = features(rows, sections, most, least)
    # a task of a pass sends a vector a problem: there are as many as keep the cluster busy, however large the input
    found.rows = found.rows.coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism).persist()
    try:
        by = found.rows.select("label", "weight", F.posexplode("held").alias("h", "out")).where("not out").groupBy("h", "label").agg(F.sum("weight").alias("w")).collect()  # two rows a group
        sums = {(r.h, int(r.label)): r.w for r in by}
        usable = [h for h in range(len(patterns)) if (h, 0) in sums and (h, 1) in sums]
        balance = {(h, y): (sums[h, 0] + sums[h, 1]) / (2 * sums[h, y]) for h in usable for y in (0, 1)}
        problems = [(s, h) for s in choices for h in usable]
        scores = None
        for a in range(0, len(problems), at_once):
            part = problems[a : a + at_once]
            out = scored(found, part, fit(found, part, balance))
            scores = out if scores is None else scores.unionByName(out)
        names = F.array(*map(F.lit, holdouts))
        told = votes.select(F.col("record_id").alias("id"), F.col("should_wake").alias("label"), F.posexplode(F.array(*[matches(F.col("label_file"), some) for some in patterns])).alias("held_group", "_in")).where("_in").drop("_in")
        scores = scores.join(told, ["id", "held_group"]).withColumn("held_group", F.get(names, F.col("held_group"))).persist()
        scores.count()
    finally:
        found.rows.unpersist()
    best = metrics.best_at_precision(metrics.sweep(scores, "score", thresholds, by=["setting"]), floor, ["setting"])
    order = Window.orderBy(*metrics.ranked(best, floor, "setting"))  # a row for each setting
    return best.withColumn("rank", F.row_number().over(order)), scores
