"""Training on MLlib: n-gram and embedding classifiers, folds, calibration, stacking, distillation.

Rows have ``id, label`` (0.0 or 1.0), optionally ``weight``, and ``text`` or ``features``.
"""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import text
from quillstone.operators import metrics, sparse
from quillstone.operators.store import durable


@dataclass
class TextModel:
    """The terms that count, and a classifier of the rows' vectors over them."""

    known: sparse.Vocabulary
    classifier: Model


SECTIONS = {"words": sparse.word_grams(1, 2), "chars": sparse.char_grams(3, 4)}


def with_words(rows: DataFrame, column: str = "text") -> DataFrame:
    """Both sections' words, in the place of the text."""
    return rows.withColumns({"words": text.word_tokens(F.col(column)), "chars": F.regexp_extract_all(F.lower(column), F.lit(r"(?U)\S+"), 0)}).drop(column)


def tfidf_vectors(rows: DataFrame, known: sparse.Vocabulary) -> DataFrame:
    """Rows of ``with_words`` with ``features``: counts by idf, each section of length one, joined to one vector."""
    idf, begins, size = known.idf, np.array(known.begins), max(1, len(known.df))

    def finish(n: int, row: np.ndarray, at: np.ndarray, count: np.ndarray) -> list[pa.Array]:
        value, part = count * idf[at], row * len(begins) + np.searchsorted(begins, at, "right")
        norm = np.sqrt(np.bincount(part, value * value, minlength=1))[part]
        value = np.divide(value, norm, out=np.zeros(len(value)), where=norm > 0)
        lists = [pa.ListArray.from_arrays(sparse.offsets(n, row), v) for v in (pa.array(at.astype(np.int32)), pa.array(value))]
        return [pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), *lists], ["type", "size", "indices", "values"])]

    return sparse.placed(rows, SECTIONS, known, finish, [T.StructField("features", VectorUDT())])


def logistic(strength: float, rows: int, weight: str | None = None) -> LogisticRegression:
    """``strength`` is the inverse penalty C of libraries that sum the loss."""
    lr = LogisticRegression(regParam=1 / (strength * max(1, rows)), standardization=False, maxIter=60)
    return lr.setWeightCol(weight) if weight else lr


def balanced(rows: DataFrame) -> DataFrame:
    """``weight`` n / (2 n_class)."""
    sizes = rows.groupBy("label").agg(F.count("*").alias("_c"))
    total = rows.count()
    return rows.join(F.broadcast(sizes), "label").withColumn("weight", total / (2 * F.col("_c"))).drop("_c")  # two rows


def fit_text(rows: DataFrame, strength: float = 4.0, size: int = 40_000, kind: str = "logistic", weight: str | None = None) -> TextModel:
    """A text is cut and counted twice, for the terms and for its vector; the vectors are written once and the classifier reads them."""
    words = with_words(rows)
    known = sparse.vocabulary(words, SECTIONS, size)
    vectors = durable(tfidf_vectors(words.select("label", *([weight] if weight else []), *SECTIONS), known))
    if kind == "bayes":
        last = NaiveBayes(modelType="complement", smoothing=0.4)
    elif kind == "svc":
        last = LinearSVC(regParam=1 / (strength * max(1, known.rows)), standardization=False)
    else:
        last = logistic(strength, known.rows, weight)
    return TextModel(known, last.fit(vectors))


def text_scores(model: TextModel, rows: DataFrame) -> DataFrame:
    """``id, label, score``; margins for machines without probabilities."""
    out = model.classifier.transform(tfidf_vectors(with_words(rows.select("id", "label", "text")), model.known))
    score = vector_to_array("probability")[1] if "probability" in out.columns else vector_to_array("rawPrediction")[1]
    return out.select("id", "label", score.alias("score"))


def calibrated(train_margins: DataFrame, margins: DataFrame) -> DataFrame:
    """Platt scaling: a logistic curve over margins from held-out folds."""
    as_vector = VectorAssembler(inputCols=["score"], outputCol="features")
    curve = LogisticRegression(regParam=1e-6).fit(as_vector.transform(train_margins))
    return curve.transform(as_vector.transform(margins)).select("id", "label", vector_to_array("probability")[1].alias("score"))


def fit_vectors(rows: DataFrame, strength: float = 1.0, scaled: bool = False, weight: str | None = None) -> PipelineModel:
    stages = [StandardScaler(inputCol="features", outputCol="scaled", withMean=True)] if scaled else []
    lr = logistic(strength, rows.count(), weight).setFeaturesCol("scaled" if scaled else "features")
    return Pipeline(stages=[*stages, lr]).fit(rows)


def vectors(embeddings: DataFrame, id_col: str, label: Column) -> DataFrame:
    """Normalised embeddings as ML vectors."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    unit = F.transform("embedding", lambda x: x / F.greatest(norm, F.lit(1e-12)))
    return embeddings.select(F.col(id_col).alias("id"), label.cast("double").alias("label"), array_to_vector(unit).alias("features"))


def vector_scores(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select("id", "label", vector_to_array("probability")[1].alias("score"))


def out_of_fold(rows: DataFrame, fit, score, folds: int = 3) -> DataFrame:
    """Scores of every row by a model that has not seen it; the loop is over folds.  ``rows`` has
    ``fold``."""
    out = None
    for k in range(folds):
        part = score(fit(rows.where(F.col("fold") != k)), rows.where(F.col("fold") == k))
        out = part if out is None else out.unionByName(part)
    return out


def leave_groups_out(rows: DataFrame, groups: list[str], fit, score, group: str = "label_file") -> DataFrame:
    """Scores of each group by a model of the others, without the group's records."""
    out = None
    for g in groups:
        test = rows.where(F.col(group) == g)
        train = rows.where(F.col(group) != g).join(test.select("id").distinct(), "id", "left_anti")
        part = score(fit(train), test).withColumn(group, F.lit(g))
        out = part if out is None else out.unionByName(part)
    return out


def glob_holdout(rows: DataFrame, patterns: list[str], group: str = "label_file") -> tuple[DataFrame, DataFrame]:
    """Training and test rows: the groups that match a pattern are held out, and with them their records in all other groups."""
    held = F.lit(False)
    for p in patterns:
        held = held | F.col(group).rlike("^" + fnmatch.translate(p))
    test = rows.where(held)
    return rows.where(~held).join(test.select("id").distinct(), "id", "left_anti"), test


def stacked_out_of_fold(rows: DataFrame, base: dict[str, tuple], folds: int = 3) -> tuple[PipelineModel, DataFrame]:
    """A stack whose base scores come from models that have not seen the rows: ``base`` maps a name to ``(fit, score)``; rows have
    ``fold``.  Returns the stack and the scores it was fitted on."""
    scores = None
    for name, (fit, score) in base.items():
        part = out_of_fold(rows, fit, score, folds).withColumnRenamed("score", name)
        scores = part if scores is None else scores.join(part.drop("label"), "id")
    return stacked(scores, list(base)), scores


def vector_groups_out(rows: DataFrame, groups: list[str], strengths: list[float], thresholds: list[float], floor: float, scaled: bool = False, group: str = "label_file") -> DataFrame:
    """For each strength: pooled scores of every group under a model of the others, and the best threshold on them."""
    out = None
    for c in strengths:
        pooled = leave_groups_out(rows, groups, lambda train, c=c: fit_vectors(train, c, scaled), vector_scores, group)
        swept = metrics.sweep(pooled.withColumn("label", F.col("label") == 1), "score", thresholds)
        best = metrics.best_at_precision(swept, floor).withColumn("strength", F.lit(c))
        out = best if out is None else out.unionByName(best)
    return out


def stacked(scores: DataFrame, columns: list[str]) -> PipelineModel:
    """A logistic regression over base scores and their least, largest, mean and spread."""
    return Pipeline(stages=[LogisticRegression(regParam=1e-4)]).fit(stack_features(scores, columns))


def stack_features(scores: DataFrame, columns: list[str]) -> DataFrame:
    from quillstone.functions.scalars import score_features

    return scores.withColumn("features", array_to_vector(score_features(F.array(*columns))))


def distilled(gold: DataFrame, teacher: DataFrame, weight: float, strength: float = 4.0) -> TextModel:
    """Gold rows of weight 1 and, for other rows, both labels weighted by the teacher's probability."""
    from quillstone.operators.labels import soft_copies

    soft = teacher.join(gold.select("id"), "id", "left_anti")
    copies = soft_copies(soft.select(F.col("id").alias("record_id"), "teacher"), weight).select(F.col("record_id").alias("id"), F.col("y").cast("double").alias("label"), F.col("w").alias("weight"))
    rows = gold.select("id", "text", "label").withColumn("weight", F.lit(1.0)).unionByName(copies.join(soft.select("id", "text"), "id"))
    return fit_text(rows, strength, weight="weight")
