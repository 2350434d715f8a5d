"""The queries of trained models against plain versions in numpy."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from quillstone.operators.tuning import Walk
from quillstone.plans import registry
from quillstone.plans.model_queries import _training

DIR = "/root/testdata/sf0.01"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    score, y = np.asarray(score)[order], np.asarray(y)[order]
    rank = np.empty(len(score))
    _, at, inverse, n = np.unique(score, return_index=True, return_inverse=True, return_counts=True)
    rank = at[inverse] + (n[inverse] + 1) / 2
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def minimum(x, y, penalty, tolerance=1e-13):
    """Weights of logistic loss (mean) plus half the penalised squares, the intercept free."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    walk = Walk(np.zeros(x1.shape[1]))
    for _ in range(3000):
        if walk.done:
            break
        w = walk.point()
        m = (2 * y - 1) * (x1 @ w)
        inner = w.copy()
        inner[-1] = 0
        g = x1.T @ (-(2 * y - 1) / (1 + np.exp(np.minimum(m, 700)))) / len(y) + penalty * inner
        walk.tell(np.logaddexp(0, -m).mean() + penalty / 2 * inner @ inner, g, tolerance)
    return walk.x


def found(spark, name):
    return registry.QUERIES[name](spark, DIR).first()


def test_embeddings(spark):
    t = pq.read_table(f"{DIR}/embeddings.parquet")
    ids, y = t["vec_id"].to_numpy(), (t["label"].to_numpy() % 2).astype(float)
    x = np.array(t["embedding"].to_pylist(), float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    train = ids % 4 != 0
    x = (x - x[train].mean(0)) / x[train].std(0, ddof=1)
    w = minimum(x[train], y[train], 1 / train.sum())
    want = auc(x[~train] @ w[:-1], y[~train])
    got = found(spark, "embedding_logistic_auc")
    assert abs(got.auc - want) < 0.01 and got.positives == (y[~train] == 1).sum()


def test_stack(spark):
    t = pq.read_table(f"{DIR}/labels.parquet")
    ids, y = t["doc_id"].to_numpy(), (t["toxic"].to_numpy() == 1).astype(float)
    a = np.round((ids * 37) % 101 / 101 * 0.6 + 0.35 * y, 3)
    b = np.round((ids * 53) % 97 / 97 * 0.7 + 0.25 * y, 3)
    x = np.stack([a, b, np.minimum(a, b), np.maximum(a, b), (a + b) / 2, np.abs(a - b)], 1)
    train = ids % 4 != 0
    scale = x[train].std(0, ddof=1)  # MLlib's penalty is on standardised features
    w = minimum(x[train] / scale, y[train], 1e-4)
    assert abs(found(spark, "stacked_scores_auc").auc - auc(x[~train] / scale @ w[:-1], y[~train])) < 0.01


@pytest.fixture(scope="module")
def texts(spark):
    """Count matrices of both sections (terms in 2 training documents or more), labels and the fold."""
    rows = _training(spark, DIR).collect()
    grams = []
    for r in rows:
        words = re.findall(r"\b\w\w+\b", r.text.lower())
        padded = [f" {w} " for w in re.findall(r"\S+", r.text.lower())]
        grams.append((Counter(words + [f"{p} {q}" for p, q in zip(words, words[1:])]), Counter(w[i : i + n] for n in (3, 4) for w in padded for i in range(len(w) - n + 1))))
    y, fold = np.array([r.label for r in rows]), np.array([r.fold for r in rows])
    parts = []
    for s in (0, 1):
        df, total = Counter(), Counter()
        for g, f in zip(grams, fold):
            if f != 0:
                df.update(g[s].keys())
                total.update(g[s])
        known = sorted((t for t in df if df[t] >= 2), key=lambda t: (-total[t], t))[:40_000]
        at = {t: i for i, t in enumerate(known)}
        x = np.zeros((len(rows), len(known)), np.float32)
        for i, g in enumerate(grams):
            for t, n in g[s].items():
                if t in at:
                    x[i, at[t]] = n
        n = (fold != 0).sum()
        idf = np.log((n + 1) / (np.array([df[t] for t in known]) + 1))
        x *= idf
        parts.append(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))
    return np.hstack(parts), y, fold != 0


def test_text_logistic(spark, texts):
    x, y, train = texts
    w = minimum(x[train].astype(float), y[train], 1 / (4.0 * train.sum()), 1e-8)
    assert abs(found(spark, "tfidf_logistic_auc").auc - auc(x[~train] @ w[:-1], y[~train])) < 0.02


def test_text_bayes(spark, texts):
    x, y, train = texts
    weights = []
    for c in (0, 1):  # of the other class: the complement
        other = x[train & (y != c)].sum(0) + 0.4
        weights.append(-np.log(other / other.sum()))
    assert abs(found(spark, "complement_bayes_auc").auc - auc(x[~train] @ (weights[1] - weights[0]), y[~train])) < 0.02
