"""Sparse rows of n-grams against counting in plain Python."""

import random
import re
from collections import Counter

import numpy as np

from quillstone.operators import sparse, training


def plain(text):
    words = re.findall(r"\b\w\w+\b", (text or "").lower())
    padded = [f" {w} " for w in (text or "").lower().split()]
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])]), Counter(w[i : i + n] for n in (3, 4) for w in padded for i in range(len(w) - n + 1))


def test_terms_and_vectors(spark, monkeypatch):
    monkeypatch.setattr(sparse, "WORDS", 20)
    monkeypatch.setattr(sparse, "HELD", 30)
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["ab", "abc", "é🙂x", "b", "ab,cd", "x" * 9, "zz"]) for _ in range(rng.randrange(30))) for _ in range(60)] + [None, "", "a", "ab " * 100]
    rows = spark.createDataFrame([(i, float(i % 2), t) for i, t in enumerate(texts)], "id long, label double, text string").repartition(3)
    words = training.with_words(rows)
    known = sparse.vocabulary(words, training.SECTIONS, 25)
    assert known.rows == len(texts)
    grams = [plain(t) for t in texts]
    df, names = [], []
    for s in (0, 1):
        total, own = Counter(), Counter()
        for g in grams:
            total.update(g[s])
            own.update(g[s].keys())
        best = sorted((t for t in own if own[t] >= 2), key=lambda t: (-total[t], t.encode()))[:25]
        assert known.terms[s].to_pylist() == best
        df += [own[t] for t in best]
        names.append(best)
    assert known.df.tolist() == df
    idf = np.log((len(texts) + 1) / (np.array(df) + 1))
    got = {r.id: r.features.toArray() for r in training.tfidf_vectors(words, known).collect()}
    for i, g in enumerate(grams):
        parts = [np.array([g[s][t] for t in names[s]], float) * idf[len(names[0]) * s :][: len(names[s])] for s in (0, 1)]
        want = np.concatenate([p / max(np.linalg.norm(p), 1e-300) for p in parts])
        assert np.allclose(got[i], want), texts[i]


def test_null_texts_and_no_terms(spark):
    """A null text counts as empty; without a term that two rows share the classifier still gives scores."""
    rows = spark.createDataFrame([(1, 1.0, None), (2, 0.0, "ab"), (3, 1.0, "")], "id long, label double, text string")
    assert training.text_scores(training.fit_text(rows), rows).count() == 3


def test_counted_takes_batches_of_bounded_bytes(spark):
    """Whatever the rows of a partition, no batch of much over 4 MiB meets the worker (a batch of 10,000 rows of these would be 70 MB)."""
    from pyspark.sql import functions as F

    from quillstone.operators import scoring

    docs = spark.range(0, 4000, 1, 1).withColumn("w", F.array_repeat(F.lit("word"), 1000))
    assert scoring.counted(docs, "id", {"word": F.col("w")}).agg(F.sum("count")).first()[0] == 4_000_000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 4 << 20
