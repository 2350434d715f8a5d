"""Masked pseudo-likelihood of documents under a bidirectional window network.

Tokens are lower-case white-space separated words, hashed into ``BUCKETS``.  Counted over the whole
corpus, frequent buckets are classes of their own and the others share classes of about equal mass,
so P(token | sides) = P(class | sides) P(token | class).  The network predicts a token's class from
the classes of the tokens on either side: side-specific embeddings are summed, passed through
tanh, and a softmax over classes follows.

Every token of every text is masked once and is a target.  What the network can learn from is how
often each class stands between each pair of classes; these counts are gathered from all texts and
summed in Spark, in whole numbers, so neither the layout of the table nor the order of its rows
matters.  The network is trained on them in numpy, by Adam steps on all counts at once.  Its
predictions for every pair of sides are then a table, and scoring sums their logarithms.

To the driver come one count per bucket and one per cell of that table, whatever the size of the input.

Cases: null, empty or wordless text has no tokens and log-likelihood zero (its mean is null); a text
of any length counts whole; repeated rows count and score like any others; rows with a null id too;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import common

BUCKETS, CLASSES, HIDDEN, STEPS = 1 << 16, 96, 48, 150
#: Tokens, of the classes' own frequencies, that every pair of sides counts beside those seen there.
PRIOR = 20.0
_EDGE = CLASSES  # the class of what lies outside a text
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words of all texts, and each text's number of them.  A word's hash is a
    difference of running sums of byte times power, brought to the power zero."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
    word = ~_BLANK[data]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    inner = offsets[1:-1]
    edge = inner[inner < n]
    starts[edge] = word[edge]  # a word never runs on into the next text
    begin = np.flatnonzero(starts)
    if not len(begin):
        return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
    gaps = np.flatnonzero(~word)
    after = np.searchsorted(gaps, begin)
    stop = np.where(after < len(gaps), gaps[np.minimum(after, max(0, len(gaps) - 1))] if len(gaps) else n, n)
    stop = np.minimum(stop, offsets[1:][np.searchsorted(offsets[1:], begin, "right")])
    power = np.full(n + 1, _P, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power[:n])])
    back = np.full(n + 1, _P_INVERSE, np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    h = (total[stop] - total[begin]) * back[begin]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    counts = np.diff(np.searchsorted(begin, offsets))
    return (h >> np.uint64(48)).astype(np.int32), counts


def _parts(batches: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, buckets and counts of groups of texts."""
    for batch in batches:
        column = batch.column(1).cast(pa.binary())
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
        a = 0
        while a < len(column):
            b = min(len(column), max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1))
            yield batch.column(0).slice(a, b - a), *tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            a = b


def classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket's class and its log-probability within the class."""
    order = np.argsort(-counts, kind="stable")
    own = CLASSES * 3 // 4
    cls = np.empty(len(counts), np.int64)
    cls[order[:own]] = np.arange(own)
    mass = np.cumsum(counts[order[own:]] + 1.0)
    cls[order[own:]] = own + np.minimum((mass - 1e-9) * (CLASSES - own) / mass[-1], CLASSES - own - 1).astype(np.int64)
    smooth = counts + 1.0
    return cls, np.log(smooth) - np.log(np.bincount(cls, smooth, CLASSES))[cls]


class Network:
    """Weights of both sides' embeddings, of the hidden values and of the softmax over classes."""

    def __init__(self, weights: np.ndarray | None = None):
        n, h = 2 * (CLASSES + 1), HIDDEN
        if weights is None:
            rng = np.random.default_rng(3)
            weights = np.concatenate([rng.normal(0, 0.3, n * h), np.zeros(h), rng.normal(0, 0.1, h * CLASSES), np.zeros(CLASSES)])
        self.flat = weights.astype(np.float64)
        self.embed, self.b1 = self.flat[: n * h].reshape(2, CLASSES + 1, h), self.flat[n * h : n * h + h]
        self.out, self.b2 = self.flat[n * h + h : -CLASSES].reshape(h, CLASSES), self.flat[-CLASSES:]

    def forward(self) -> tuple[np.ndarray, np.ndarray]:
        """Hidden values and log-probabilities of the classes for every pair of sides."""
        hidden = np.tanh((self.embed[0][:, None] + self.embed[1][None] + self.b1).reshape(-1, HIDDEN))
        logits = hidden @ self.out + self.b2
        logits -= logits.max(1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(1, keepdims=True))
        return hidden, logits

    def gradient(self, share: np.ndarray) -> np.ndarray:
        """Of the mean negative log-probability of the targets; ``share``: each pair's and class's part of all tokens."""
        hidden, logs = self.forward()
        d = np.exp(logs) * share.sum(1, keepdims=True) - share
        inner = (d @ self.out.T) * (1 - hidden * hidden)
        pairs = inner.reshape(CLASSES + 1, CLASSES + 1, HIDDEN)
        return np.concatenate([pairs.sum(1).ravel(), pairs.sum(0).ravel(), inner.sum(0), (hidden.T @ d).ravel(), d.sum(0)])


def trained(cells: np.ndarray, steps: int = STEPS, rate: float = 0.03) -> Network:
    """A network fitted to ``cells``: how often each class stands between each pair of classes."""
    network = Network()
    share = cells.reshape(-1, CLASSES) / cells.sum()
    m, v = np.zeros_like(network.flat), np.zeros_like(network.flat)
    for t in range(1, steps + 1):
        g = network.gradient(share)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        network.flat -= rate * (1 - (t - 1) / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return network


def sides(cls: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The pair of classes around every token, as one number; texts do not see each other."""
    left, right = np.full(len(cls), _EDGE), np.full(len(cls), _EDGE)
    left[1:], right[:-1] = cls[:-1], cls[1:]
    stop = np.cumsum(counts)
    some = counts > 0
    left[(stop - counts)[some]] = _EDGE
    right[stop[some] - 1] = _EDGE
    return left * (CLASSES + 1) + right


def corpus_counts(docs: DataFrame) -> DataFrame:
    """``bucket, n`` over the whole corpus."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for _, bucket, _ in _parts(batches):
            total += np.bincount(bucket, minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], schema=schema)

    return common.mapped(common.texts(docs), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def corpus_cells(docs: DataFrame, cls: np.ndarray) -> DataFrame:
    """``cell, n``: tokens of the corpus by their sides and class."""
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES + 1) ** 2 * CLASSES, np.int64)
        for _, bucket, counts in _parts(batches):
            own = cls[bucket]
            total += np.bincount(sides(own, counts) * CLASSES + own, minlength=len(total))
        used = np.flatnonzero(total)
        for a in range(0, len(used), 100_000):
            part = used[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], schema=schema)

    return common.mapped(common.texts(docs), run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def smoothed(cells: np.ndarray, counts: np.ndarray, cls: np.ndarray) -> np.ndarray:
    mass = np.bincount(cls, counts + 1.0, CLASSES)
    return cells.reshape(-1, CLASSES) + PRIOR * mass / mass.sum()


def _collected(counts: DataFrame, size: int) -> np.ndarray:
    """Two columns, a place and a count, as an array of ``size``."""
    out, found = np.zeros(size, np.int64), counts.toArrow()
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def learn(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each bucket's class, its log-probability within it, and the classes' log-probabilities by sides."""
    counts = _collected(corpus_counts(docs), BUCKETS)
    cls, inside = classes(counts)
    cells = _collected(corpus_cells(docs, cls), (CLASSES + 1) ** 2 * CLASSES)
    return cls, inside, trained(smoothed(cells, counts, cls)).forward()[1].astype(np.float32)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood, mean``, under the model of these documents or another one."""
    shared = docs.sparkSession.sparkContext.broadcast(model or learn(docs))  # some 5 MB, always
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("log_likelihood", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, inside, table = shared.value
        flat = table.ravel()
        for ids, bucket, n in _parts(batches):
            own = cls[bucket]
            logs = np.concatenate([[0.0], inside[bucket] + flat[sides(own, n) * CLASSES + own], [0.0]])
            stop = np.cumsum(n)
            sums = np.where(n > 0, np.add.reduceat(logs[1:], stop - n), 0.0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(sums, pa.float64())], schema=schema)

    found = common.mapped(common.texts(docs), run, "doc_id long, n_tokens long, log_likelihood double")
    return found.withColumn("log_likelihood", F.round("log_likelihood", 4)).withColumn("mean", F.round(F.try_divide(F.col("log_likelihood"), F.col("n_tokens")), 6))
