"""Masked pseudo-likelihood of documents over all their words, each with a distribution of its own.

Tokens are lower-case white-space separated words, told apart by their spelling and by nothing less:
no hash buckets, no limit to the vocabulary.  The window network of ``maskedlm`` predicts a token's
class from its sides; the ``OWN`` most frequent words are classes of their own, the others share the
rest by their last two bytes.  Within a class the two sides tell the words apart,

    P(word | class, l, r) = mean over both sides s of (n(word, s) + WEIGHT p) / (n(class, s) + WEIGHT),
    p = (n(word) + 1) / (n(class) + words of the class + 1),

where n counts tokens of the whole corpus (by the class of the neighbour on that side, after the
comma); the last 1 is the share of words that the corpus lacks.  Every token is masked once and is a target.

Three passes: the words are counted; the cells of the network and the sides of the ``head`` most
frequent words are counted; the texts are scored.  A task scores the words of the head at once.  All
others go by word to partitions of about ``ROWS`` tokens, where their own sides are counted and their
probabilities found; these come back to their rows and are added up.  So ``head`` bounds what is broadcast and
changes no result (it is ``OWN`` at least).  The sums are in whole units of 2 ** -30, so their order does not matter either.

Cases: null, empty or wordless text has no tokens and log-likelihood zero (its mean is null); a text
of any length counts whole, within the memory of a task; repeated rows count and score like any
others; rows with a null id too; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import common, maskedlm
from quillstone.llm.maskedlm import CLASSES

HEAD, ROWS = 1 << 14, 1_000_000
#: Tokens, of the words' own frequencies, that every class on every side counts beside those seen there.
WEIGHT = 100.0
OWN, SIDES = CLASSES * 3 // 4, CLASSES + 1
_CELLS = SIDES * SIDES * CLASSES
_UNIT = float(1 << 30)
_CHUNK = 1 << 16  # counters in a row of those that are summed


@dataclass(frozen=True)
class Model:
    """What a corpus has taught; of the words beyond the head the corpus itself (``docs``) is kept."""

    docs: DataFrame | None
    rare: int  # tokens beyond the head
    head: pa.Array
    mass: np.ndarray  # tokens and distinct words of every class
    kinds: np.ndarray
    left: np.ndarray  # tokens of every class by the class on that side
    right: np.ndarray
    table: np.ndarray  # log-probabilities of the classes by both sides
    by_left: np.ndarray | None  # halves of P(word | class, side) of the head, by side
    by_right: np.ndarray | None


def _texts(docs: DataFrame) -> DataFrame:
    return common.texts(docs).withColumn("row", F.monotonically_increasing_id())


def _words(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray]]:
    """Groups of texts, their distinct words, each token's place among these, and each text's number of tokens."""
    for batch in common.gathered(batches, most):
        for part in common.slices(batch, 1, most):
            split = pc.ascii_split_whitespace(pc.ascii_lower(part.column(1).cast(pa.string())))
            flat, counts = split.flatten(), split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            full = pc.greater(pc.binary_length(flat), 0)
            if full.false_count:
                kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
                counts = np.diff(kept[np.concatenate([[0], np.cumsum(counts)])])
                flat = flat.filter(full)
            words = flat.dictionary_encode()
            yield part, words.dictionary, words.indices.to_numpy(), counts


def spelled(words: pa.Array) -> np.ndarray:
    """The shared class of each word, by its last two bytes (of one, where it has no more)."""
    if not len(words):
        return np.zeros(0, np.int64)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)
    last, stop = data[offsets[1:] - 1].astype(np.int64), offsets[1:] - 2
    before = np.where(stop >= offsets[:-1], data[np.maximum(stop, 0)], 0).astype(np.int64)
    return OWN + ((last * 256 + before) * 40503 >> 4) % (CLASSES - OWN)


def _places(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Each word's place among others, or -1."""
    return pc.fill_null(pc.index_in(words, value_set=among), -1).to_numpy(zero_copy_only=False)


def classes(words: pa.Array, head: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each word's class and its place in the head, or -1."""
    place, cls = _places(words, head), spelled(words)
    own = (place >= 0) & (place < OWN)
    cls[own] = place[own]
    return cls, place


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over the whole corpus."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, code, _ in _words(batches):
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(code, minlength=len(words)))], schema=schema)

    return common.mapped(common.texts(docs), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counted: DataFrame, head: int) -> tuple[pa.Array, np.ndarray]:
    """The ``OWN`` most frequent words in order, ties by spelling, then all others of at least some count, about
    ``head`` at most in all, and how often each occurs.  A table of counts says from where on, so that no task sorts words."""
    own = counted.orderBy(F.desc("n"), "word").limit(OWN).toArrow()
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted((tuple(r) for r in counted.groupBy(level.alias("level")).count().collect()), reverse=True)
    upto = np.cumsum([k for _, k in sizes])
    fit = int(np.searchsorted(upto, head, "right"))  # levels that fit whole
    words, n = own.column(0).combine_chunks().cast(pa.string()), own.column(1).to_numpy()
    if not fit:
        return words, n
    more = counted.where(level >= sizes[fit - 1][0]).toArrow()
    more = more.filter(pc.invert(pc.is_in(more.column(0).cast(pa.string()), value_set=words))).sort_by("word")
    return pa.concat_arrays([words, more.column(0).combine_chunks().cast(pa.string())]), np.concatenate([n, more.column(1).to_numpy()])


def class_counts(counted: DataFrame, head: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            cls, n = classes(batch.column(0).cast(pa.string()), head)[0], batch.column(1).to_numpy()
            np.add.at(mass, cls, n)
            kinds += np.bincount(cls, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), pa.array(mass), pa.array(kinds)], names=["cls", "mass", "kinds"])

    found = common.mapped(counted, run, "cls int, mass long, kinds long").groupBy("cls").agg(F.sum("mass").alias("mass"), F.sum("kinds").alias("kinds"))
    mass, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in found.collect():
        mass[r.cls], kinds[r.cls] = r.mass, r.kinds
    return mass, kinds


def counters(docs: DataFrame, head: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens by their sides and class, and of each word of the head by the class on its left and on its right.

    A task counts into one array of fixed size; its parts are summed by Spark."""
    size, shared = _CELLS + len(head) * 2 * SIDES, docs.sparkSession.sparkContext.broadcast(head)
    names = "chunk int, width int, counts binary"
    schema = pa.schema([("chunk", pa.int32()), ("width", pa.int32()), ("counts", pa.binary())])

    def rows(parts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for chunk, part in parts.items():
            if part.any():
                part = part.astype(np.min_scalar_type(int(part.max())))
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([part.itemsize], pa.int32()), pa.array([part.tobytes()], pa.binary())], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for _, words, code, counts in _words(batches):
            cls, place = classes(words, shared.value)
            own, at = cls[code], place[code].astype(np.int64)
            pair = maskedlm.sides(own, counts)
            total[:_CELLS] += np.bincount(pair * CLASSES + own, minlength=_CELLS)
            some = at >= 0
            left, right = np.divmod(pair[some], SIDES)
            at = at[some] * (2 * SIDES)
            total[_CELLS:] += np.bincount(np.concatenate([at + left, at + SIDES + right]), minlength=size - _CELLS)
        yield from rows({i: total[i * _CHUNK : (i + 1) * _CHUNK] for i in range(-(-size // _CHUNK))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, width, counts in zip(*(batch.column(i) for i in range(3))):
                part = np.frombuffer(counts.as_buffer(), f"u{width.as_py()}")
                sums.setdefault(chunk.as_py(), np.zeros(len(part), np.int64))
                sums[chunk.as_py()] += part.astype(np.int64)
        yield from rows(sums)

    total = np.zeros(size, np.int64)
    for chunk, width, counts in zip(*common.mapped(common.mapped(common.texts(docs), count, names).repartition("chunk"), add, names).toArrow().columns):
        part = np.frombuffer(counts.as_buffer(), f"u{width.as_py()}")
        total[chunk.as_py() * _CHUNK :][: len(part)] = part
    return total[:_CELLS], total[_CELLS:].reshape(len(head), 2, SIDES)


def _half(n, n_word, cls, of_side: np.ndarray, side, model: Model) -> np.ndarray:
    """Half of P(word | class, side)."""
    p = (n_word + 1.0) / (model.mass[cls] + model.kinds[cls] + (cls >= OWN))
    return 0.5 * (n + WEIGHT * p) / (of_side[cls, side] + WEIGHT)


def learn(docs: DataFrame, head: int = HEAD) -> Model:
    counted = common.durable(word_counts(docs))
    words, n = most_frequent(counted, head)
    mass, kinds = class_counts(counted, words)
    cells, sided = counters(docs, words)
    cells = cells.reshape(SIDES, SIDES, CLASSES)
    left, right = cells.sum(1).T, cells.sum(0).T
    smooth = mass + kinds + (np.arange(CLASSES) >= OWN)
    network = maskedlm.trained(cells.reshape(-1, CLASSES) + maskedlm.PRIOR * smooth / smooth.sum())
    model = Model(docs, int(mass.sum() - n.sum()), words, mass, kinds, left, right, network.forward()[1], None, None)
    cls, side = classes(words, words)[0][:, None], np.arange(SIDES)[None]
    return replace(model, by_left=_half(sided[:, 0], n[:, None], cls, left, side, model), by_right=_half(sided[:, 1], n[:, None], cls, right, side, model))


_TOKENS = "word string, row long, pair int, doc struct<doc_id: long, n: long, part: long>"
_DOC = pa.struct([("doc_id", pa.int64()), ("n", pa.int64()), ("part", pa.int64())])


def _units(log: np.ndarray) -> np.ndarray:
    return np.rint(log * _UNIT).astype(np.int64)


def _sent(docs: DataFrame, shared, scored: bool) -> DataFrame:
    """Every token beyond the head, with its sides, and a row for every text with what its other tokens add up to."""
    schema = pa.schema([("word", pa.string()), ("row", pa.int64()), ("pair", pa.int32()), ("doc", _DOC)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part, words, code, counts in _words(batches):
            cls, place = classes(words, model.head)
            own, at = cls[code], place[code]
            pair = maskedlm.sides(own, counts)
            rare = np.flatnonzero(at < 0)
            row = np.repeat(part.column(2).to_numpy(), counts)
            for a in range(0, len(rare), 100_000):
                some = rare[a : a + 100_000]
                rows = pa.array(row[some]) if scored else pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([words.take(pa.array(code[some])), rows, pa.array(pair[some].astype(np.int32)), pa.nulls(len(some), _DOC)], schema=schema)
            if scored:
                log = np.zeros(len(code) + 1, np.int64)
                known = np.flatnonzero(at >= 0)
                left, right = np.divmod(pair[known], SIDES)
                log[known] = _units(model.table[pair[known], own[known]] + np.log(model.by_left[at[known], left] + model.by_right[at[known], right]))
                stop = np.cumsum(counts)
                sums = np.where(counts > 0, np.add.reduceat(log, stop - counts), 0)
                doc = pa.StructArray.from_arrays([part.column(0), pa.array(counts), pa.array(sums)], fields=list(_DOC))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(doc), pa.string()), part.column(2), pa.nulls(len(doc), pa.int32()), doc], schema=schema)

    return common.mapped(_texts(docs), run, _TOKENS)


class _Rare:
    """The words of a partition: how often they stand in the corpus, and with which side."""

    def __init__(self, words: pa.Array, pair: np.ndarray):
        code = words.dictionary_encode()
        self.words, at = code.dictionary, code.indices.to_numpy().astype(np.int64)
        self.n = np.bincount(at, minlength=len(self.words))
        self.left, self.right = (np.unique(at * SIDES + s, return_counts=True) for s in np.divmod(pair, SIDES))

    @staticmethod
    def _found(keys: np.ndarray, counts: np.ndarray, key: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, counts[at], 0)

    def units(self, words: pa.Array, pair: np.ndarray, model: Model) -> np.ndarray:
        """Each token's log-probability."""
        code = words.dictionary_encode()
        place = _places(code.dictionary, self.words).astype(np.int64)
        cls, code = spelled(code.dictionary), code.indices.to_numpy()
        at, cls = place[code], cls[code]
        n = np.append(self.n, 0)[at]  # none of a word that the corpus lacks
        left, right = np.divmod(pair, SIDES)
        by_left, by_right = (self._found(*known, np.where(at < 0, -1, at * SIDES + s)) for known, s in ((self.left, left), (self.right, right)))
        return _units(model.table[pair, cls] + np.log(_half(by_left, n, cls, model.left, left, model) + _half(by_right, n, cls, model.right, right, model)))


def score(docs: DataFrame, model: Model | None = None, head: int = HEAD) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood, mean``, under the model of these documents or another one."""
    itself = model is None
    model = model or learn(docs, head)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(replace(model, docs=None))  # some 40 MB at most, whatever the corpus
    lean = context.broadcast(replace(model, docs=None, by_left=None, by_right=None, head=None))
    sent, size = _sent(docs, shared, True), model.rare / ROWS
    if not itself:  # the words of the model's corpus meet those of these texts, and come first
        sent = _sent(model.docs, shared, False).unionByName(sent)
        size += (common.texts(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0) / (8 * ROWS)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = sent.repartition(max(least, int(np.ceil(size))), F.coalesce("word", F.col("row").cast("string")))
    if not itself:
        sent = sent.sortWithinPartitions(F.col("row").asc_nulls_first())
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("part", pa.int64())])

    def results(rare: _Rare, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        docs_ = rows.filter(pc.is_null(rows["word"])).combine_chunks()
        for batch in docs_.to_batches():
            doc = batch.column(3)
            yield pa.RecordBatch.from_arrays([batch.column(1), *doc.flatten()], schema=schema)
        rows = rows.filter(pc.is_valid(rows["word"]))
        if rows.num_rows:
            units = rare.units(pa.concat_arrays(rows["word"].chunks), rows["pair"].to_numpy(), lean.value)
            row = rows["row"].to_numpy()
            for a in range(0, len(row), 100_000):
                some = row[a : a + 100_000]
                none = pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(some), none, none, pa.array(units[a : a + 100_000])], schema=schema)

    def learned(batches: list[pa.RecordBatch]) -> _Rare:
        rows = pa.Table.from_batches(batches).filter(pc.is_valid(pc.field("word"))) if batches else None
        if rows is None or not rows.num_rows:
            return _Rare(pa.array([], pa.string()), np.zeros(0, np.int64))
        return _Rare(pa.concat_arrays(rows["word"].chunks), rows["pair"].to_numpy().astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if itself:
            held = list(batches)
            if held:
                yield from results(learned(held), pa.Table.from_batches(held))
            return
        held, rare = [], None
        for batch in batches:
            known = batch.column(1).null_count  # these come first
            if known:
                held.append(batch.slice(0, known))
            if known < len(batch):
                rare = rare or learned(held)
                yield from results(rare, pa.Table.from_batches([batch.slice(known)]))

    found = common.mapped(sent, run, "row long, doc_id long, n long, part long")
    found = found.repartition("row").groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.round(F.sum("part") / _UNIT, 4).alias("log_likelihood"))
    return found.select("doc_id", "n_tokens", "log_likelihood", F.round(F.try_divide(F.col("log_likelihood"), F.col("n_tokens")), 6).alias("mean"))
