"""Rows of sparse n-grams: each section's most frequent terms, and of every row the places and counts of those it has.

N-grams are cut and counted within the row, in Arrow batches, from lists of words.  In a first pass what leaves a task is, for
each term, how often and in how many rows it occurs in some part of them; in a second one the known terms' numbers.  No
pair of row and term is shuffled.  Terms are ranked by their occurrences, ties by the smaller term (UTF-8).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.operators.store import durable, mapped

#: Of every n-gram its row and number, and the terms by number.
Cut = Callable[[pa.ListArray], tuple[np.ndarray, np.ndarray, pa.Array]]
#: Words of a part of a batch, and rows of the counts that a task holds before they leave it.
WORDS, HELD = 150_000, 400_000


def _coded(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), pc.fill_null(lists.value_lengths(), 0).to_numpy())
    if flat.null_count:
        row, flat = row[pc.is_valid(flat).to_numpy(zero_copy_only=False)], flat.drop_null()
    coded = flat.dictionary_encode()
    return row, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def given(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Lists of n-grams as they are."""
    return _coded(lists)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    coded = pa.array(keys).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def _runs(row: np.ndarray, code: np.ndarray, names: pa.Array, low: int, high: int, joint: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """All runs of ``low`` to ``high`` neighbours of a row: a run is a shorter one and what follows it in the row."""
    n, runs, spelled = max(1, len(names)), code, names
    rows, codes, terms, begin = [], [], [], 0
    for size in range(1, high + 1):
        inside = row[size - 1 :] == row[: max(0, len(row) - size + 1)]
        if size > 1:
            pairs, at = _distinct((runs[: len(inside)] * n + code[size - 1 :])[inside])
            runs = np.zeros(len(inside), np.int64)
            runs[inside] = at
            spelled = pc.binary_join_element_wise(spelled.take(pa.array(pairs // n)), names.take(pa.array(pairs % n)), joint)
        if size >= low:
            rows.append(row[: len(inside)][inside])
            codes.append(runs[inside] + begin)
            terms.append(spelled)
            begin += len(spelled)
    return np.concatenate(rows), np.concatenate(codes), pa.concat_arrays(terms)


def word_grams(low: int, high: int) -> Cut:
    """All runs of ``low`` to ``high`` words, joined by blanks, repeats included."""
    return lambda words: _runs(*_coded(words), low, high, " ")


def char_grams(low: int, high: int) -> Cut:
    """All substrings of ``low`` to ``high`` characters of each word between two blanks, repeats included; a distinct word is cut once."""

    def cut(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        row, code, names = _coded(words)
        marks, at = _distinct(np.frombuffer("".join(f" {w} " for w in names.to_pylist()).encode("utf-32-le"), np.uint32))
        word = np.repeat(np.arange(len(names)), pc.utf8_length(names).to_numpy() + 2)
        word, gram, terms = _runs(word, at.astype(np.int64), pa.array(map(chr, marks.tolist()), pa.string()), low, high, "")
        gram, size = gram[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(names))
        n = size[code]
        return np.repeat(row, n), gram[np.repeat((np.cumsum(size) - size)[code] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], terms

    return cut


def _parts(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
    """Parts of batches of about ``WORDS`` elements of the lists from column ``first`` on (a longer row is a part of its own)."""
    for batch in batches:
        size = np.cumsum(sum(pc.fill_null(c.value_lengths(), 0).to_numpy().astype(np.int64) for c in batch.columns[first:]))
        a = 0
        while a < len(batch):
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + WORDS, "right")))
            yield batch.slice(a, b - a)
            a = b


@dataclass
class Vocabulary:
    """``terms`` of every section, the most frequent first, the numbers of rows that have them, and the number of all rows."""

    terms: list[pa.Array]
    df: np.ndarray
    rows: int

    @property
    def begins(self) -> list[int]:
        return np.cumsum([0, *map(len, self.terms)]).tolist()

    @property
    def idf(self) -> np.ndarray:
        return np.log((self.rows + 1) / (self.df + 1))


def vocabulary(rows: DataFrame, sections: dict[str, Cut], most: int, least: float = 2) -> Vocabulary:
    """The ``most`` most frequent n-grams of every section (a column of lists) that are in ``least`` rows or more (below 1: in that share of them)."""
    cuts = list(sections.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, 0

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by(["section", "term"]).aggregate([("total", "sum"), ("df", "sum")]).rename_columns(["section", "term", "total", "df"])

        for part in _parts(batches, 0):
            n += len(part)
            for i, cut in enumerate(cuts):
                row, code, names = cut(part.column(i))
                if not len(names):
                    continue
                pairs, _ = _distinct(row * len(names) + code)
                df, total = (np.bincount(c, minlength=len(names)) for c in (pairs % len(names), code))
                held.append(pa.table({"section": pa.array(np.full(len(names), i, np.int32)), "term": names, "total": total, "df": df}))
                size += len(names)
            if size > 2 * HELD:
                held = [merged()]
                if (size := held[0].num_rows) > HELD:
                    yield from held[0].to_batches(50_000)
                    held, size = [], 0
        if held:
            yield from merged().to_batches(50_000)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([""]), pa.array([n]), pa.array([n])], ["section", "term", "total", "df"])

    found = mapped(rows.select(*sections), run, "section int, term string, total long, df long")
    found = durable(found.groupBy("section", "term").agg(F.sum("total").alias("total"), F.sum("df").alias("df")))
    n = sum(r.df for r in found.where("section = -1").collect())  # one row
    enough = found.where(F.col("df") >= (least if least >= 1 else least * n))
    tables = [enough.where(F.col("section") == i).orderBy(F.desc("total"), "term").limit(most).select("term", "df").toArrow() for i in range(len(cuts))]
    return Vocabulary([t.column("term").cast(pa.string()).combine_chunks() for t in tables], np.concatenate([t.column("df").to_numpy() for t in tables]), n)


def placed(rows: DataFrame, sections: dict[str, Cut], known: Vocabulary, finish: Callable[[int, np.ndarray, np.ndarray, np.ndarray], list[pa.Array]], fields: list[T.StructField]) -> DataFrame:
    """``rows`` with ``fields`` in the place of the sections: ``finish`` makes them from the number of rows of a part and from the
    row, place and count of each distinct n-gram that is known, in this order."""
    cuts, others = list(sections.values()), [c for c in rows.columns if c not in sections]
    begins, sent = known.begins, rows.sparkSession.sparkContext.broadcast(known.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, begins[-1])
        for part in _parts(batches, len(others)):
            keys = [np.zeros(0, np.int64)]
            for i, cut in enumerate(cuts):
                row, code, names = cut(part.column(len(others) + i))
                at = pc.fill_null(pc.index_in(names, value_set=sent.value[i]), -1).to_numpy()[code]
                keys.append((row * size + begins[i] + at)[at >= 0])
            own, number = _distinct(np.concatenate(keys))
            count, order = np.bincount(number, minlength=len(own)), np.argsort(own)
            own = own[order]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(others)], *finish(len(part), own // size, own % size, count[order])], [*others, *(f.name for f in fields)])

    return mapped(rows.select(*others, *sections), run, T.StructType([*(rows.schema[c] for c in others), *fields]))


def offsets(n: int, row: np.ndarray) -> pa.Array:
    """Where the lists of ``n`` rows begin and end."""
    return pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
