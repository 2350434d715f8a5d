"""Spelling variants: words that differ by one inserted, deleted or replaced code point, without pairs.

Words (with counts) are numbered in their order.  Each stands in a group for every position, that of all words
with the same prefix and suffix around it, and every word without one code point is looked up among the
words.  Both are equalities of strings: ``prefix * suffix``, and the shorter word itself.  A string is named by
124 bits, four polynomial sums modulo 2**31 - 1, so a word of any length costs its length, and every name takes
constant time.  Names are dealt out to tasks by ranges, sorted there, and equal ones are runs:

* of a wildcard group its size and its two most frequent words are kept: each member has ``size - 1`` neighbours
  here, the best of which is the first, or for the first itself the second;
* of a word and what becomes it by a deletion, the word gets their number and the best, each of them the word.

A group has at most as many words as there are letters (times places, for deletions), so none is hot; what
comes out is a row for each word and group, which an aggregation by word combines.  Following forms to the last
is pointer doubling: each form is ten times as frequent, so chains are of logarithmic length.

Cases: null text has no words; a null id is an empty string in the hash; repeated rows count again; texts and
words of any length are taken whole; ties go to the smaller word; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import common

LEAST_LENGTH, LEAST_COUNT, FACTOR, EVERY = 7, 2, 10, 31
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)

PRIME = np.uint64((1 << 31) - 1)
_BASES = [int(b) for b in np.random.default_rng(12).integers(1 << 20, (1 << 31) - 2, 4)]
WILD = np.uint64(0x110001)  # no code point
MEMBER, SELF, SHORTER = 0, 1, 2
NAMES = 1_000_000  # of a task
SENT = pa.schema([("range", pa.int32()), ("names", pa.binary())])
_NAME = np.dtype([("a", "<u8"), ("b", "<u8"), ("n", "<i8"), ("id", "<i8"), ("kind", "u1")])
NEAR = pa.schema([("id", pa.int64()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.int64())])


def _checksums(heads: np.ndarray, raw: np.ndarray, begins: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of every run of ``raw`` behind a text whose crc32 is in ``heads``."""
    found = np.zeros(len(begins), np.uint32)
    long = length > 64
    for i in np.flatnonzero(long):
        found[i] = zlib.crc32(raw[begins[i] : begins[i] + length[i]].tobytes(), int(heads[i]))
    at = np.flatnonzero(~long)
    at = at[np.argsort(-length[at], kind="stable")]  # those that end first stand last
    state, first, size = ~heads[at], begins[at], length[at]
    for k in range(int(size[0]) if len(size) else 0):
        m = int(np.searchsorted(-size, -k))  # longer than k
        state[:m] = _CRC[(state[:m] ^ raw[first[:m] + k]) & 0xFF] ^ (state[:m] >> 8)
    found[at] = ~state
    return found


def _runs(keys: pa.Array, texts: pa.Array, least: int) -> pa.Array:
    """The words of a block of texts: lower-cased runs of letters with at least ``least`` code points, some with one deleted."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    raw = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    lead = raw == 0xC3  # U+00C0 to U+00FF are its two-byte characters
    inside = _LETTER[raw] | lead
    inside[1:] |= lead[:-1]
    opens = np.zeros(len(raw) + 1, bool)
    opens[offsets] = True
    begins, ends = inside.copy(), inside
    begins[1:] &= ~inside[:-1] | opens[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | opens[1:-1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long = ends - begins >= least
    begins, ends = begins[long], ends[long]
    wide = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(lead, out=wide[1:])
    points = ends - begins - (wide[ends] - wide[begins])
    begins, ends, points = begins[points >= least], ends[points >= least], points[points >= least]
    raw = _LOWER[raw]
    heads = np.array([zlib.crc32(b"%s:" % (b"" if k is None else str(k).encode())) for k in keys.to_pylist()], np.uint32)
    h = _checksums(heads[np.searchsorted(offsets, begins, "right") - 1], raw, begins, ends - begins)
    cut = h % EVERY == 0
    kept = np.zeros(len(raw) + 1, np.int8)
    whole = np.flatnonzero(~cut)
    kept[begins[whole]] += 1
    kept[ends[whole]] -= 1
    kept = np.cumsum(kept[:-1], dtype=np.int8).astype(bool)
    upto = np.zeros(len(whole) + 1, np.int32)
    np.cumsum(ends[whole] - begins[whole], out=upto[1:])
    found = pa.StringArray.from_buffers(len(whole), pa.py_buffer(upto), pa.py_buffer(raw[kept]))
    shorter = []
    for i in np.flatnonzero(cut & (points > least)):
        word = raw[begins[i] : ends[i]].tobytes().decode()
        k = int(h[i]) % len(word)
        shorter.append(word[:k] + word[k + 1 :])
    return pa.concat_arrays([found, pa.array(shorter, pa.string())])


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``id, word, n`` of all words with at least so many code points and occurrences, numbered in code-point order; durable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.gathered(batches, 8_000_000):
            for part in common.slices(batch, most=8_000_000):
                found = _runs(part.column(0), part.column(1), least_length).value_counts()
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])

    found = common.mapped(common.texts(docs), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
    return common.durable(common.ranked(found, [], ["word"], "id"))


def names(words: pa.Array, least_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The names of every word's strings: two 64-bit halves, the word's place, and the kind."""
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4").astype(np.uint64)
    size = pc.utf8_length(words).to_numpy().astype(np.int64)
    begin = np.cumsum(size) - size
    of = np.repeat(np.arange(len(size)), size)
    nth = np.arange(len(points)) - begin[of]
    fresh = nth == 0
    fresh[1:] |= points[1:] != points[:-1]  # deleting either of two equal neighbours gives the same
    fresh &= size[of] > least_length
    halves = []
    for base in _BASES:
        inverse = np.uint64(pow(base, -1, int(PRIME)))
        powers = np.ones(int(size.max(initial=0)) + 1, np.uint64)
        done = 1
        while done < len(powers):  # doubling
            more = min(done, len(powers) - done)
            powers[done : done + more] = powers[:more] * np.uint64(pow(base, done, int(PRIME))) % PRIME
            done += more
        term = points * powers[nth] % PRIME
        sums = np.concatenate([[np.uint64(0)], np.cumsum(term)])
        total = (sums[begin + size] - sums[begin]) % PRIME
        before = (sums[:-1] - sums[begin][of]) % PRIME
        after = (sums[begin + size][of] - sums[1:]) % PRIME
        wild = (before + after + WILD * powers[nth]) % PRIME
        short = (before[fresh] + after[fresh] * inverse) % PRIME
        halves.append(np.concatenate([wild, total, short]))
    place = np.concatenate([of, np.arange(len(size)), of[fresh]])
    kind = np.repeat(np.array([MEMBER, SELF, SHORTER], np.uint8), [len(of), len(size), int(fresh.sum())])
    return halves[0] << np.uint64(32) | halves[1], halves[2] << np.uint64(32) | halves[3], place, kind


def neighbours(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every word and group with others of its own: the word's id, their number, the best one's count and id."""
    order = np.argsort(rows["a"])
    a = rows["a"][order]
    same = np.zeros(len(a) + 1, bool)
    same[1:-1] = a[1:] == a[:-1]
    rows = rows[order[same[:-1] | same[1:]]]  # most names occur once
    rows = rows[np.lexsort((rows["id"], -rows["n"], rows["kind"], rows["b"], rows["a"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(rows)))
    plain = rows["kind"][first] != MEMBER
    use = (size > 1) & ((rows["kind"][first] == MEMBER) | (rows["kind"][first] == SELF))
    member = np.repeat(use, size)
    head, group_size, group_plain = np.repeat(first, size)[member], np.repeat(size, size)[member], np.repeat(plain, size)[member]
    at = np.flatnonzero(member)
    leads = at == head
    best = np.where(leads, head + 1, head)
    count = np.where(group_plain & ~leads, 1, group_size - 1)
    return rows["id"][at], count, rows["n"][best], rows["id"][best]


def near(known: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """``id, n_near, best_n, best`` of the words (``id, word, n``) that have others near: how many, and the most frequent (smallest id)."""
    total = known.agg(F.sum(2 * F.length("word") + 1)).first()[0] or 0
    parts = int(total // NAMES) + 1
    bounds = np.linspace(0, float(1 << 63), parts + 1)[1:-1].astype(np.uint64)  # names' first halves lie below 2**63

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.gathered(batches, 2_000_000):
            for part in common.slices(batch, column=1, most=1_000_000):
                a, b, place, kind = names(part.column(1), least_length)
                rows = np.empty(len(a), _NAME)
                rows["a"], rows["b"], rows["kind"] = a, b, kind
                rows["id"], rows["n"] = part.column(0).to_numpy()[place], part.column(2).to_numpy()[place]
                rows = rows[np.argsort(a)]
                cuts = [0, *np.searchsorted(rows["a"], bounds).tolist(), len(rows)]
                full = [k for k in range(parts) if cuts[k + 1] > cuts[k]]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([rows[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary())], schema=SENT)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(x.as_py(), _NAME) for batch in batches for x in batch.column("names")]
        if held:
            columns = neighbours(np.concatenate(held))
            for a in range(0, len(columns[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 100_000].astype(np.int64)) for c in columns], schema=NEAR)

    sent = common.mapped(known.select("id", "word", "n"), deal, "range int, names binary").repartitionById(parts, F.col("range"))
    found = common.mapped(sent, match, "id long, near long, best_n long, best long")
    best = F.max(F.struct("best_n", -F.col("best")))
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), best.alias("b")).select("id", "n_near", F.col("b.best_n").alias("best_n"), (-F.col("b.col2")).alias("best"))


def variants(docs: DataFrame, factor: int = FACTOR, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: of every word its near word of largest count, if that is at least
    ``factor`` times its own, the last of its forms (itself if it has none), and the number of near words."""
    known = vocabulary(docs, least_length, least_count)
    found = known.join(near(known, least_length), "id", "left")
    found = common.durable(found.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(F.col("best_n") >= factor * F.col("n"), F.col(c)).alias(d) for c, d in (("best", "form_id"), ("best_n", "form_n"))]))
    formed = found.where(F.col("form_id").isNotNull())
    ends = formed.select("id", F.col("form_id").alias("to"))
    steps = 1  # the longest chain that ``ends`` has followed
    most = known.agg(F.max("n")).first()[0] or 0
    while least_count * factor**steps <= most:
        on = ends.select(F.col("id").alias("to"), F.col("to").alias("further"))
        ends = common.durable(ends.join(on, "to", "left").select("id", F.coalesce("further", "to").alias("to")))
        steps *= 2
    spelling = known.select(F.col("id").alias("of"), F.col("word").alias("spelt"))
    named = formed.select("id", "form_id").join(ends, "id")
    named = named.join(spelling.withColumnsRenamed({"of": "form_id", "spelt": "form"}), "form_id").join(spelling.withColumnsRenamed({"of": "to", "spelt": "root"}), "to").select("id", "form", "root")
    return found.join(named, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
