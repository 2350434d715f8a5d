"""Phrase collocation mining over packed word ids.

1. Texts become blocks: a stream of local word codes with breaks, and the block's distinct words with counts.
   Counts are summed by (language, word), and words that reach ``least`` are the dictionary, numbered
   in their order.  Codes become ids by a join of the blocks' distinct words with the dictionary, so nothing
   that grows with the corpus is broadcast; a word that is no dictionary word breaks its piece, since no
   phrase that holds it can reach ``least``.
2. For 2, 3, .. words: n-grams of ids are packed into binary keys of 4 bytes a word, radix-sorted and counted in
   runs per task, cut at the bounds of key ranges and sent to the ranges' tasks as packed blocks; those sort
   and count runs again.  A longer n-gram is packed only where both its shorter ends have reached
   ``least``, by a bitmap of bounded size (what slips through costs time, never a result).
3. Scores, containment and the best of each language are joins and aggregations of the frequent phrases.

A hot word, pair or passage is one entry of each task's counts, so no range gets more of it than a row a task.

Cases: null text is empty, null language is ``und``; repeated rows count again; a text of any length is one
block (some 20 bytes of memory a byte of text); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm import common

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

BLOCKS = "block long, codes binary, size long, words array<string>, counts array<long>, langs array<string>, totals array<long>"
_BLOCKS = pa.schema([("block", pa.int64()), ("codes", pa.binary()), ("size", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())), ("totals", pa.list_(pa.int64()))])
STREAM = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("size", pa.int64())])
PACKED = pa.schema([("range", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
COUNTED = pa.schema([("key", pa.binary()), ("a", pa.int64()), ("hash", pa.int64())])
KEY_BYTES = 24_000_000  # of keys sorted at a time
BITS = 1 << 26  # at most, of the bitmap


def _squeezed(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), "zstd", asbytes=True)


def _unsqueezed(raw: bytes, size: int, dtype: str = "<u4") -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, 4 * size, "zstd", asbytes=True), dtype)


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of a string array without nulls, their documents' places, and whether a break stands before each."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    raw = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = _KIND[raw]
    inside = kind == 0
    opens = np.zeros(len(raw) + 1, bool)  # a document begins here
    opens[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | opens[1:-1]
    begins = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | opens[1:-1]
    length = np.flatnonzero(ends) + 1 - begins
    doc = np.searchsorted(offsets, begins, "right") - 1
    part = np.cumsum(kind == 2, dtype=np.int64)[begins]
    breaks = np.ones(len(begins), bool)
    breaks[1:] = (np.diff(part) != 0) | (np.diff(doc) != 0)
    upto = np.zeros(len(begins) + 1, np.int32)
    np.cumsum(length, out=upto[1:])
    found = pa.StringArray.from_buffers(len(begins), pa.py_buffer(upto), pa.py_buffer(_LOWER[raw[inside]]))
    return found, doc, breaks


def block(langs: pa.Array, texts: pa.Array, number: int) -> pa.RecordBatch:
    """One block of texts as a row of ``BLOCKS``; its distinct words are ``<language> tab <word>``."""
    found, doc, breaks = words(texts)
    known, lang = found.dictionary_encode(), langs.dictionary_encode()
    of = lang.indices.to_numpy()[doc].astype(np.int64)
    n = max(1, len(known.dictionary))
    both = of * n + known.indices.to_numpy()
    distinct, codes, counts = np.unique(both, return_inverse=True, return_counts=True)
    keys = pc.binary_join_element_wise(lang.dictionary.take(pa.array(distinct // n)), known.dictionary.take(pa.array(distinct % n)), "\t")
    stream = np.zeros(len(codes) + int(breaks.sum()), "<u4")
    stream[np.arange(len(codes)) + np.cumsum(breaks)] = codes + 1
    totals = np.bincount(of, minlength=len(lang.dictionary))
    one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))
    columns = [pa.array([number], pa.int64()), pa.array([_squeezed(stream)], pa.binary()), pa.array([len(stream)], pa.int64()), one(keys, pa.string()), one(pa.array(counts), pa.int64()), one(lang.dictionary, pa.string()), one(pa.array(totals), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, schema=_BLOCKS)


def blocks(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The texts as durable rows of ``BLOCKS``, of some 8 MB each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in common.gathered(batches, 8_000_000):
            for part in common.slices(batch, most=8_000_000):
                yield block(part.column(0), part.column(1), number)
                number += 1

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return common.durable(common.mapped(rows, run, BLOCKS))


def dictionary(made: DataFrame, least: int) -> DataFrame:
    """``key, lang, word, f, id`` of the words that occur ``least`` times in their language; ids from 1, below 2**32."""
    occurring = made.select(F.inline(F.arrays_zip("words", "counts"))).groupBy(F.col("words").alias("key")).agg(F.sum("counts").alias("f"))
    known = common.ranked(occurring.where(F.col("f") >= least), [], ["key"], "id").withColumns({"id": F.col("id") + 1, "word": F.substring_index("key", "\t", -1)})
    return common.durable(known.withColumn("lang", F.expr("left(key, length(key) - length(word) - 1)")))


def encoded(made: DataFrame, known: DataFrame) -> DataFrame:
    """Every block's stream of ids as durable rows of ``STREAM``: 0 is a break, and so is every word without id."""
    word = made.select("block", F.posexplode("words").alias("pos", "key")).join(known.select("key", "id"), "key", "left")
    ids = word.groupBy("block").agg(F.collect_list("pos").alias("pos"), F.collect_list(F.coalesce("id", F.lit(0))).alias("id"))
    rows = made.select("block", "codes", "size").join(ids, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                number, codes, size, pos, new = (batch.column(k).slice(i, 1) for k in range(5))
                stream = _unsqueezed(codes[0].as_py(), size[0].as_py())
                table = np.zeros(int(stream.max(initial=0)) + 1, "<u4")
                table[pos.flatten().to_numpy() + 1] = new.flatten().to_numpy()
                stream = table[stream]
                beside = np.zeros(len(stream) + 2, bool)
                beside[1:-1] = stream != 0
                stream = stream * (beside[:-2] | beside[2:])  # a word alone is in no phrase
                keep = stream != 0
                keep[1:] |= keep[:-1].copy()  # one break behind each run is enough
                stream = stream[keep]
                yield pa.RecordBatch.from_arrays([number, pa.array([_squeezed(stream)], pa.binary()), pa.array([len(stream)], pa.int64())], schema=STREAM)

    return common.durable(common.mapped(rows, run, "block long, ids binary, size long"))


def radix(columns: list[np.ndarray]) -> np.ndarray:
    """The order that sorts keys of several uint32 columns, first column first: least digit first, 16 bits a pass."""
    order = None
    for column in reversed(columns):
        for digit in (column & 0xFFFF, column >> 16):
            digit = digit.astype(np.uint16)
            if order is None:
                order = np.argsort(digit, kind="stable")
            elif digit.any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def counted(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct keys in order with their counts: radix sort, then lengths of runs."""
    if not len(columns[0]):
        return columns, np.zeros(0, np.int64)
    order = radix(columns)
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    sums = np.diff(np.append(at, len(order))) if counts is None else np.add.reduceat(counts[order], at)
    return [c[at] for c in columns], sums.astype(np.int64)


def hashes(columns: list[np.ndarray]) -> np.ndarray:
    """64 bits of every key."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def grams(stream: np.ndarray, m: int, bitmap: np.ndarray | None) -> list[np.ndarray]:
    """The ``m`` columns of all n-grams of ``m`` ids within runs; with the shorter ones' bitmap only those whose both ends are in it."""
    n = len(stream) - m + 1
    if n <= 0:
        return [np.zeros(0, np.uint32)] * m
    good = np.ones(n, bool)
    for k in range(m):
        good &= stream[k : k + n] != 0
    at = np.flatnonzero(good)
    columns = [stream[at + k] for k in range(m)]
    if bitmap is not None:
        mask = np.uint64(64 * len(bitmap) - 1)
        for end in (slice(None, -1), slice(1, None)):
            h = hashes(columns[end]) & mask
            ok = (bitmap[h >> np.uint64(6)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)
            columns = [c[ok] for c in columns]
    return columns


def _bytes(columns: list[np.ndarray]) -> np.ndarray:
    return np.ascontiguousarray(np.stack(columns, 1).astype(">u4"))


def _bounds(streams: DataFrame, m: int, bitmap, parts: int, total: int) -> np.ndarray:
    """Bounds of key ranges, from n-grams of some hundred blocks picked by hash (they decide on nothing else)."""
    share = min(1.0, 200 / max(1, total))
    picked = streams.where(F.pmod(F.xxhash64("block"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, size in zip(batch.column("ids"), batch.column("size")):
                columns = grams(_unsqueezed(ids.as_py(), size.as_py()), m, bitmap.value if bitmap else None)
                step = max(1, len(columns[0]) // 2000)
                keys = _bytes([c[step // 2 :: step] for c in columns])
                yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary()), pa.array([len(columns[0])], pa.int64())], ["keys", "n"])

    rows = common.mapped(picked, run, "keys binary, n long").toArrow()
    keys = np.sort(np.frombuffer(b"".join(rows.column("keys").to_pylist()), f"S{4 * m}"))
    wanted = int(max(parts, sum(rows.column("n").to_pylist()) / share // 4_000_000))
    return np.unique(keys[np.linspace(0, len(keys) - 1, wanted + 1).astype(int)[1:-1]]) if len(keys) else keys


def frequent(streams: DataFrame, m: int, least: int, bitmap, total: int) -> DataFrame:
    """``key`` (4 bytes an id, big-endian), ``a`` and ``hash`` of the n-grams of ``m`` ids with ``least`` occurrences; durable."""
    spark = streams.sparkSession
    bounds = spark.sparkContext.broadcast(_bounds(streams, m, bitmap, int(spark.conf.get("spark.sql.shuffle.partitions")), total))

    def packed(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        columns, counts = counted([np.concatenate(c) for c in zip(*held)])
        raw = _bytes(columns)
        cuts = [0, *np.searchsorted(np.frombuffer(raw.tobytes(), f"S{4 * m}"), bounds.value).tolist(), len(counts)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([raw[a:b].tobytes()], pa.binary()), pa.array([counts[a:b].tobytes()], pa.binary())], schema=PACKED)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for ids, n in zip(batch.column("ids"), batch.column("size")):
                held.append(grams(_unsqueezed(ids.as_py(), n.as_py()), m, bitmap.value if bitmap else None))
                size += 4 * m * len(held[-1][0])
                if size >= KEY_BYTES:
                    yield from packed(held)
                    held, size = [], 0
        if held:
            yield from packed(held)

    def merged(held: list[tuple]) -> tuple[list[np.ndarray], np.ndarray]:
        return counted([np.concatenate([columns[k] for columns, _ in held]) for k in range(m)], np.concatenate([counts for _, counts in held]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, limit = [], 0, KEY_BYTES
        for batch in batches:
            for keys, counts in zip(batch.column("keys"), batch.column("counts")):
                raw = np.frombuffer(keys.as_py(), ">u4").reshape(-1, m)
                held.append(([raw[:, k].astype(np.uint32) for k in range(m)], np.frombuffer(counts.as_py(), np.int64)))
                size += 4 * len(raw) * (m + 2)
                if size >= limit:
                    held = [merged(held)]
                    size = 4 * len(held[0][1]) * (m + 2)
                    limit = max(KEY_BYTES, 2 * size)
        if not held:
            return
        columns, counts = merged(held)
        columns, counts = [c[counts >= least] for c in columns], counts[counts >= least]
        for a in range(0, len(counts), 50_000):
            part = [c[a : a + 50_000] for c in columns]
            raw = _bytes(part).tobytes()
            upto = np.arange(0, len(raw) + 1, 4 * m, dtype=np.int32)
            keys = pa.BinaryArray.from_buffers(pa.binary(), len(part[0]), [None, pa.py_buffer(upto), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([keys, pa.array(counts[a : a + 50_000]), pa.array(hashes(part).view(np.int64))], schema=COUNTED)

    sent = common.mapped(streams, pack, "range int, keys binary, counts binary").repartitionById(len(bounds.value) + 1, F.col("range"))
    return common.durable(common.mapped(sent, merge, "key binary, a long, hash long"))


def _bitmap(found: DataFrame, n: int):
    """The hashes' bits, some 32 for each and ``BITS`` at most."""
    bits = min(BITS, 1 << max(10, (32 * n).bit_length()))
    low = F.col("hash").bitwiseAND(F.lit(bits - 1))
    words = found.groupBy(F.shiftright(low, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((hash & {bits - 1}L) & 63L as int))")).alias("w")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words.column("at").to_numpy()] = words.column("w").to_numpy().view(np.uint64)
    return found.sparkSession.sparkContext.broadcast(table)


def phrases(docs: DataFrame, least: int = 100, longest: int = 5, most: int | None = None, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Frequent phrases: ``lang, phrase, words, a, l, r, n, score, contained``; ``contained`` are those whose every
    occurrence lies in an occurrence of one longer phrase.  With ``most`` each language's best that are not, with ``rank``."""
    made = blocks(docs, lang_col, text_col)
    known = dictionary(made, least)
    totals = made.select(F.inline(F.arrays_zip("langs", "totals"))).groupBy(F.col("langs").alias("lang")).agg(F.sum("totals").alias("n"))
    streams = encoded(made, known)
    total = streams.count()
    counts = known.select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("key"), F.col("f").alias("a"))
    bitmap = None
    for m in range(2, longest + 1):
        found = frequent(streams, m, least, bitmap, total)
        n = found.count()
        if not n:
            break
        counts = counts.unionByName(found.select("key", "a"))
        bitmap = _bitmap(found, n)
    scored = _scored(counts, known, totals)
    if most is None:
        return spelled(scored, known).drop("key")
    by = [F.desc("score"), F.desc("a")]
    best = scored.where(~F.col("contained")).withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= most)
    named = spelled(common.durable(best), known).drop("key")
    return named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by, "phrase")).cast("long")).where(F.col("rank") <= most)


def digest(found: DataFrame) -> DataFrame:
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _scored(counts: DataFrame, known: DataFrame, totals: DataFrame) -> DataFrame:
    size = F.expr("int(length(key) / 4)")
    candidates = counts.where(F.length("key") > 4)
    # a phrase lies inside a longer one all the time if it does in one that has a word more
    longer = candidates.where(F.length("key") > 8).select("a", F.explode(F.array(F.expr("substring(key, 1, length(key) - 4)"), F.expr("substring(key, 5)"))).alias("key"))
    longer = longer.groupBy("key").agg(F.max("a").alias("within"))
    cuts = candidates.select("key", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.expr("substring(key, 1, 4 * k)"), "right": F.expr("substring(key, 4 * k + 1)")})
    cuts = cuts.join(counts.select(F.col("key").alias("left"), F.col("a").alias("l")), "left").join(counts.select(F.col("key").alias("right"), F.col("a").alias("r")), "right")
    first = F.expr("conv(hex(substring(key, 1, 4)), 16, 10)").cast("long")
    cuts = cuts.withColumn("id", first).join(known.select("id", "lang"), "id").join(F.broadcast(totals), "lang")
    whole = lambda name, digits: F.col(name).cast(f"decimal({digits},0)")
    cuts = cuts.withColumn("product", (F.lit(1000) * F.col("a")).cast("decimal(18,0)") * whole("n", 19)).withColumn("parts", whole("l", 18) * whole("r", 19))
    cuts = cuts.withColumn("score", F.expr("product div parts"))
    best = cuts.groupBy("key").agg(F.min(F.struct("score", "k", "l", "r", "a", "n", "lang")).alias("b")).select("key", "b.*")
    best = best.join(longer, "key", "left").withColumn("contained", F.coalesce(F.col("within") >= F.col("a"), F.lit(False)))
    return best.select("key", "lang", size.alias("words"), "a", "l", "r", "n", "score", "contained")


def spelled(found: DataFrame, known: DataFrame) -> DataFrame:
    """``found`` with the words of ``key``, ``phrase``."""
    parts = found.select("key", F.explode(F.sequence(F.lit(0), F.col("words") - 1)).alias("i")).withColumn("id", F.expr("conv(hex(substring(key, 4 * i + 1, 4)), 16, 10)").cast("long"))
    text = parts.join(known.select("id", "word"), "id").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return found.join(text, "key")
