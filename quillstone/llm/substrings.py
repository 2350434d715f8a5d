"""Removal of every byte covered by a long string that occurs earlier.

A string of ``length`` bytes is judged by its start: if the same bytes also start earlier (smaller
doc_id, or the same document at a smaller position) all of them are removed.  The work is done by
a logarithmic family of suffix arrays (Bentley and Saxe's logarithmic method): the suffixes of each
new batch are sorted by their first ``length`` bytes into a suffix array, which is merge-scanned
against the arrays of the family's levels for matches of ``length`` bytes and becomes a level of
its own; levels of about equal size merge, so there are few.  One family per partition takes the
suffixes that belong together:

1. Anchors.  Of the 32-byte strings in each ``length``-byte window the one with the least hash
   (the leftmost of equals) is the window's anchor, so equal windows have equal anchors.  Anchors
   are counted over the corpus; windows whose anchor occurs once cannot repeat and are done.
2. The others are dealt out by their anchor, with just the bytes that their windows cover.
   Windows under an anchor of more than ``HOT`` occurrences first pass a family inside their map
   task; what is new there is dealt out by the whole window instead, so no anchor or passage
   gathers in one task: a common string arrives once from every map task.
3. Each partition feeds its rows, in order of (doc_id, start), to its family.

Texts that repeat as a whole are settled beforehand: all but the one with the smallest doc_id lose
every byte if they have ``length`` bytes or more.

Cases: null text is empty; texts shorter than ``length`` stay; repeated rows of one id and text
are the same document and keep what one row would keep; rows of one id with different texts are
one document to the order; rows with a null id are returned whole; a text of any length is cut
into windows like the others, its own repeats included; an empty table gives an empty result; other
columns are not read.  Positions are bytes, so spans may cut characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import common

ANCHOR = 32
#: Occurrences of an anchor from which its windows are dealt out one by one.
HOT = 2000
#: Bytes of text of a batch, work (in suffixes; 32 bytes cost about as much as one) that a batch of a
#: family takes in, and bytes that a partition is planned for.
BATCH, WORK, PART = 1_000_000, 400_000, 3_000_000
#: Rows of single strings that leave a task at a time.
ROWS = 20_000
#: Parts that the copies of one text are spread over where they are joined.
SALTS = 16
#: Odd multipliers of the fingerprints; any will do, since matches are compared byte by byte.
_M = [np.uint64(int.from_bytes(hashlib.sha256(b"%d" % i).digest()[:8], "little") | 1) for i in range(64)]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column."""
    column = column.cast(pa.binary()) if pa.types.is_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _words(data: np.ndarray, n: int, extra: int) -> np.ndarray:
    """The eight bytes from each of the first ``n + extra`` positions; zeros follow the data."""
    padded = np.zeros(n + extra + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((n + extra,), "<u8", padded, strides=(1,)).copy()


def _hash(words: np.ndarray, at: list[int], n: int) -> np.ndarray:
    return _hash_of(words[a : a + n] for a in at)


def _hash_of(words: Iterable[np.ndarray]) -> np.ndarray:
    h: np.ndarray | None = None
    for m, w in zip(_M, words):
        h = w * m if h is None else np.add(h, w * m, out=h)
    h ^= h >> np.uint64(29)
    h *= _M[40]
    h ^= h >> np.uint64(32)
    return h


def _steps(length: int) -> list[int]:
    """Offsets of the eight-byte words that cover ``length`` bytes."""
    return [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of the texts ``data[offsets[k]:offsets[k+1]]``: text number, position of the
    anchor, its hash, and the first and last window start that it stands for (in the text)."""
    none = np.zeros(0, np.int64)
    lens = np.diff(offsets)
    if not len(lens) or lens.max() < length:
        return none, none, none, none, none
    n = len(data)
    h = _hash(_words(data, n, ANCHOR), _steps(ANCHOR), n)
    least = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(n, dtype=np.uint64)
    span, wide = length - ANCHOR + 1, 1
    while 2 * wide <= span:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < span:
        least = np.minimum(least[: len(least) - (span - wide)], least[span - wide :])
    windows = np.maximum(lens - length + 1, 0)
    text = np.repeat(np.arange(len(lens)), windows)
    first = np.cumsum(windows) - windows
    start = np.arange(len(text)) - first[text] + offsets[text]
    at = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(new[1:], len(at)) - 1
    text, at = text[new], at[new]
    base = offsets[text]
    return text, at - base, h[at].view(np.int64), start[new] - base, start[last] - base


def _groups(data: np.ndarray, offsets: np.ndarray, most: int = BATCH) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes (or of whatever else ``offsets`` sums up)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b


def _text_words(data: np.ndarray, kind: str) -> np.ndarray:
    """The eight bytes from every position of padded data as a view, '<u8' or, to be compared as text, '>u8'."""
    return np.ndarray((len(data) - 7,), kind, data, strides=(1,))


def suffix_array(data: np.ndarray, at: np.ndarray, steps: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at ``at`` by their first bytes (``steps`` are the offsets of the
    words compared), ties in the given order; and which are the first of equal ones.

    Every pass sorts those still tied by their next eight bytes, inside their groups."""
    words = _text_words(data, ">u8")
    first = words[at].astype(np.uint64)
    order = np.argsort(first, kind="stable")
    first = first[order]
    new = np.concatenate([[True], first[1:] != first[:-1]]) if len(at) else np.zeros(0, bool)
    for s in steps[1:]:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        group = np.cumsum(new)[tied]
        value = words[at[order[tied]] + s].astype(np.uint64)
        sub = np.lexsort((value, group))
        order[tied] = order[tied[sub]]
        value = value[sub]
        new[tied[1:]] |= (value[1:] != value[:-1]) | (group[1:] != group[:-1])
    return order, new


class Level:
    """A suffix array: distinct strings in the order of their bytes, where each starts in ``data``
    (padded by eight bytes), and its first place in the corpus."""

    def __init__(self, data: np.ndarray, at: np.ndarray, doc: np.ndarray, start: np.ndarray):
        self.data, self.at, self.doc, self.start = data, at.astype(np.int32), doc, start.astype(np.int32)
        self.first = _text_words(data, ">u8")[self.at].astype(np.uint64)

    def locate(self, data: np.ndarray, at: np.ndarray, steps: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Where the sorted suffixes ``at`` of ``data`` belong in this array, and whether they are there.

        The range of equals is narrowed word by word, for all suffixes at once."""
        mine, theirs = _text_words(self.data, ">u8"), _text_words(data, ">u8")
        first = theirs[at].astype(np.uint64)
        low, high = np.searchsorted(self.first, first, "left"), np.searchsorted(self.first, first, "right")
        k = np.flatnonzero(low < high)
        found = np.zeros(len(at), bool)
        for i, s in enumerate(steps[1:], 1):
            one = high[k] - low[k] == 1
            self._compare(mine, theirs, at, k[one], steps[i:], low, found)
            k = k[~one]
            if not len(k):
                return low, found
            value = theirs[at[k] + s]
            low[k], high[k] = self._bound(mine, s, value, low[k], high[k], False), self._bound(mine, s, value, low[k], high[k], True)
            k = k[low[k] < high[k]]
        found[k] = True
        return low, found

    def _compare(self, mine: np.ndarray, theirs: np.ndarray, at: np.ndarray, k: np.ndarray, steps: list[int], low: np.ndarray, found: np.ndarray) -> None:
        """Settles those with one suffix left to be equal to: it is, or they belong before or after it."""
        a, b = self.at[low[k]].astype(np.int64), at[k]
        for s in steps:
            x, y = mine[a + s], theirs[b + s]
            low[k[x < y]] += 1
            same = x == y
            if not same.all():
                k, a, b = k[same], a[same], b[same]
        found[k] = True

    def _bound(self, words: np.ndarray, s: int, value: np.ndarray, low: np.ndarray, high: np.ndarray, above: bool) -> np.ndarray:
        """Bisection in [low, high) for the first suffix whose word at ``s`` is not below ``value`` (or, ``above``, is above it)."""
        low, high = low.copy(), high.copy()
        open_ = np.arange(len(low))
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            seen, wanted = words[self.at[middle] + s], value[open_]
            right = seen <= wanted if above else seen < wanted
            low[open_[right]] = middle[right] + 1
            high[open_[~right]] = middle[~right]
            open_ = open_[low[open_] < high[open_]]
        return low

    def merged(self, other: "Level", steps: list[int]) -> "Level":
        """Both arrays as one; they have no string in common."""
        big, small = (self, other) if len(self.at) >= len(other.at) else (other, self)
        place = big.locate(small.data, small.at, steps)[0] + np.arange(len(small.at))
        from_big = np.ones(len(big.at) + len(small.at), bool)
        from_big[place] = False

        def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            out = np.empty(len(from_big), a.dtype)
            out[from_big], out[place] = a, b
            return out

        shift = len(big.data)
        return Level(np.concatenate([big.data, small.data]), both(big.at, small.at + np.int32(shift)), both(big.doc, small.doc), both(big.start, small.start))


def _same(a: np.ndarray, x: np.ndarray, y: np.ndarray, steps: list[int]) -> np.ndarray:
    """Whether the strings at ``x`` and at ``y`` in ``a`` are equal."""
    words = _text_words(a, "<u8")
    same = np.ones(len(x), bool)
    for s in steps:
        same &= words[x + s] == words[y + s]
    return same


class Family:
    """Levels of suffix arrays; batches must come in the order of (doc, start)."""

    def __init__(self, length: int):
        self.length, self.steps = length, _steps(length)
        self.levels: list[Level] = []

    def _fingerprints(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = len(data) - 8
        if len(at) * 4 > n:
            return _hash(_words(data[:n], n, self.length), self.steps, n)[at]
        words = _text_words(data, "<u8")
        return _hash_of([words[at + s] for s in self.steps])

    def add(self, data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Takes pieces of text in, all of whose strings count; ``first`` is where in its document
        a piece starts.  Returns for every string its piece, its offset there, its fingerprint,
        whether it occurs earlier, and whether it was new to the family."""
        data = np.concatenate([data, np.zeros(8, np.uint8)])
        windows = np.maximum(np.diff(offsets) - self.length + 1, 0)
        piece = np.repeat(np.arange(len(windows)), windows)
        inside = np.arange(len(piece)) - (np.cumsum(windows) - windows)[piece]
        if not len(piece):
            return piece, inside, np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, bool)
        at = offsets[piece] + inside
        docs, starts = doc[piece], first[piece] + inside
        fp = self._fingerprints(data, at)
        # equal strings of the batch are merged before they are sorted
        order = np.argsort(fp)
        sorted_ = fp[order]
        new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
        group = np.empty(len(fp), np.int64)
        group[order] = np.cumsum(new) - 1
        heads = np.minimum.reduceat(order, np.flatnonzero(new))  # the earliest of each
        if not _same(data, at, at[heads[group]], self.steps).all():  # a fingerprint of two strings
            order, new = suffix_array(data, at, self.steps)
            group[order] = np.cumsum(new) - 1
            heads = order[new]
        sorted_, _ = suffix_array(data, at[heads], self.steps)
        heads = heads[sorted_]
        rank = np.empty(len(heads), np.int64)
        rank[sorted_] = np.arange(len(heads))
        number = rank[group]
        known_doc, known_start = docs[heads], starts[heads]
        left = np.arange(len(heads))
        for level in self.levels:
            place, hit = level.locate(data, at[heads[left]], self.steps)
            known_doc[left[hit]], known_start[left[hit]] = level.doc[place[hit]], level.start[place[hit]]
            left = left[~hit]
        earlier = (known_doc[number] != docs) | (known_start[number] != starts)
        keep = heads[left]
        fresh = np.zeros(len(fp), bool)
        fresh[keep] = True
        if len(keep):
            self.levels.append(Level(data, at[keep], docs[keep], starts[keep]))
            while len(self.levels) > 1 and len(self.levels[-2].at) < 2 * len(self.levels[-1].at):
                last = self.levels.pop()
                self.levels[-1] = self.levels[-1].merged(last, self.steps)
        return piece, inside, fp, earlier, fresh


def _runs(piece: np.ndarray, inside: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of flagged neighbours in a piece: piece, first, last."""
    k = np.flatnonzero(flag)
    if not len(k):
        return k, k, k
    cut = (piece[k][1:] != piece[k][:-1]) | (inside[k][1:] != inside[k][:-1] + 1)
    a = np.concatenate([[True], cut])
    b = np.concatenate([cut, [True]])
    return piece[k[a]], inside[k[a]], inside[k[b]]


_PIECE = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("bytes", pa.binary())])
_SPAN = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("span", pa.int64())])


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _find_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = _flat(batch.column(1))
            for a, b in _groups(data, offsets):
                text, at, h, _, _ = anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length)
                if len(text):
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids[a + text]), pa.array(at.astype(np.int32))], names=["h", "k", "at"])

    return run


def _cut_pieces(length: int):
    """Rows ``doc_id, th, text, hits`` to pieces; a row without bytes carries a span found here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Family(length)
        for batch in batches:
            ids, ths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = _flat(batch.column(2))
            hits = batch.column(3)
            for a, b in _groups(data, offsets):
                part, offs = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                text, at, h, lo, hi = anchors(part, offs, length)
                if not len(text):
                    continue
                marks = hits.slice(a, b - a)
                owner = np.repeat(np.arange(b - a), marks.value_lengths().fill_null(0).to_numpy())
                code = marks.flatten().to_numpy()
                place = offs[:-1]
                found = np.unique(place[owner] * 2 + code)  # (position in part) * 2 + hot
                want = (place[text] + at) * 2
                cold, hot = np.isin(want, found), np.isin(want + 1, found)
                raw = part.tobytes()
                k = np.flatnonzero(cold)
                x, y = place[text[k]] + lo[k], place[text[k]] + hi[k] + length
                yield _batch(_PIECE, h[k], ids[a + text[k]], ths[a + text[k]], lo[k], hi[k], [raw[p:q] for p, q in zip(x.tolist(), y.tolist())])
                k = np.flatnonzero(hot)
                if not len(k):
                    continue
                x, y = place[text[k]] + lo[k], place[text[k]] + hi[k] + length
                offs_k = np.concatenate([[0], np.cumsum(y - x)])
                own = np.frombuffer(b"".join(raw[p:q] for p, q in zip(x.tolist(), y.tolist())), np.uint8)
                doc, th = ids[a + text[k]], ths[a + text[k]]
                piece, inside, fp, earlier, fresh = family.add(own, offs_k, doc, lo[k])
                p, s, e = _runs(piece, inside, earlier)
                yield _batch(_PIECE, doc[p] * 31 + s, doc[p], th[p], lo[k][p] + s, lo[k][p] + e, [b""] * len(p))
                new = np.flatnonzero(fresh)
                for c in range(0, len(new), ROWS):
                    j = new[c : c + ROWS]
                    begin = (x[piece[j]] + inside[j]).tolist()
                    spot = lo[k][piece[j]] + inside[j]
                    yield _batch(_PIECE, fp[j].view(np.int64), doc[piece[j]], th[piece[j]], spot, spot, [raw[q : q + length] for q in begin])

    return run


def _search(length: int):
    """Pieces in the order of (doc_id, first) to spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Family(length)
        for batch in common.gathered(batches, 6_000_000):
            doc, th, first, last = (batch.column(i).to_numpy() for i in (1, 2, 3, 4))
            data, offsets = _flat(batch.column(5))
            done = offsets[1:] == offsets[:-1]
            yield _batch(_SPAN, doc[done], th[done], (first[done] << 32) + last[done] + length)
            work = np.concatenate([[0], np.cumsum(np.maximum(np.diff(offsets) - length + 1, 0) + np.diff(offsets) // 32 + 1)])
            for a, b in _groups(data, work, WORK):
                piece, inside, _, earlier, _ = family.add(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], doc[a:b], first[a:b])
                p, s, e = _runs(piece, inside, earlier)
                p = p + a
                yield _batch(_SPAN, doc[p], th[p], ((first[p] + s) << 32) + first[p] + e + length)

    return run


def spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """``doc_id, th`` (hash of the text) ``, spans``: parts to remove as ``start << 32 | end``, in no
    order and overlapping; for copies of whole texts the span of the whole."""
    if length < 2 * ANCHOR:
        raise ValueError(f"length must be {2 * ANCHOR} at least")
    spark = docs.sparkSession
    keyed = common.texts(docs).where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("th"), F.xxhash64("doc_id", "text").alias("k"))
    heads = keyed.where(F.octet_length("text") >= length).select("doc_id", "th", "k", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n"))
    first = heads.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    # the copies of one text may be a third of all rows: they meet their first one in SALTS parts
    first = first.select("sha", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    copies = heads.withColumn("salt", F.pmod(F.xxhash64("doc_id", "sha"), F.lit(SALTS)).cast("int")).join(first, ["sha", "salt"]).where("doc_id > first")
    copies = common.durable(copies.select("doc_id", "th", "k", F.col("n").alias("span")).distinct())

    found = common.mapped(keyed.select("k", "text"), _find_anchors(length), "h long, k long, at int")
    often = found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", (F.col("n") > HOT).cast("int").alias("hot"))
    often = common.durable(often)  # read from a table, the join's sides are plain exchanges, which Spark splits where skewed
    marks = found.join(often.hint("merge"), "h").groupBy("k").agg(F.collect_set(F.col("at").cast("long") * 2 + F.col("hot")).alias("hits"))
    # whole copies go here, beside the small table, so that texts are shuffled once and by one key
    marks = common.durable(marks.join(copies.select("k").hint("merge"), "k", "left_anti"))
    pieces = marks.select(F.sum(F.size("hits"))).first()[0] or 0
    rows = keyed.join(marks.hint("merge"), "k")
    cut = common.mapped(rows.select("doc_id", "th", "text", "hits").sortWithinPartitions("doc_id"), _cut_pieces(length), "key long, doc_id long, th long, first long, last long, bytes binary")
    parts = max(spark.sparkContext.defaultParallelism, int(pieces * 1.5 * length) // PART)
    dealt = cut.repartition(parts, "key").sortWithinPartitions("doc_id", "first")
    parts_found = common.mapped(dealt, _search(length), "doc_id long, th long, span long").groupBy("doc_id", "th").agg(F.collect_set("span").alias("spans"))
    return common.durable(parts_found.unionAll(copies.select("doc_id", "th", F.array("span").alias("spans"))))


_KEPT = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("removed", pa.list_(pa.int64())), ("kept", pa.binary())])


def _keep(text: bytes, found: np.ndarray) -> tuple[int, int, int, list[int], bytes]:
    out, gone, at, merged = [], 0, 0, []
    if len(found):
        s = np.sort(found)
        start, end = s >> 32, np.maximum.accumulate(s & 0xFFFFFFFF)
        k = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
        for a, b in zip(start[k].tolist(), end[np.append(k[1:], len(s)) - 1].tolist()):
            out.append(text[at:a])
            gone, at = gone + b - a, b
            merged += [a, b]
    out.append(text[at:])
    return len(text), gone, len(merged) // 2, merged, b"".join(out)


def _kept(text: pa.Array, found: pa.Array) -> pa.Array:
    none = np.zeros(0, np.int64)
    parts = ((text.slice(a, 500).cast(pa.binary()).to_pylist(), found.slice(a, 500)) for a in range(0, len(text), 500))
    rows = [_keep(t, f.values.to_numpy() if f.is_valid else none) for ts, fs in parts for t, f in zip(ts, fs)]
    columns = list(zip(*rows)) or [()] * 5
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _KEPT)], fields=list(_KEPT))


def _joined(docs: DataFrame, length: int) -> DataFrame:
    """``row`` (all columns), ``text`` (null is empty) and ``spans``."""
    found = spans(docs, length).select(F.col("doc_id").alias("id"), F.col("th").alias("of"), "spans")
    rows = common.whole(docs).withColumn("text", F.coalesce(F.col("row.text").cast("string"), F.lit("")))
    rows = rows.join(found.hint("merge"), (F.col("row.doc_id").cast("long") == F.col("id")) & (F.xxhash64("text") == F.col("of")), "left")
    return rows.select("row", "text", "spans")


def dedup(docs: DataFrame, length: int = 100) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, removed`` (starts and ends in turn) ``, kept`` (bytes)
    of every row."""
    kept = F.arrow_udf(_kept, "n_bytes long, n_removed long, n_spans long, removed array<long>, kept binary")
    return _joined(common.texts(docs), length).select("row.doc_id", kept("text", "spans").alias("r")).select("doc_id", "r.*")


def cleaned(docs: DataFrame, length: int = 100) -> DataFrame:
    """The rows of ``docs`` with what is left of their texts (bytes of cut characters go) and, where
    there is such a column, its length in ``n_chars``.  Rows that lose nothing stay as they are."""
    rows = _joined(docs, length).select("row", F.arrow_udf(_left, "string")("text", "spans").alias("left"))
    row = F.col("row").withField("text", F.col("left"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("left").cast(docs.schema["n_chars"].dataType))
    return rows.select(F.when(F.col("left").isNull(), F.col("row")).otherwise(row).alias("row")).select("row.*")


def _left(text: pa.Array, found: pa.Array) -> pa.Array:
    """What is left of texts that lose something, else null."""
    kept = _kept(text, found)
    return pa.array([k.decode("utf-8", "ignore") if n else None for n, k in zip(kept.field(1).to_pylist(), kept.field(4).to_pylist())], pa.string())


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
