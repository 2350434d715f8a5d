"""Packing of tokenised documents into fixed windows by the sum-of-squares rule.

Every partition is packed on its own, so nothing is shuffled.  Within it documents arrive one by
one.  A document longer than a window fills whole windows first; its remainder is placed online
into the fill level that minimises the sum of the squared numbers of partially filled windows per
level (Csirik, Johnson, Kenyon et al.).  When the stream ends, or when the open windows together
hold more ids than ``open_ids``, the emptiest open windows are poured into the gaps of the fullest
ones, cutting freely, until at most one window is short; that one is dealt out as sequences whose
lengths are powers of two, which need no padding.  Memory is bounded by ``open_ids`` and a batch.

Cases: null or empty text has no ids of its own and yields one piece holding the end id; repeated
rows and repeated or null ids are packed like any others; a text of any length is tokenised as one and
cut freely, one task holding its ids (four bytes each) at a time; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import common
from quillstone.llm.wordids import WordIds

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


class Packer:
    """Online packer.  ``add`` and ``flush`` yield pieces
    ``(doc_id, start, length, doc_tokens, sequence_id, offset, ids)``; ids are little-endian uint32."""

    def __init__(self, window: int, first_sequence: int = 0, open_ids: int = 4_000_000):
        self.window, self.next, self.limit = window, first_sequence, open_ids
        self.open: list[list[tuple[list, int]]] = [[] for _ in range(window + 1)]  # by fill level
        self.charge = np.zeros(window + 1, np.int64)  # what raising a level's count adds: 2 n + 1; 0 for a full window
        self.refund = np.full(window + 1, np.iinfo(np.int32).min, np.int64)  # what lowering it takes off: 2 n - 1
        self.charge[1:window] = 1
        self.held = 0

    def _count(self, level: int) -> None:
        n = len(self.open[level])
        self.charge[level] = 2 * n + 1
        self.refund[level] = 2 * n - 1 if n else np.iinfo(np.int32).min

    def _emit(self, pieces: list) -> Iterator[tuple]:
        at = 0
        for doc, start, total, ids in pieces:
            n = len(ids) // 4
            yield doc, start, n, total, self.next, at, ids
            at += n
        self.next += 1

    def add(self, doc: int, ids: bytes) -> Iterator[tuple]:
        total, w = len(ids) // 4, self.window
        whole = total - total % w
        for s in range(0, whole, w):
            yield from self._emit([(doc, s, total, ids[4 * s : 4 * (s + w)])])
        size = total - whole
        if not size:
            return
        piece = (doc, whole, total, ids[4 * whole :])
        change = self.charge[1 + size : w + 1] - self.refund[1 : w + 1 - size]  # of joining level 1, 2, ...
        best = int(change.argmin()) + 1 if len(change) else 0
        if best and change[best - 1] < self.charge[size]:
            pieces = self.open[best].pop()
            self._count(best)
            pieces.append(piece)
            fill = best + size
        else:
            pieces, fill = [piece], size
        self.held += size
        if fill == w:
            self.held -= w
            yield from self._emit(pieces)
            return
        self.open[fill].append(pieces)
        self._count(fill)
        if self.held > self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        """Closes every open window."""
        w = self.window
        left = [(fill, pieces) for fill in range(1, w) for pieces in self.open[fill]]  # emptiest first
        for fill in range(1, w):
            if self.open[fill]:
                self.open[fill] = []
                self._count(fill)
        self.held = 0
        source, pool = 0, []  # pool: what was poured out of the emptiest windows
        while source < len(left):
            fill, pieces = left.pop()
            while fill < w and (pool or source < len(left)):
                if not pool:
                    pool = left[source][1]
                    source += 1
                doc, start, total, ids = pool.pop()
                n, gap = len(ids) // 4, w - fill
                if n > gap:
                    pool.append((doc, start, total, ids[: 4 * (n - gap)]))
                    start, ids, n = start + n - gap, ids[4 * (n - gap) :], gap
                pieces.append((doc, start, total, ids))
                fill += n
            if fill == w:
                yield from self._emit(pieces)
            else:
                pool = pieces
        ids_left = sum(len(p[3]) // 4 for p in pool)
        while ids_left:
            take = min(w, 1 << (ids_left.bit_length() - 1))
            ids_left -= take
            pieces = []
            while take:
                doc, start, total, ids = pool.pop()
                n = len(ids) // 4
                if n > take:
                    pool.append((doc, start + take, total, ids[4 * take :]))
                    ids, n = ids[: 4 * take], take
                pieces.append((doc, start, total, ids))
                take -= n
            yield from self._emit(pieces)


def _batches(rows: Iterable[tuple], size: int = 1000) -> Iterator[pa.RecordBatch]:
    block: list[tuple] = []
    for row in rows:
        block.append(row)
        if len(block) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), _ARROW.types)], schema=_ARROW)
            block = []
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), _ARROW.types)], schema=_ARROW)


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, open_ids: int = 4_000_000) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    ``sequence_id`` holds the partition's number above bit 40.  Sequences are ``window`` ids long,
    but for at most a few per partition (and flush) with a power of two.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer_path)
        packer = Packer(window, TaskContext.get().partitionId() << 40, open_ids)

        def rows() -> Iterator[tuple]:
            for batch in common.gathered(batches, 7_000_000):
                for part in common.slices(batch, most=10_000_000):
                    for key, ids in zip(part.column(0).to_pylist(), words.encode_all(part.column(1))):
                        yield from packer.add(key, ids.tobytes() + end)
            yield from packer.flush()

        yield from _batches(rows())

    return common.mapped(common.texts(docs), run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
