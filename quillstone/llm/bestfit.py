"""Best-fit packing in bulk-synchronous steps: whole documents into as few windows as can be.

Only lengths matter for the places, and documents of one length are interchangeable.  So documents sorted
by length are runs ``(length, count)``, at most ``window`` of them however large the corpus, made by an
aggregation that combines before its shuffle; open windows sorted by gap are runs likewise.  One step
sweeps both in ascending order: every gap has as its match the longest documents that fit it and are not
yet taken (the gap is their successor), so each run of gaps is matched with runs of documents, and the
conflict of who gets which gap is settled by rank: the documents ranked ``first ..`` of a length go, ``each``
to a window, to the run's windows in turn.  Then all gaps are updated at once and the next step sweeps again.
Long documents come first: those above a half of a window, above a third, and so on, then all.  When no gap
fits any document of the class, windows are opened for what is left of it and the steps go on.

The documents themselves are placed in parallel: range-sorted by length, ranked within it by the
partitions' counts, and joined with the runs' table, whose rows are bounded by ``window`` times the steps.

Cases: null or empty text has no ids of its own and yields one piece holding the end id; repeated rows and
repeated or null ids are packed like any others; a text of any length is cut into pieces of ``window`` ids,
one task holding one text at a time; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import common
from quillstone.llm.wordids import WordIds

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
RUNS = "length long, first long, last long, each long, window_no long, offset long"


def pieces(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """Every document's ids, with ``end_id`` behind them, cut after each ``window`` ids: ``doc_id, piece, start,
    length, ids_crc32, ids`` (little-endian uint32; null where they are not wanted)."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer_path)
        rows: list[tuple] = []
        held = 0
        for batch in common.gathered(batches, 7_000_000):
            for part in common.slices(batch, most=10_000_000):
                for key, ids in zip(part.column(0).to_pylist(), words.encode_all(part.column(1))):
                    raw = ids.tobytes() + end
                    for k, a in enumerate(range(0, len(raw), 4 * window)):
                        cut = raw[a : a + 4 * window]
                        rows.append((key, k, a // 4, len(cut) // 4, zlib.crc32(cut), cut if with_ids else None))
                        held += len(cut) if with_ids else 0
                        if len(rows) == 5000 or held > 8_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

    return common.mapped(common.texts(docs), run, PIECES)


class Steps:
    """The runs of documents and of open windows, and what each step has matched."""

    def __init__(self, counts: dict[int, int], window: int, most: int | None = None):
        self.most = most  # documents a window takes in one step; None: as many of a length as fit
        self.window, self.left, self.used = window, {s: int(n) for s, n in sorted(counts.items()) if n > 0}, {}
        self.gaps: list[tuple[int, int, int]] = []  # gap, first window, windows
        self.matched: list[tuple[int, int, int, int, int, int]] = []
        self.opened = self.steps = 0

    def open(self, above: int) -> None:
        """Windows for the documents longer than ``above``: by their sum, or one for each of which no two fit together."""
        total = sum(s * n for s, n in self.left.items() if s > above)
        lone = sum(n for s, n in self.left.items() if 2 * s > self.window)
        n = max(-(-total // self.window), lone)
        self.gaps.append((self.window, self.opened, n))
        self.opened += n

    def step(self, above: int) -> bool:
        """One sweep for the documents longer than ``above``; False if no gap fits any of them."""
        waiting, upto = [s for s in self.left if s > above], 0
        fitting: list[int] = []  # lengths up to the gap, the longest last
        gaps, placed = [], False
        for gap, at, n in sorted(self.gaps):
            while upto < len(waiting) and waiting[upto] <= gap:
                fitting.append(waiting[upto])
                upto += 1
            while n and fitting:
                s = fitting[-1]
                each = min(gap // s, self.left[s], self.most or gap)
                windows = min(n, self.left[s] // each)
                first = self.used.get(s, 0)
                self.matched.append((s, first, first + each * windows, each, at, self.window - gap))
                self.used[s] = first + each * windows
                self.left[s] -= each * windows
                if not self.left[s]:
                    del self.left[s]
                    fitting.pop()
                if gap > each * s:
                    gaps.append((gap - each * s, at, windows))
                at, n, placed = at + windows, n - windows, True
            if n:
                gaps.append((gap, at, n))
        self.gaps = gaps
        self.steps += placed
        return placed


#: Classes of length (above a window's k-th part) and documents a step: each is tried, the fewest windows win.
SCHEDULES = (((*range(2, 40),), None), ((), None), ((2, 3, 4, 6, 8, 12, 16), 1))


def plan(counts: dict[int, int], window: int) -> Steps:
    """All steps: ``matched`` has rows ``length, first, last, each, window_no, offset``: the documents of the length
    with ranks from ``first`` to before ``last`` go, ``each`` to a window, to the windows from ``window_no`` on, the
    first of them at ``offset``."""
    tried = []
    for parts, most in SCHEDULES:
        steps = Steps(counts, window, most)
        for above in [*(window // k for k in parts), 0]:
            while any(s > above for s in steps.left):
                if not steps.step(above):
                    steps.open(above)
        tried.append(steps)
    return min(tried, key=lambda steps: steps.opened)


def placed(cut: DataFrame, window: int = 4096) -> DataFrame:
    """``cut`` (durable pieces with ``length``) with ``sequence_id`` and ``offset``."""
    whole = F.col("length") == window
    full = cut.where(whole).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = cut.where(~whole)
    counts = {r["length"]: r["n"] for r in rest.groupBy("length").agg(F.count("*").alias("n")).collect()}  # fewer than ``window`` rows
    runs = cut.sparkSession.createDataFrame(plan(counts, window).matched, RUNS)
    found = common.ranked(rest, ["length"], ["doc_id", "piece", "ids_crc32"]).withColumnRenamed("length", "len")
    met = found.join(F.broadcast(runs), (F.col("len") == F.col("length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    nth = F.col("rank") - F.col("first")
    short = met.withColumn("sequence_id", -1 - F.col("window_no") - F.floor(nth / F.col("each"))).withColumn("offset", F.col("offset") + nth % F.col("each") * F.col("len"))
    return full.unionByName(short.select(*full.columns))


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their places: those of ``pieces``, ``sequence_id`` and ``offset`` (gapless from 0).
    Sequences of one whole piece have ids from 0 on, shared ones below 0."""
    return placed(common.durable(pieces(docs, tokenizer_path, window, end_id, with_ids)), window)


def digest(packed: DataFrame) -> DataFrame:
    return packed.drop("ids")
