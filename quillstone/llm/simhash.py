"""SimHash fingerprints and exact linking of all fingerprints within a Hamming radius.

Fingerprints are grouped into tiles by the population counts of equal lanes of their 64 bits.  Two
fingerprints within the radius differ by no more than the radius in the summed differences of
these counts, so tile pairs beyond it are skipped; the others are compared exactly with numpy's
exclusive-or and bit counts.  Tiles above a fixed size are cut into blocks, every pair of blocks
being a unit of work of its own, and inside a unit large tiles are split into finer lanes again.
Equal fingerprints are merged first, so copies are never paired; a unit returns a spanning forest
of its links (at most one per fingerprint), never all pairs.

Cases: null or empty text, or text of white space only, has fingerprint zero and links like any
other; fewer words than a shingle make one shingle; repeated ids are rows of their own with the
smallest id of their component; rows with a null id link and bridge like any others; a text of any
length counts whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm import common, nearcopies
from quillstone.llm.components import components

_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Fingerprints of a tile that are compared in one unit of work.
BLOCK = 8192


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included."""
    w = text.lower().split()
    h, join = xxhash.xxh64_intdigest, b" ".join
    if len(w) <= words:
        return np.array([h(join(w), 42)] if w else [], np.uint64)
    return np.fromiter((h(join(s), 42) for s in zip(*(w[i:] for i in range(words)))), np.uint64, len(w) - words + 1)


def fingerprint(text: bytes, words: int = 3) -> int:
    """The bits set in more than half of the shingles' hashes."""
    return majority(shingle_hashes(text, words))


def majority(hashes: np.ndarray) -> int:
    set_in = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        set_in += np.unpackbits(part.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.encode(), words) for part in common.slices(batch) for t in part.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], schema=_FP)

    return common.mapped(common.texts(docs), run, "doc_id long, fp long")


def lane_counts(fps: np.ndarray, lanes: int) -> np.ndarray:
    """Population counts of ``lanes`` equal lanes, from the high bits down, a row for each."""
    width = 64 // lanes
    mask = np.uint64((1 << width) - 1)
    return np.stack([np.bitwise_count((fps >> np.uint64(64 - width * (i + 1))) & mask) for i in range(lanes)]).astype(np.int16)


def _pairs(a: np.ndarray, b: np.ndarray, same: bool, radius: int, lanes: int, at_a: np.ndarray, at_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of linked fingerprints; ``same``: a and b are one set, of which each pair is seen once."""
    if lanes < 8 and len(a) * len(b) > 4_000_000:
        finer = lanes * 2
        cells = []
        for fps, at in ((a, at_a),) if same else ((a, at_a), (b, at_b)):
            counts = lane_counts(fps, finer)
            order = np.lexsort(counts[::-1])
            counts = counts[:, order]
            cut = np.flatnonzero((counts[:, 1:] != counts[:, :-1]).any(0)) + 1
            starts = np.concatenate([[0], cut])
            cells.append((counts[:, starts].T, np.split(fps[order], cut), np.split(at[order], cut)))
        (ca, fa, pa_), (cb, fb, pb) = cells[0], cells[-1]
        for i in range(len(ca)):
            near = np.flatnonzero(np.abs(cb - ca[i]).sum(1) <= radius)
            for j in near[near >= i] if same else near:
                yield from _pairs(fa[i], fb[j], same and i == j, radius, finer, pa_[i], pb[j])
        return
    step = 2048
    for i in range(0, len(a), step):
        for j in range(i if same else 0, len(b), step):
            hit = np.bitwise_count(a[i : i + step, None] ^ b[None, j : j + step]) <= radius
            if same and i == j:
                hit = np.triu(hit, 1)
            if hit.any():
                x, y = np.nonzero(hit)
                yield at_a[i + x], at_b[j + y]


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, xs: np.ndarray, ys: np.ndarray) -> None:
        for x, y in zip(xs.tolist(), ys.tolist()):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)


def _unit(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray] | None, radius: int, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between the nodes of one or two blocks; a block is (fingerprints, nodes)."""
    fa, na = left
    fb, nb = right or left
    nodes = na if right is None else np.concatenate([na, nb])
    forest = Forest(len(nodes))
    at_a = np.arange(len(na))
    at_b = at_a if right is None else np.arange(len(nb)) + len(na)
    touched = False
    for x, y in _pairs(fa, fb, right is None, radius, lanes, at_a, at_b):
        forest.join(x, y)
        touched = True
    if not touched:
        return na[:0], na[:0]
    roots = np.array([forest.root(i) for i in np.flatnonzero(forest.up != np.arange(len(nodes)))], np.int64)
    return nodes[forest.up != np.arange(len(nodes))], nodes[roots]


def offsets(lanes: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of lane counts that a pair may have, one of each pair of opposites; zero first."""
    found = [d for d in itertools.product(range(-radius, radius + 1), repeat=lanes) if sum(map(abs, d)) <= radius and d > (0,) * lanes]
    return [(0,) * lanes, *found]


def links(fps: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` between nodes whose fingerprints differ in ``radius`` bits at most, enough to
    give the components.  ``fps`` has ``node, fp``, each fingerprint once."""
    spark = fps.sparkSession
    n = fps.count()
    lanes = 2 if n <= 2_000_000 else 4
    width = 64 // lanes
    fps = fps.withColumn("c", F.array(*[F.bit_count(F.shiftrightunsigned("fp", 64 - width * (i + 1)).bitwiseAND(F.lit((1 << width) - 1).cast("long"))).cast("int") for i in range(lanes)]))
    sizes = fps.groupBy("c").agg(F.count("*").alias("n"))
    sizes = sizes.select("c", F.ceil(F.col("n") / block).cast("int").alias("blocks"))  # at most 33**2 or 17**4 tiles
    moves = offsets(lanes, radius)

    def tile(i: Column | str) -> Column:
        return F.concat_ws(",", *[F.col(i)[k].cast("string") for k in range(lanes)])

    # Every tile goes to its own units and to those of each neighbour; "first" is the unit's left tile.
    own = fps.join(F.broadcast(sizes), "c").withColumn("block", F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("fp"), "blocks")).cast("int"))
    steps = F.array(*[F.struct(F.lit(k).alias("move"), F.lit(s).alias("side"), F.array(*[F.lit(-s * x) for x in m]).alias("to")) for k, m in enumerate(moves) for s in ((0,) if k == 0 else (0, 1))])
    spread = own.select("node", "fp", "c", "block", "blocks", F.explode(steps).alias("s")).select(
        "node", "fp", "block", "blocks", F.col("s.move").alias("move"), F.col("s.side").alias("side"),
        F.array(*[F.col("c")[k] + F.col("s.to")[k] for k in range(lanes)]).alias("first"),
        F.array(*[F.col("c")[k] + F.when(F.col("s.side") == 0, F.element_at(F.array(*[F.lit(m[k]) for m in moves]), F.col("s.move") + 1)).otherwise(-F.element_at(F.array(*[F.lit(m[k]) for m in moves]), F.col("s.move") + 1)) for k in range(lanes)]).alias("other"),
    )
    partner = sizes.select(F.col("c").alias("other"), F.col("blocks").alias("partners"))
    spread = spread.join(F.broadcast(partner), "other")  # drops tiles that have no neighbour there
    spread = spread.withColumn("meets", F.explode(F.sequence(F.lit(0), F.col("partners") - 1)))
    mine, theirs = F.col("block"), F.col("meets")
    within = F.col("move") == 0
    units = spread.select(
        F.concat_ws(":", tile("first"), "move", F.when(within, F.least(mine, theirs)).when(F.col("side") == 0, mine).otherwise(theirs), F.when(within, F.greatest(mine, theirs)).when(F.col("side") == 0, theirs).otherwise(mine)).alias("unit"),
        F.when(within & (mine == theirs), 2).when(within, (mine > theirs).cast("int")).otherwise(F.col("side")).cast("int").alias("side"),
        "node", "fp",
    )  # side 2: a block that is compared with itself
    parts = max(8, spark.sparkContext.defaultParallelism, n * (2 * len(moves) - 1) // 400_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def close() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            side, node, fp = (t.column(i).to_numpy() for i in (1, 2, 3))
            fp = fp.astype(np.int64).view(np.uint64)
            pick = lambda k: (fp[side == k], node[side == k])
            if len(node) == 0:
                return
            if side[0] == 2:
                x, y = _unit(pick(2), None, radius, lanes)
            elif side[0] == side[-1]:
                return
            else:
                x, y = _unit(pick(0), pick(1), radius, lanes)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], schema=_LINK)

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cut, cut[1:]):
                if a == b:
                    continue
                if held and keys[a] != key:
                    yield from close()
                    held = []
                key = keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from close()

    return common.mapped(units.repartition(parts, "unit").sortWithinPartitions("unit", "side"), run, "a long, b long")


def _named(rows: DataFrame, names: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """``rows`` joined to ``names`` (a row for each ``key``, and ``n``, how many rows have it).  Keys that
    more than a ``most``-th of all rows have, fewer than ``most`` keys, are broadcast; so none gathers in a task."""
    total = names.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") > max(1000, total // most)
    hot, cold = names.where(often).drop("n"), names.where(~often).drop("n")
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` of every document: the component's smallest id, null where it has none."""
    fps = common.durable(fingerprints(docs, words))
    nodes = common.durable(fps.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")))
    groups = components(links(nodes.select(F.col("fp").alias("node"), "fp"), radius))
    nodes = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = nodes.groupBy("component").agg(F.min("id").alias("component_id"))
    named = common.durable(nodes.join(least, "component").select("fp", "component_id", "n"))
    return _named(fps, named, "fp").select("doc_id", "fp", "component_id")


def result(found: DataFrame) -> DataFrame:
    """The fingerprint as 16 lowercase hex digits."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_SKETCH = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("fp", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("keys", pa.list_(pa.int64()))])


def _sketches(rows: DataFrame, words: int) -> DataFrame:
    """For rows ``doc_id, k, text``: the fingerprint, the hash of the set of shingles, its size and its
    min-wise keys (none for texts without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, 2):
                hashed = [shingle_hashes(t.encode(), words) for t in part.column(2).to_pylist()]
                fps = np.array([majority(h) for h in hashed], np.uint64).view(np.int64)
                sets = [np.unique(h) for h in hashed]
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
                keys = [nearcopies.keys(s) if len(s) else s.view(np.int64) for s in sets]
                columns = [part.column(0), part.column(1), fps, nodes, [len(s) for s in sets], keys]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SKETCH)], schema=_SKETCH)

    return common.mapped(rows, run, "doc_id long, k long, fp long, node long, n int, keys array<long>")


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """``node, s`` for rows ``node, text``."""
    schema = pa.schema([("node", pa.int64()), ("s", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                sets = [np.unique(shingle_hashes(t.encode(), words)).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, schema.field(1).type)], schema=schema)

    return common.mapped(rows, run, "node long, s array<long>")


def without_copies(docs: DataFrame, words: int = 5, radius: int = 3, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near copies, with all its columns.

    Texts are linked by fingerprints within the radius, or by the exact Jaccard similarity of their
    shingles.  Of a group the row with the smallest id stays (null ids come last; of equal ids the
    text with the smaller hash); of rows with the same id and text one stays, whichever its other columns."""
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    rows = common.whole(docs).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("k", F.xxhash64("doc_id", "text"))
    sketches = common.durable(_sketches(rows.select("doc_id", "k", "text"), words))
    slim = sketches.select("doc_id", "k", "fp", "node")

    prints = common.durable(slim.groupBy("fp").agg(F.min("k").alias("node")))
    close = links(prints, radius)
    sets = sketches.where("n > 0").groupBy("node").agg(F.min("k").alias("of"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    sets = common.durable(sets)

    def sets_of(wanted: DataFrame) -> DataFrame:
        picked = sets.select("node", "of").join(wanted, "node")
        # rows of one id and text have one k and one set, of which the first is as good as any
        read = rows.select("k", "text").join(picked.withColumnRenamed("of", "k"), "k").select("node", "text")
        return _sets(read, words).groupBy("node").agg(F.first("s").alias("s"))

    alike = nearcopies.links(sets.select("node", "n", "keys"), sets_of, similarity)
    of = sets.select("node", "of")
    alike = alike.join(of.select(F.col("node").alias("a"), F.col("of").alias("i")), "a").join(of.select(F.col("node").alias("b"), F.col("of").alias("j")), "b").select(F.col("i").alias("a"), F.col("j").alias("b"))
    same = slim.join(prints.select("fp", F.col("node").alias("b")), "fp").where("k <> b").select(F.col("k").alias("a"), "b")
    same_set = slim.join(of, "node").where("k <> of").select(F.col("k").alias("a"), F.col("of").alias("b"))
    groups = components(close.unionAll(alike).unionAll(same).unionAll(same_set))

    ids = slim.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"))
    members = ids.select("k", "doc_id").join(groups.withColumnRenamed("node", "k"), "k")
    first = members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k"))["k"].alias("first"))
    lost = groups.join(first, "component").where("node <> first").select(F.col("node").alias("k"))
    lost, repeated = common.durable(lost), common.durable(ids.where("rows > 1").select("k"))
    kept = rows.drop("text", "doc_id").join(lost, "k", "left_anti")
    if not repeated.isEmpty():
        one = kept.join(repeated, "k", "left_semi").groupBy("k").agg(F.first("row").alias("row"))
        kept = kept.join(repeated, "k", "left_anti").select("k", "row").unionByName(one)
    return kept.select("row.*")
