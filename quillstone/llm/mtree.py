"""Exact search for the largest integer inner products with M-trees.

The rows are dealt into blocks, a paged M-tree over each.  Within a block of largest norm M, a
vector x is placed at (x, sqrt(M^2 - |x|^2)) and a query at (q, 0); the squared distance is then
|q|^2 + M^2 - 2 q.x, so the nearest entries have the largest products.  Pages hold a routing point, a
covering radius and their entries' distances to it.  The search takes pages best first, by the
least distance that any of their entries can have; the triangle inequality over the stored
distances spares most entries and pages their own computation, and the search of a block ends when
the next page can't hold an entry as good as the last of the best so far.  Bounds are compared with
a margin above rounding; scores themselves are exact integers, ties going to the smaller id.

Rows are dealt into blocks by a number of their own, so an id with a third of all rows is spread.
Queries come in groups, and each pair of a group and a block is a unit of work of bounded size.  A
query is first searched in one block, its home; in the others it starts from the radius that its
best there leave, so that most of their pages, or all, are never opened.

Cases: vectors null or with null or non-finite components take no part; shorter vectors, empty ones
too, count as padded with zeros; rows of one id are all candidates, and all queries where that id is
one (a query's own row alone is left out); products beyond 64 bits are held at its ends; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm import common

LEAF, FAN = 128, 16
#: Rows of a block at most, and from which a table is dealt to more cores; queries of a group.
ROWS, FEW, QUERIES = 32768, 4096, 4096
_LIMIT = 1 << 63


@dataclass
class Page:
    """``at``: rows of a leaf's entries; ``children``: pages otherwise.  ``parent`` holds the
    entries' distances to this page's routing point, for children ``radii`` and ``routes`` too."""

    radius: float
    parent: np.ndarray
    at: np.ndarray | None = None
    children: "list[Page] | None" = None
    routes: np.ndarray | None = None
    radii: np.ndarray | None = None


class MTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None):
        """``vectors``: integers, one for each id; ``rows`` tells rows of one id apart (default: the ids)."""
        self.ids, self.vectors, self.rows = ids, vectors, ids if rows is None else rows
        real = vectors.astype(np.float64)
        square = (real * real).sum(1)
        self.square = float(square.max(initial=0.0))
        self.points = np.column_stack([real, np.sqrt(np.maximum(self.square - square, 0))])
        self.exact = self.square * 4 < 2**52
        rng = np.random.default_rng(6)
        route = self.points[0] if len(ids) else np.zeros(self.points.shape[1])
        self.route, self.root = route, self._page(np.arange(len(ids)), route, rng)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "points"}

    def _distances(self, rows: np.ndarray, route: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[rows] - route) ** 2).sum(1))

    def _page(self, rows: np.ndarray, route: np.ndarray, rng: np.random.Generator) -> Page:
        far = self._distances(rows, route)
        radius = float(far.max(initial=0.0))
        if len(rows) <= LEAF:
            return Page(radius, far, at=rows)
        routes = self.points[rng.choice(rows, min(FAN, -(-len(rows) // LEAF)), replace=False)]
        near = ((routes**2).sum(1) - 2 * self.points[rows] @ routes.T).argmin(1)
        groups = [np.flatnonzero(near == k) for k in range(len(routes))]
        groups = [(r, g) for r, g in zip(routes, groups) if len(g)]
        if len(groups) == 1:  # too many equal points to tell apart
            groups = [(routes[0], g) for g in np.array_split(np.arange(len(rows)), len(routes))]
        children = [self._page(rows[g], r, rng) for r, g in groups]
        routes = np.array([r for r, _ in groups])
        return Page(radius, np.sqrt(((routes - route) ** 2).sum(1)), children=children, routes=routes, radii=np.array([c.radius for c in children]))

    def _scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.exact and float((q.astype(np.float64) ** 2).sum()) * 4 < 2**52:
            return (self.vectors[rows].astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
        whole = [sum(int(a) * int(b) for a, b in zip(q, v)) for v in self.vectors[rows]]
        return np.array([max(-_LIMIT, min(_LIMIT - 1, s)) for s in whole], np.int64)

    def best(self, q: np.ndarray, own: int, k: int, floor: int | None = None) -> tuple[list[tuple[int, int]], int]:
        """The k best (-score, id) but for the row ``own``, and how many scores were computed.  With a
        ``floor`` only scores from it on matter."""
        point = np.append(q.astype(np.float64), 0.0)
        square = float(point @ point)
        margin = 1e-6 * (1 + square**0.5 + self.square**0.5)
        best: list[tuple[int, int]] = []
        computed, serial = 0, 0

        def far(score: int) -> float:
            return max(0.0, square + self.square - 2 * float(score)) ** 0.5 + margin

        reach = np.inf if floor is None else far(floor)  # how far an entry may be to matter
        d = float(np.sqrt(((point - self.route) ** 2).sum()))
        queue = [(max(0.0, d - self.root.radius), serial, d, self.root)]
        while queue:
            bound, _, d, page = heapq.heappop(queue)
            if bound > reach:
                break
            if page.children is not None:
                for j in np.flatnonzero(np.abs(d - page.parent) - page.radii <= reach):
                    serial += 1
                    to = float(np.sqrt(((point - page.routes[j]) ** 2).sum()))
                    if to - page.radii[j] <= reach:
                        heapq.heappush(queue, (max(0.0, to - page.radii[j]), serial, to, page.children[j]))
                continue
            rows = page.at[np.abs(d - page.parent) <= reach]
            if not len(rows):
                continue
            scores, ids = self._scores(q, rows), self.ids[rows]
            computed += len(rows)
            keep = self.rows[rows] != own
            least = -best[-1][0] if len(best) == k else floor
            if least is not None:
                keep &= scores >= least
            best = sorted([*best, *((-s, i) for s, i in zip(scores[keep].tolist(), ids[keep].tolist()))])[:k]
            if len(best) == k:
                reach = min(reach, far(-best[-1][0]))
        return best, computed


def _matrix(column: pd.Series) -> np.ndarray:
    out = np.zeros((len(column), max(1, *map(len, column))), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("row")
    vectors = _matrix(pdf["v"])
    if -(1 << 15) < vectors.min(initial=0) and vectors.max(initial=0) < 1 << 15:
        vectors = vectors.astype(np.int16)
    tree = MTree(pdf["vec_id"].to_numpy(np.int64), vectors, pdf["row"].to_numpy(np.int64))
    return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "tree": [pickle.dumps(tree)]})


def _gather(pdf: pd.DataFrame) -> pd.DataFrame:
    floor = [int(f) if known else None for f, known in zip(pdf["floor"], pdf["bounded"])]
    asked = (pdf["row"].to_numpy(np.int64), pdf["vec_id"].to_numpy(np.int64), pdf["home"].to_numpy(np.int64), floor, _matrix(pdf["v"]))
    return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "queries": [pickle.dumps(asked)]})


def _search(k: int, at_home: bool):
    """Searches in the home blocks of queries, or in all but them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, tree, queries in zip(pdf["block"], pdf["tree"], pdf["queries"]):
                tree, asked = pickle.loads(tree), pickle.loads(queries)
                width = tree.vectors.shape[1]
                rows = []
                for row, own, home, floor, q in zip(*(a if isinstance(a, list) else a.tolist() for a in asked[:4]), asked[4]):
                    if (home == block) != at_home:
                        continue
                    q = q[:width] if len(q) >= width else np.pad(q, (0, width - len(q)))
                    rows += [(row, own, i, -s) for s, i in tree.best(q, row, k, floor)[0]]
                yield pd.DataFrame(rows, columns=["row", "query_id", "vec_id", "score"]).astype("int64")

    return run


def integers(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v``: the usable vectors with components floor(256 x)."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"))
    usable = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & usable).select("vec_id", F.transform("e", lambda x: F.floor(x * 256)).alias("v"))


_FOUND = "row long, query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, asks: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors`` (``vec_id, v``) that ``asks`` holds for."""
    # written once, so that a row's number is the same wherever it is read
    vectors = common.durable(vectors.select("vec_id", "v").withColumn("row", F.monotonically_increasing_id()))
    n, m = vectors.agg(F.count("*"), F.count_if(asks)).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks, parts = max(1, -(-n // ROWS), min(cores, -(-n // FEW))), max(1, -(-m // QUERIES))
    deal = lambda salt, count: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(count)).cast("int")
    trees = common.durable(vectors.withColumn("block", deal(0, blocks)).groupBy("block").applyInPandas(_build, "block int, tree binary"))
    queries = vectors.where(asks).select("row", "vec_id", "v", deal(1, blocks).alias("home"))

    # at home a unit is a block with its own queries, in parts of bounded size
    asked = queries.withColumns({"part": F.col("home") * parts + deal(2, parts), "floor": F.lit(0).cast("long"), "bounded": F.lit(False)}).groupBy("part").applyInPandas(_gather, "part int, queries binary")
    units = asked.withColumn("block", F.floor(F.col("part") / parts).cast("int")).join(trees, "block").repartition(blocks * parts, "part")
    first = common.durable(units.select("block", "tree", "queries").mapInPandas(_search(k, True), _FOUND))

    # elsewhere a query needs only what reaches its k-th best from home
    kept = first.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    rest = queries.join(kept, "row", "left").withColumns({"bounded": F.col("floor").isNotNull(), "floor": F.coalesce("floor", F.lit(0).cast("long"))})
    rest = rest.withColumn("part", deal(3, parts)).groupBy("part").applyInPandas(_gather, "part int, queries binary")
    units = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(trees, "block").repartition(blocks * parts, "part", "block")
    found = first.unionAll(units.select("block", "tree", "queries").mapInPandas(_search(k, False), _FOUND))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
