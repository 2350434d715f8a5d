"""Links between sets of word shingles with a Jaccard similarity of ``similarity`` or more.

Candidates come from min-wise hashing: ``BANDS`` keys of ``ROWS`` minima each, so that a pair at 0.8
shares a key with probability 1 - (1 - 0.8**5)**30, all but some seven in a million.  Every candidate is
confirmed by the exact similarity of its two sets of shingles, so chance meetings link nothing.

Equal sets are one node.  In every turn the members of a key are compared with its pivot, of those that
have been none yet the one that meets most others, so the text that a group was edited from comes
first; keys whose other members are then in one component are done.  So a large
group of near copies costs a comparison a member, key and turn, not one a pair.  The members of what
keys are left after the turns are joined by an exact prefix filter, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import common
from quillstone.llm.components import components

BANDS, ROWS = 30, 5
_RNG = np.random.default_rng(5)
_MIX = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)
_TIMES = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def keys(found: np.ndarray) -> np.ndarray:
    """The band keys of a set of shingles."""
    least = np.full((BANDS * ROWS, 1), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(found), 1024):
        least = np.minimum(least, ((found[a : a + 1024] ^ _MIX) * _TIMES).min(1, keepdims=True))
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(bands[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64)


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` of nodes whose sets (``node, s``) are alike enough."""
    a, b = sets.select(F.col("node").alias("a"), F.col("s").alias("x")), sets.select(F.col("node").alias("b"), F.col("s").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(a, "a").join(b, "b").where(both >= similarity * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b")


def prefix_pairs(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a, b`` of ``nodes`` (``node, component``) of different components that can be alike enough:
    all of those that are, and few others.

    Sets ordered from their rarest member on are alike only if they share one of the first few: of the
    smaller set those beyond 2 s / (1 + s) of its size, of the larger those beyond s of its size (Bayardo
    et al., Xiao et al.); what may follow their first common one must be enough as well.  Texts edited
    from one and too far apart have own members there, so they don't meet, however many they are."""
    rows = nodes.join(sets, "node").select("node", "component", F.size("s").alias("n"), "s")
    members = rows.select("node", F.explode("s").alias("t"))
    common_ = members.groupBy("t").agg(F.count("*").alias("df"))
    order = members.join(common_, "t").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("o"))
    rows = common.durable(rows.drop("s").join(order, "node"))
    beyond = lambda share: (F.col("n") - F.ceil(share * F.col("n") - 1e-9) + 1).cast("int")
    first = lambda share: F.posexplode(F.slice("o", F.lit(1), F.greatest(beyond(share), F.lit(1)))).alias("at", "m")
    small = rows.select("node", "component", "n", first(2 * similarity / (1 + similarity))).select("node", "component", "n", "at", F.col("m.t").alias("t"))
    large = rows.select("node", "component", "n", first(similarity)).select(F.col("node").alias("node2"), F.col("component").alias("component2"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("m.t").alias("t"))
    x, y = F.col("n"), F.col("n2")
    fits = ((x < y) | ((x == y) & (F.col("node") < F.col("node2")))) & (x >= similarity * y - 1e-9) & (F.col("component") != F.col("component2"))
    enough = F.least(x - F.col("at"), y - F.col("at2")) >= similarity / (1 + similarity) * (x + y) - 1e-9
    return small.join(large, "t").where(fits & enough).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))


def links(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float = 0.8, rounds: int = 2) -> DataFrame:
    """Links ``a, b`` between nodes, enough to give the components.

    ``nodes``: ``node, n, keys`` of each distinct set; ``sets_of`` gives ``node, s`` for a table of wanted nodes."""
    met = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = met.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    met = met.join(shared, "key")
    # a text that others were edited from lies in the largest groups, with nearly all of them
    pull = met.groupBy("node").agg(F.sum("members").alias("pull"))
    met = common.durable(met.select("key", "node", "n").join(pull, "node"))
    sets = common.durable(sets_of(met.select("node").distinct()))
    near = lambda n, m: F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9
    edge = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    found, known = None, None
    left = met.withColumn("component", F.col("node"))
    for turn in range(rounds + 1):
        if turn < rounds:
            pivot = left.groupBy("key").agg(F.max(F.struct("pull", "node", "n", "component")).alias("p"))
            pairs = left.join(pivot, "key").where((F.col("component") != F.col("p.component")) & near(F.col("n"), F.col("p.n"))).select(*edge(F.col("node"), F.col("p.node")))
        else:
            pairs = prefix_pairs(left.groupBy("node").agg(F.first("component").alias("component")), sets, similarity)
        new = common.durable(confirmed(pairs.distinct(), sets, similarity))
        found = new if found is None else found.unionAll(new)
        if turn == rounds:
            break
        known = components(found)
        left = left.join(pivot, "key").where("node <> p.node").select("key", "node", "n", "pull").join(known, "node", "left").select("key", "node", "n", "pull", F.coalesce("component", "node").alias("component"))
        split = left.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q").select("key")
        left = common.durable(left.join(split, "key"))
        if left.isEmpty():
            break
    return found
