import itertools

import numpy as np

from quillstone.llm import nearcopies, simhash
from tests.llm.conftest import ODD
from tests.llm.test_simhash import brute_fp


def shingled(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_copies_from_a_similarity_of_08_go(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        rows.append((10 * k, " ".join(words)))
        for at in range(1, 1 + k % 6):
            words[at * 33] = f"new{at}"
            rows.append((10 * k + at, " ".join(words)))
    sets = {i: shingled(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            up[max(root(i), root(j))] = min(root(i), root(j))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.without_copies(frame).collect()) == sorted(i for i in up if root(i) == i)
    assert len(set(map(root, up))) == 60


def test_chance_meetings_link_nothing(spark):
    words = [f"w{k}" for k in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:88] + [f"v{k}" for k in range(12)])), (3, " ".join(words[:90] + [f"u{k}" for k in range(10)]))]
    exact = {(i, j): len(shingled(a) & shingled(b)) / len(shingled(a) | shingled(b)) for (i, a), (j, b) in itertools.combinations(rows, 2)}
    assert exact[1, 2] < 0.8 and exact[1, 3] > 0.8 and exact[2, 3] < 0.8
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.without_copies(frame).collect()) == [1, 2]


def test_large_groups_of_near_copies_and_recall(spark):
    """Every text differs from the base in its own places: pairs are near 0.8, many below; links chain them."""
    rng = np.random.default_rng(7)
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    rows = []
    for i in range(250):
        words = list(base)
        for at in rng.choice(290, rng.integers(1, 8), replace=False):
            words[at] = f"new{i}x{at}"
        rows.append((i, " ".join(words)))
    sets = {i: shingled(t) for i, t in rows}
    up = list(range(250))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    linked, fps = 0, [brute_fp(t, 5) for _, t in rows]
    for i, j in itertools.combinations(range(250), 2):
        alike = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
        linked += alike
        if alike or (fps[i] ^ fps[j]).bit_count() <= 3:
            up[max(root(i), root(j))] = min(root(i), root(j))
    assert linked > 1000
    kept = sorted(r.doc_id for r in simhash.without_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert kept == sorted({root(i) for i in range(250)})


def test_one_row_of_repeated_rows_and_ids(spark):
    a, b = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    rows = [(5, a, "x"), (5, a, "y"), (5, b, "z"), (6, b, "u"), (None, a, "v"), (None, "only here", "w"), (7, None, "n"), (8, " ", "e")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, k string").repartition(3)
    got = sorted(((r.doc_id or 0, r.text) for r in simhash.without_copies(frame).collect()), key=str)
    assert got == sorted([(5, a), (5, b), (0, "only here"), (7, None)], key=str)


def test_odd_rows(odd, none):
    assert simhash.without_copies(none).count() == 0
    kept = {r.doc_id for r in simhash.without_copies(odd).collect()}
    assert 1 in kept and 6 in kept and 7 not in kept and kept <= {i for i, _ in ODD}


def test_prefix_pairs_hold_every_alike_pair(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 40, 60)
    sets = {}
    for i in range(120):
        own = np.unique(np.concatenate([rng.choice(base, rng.integers(20, 60), replace=False), rng.integers(0, 1 << 40, rng.integers(0, 12))]))
        sets[i] = own.tolist()
    sets |= {500 + i: sets[i] for i in range(3)} | {600: [1], 601: [1], 602: [2]}
    nodes = spark.createDataFrame([(i, i % 7) for i in sets], "node long, component long")
    rows = spark.createDataFrame(list(sets.items()), "node long, s array<long>")
    found = {(r.a, r.b) for r in nearcopies.confirmed(nearcopies.prefix_pairs(nodes, rows, 0.8).distinct(), rows, 0.8).collect()}
    alike = lambda a, b: len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b))
    assert found == {(i, j) for i, j in itertools.combinations(sorted(sets), 2) if i % 7 != j % 7 and alike(sets[i], sets[j])} and len(found) > 20
