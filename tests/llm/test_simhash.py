import numpy as np
import xxhash

from quillstone.llm import simhash
from tests.llm.conftest import ODD


def brute_fp(text, words=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) > words else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps, radius=3):
    ids = list(range(len(fps)))
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in ids:
        for j in ids[:i]:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in ids]


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    fps = [brute_fp(r.text or "") for r in rows]
    roots = brute_groups(fps)
    want = {r.doc_id: (f"{f:016x}", rows[c].doc_id) for r, f, c in zip(rows, fps, roots)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.result(simhash.near_duplicates(docs)).collect()}
    assert got == want


def test_planted_neighbours_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = []
    for b in base:
        fps.append(int(b))
        for _ in range(6):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(bit)
            fps.append(x)
    fps = sorted(set(fps))
    want = brute_groups(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame(list(enumerate(signed)), "node long, fp long")
    for block in (4, 8192):
        got = {r.node: r.component for r in simhash.components(simhash.links(frame, 3, block)).collect()}
        assert [got.get(i, i) for i in range(len(fps))] == want


def test_finer_lanes_agree(spark):
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 1 << 20, 3000, dtype=np.uint64))
    at = np.arange(len(fps))
    seen = set()
    for x, y in simhash._pairs(fps, fps, True, 1, 2, at, at):
        seen |= set(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist()))
    d = np.bitwise_count(fps[:, None] ^ fps[None]) <= 1
    assert seen == set(zip(*(v.tolist() for v in np.nonzero(np.triu(d, 1)))))


def test_odd_rows(odd, none):
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.result(simhash.near_duplicates(odd)).collect())
    assert len(got) == len(ODD)
    by = {g[0]: g for g in got}
    assert by[1][1] == by[2][1] == by[3][1] == "0" * 16 and by[3][2] == 1
    assert by[7][2] == 6 and by[8][1] == f"{brute_fp(dict(ODD)[8]):016x}"
    assert simhash.near_duplicates(none).count() == 0
