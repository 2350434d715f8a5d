import hashlib

from quillstone.llm import sharding
from tests.llm.conftest import ODD


def brute(rows, limit):
    """One bucket, split bit by bit while oversized; ids are distinct."""
    h = {i: f"{int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16):060b}" for i, _ in rows}
    todo, out = [("", rows)], {}
    while todo:
        p, part = todo.pop()
        n = sum(b for _, b in part)
        if n > limit and len(part) > 1:
            for c in "01":
                todo.append((p + c, [r for r in part if h[r[0]].startswith(p + c)]))
        else:
            out |= {i: (i, b, p, len(p), n) for i, b in part}
    return sorted(out.values())


def run(frame, limit, **kw):
    return sorted(tuple(r) for r in sharding.shards(frame, limit, **kw).collect())


def test_documents_against_splitting_one_by_one(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, len(r.text.encode())) for r in docs.collect()]
    for limit, bits in ((10**9, 16), (100_000, 16), (20_000, 16), (20_000, 2), (1, 3)):
        monkeypatch.setattr(sharding, "ROUND", bits)
        assert run(docs, limit) == brute(rows, limit)
    monkeypatch.setattr(sharding, "SMALL", 1)
    assert run(docs, 20_000) == brute(rows, 20_000)


def test_a_hot_key_is_split(spark):
    frame = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}", "x" * 100) for i in range(300)], "doc_id long, source string, text string").repartition(4)
    got = run(frame, 1500, key_col="source")
    sizes = {}
    for i, n, shard, depth, total in got:
        sizes[shard] = sizes.get(shard, 0) + n
        assert total <= 1500
    assert len(got) == 300 and all(s <= 1500 for s in sizes.values())


def test_odd_rows(odd, none):
    got = run(odd, 1000)
    assert [g[0] for g in got] == [i for i, _ in ODD]
    assert [g[1] for g in got] == [len((t or "").encode()) for _, t in ODD]
    assert run(none, 1000) == []
    assert run(odd, 10**9)[0][2] == ""
