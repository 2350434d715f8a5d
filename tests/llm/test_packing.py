import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillstone.llm import packing
from quillstone.llm.wordids import WordIds
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs, window=4096):
    """rows: pieces with ids; docs: (doc_id, ids).  Every id once, no gaps, little padding."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault((r[0], r[3]), []).append(r)
        by_seq.setdefault(r[4], []).append(r)
    want = {}
    for i, ids in docs:
        want.setdefault((i, len(ids)), []).append(ids)
    assert set(by_doc) == set(want)
    for k, parts in by_doc.items():
        seen = {}
        for r in parts:
            got = np.frombuffer(r[6], "<u4").tolist()
            assert len(got) == r[2] and any(got == ids[r[1] : r[1] + r[2]] for ids in want[k])
            for p in range(r[1], r[1] + r[2]):
                seen[p] = seen.get(p, 0) + 1
        assert all(seen.get(p, 0) == len(want[k]) for p in range(k[1]))
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r[5]):
            assert r[5] == at
            at += r[2]
        assert at == window or at < window and at & (at - 1) == 0


@pytest.mark.parametrize("open_ids", [4_000_000, 500])
@pytest.mark.parametrize("window", [8, 64, 100])
def test_packer(window, open_ids):
    rng = random.Random(window)
    docs = [(i, [rng.randrange(1000) for _ in range(rng.choice([1, 2, 3, window // 2, window, window + 1, 3 * window + 5, rng.randrange(1, 2 * window)]))]) for i in range(400)]
    packer, rows = packing.Packer(window, 7, open_ids), []
    for i, ids in docs:
        rows += packer.add(i, np.array(ids, "<u4").tobytes())
    rows += packer.flush()
    check(rows, docs, window)
    assert not list(packer.flush())


def test_rule_minimises_the_sum_of_squares():
    rng = random.Random(1)
    packer, levels = packing.Packer(30), [0] * 31
    for i in range(300):
        n = rng.randrange(1, 30)
        best = min(((sum(c * c for c in moved(levels, h, n)), h) for h in range(0, 31 - n) if h == 0 or levels[h]), key=lambda x: x[0])[0]
        list(packer.add(i, bytes(4 * n)))
        levels = [len(x) for x in packer.open]
        assert sum(c * c for c in levels) == best


def moved(levels, h, n):
    out = list(levels)
    if h:
        out[h] -= 1
    if h + n < 30:
        out[h + n] += 1
    return out


def test_word_ids_are_those_of_the_library():
    plain = Tokenizer.from_file(PATH)
    words = WordIds(PATH, 50)
    texts = [t or "" for _, t in ODD] + ["İstanbul ΑΣ ŒUVRE ﬁn été a b c", "it's 'tis they'll x's'd '' 'S", "ª º µ ß ÿ", "a\x1cb\x85c ́d", "1234 5,6 %$# a$$"]
    for size in (1, 3, len(texts)):
        column = pa.array([None, *texts]).slice(1)
        found = [ids for a in range(0, len(texts), size) for ids in words.encode_all(column.slice(a, size))]
        for t, ids in zip(texts, found, strict=True):
            assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids, t[:50]
    assert list(words.encode_all(pa.array([], pa.string()))) == []


def test_documents_and_odd_rows(spark, odd, none):
    plain = Tokenizer.from_file(PATH)
    for frame in (spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3), odd):
        docs = [(r.doc_id, plain.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in frame.collect()]
        rows = packing.pack(frame, PATH).collect()
        check(rows, docs)
        for a, b in zip(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), packing.digest(packing.pack(frame, PATH)).orderBy("sequence_id", "offset").collect()):
            assert zlib.crc32(a.ids) == b.ids_crc32
    assert packing.pack(none, PATH).count() == 0
