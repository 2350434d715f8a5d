import hashlib
import itertools
import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from quillstone.llm import pieces
from tests.llm.conftest import ODD

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.shared(MODEL)


def segmentations(v, text):
    if not text:
        yield (), 0.0
    for k in range(1, len(text) + 1):
        if text[:k] in v.pieces:
            i, w = v.pieces[text[:k]]
            for rest, x in segmentations(v, text[k:]):
                yield (i, *rest), w + x


@pytest.mark.parametrize("sharpness", [1.0, 0.3])
def test_frequencies_are_those_of_all_segmentations(vocabulary, sharpness):
    text, n = " the blend", 40000
    sampler = pieces.Sampler(vocabulary, sharpness)
    keys = pieces.mix(np.arange(n, dtype=np.uint64))
    got = Counter(tuple(np.frombuffer(b, "<u4").tolist()) for b in sampler.encode_all([text] * n, keys))
    want = {s: math.exp(sharpness * w) for s, w in segmentations(vocabulary, text)}
    total = sum(want.values())
    assert set(got) <= set(want)
    for s, w in want.items():
        p = w / total
        assert abs(got[s] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_parts_have_no_piece_across(vocabulary):
    text = "  two  words,\n\nand more \n 字字 é字 öß êxç"
    parts = vocabulary.parts(text)
    assert "".join(parts) == text
    cuts = list(itertools.accumulate(map(len, parts)))[:-1]
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in vocabulary.pieces:
                assert not any(i < c < j for c in cuts)


def test_long_parts_agree_with_short_ones(vocabulary):
    text = "thethethe" * 7
    assert len(text) > 50 and len(vocabulary.parts(text)) == 1
    n = 3000
    sampler = pieces.Sampler(vocabulary, 1.0)
    out = sampler.encode_all([text] * n, pieces.mix(np.arange(n, dtype=np.uint64)))
    assert all(vocabulary.decode(o).decode() == text for o in out) and len(set(out)) > 100


def test_odd_rows_round_trip(odd, none):
    got = pieces.decode(pieces.encode(odd, MODEL, seed=3), MODEL).collect()
    texts = {i: t or "" for i, t in ODD}
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in ODD)
    assert all(r.text == texts[r.doc_id] for r in got)
    again = {(r.doc_id, bytes(r.ids)) for r in pieces.encode(odd.repartition(5), MODEL, seed=3).collect()}
    assert again == {(r.doc_id, bytes(r.ids)) for r in got}
    other = {(r.doc_id, bytes(r.ids)) for r in pieces.encode(odd, MODEL, seed=4).collect()}
    assert other != again
    assert pieces.decode(pieces.encode(none, MODEL), MODEL).count() == 0


def test_company_changes_nothing(vocabulary):
    texts = [f"some words {i} and others {i * i}" for i in range(50)]
    keys = np.arange(50, dtype=np.uint64)
    sampler = pieces.Sampler(vocabulary, 1.0)
    one = sampler.encode_all(texts, keys)
    assert one == list(itertools.chain.from_iterable(sampler.encode_all(texts[i : i + 7], keys[i : i + 7]) for i in range(0, 50, 7)))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in pieces.digest(pieces.decode(pieces.encode(docs, MODEL), MODEL)).collect()}
    for r in docs.collect():
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
