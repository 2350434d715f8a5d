"""Best-fit packing against a plain sequential best fit and the tokeniser itself."""

from __future__ import annotations

import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillstone.llm import bestfit

MODEL = public_tokenizers.path("word_bpe_49k.json")


def plain(lengths: list[int], window: int) -> int:
    gaps, opened = [], 0
    for size in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, size)
        if i == len(gaps):
            opened += 1
            gap = window
        else:
            gap = gaps.pop(i)
        bisect.insort(gaps, gap - size)
    return opened


@pytest.mark.parametrize("lo, hi, slack", [(1, 4095, 1.002), (1, 60, 1.0), (1200, 1800, 1.005), (900, 2000, 1.005), (1400, 2600, 1.0), (7, 7, 1.0), (4095, 4095, 1.0)])
def test_steps_pack_like_sequential_best_fit(lo, hi, slack):
    rng = random.Random(lo)
    lengths = [rng.randint(lo, hi) for _ in range(5000)]
    steps = bestfit.plan(dict(Counter(lengths)), 4096)
    fill: dict[int, int] = defaultdict(int)
    taken: dict[int, list[int]] = defaultdict(list)
    for size, first, last, each, window_no, offset in steps.matched:
        for rank in range(first, last):
            no, at = window_no + (rank - first) // each, offset + (rank - first) % each * size
            assert fill[no] == at  # gapless
            fill[no] += size
            taken[size].append(rank)
    assert max(fill.values()) <= 4096
    assert {s: sorted(r) for s, r in taken.items()} == {s: list(range(n)) for s, n in Counter(lengths).items()}
    assert len(fill) == steps.opened <= np.ceil(plain(lengths, 4096) * slack)


def test_pieces_and_places(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "Gamma,", "delta!", "<|x", "ä"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 40, 300, 900]))), "x") for i in range(300)]
    rows += [(300 + i, "same words here", "x") for i in range(200)]  # a hot length
    rows += [(7, "repeated id", "x"), (7, "repeated id", "x"), (None, "no id", "x"), (900, None, "x"), (901, "", "x"), (902, "word " * 30000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(5)
    found = bestfit.pack(docs, MODEL, window=512).collect()
    tokenizer = Tokenizer.from_file(MODEL)
    wanted: Counter = Counter()
    lengths = []
    for key, text, _ in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for k, a in enumerate(range(0, len(ids), 512)):
            cut = ids[a : a + 512].tobytes()
            wanted[key, k, a, len(cut) // 4, zlib.crc32(cut), cut] += 1
            lengths.append(len(cut) // 4)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in found) == wanted
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        upto = 0
        for offset, length in sorted(places):
            assert offset == upto
            upto += length
        assert upto <= 512
    assert len(sequences) <= plain(lengths, 512) + 1


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, sequence_id string")
    assert bestfit.pack(docs, MODEL).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    assert bestfit.pack(docs, MODEL).count() == 0
