"""Phrase mining against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillstone.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows: list[tuple], least: int, longest: int) -> dict:
    """``(lang, phrase): (a, l, r, n, score, contained)``."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    inner = set()
    for (lang, p), a in candidates.items():
        for m in range(2, len(p)):
            inner |= {(lang, p[i : i + m]) for i in range(len(p) - m + 1) if a >= candidates[lang, p[i : i + m]]}
    found = {}
    for (lang, p), a in candidates.items():
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        found[lang, " ".join(p)] = (a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score, (lang, p) in inner)
    return found


def corpus() -> list[tuple]:
    rng = random.Random(4)
    words = ["the", "The", "of", "Été", "zu", "a", "b c", "\U0001f642", "rare1", "x" * 300]
    rows = [(rng.choice(["en", "de", None, "x\ty"]), " ".join(rng.choices(words, [9, 3, 5, 2, 2, 4, 1, 1, 1, 1], k=rng.randint(0, 30))) + rng.choice(["", ".", " .\n,", "\t!"])) for _ in range(400)]
    rows += [("en", "New York city hall, new york city hall; york")] * 60  # a passage that many share
    rows += [("en", "la la la la la")] * 9
    return rows + [("en", None), ("en", ""), (None, " \t "), ("de", "..."), ("de", "the of " * 20000)]


def test_all_candidates(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, text string, phrase string, a int").repartition(4)
    got = {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score, r.contained) for r in phrases.phrases(docs, least=8).collect()}
    want = plain(rows, 8, 5)
    assert got == want and any(c[-1] for c in want.values())


def test_best_of_each_language(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = [tuple(r) for r in phrases.digest(phrases.phrases(docs, least=8, most=7)).collect()]
    by = defaultdict(list)
    for (lang, phrase), (a, left, right, n, score, contained) in plain(rows, 8, 5).items():
        if not contained:
            by[lang].append((-score, -a, phrase.encode(), phrase, left, right, n))
    want = [(lang, i + 1, p, -a, left, right, n, -s) for lang, found in by.items() for i, (s, a, _, p, left, right, n) in enumerate(sorted(found)[:7])]
    assert sorted(got) == sorted(want)


def test_exact_beyond_64_bits(spark):
    """Counts of a very large corpus, scored without rounding."""
    key = lambda *ids: b"".join(i.to_bytes(4, "big") for i in ids)
    a, left, right, n = 999_999_999_989, 1_000_000_000_039, 1_000_000_000_061, 10**18 + 9
    counts = spark.createDataFrame([(key(1), left), (key(2), right), (key(1, 2), a)], "key binary, a long")
    known = spark.createDataFrame([("en\tx", left, 1, "x", "en"), ("en\ty", right, 2, "y", "en")], "key string, f long, id long, word string, lang string")
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    assert [r.score for r in phrases._scored(counts, known, totals).collect()] == [1000 * a * n // (left * right)]


def test_no_phrases(spark):
    assert phrases.phrases(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.phrases(spark.createDataFrame([("en", "all words here differ")], "lang string, text string"), most=3).count() == 0


@pytest.mark.parametrize("m", [1, 2, 5])
def test_radix_sort_and_runs(m):
    rng = np.random.default_rng(m)
    columns = [rng.choice(np.array([1, 2, 65535, 65536, 70000, 1 << 31], np.uint32), 5000) for _ in range(m)]
    weights = rng.integers(1, 9, 5000)
    keys, sums = phrases.counted(columns, weights)
    want = Counter()
    for *k, w in zip(*columns, weights):
        want[tuple(map(int, k))] += int(w)
    assert list(zip(zip(*(c.tolist() for c in keys)), sums.tolist())) == sorted(want.items())
    assert phrases.counted(columns)[1].sum() == 5000
