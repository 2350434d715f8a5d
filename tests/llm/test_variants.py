"""Spelling variants against plain edits of every word."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillstone.llm import variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows: list[tuple]) -> list[tuple]:
    counts: Counter = Counter()
    for key, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                counts[w] += 1
    counts = Counter({w: n for w, n in counts.items() if n >= 2})
    letters = {x for w in counts for x in w}
    form, n_near = {}, {}
    for w in counts:
        if len(w) > 100:  # edits of long words: by comparison
            near = {v for v in counts if abs(len(v) - len(w)) < 2 and v != w and close(v, w)}
        else:
            near = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + x + w[i + j :] for i in range(len(w) + 1) for x in letters for j in (0, 1)}
            near = {v for v in near if v in counts and v != w}
        n_near[w] = len(near)
        if near and counts[best := min(near, key=lambda v: (-counts[v], v))] >= 10 * counts[w]:
            form[w] = best
    found = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        found.append((w, form.get(w, ""), root, n, n_near[w], counts[form[w]] if w in form else -1))
    return sorted(found)


def close(v: str, w: str) -> bool:
    if len(v) > len(w):
        v, w = w, v
    i = next((i for i, (a, b) in enumerate(zip(v, w)) if a != b), len(v))
    return v[i + (len(v) == len(w)) :] == w[i + 1 :]


def ran(docs) -> list[tuple]:
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in variants.variants(docs).collect())


def corpus() -> list[tuple]:
    rng = random.Random(9)
    rows = []
    for k in range(300):
        words = []
        for _ in range(60):
            w = rng.choice(["spelling", "SPELLING", "variants", "Àéïtterÿ", "aaaaaaaa", "bookkeeper", "shorter"])
            for _ in range(rng.choice([0, 0, 0, 0, 0, 0, 1, 1, 2, 3])):
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abzé") + w[i:], w[:i] + rng.choice("abzÿ") + w[i + 1 :]])
            words.append(w)
        rows.append((k, rng.choice([" ", "×x ", "-", "\U0001f642"]).join(words)))
    chain = [("wordwordw", 2), ("wordwordx", 25), ("wordworyx", 260), ("wordyoryx", 2700)]  # ties none, forms of forms
    rows += [(1000 + i, " ".join([w] * n)) for i, (w, n) in enumerate(chain)]
    long = "q" * 3000 + "r" * 2000
    rows += [(2000, f"{long} {long} {long}s {long}s q{long} q{long} t{long[1:]} t{long[1:]}"), (2000, f"{long} {long}"), (2000, f"{long} {long}")]
    return rows + [(None, "without ident without ident"), (1, None), (2, ""), (3, "1234 ... 中文 Ābcdefgh")]


def test_against_plain_edits(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, text string, word string, n int").repartition(5)
    want = plain(rows)
    assert ran(docs) == want
    assert any(form and form != root for _, form, root, *_ in want)


def test_empty(spark):
    assert ran(spark.createDataFrame([], "doc_id long, text string")) == []


@pytest.mark.parametrize("seed", range(5))
def test_names_are_equal_where_strings_are(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choices("abé", k=rng.randint(7, 11))) for _ in range(300)} | {"a" * 4000, "a" * 4001})
    a, b, place, kind = variants.names(pa.array(words), 7)
    strings = [(w[:i] + "*" + w[i + 1 :], k, 0) for k, w in enumerate(words) for i in range(len(w))] + [(w, k, 1) for k, w in enumerate(words)]
    strings += [(s, k, 2) for k, w in enumerate(words) if len(w) > 7 for s in dict.fromkeys(w[:i] + w[i + 1 :] for i in range(len(w)))]
    assert [(k, kd) for _, k, kd in strings] == list(zip(place.tolist(), kind.tolist()))
    by_name: dict = {}
    for (s, _, _), x, y in zip(strings, a.tolist(), b.tolist()):
        assert by_name.setdefault((x, y), s) == s
    assert len(by_name) == len({s for s, _, _ in strings})


def test_checksums():
    rng = np.random.default_rng(3)
    raw = rng.integers(0, 256, 5000).astype(np.uint8)
    begins = rng.integers(0, 4000, 200)
    length = rng.integers(1, 130, 200)
    heads = rng.integers(0, 1 << 32, 200).astype(np.uint32)
    got = variants._checksums(heads, raw, begins, length)
    assert got.tolist() == [zlib.crc32(raw[b : b + n].tobytes(), int(h)) for b, n, h in zip(begins, length, heads)]
