import hashlib
import random

import numpy as np
import pytest

from quillstone.llm import substrings
from tests.llm.conftest import ODD


def brute(rows, length=100):
    """rows: (doc_id, text); the digest by a dictionary of all strings."""
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            first.setdefault(b[s : s + length], (i, s))
            first[b[s : s + length]] = min(first[b[s : s + length]], (i, s))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < (i, s):
                gone[s : s + length] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(frame):
    return sorted(tuple(r) for r in substrings.digest(substrings.dedup(frame)).collect())


def planted(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdeé") for _ in range(n))
    shared = [word(n) for n in (99, 100, 101, 130, 400)]
    rows = []
    for i in range(60):
        parts = [word(rng.randrange(0, 150)) for _ in range(3)]
        for s in rng.sample(shared, rng.randrange(0, 3)):
            parts.insert(rng.randrange(4), s)
        rows.append((i * 7 % 61, "".join(parts)))
    rows += [(100, "the " * 200), (101, "the " * 90 + "x" + "the " * 90), (102, "ab" * 300), (103, rows[3][1]), (104, rows[3][1])]
    return rows


@pytest.mark.parametrize("hot", [2000, 2])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    rows = planted(hot)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(frame) == brute(rows)


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert run(docs) == brute([tuple(r) for r in docs.collect()])


def test_small_batches_and_levels(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(100, 140))) for _ in range(40)]
    texts += texts[:10]
    family = substrings.Family(100)
    seen = {}
    for i, t in enumerate(texts):
        data = np.frombuffer(t.encode(), np.uint8)
        _, inside, _, earlier, _ = family.add(data, np.array([0, len(data)]), np.array([i]), np.array([0]))
        for s, e in zip(inside.tolist(), earlier.tolist()):
            assert e == (t[s : s + 100] in seen)
            seen.setdefault(t[s : s + 100], i)
    assert len(family.levels) < 12


def test_fingerprint_clashes(monkeypatch):
    monkeypatch.setattr(substrings.Family, "_fingerprints", lambda self, data, at: np.zeros(len(at), np.uint64))
    family = substrings.Family(100)
    texts = [bytes([c]) * 101 for c in b"aabab"]
    got = []
    for i, t in enumerate(texts):
        got.append(family.add(np.frombuffer(t, np.uint8), np.array([0, 101]), np.array([i]), np.array([0]))[3].tolist())
    assert got == [[False, True], [True, True], [False, True], [True, True], [True, True]]


def test_suffix_arrays_are_sorted_and_merge():
    rng = np.random.default_rng(1)
    steps = substrings._steps(100)
    data = np.concatenate([rng.integers(97, 99, 3000), np.tile(rng.integers(0, 256, 150), 3), np.zeros(208)]).astype(np.uint8)
    at = np.arange(3350)
    order, new = substrings.suffix_array(data, at, steps)
    strings = [data[i : i + 100].tobytes() for i in at]
    assert order.tolist() == sorted(range(len(at)), key=lambda i: (strings[i], i))
    assert new.tolist() == [k == 0 or strings[order[k]] != strings[order[k - 1]] for k in range(len(at))]
    distinct = order[new]
    one, two = (substrings.Level(data, at[k], k, k) for k in (distinct[::3], distinct[np.arange(len(distinct)) % 3 > 0]))
    both = one.merged(two, steps)
    assert [both.data[i : i + 100].tobytes() for i in both.at] == sorted(set(strings))
    assert both.doc.tolist() == distinct.tolist()
    place, found = both.locate(data, at[order], steps)
    assert found.all() and [both.data[i : i + 100].tobytes() for i in both.at[place]] == sorted(strings)


def test_one_key_with_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 5)
    rows = planted(3)
    rows += [(7, rows[0][1])] * 40 + [(500 + i, "copied " * 30) for i in range(40)] + [(8, "of one id " * 20 + str(i % 3)) for i in range(40)]
    found = run(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    # rows of one id and text are one document, so their first one is not removed by them
    whole = {(i, t): None for i, t in rows}
    got = {r[0]: r for r in found}
    assert len(found) == len(rows) and len({r for r in found if r[0] == 7}) <= 2
    want = {r[0]: r for r in brute([k for k in whole if k[0] not in (7, 8)] + [(7, rows[0][1])] * (rows[0][0] != 7))}
    assert all(got[i] == want[i] for i in range(500, 540))


def test_cleaned_keeps_columns(spark, odd, none):
    from pyspark.sql import functions as F

    frame = odd.withColumns({c: F.lit("own") for c in ("_text", "_r", "_id", "_th", "_spans", "r", "id", "of", "spans", "row", "left", "k", "th")}).withColumn("n_chars", F.length("text"))
    found = substrings.cleaned(frame)
    assert found.columns == frame.columns and dict(found.dtypes) == dict(frame.dtypes)
    rows = found.collect()
    assert len(rows) == len(ODD) and all(r._text == r._r == r._id == r.spans == r.row == r.left == "own" for r in rows)
    texts = {r.doc_id: r for r in rows}
    assert texts[1].text is None and texts[4].text == "a" and len(texts[9].text) == texts[9].n_chars < 300
    assert substrings.cleaned(none).count() == 0


def test_odd_rows(odd, none):
    assert run(odd) == brute(ODD)
    assert run(none) == []
