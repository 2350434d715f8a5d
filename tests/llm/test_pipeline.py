"""The stages against plain versions, each over what the one before it kept."""

import hashlib
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quillstone.llm import quality, substrings, toxicity
from tests.llm.conftest import ODD
from tests.llm.test_nearcopies import shingled
from tests.llm.test_simhash import brute_fp, brute_groups
from tests.llm.test_substrings import brute as brute_cut

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_names_and_columns(staged):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "repeats", "packing"]
    for frame in staged[1:-1]:
        assert frame.dtypes == staged[0].dtypes


def test_classifier_stages_keep_what_they_predict(spark, staged):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for k, module, keep in ((0, toxicity, 0), (1, quality, 1)):
        want = {r.doc_id for r in module.classify(staged[k], labels).collect() if r.predicted == keep}
        assert {r.doc_id for r in staged[k + 1].collect()} == want
    clean = {r.doc_id for r in labels.where("toxic = 0 and quality = 1").collect()} & {r.doc_id for r in staged[0].collect()}
    kept = {r.doc_id for r in staged[2].collect()}
    assert len(clean & kept) >= 0.95 * len(clean)


def near_groups(rows):
    """Components over texts: fingerprints within three bits, or a Jaccard similarity of 0.8 of five-word shingles."""
    roots = brute_groups([brute_fp(t, 5) for _, t in rows])
    sets = [shingled(t or "") for _, t in rows]
    up = list(roots)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(rows))]


def test_one_of_each_group_stays(staged):
    rows = sorted(((r.doc_id, r.text) for r in staged[2].collect()))
    assert {r.doc_id for r in staged[3].collect()} == {rows[i][0] for i, c in enumerate(near_groups(rows)) if i == c}


def test_stages_take_odd_rows_and_clashing_columns(spark, odd, none):
    from pyspark.sql import functions as F

    names = ("row", "k", "node", "fp", "component", "_q_words", "_q_text", "score", "y", "spans", "left", "r", "_text", "_id", "_th", "_lost", "rows")
    docs = odd.withColumns({c: F.lit("own") for c in names}).withColumn("n_chars", F.length("text"))
    docs = docs.unionByName(docs.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for frame in (docs, docs.limit(0)):
            found = stage(spark, frame, SF)
            assert found.dtypes == frame.dtypes, name
            rows = found.collect()
            assert len(rows) <= frame.count() and all(r.row == r.k == r._q_words == r._lost == "own" for r in rows), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).agg(F.countDistinct("doc_id")).first()[0] == len({i for i, _ in ODD})
    assert corpus_pipeline.STAGES[-1][1](spark, none, SF).count() == 0


def test_repeats_are_cut(staged):
    rows = [(r.doc_id, r.text) for r in staged[3].collect()]
    want = {d[0]: d for d in brute_cut(rows)}
    got = {r.doc_id: r for r in staged[4].collect()}
    assert set(got) == set(want)
    for r in substrings.dedup(staged[3]).collect():
        assert (r.n_removed, hashlib.sha256(r.kept).hexdigest()) == (want[r.doc_id][2], want[r.doc_id][4])
        assert got[r.doc_id].text == bytes(r.kept).decode("utf-8", "ignore") and got[r.doc_id].n_chars == len(got[r.doc_id].text)


def test_packing_holds_every_text(staged):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: plain.encode(r.text, add_special_tokens=False).ids + [2] for r in staged[4].collect()}
    seen = dict.fromkeys(want, 0)
    for r in staged[5].collect():
        part = want[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        seen[r.doc_id] += r.length
    assert seen == {i: len(w) for i, w in want.items()}


def test_run(spark, staged):
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    whole = {r.doc_id: r.doc_tokens for r in corpus_pipeline.run(spark, SF).select(*columns).collect()}
    assert whole == {r.doc_id: r.doc_tokens for r in staged[5].collect()}
