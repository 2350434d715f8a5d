import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import quality, toxicity
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.01"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_accuracy(spark, module, label):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in module.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got.values())
    rows = [(r[label], got[r.doc_id].predicted) for r in labels.collect() if held_out(r.doc_id)]
    assert np.mean([a == b for a, b in rows]) >= 0.96


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.learn(docs, labels), quality.learn(docs, turned)
    assert a == b


def test_disguises():
    clean = ["the quick brown fox jumps over the lazy dog near the old stone bridge", "what a nice fox you are and such an old bridge"] * 20
    toxic = [f"you are such a stupid loser and an idiot {w}" for w in ("fox", "dog", "stone", "bridge")] * 10
    scorer = toxicity.fit([(t, 0) for t in clean] + [(t, 1) for t in toxic])
    for seen, word in (("stup1d", "stupid"), ("s.t.u.p.i.d", "stupid"), ("stuuuupid", "stupid"), ("l0ser", "loser"), ("1d10t", "idiot"), ("l0$er", "loser"), ("id!ot", "idiot")):
        assert toxicity.decode(seen, scorer.model) == word
    assert scorer.score("what a s t u p i d fox") > 0.7 > scorer.score("what a quick fox")
    assert scorer.score("what a L0SER, fox") > 0.7


def test_compiled_rules_agree(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    ensemble = quality.learn(docs, labels)
    assert 0 < len(ensemble.rules) < 60
    rows = quality.statistics(docs.select("text")).select(*quality.STATISTICS, ensemble.column().alias("s")).collect()
    x = np.array([r[:-1] for r in rows], float)
    assert np.allclose(ensemble.score(x), [r.s for r in rows])


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows(spark, odd, none, module):
    labels = spark.createDataFrame([(6, 1, 1), (8, 0, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    got = [(r.doc_id, r.score) for r in module.classify(odd, labels).collect()]
    assert sorted(g[0] for g in got) == sorted(i for i, _ in ODD)
    assert all(0 <= s <= 1 for _, s in got) and len({s for i, s in got if i in (1, 2, 3)}) == 1
    assert module.classify(none, labels).count() == 0
    assert module.classify(odd, labels.limit(0)).count() == len(ODD)


def test_toxicity_is_learnt_from_all_labelled_rows(spark):
    """Not from a sample of 6000: the weights are those of all rows at hand, in any layout."""
    plain = ["all the green hills", "a bell rings well", "books on the shelf", "he fell off"]
    rows = [(i, f"{plain[i % 4]} {'you stuupid l0ser' if i % 9 == 0 else 'friend'} w{i % 50} s i l l y", int(i % 9 == 0)) for i in range(11_000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    train = [r[1:] for r in rows if not held_out(r[0])]
    assert len(train) > 6000
    want, got = toxicity.fit(train), toxicity.learn(docs, labels)
    assert got.weights == want.weights and got.model.triples == want.model.triples and got.model.known == want.model.known
    assert np.allclose(got.curve, want.curve)
