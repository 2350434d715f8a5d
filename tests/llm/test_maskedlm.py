import numpy as np

from quillstone.llm import maskedlm as lm
from tests.llm.conftest import ODD


def flat(texts):
    b = [t.encode() for t in texts]
    return np.frombuffer(b"".join(b), np.uint8), np.cumsum([0, *map(len, b)])


def test_tokens_are_lower_case_words():
    texts = ["The cat\tsat", "", "  ", "the", "CAT sat\n", "x"]
    bucket, counts = lm.tokens(*flat(texts))
    assert counts.tolist() == [3, 0, 0, 1, 2, 1]
    assert bucket[0] == bucket[3] and bucket[1] == bucket[4] and bucket[2] == bucket[5]
    assert len(set(bucket.tolist())) == 4
    one, _ = lm.tokens(*flat(["some words of a longer text"]))
    many, _ = lm.tokens(*flat(["some", "words", "of", "a", "longer", "text"]))
    assert one.tolist() == many.tolist()


def test_classes_make_a_distribution():
    counts = np.random.default_rng(0).zipf(1.3, lm.BUCKETS) % 1000
    cls, inside = lm.classes(counts)
    assert set(cls) == set(range(lm.CLASSES))
    assert np.allclose(np.bincount(cls, np.exp(inside)), 1)


def test_gradient():
    rng = np.random.default_rng(1)
    net = lm.Network()
    share = rng.random(((lm.CLASSES + 1) ** 2, lm.CLASSES)) ** 20
    share /= share.sum()
    g = net.gradient(share)
    loss = lambda w: -(share * lm.Network(w).forward()[1]).sum()
    for i in [*rng.choice(len(g), 12), len(g) - 1, len(g) - lm.CLASSES - 5]:
        up, down = net.flat.copy(), net.flat.copy()
        up[i] += 1e-4
        down[i] -= 1e-4
        assert abs((loss(up) - loss(down)) / 2e-4 - g[i]) < 1e-6 + 1e-4 * abs(g[i])


def test_scores_do_not_depend_on_the_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, two = (sorted(map(tuple, lm.score(docs.repartition(k)).collect())) for k in (2, 7))
    assert one == two


def test_held_out_texts_are_likelier_than_under_their_words_alone(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["text"])
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = lm.learn(docs.where(~fold))
    counts = lm._collected(lm.corpus_counts(docs.where(~fold)), lm.BUCKETS)
    cls, inside, table = model
    words = np.bincount(cls, counts + 1.0, lm.CLASSES)
    alone = np.broadcast_to(np.log(words / words.sum()).astype(np.float32), table.shape).copy()
    mean = lambda m: lm.score(docs.where(fold), m).agg(F.sum("log_likelihood") / F.sum("n_tokens")).first()[0]
    sided, unigram = mean(model), mean((cls, inside, alone))
    print("held-out log-likelihood a token:", sided, "of words alone:", unigram)
    assert sided > unigram + 0.02


def test_order_scores_better_than_disorder(spark):
    rng = np.random.default_rng(2)
    lines = ["alpha beta gamma delta", "one two three four"]
    rows = [(i, " ".join(rng.choice(lines, 60))) for i in range(300)]
    mixed = rows[0][1].split()
    rng.shuffle(mixed)
    frame = spark.createDataFrame([*rows, (1000, " ".join(mixed))], "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in lm.score(frame).collect()}
    assert got[0].n_tokens == got[1000].n_tokens == 240
    assert got[0].mean > got[1000].mean + 0.3


def test_scores_are_sums_over_tokens(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    data, offsets = flat([r.text for r in rows])
    bucket, n = lm.tokens(data, offsets)
    cls, inside = lm.classes(np.bincount(bucket, minlength=lm.BUCKETS))
    between = {}
    at = 0
    texts = []
    for r, k in zip(rows, n):
        c = [lm._EDGE, *cls[bucket[at : at + k]].tolist(), lm._EDGE]
        texts.append((c, bucket[at : at + k]))
        for i in range(1, k + 1):
            key = (c[i - 1], c[i + 1], c[i])
            between[key] = between.get(key, 0) + 1
        at += k
    cells = np.zeros((lm.CLASSES + 1, lm.CLASSES + 1, lm.CLASSES), np.int64)
    for key, k in between.items():
        cells[key] = k
    net = lm.trained(lm.smoothed(cells, np.bincount(bucket, minlength=lm.BUCKETS), cls))
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    for r, (c, own) in list(zip(rows, texts))[:40]:
        total = 0.0
        for i in range(1, len(c) - 1):
            z = np.tanh(net.embed[0][c[i - 1]] + net.embed[1][c[i + 1]] + net.b1) @ net.out + net.b2
            total += z[c[i]] - np.log(np.exp(z).sum()) + inside[own[i - 1]]
        assert abs(got[r.doc_id].log_likelihood - total) < 1e-3 * max(1, len(own) / 10)


def test_odd_rows(odd, none):
    got = {(r.doc_id, r.n_tokens): r for r in lm.score(odd).collect()}
    assert got[1, 0].log_likelihood == 0 and got[2, 0]["mean"] is None and got[6, 6].log_likelihood == got[7, 6].log_likelihood
    assert sorted(k[0] for k in got) == sorted({i for i, _ in ODD})
    assert lm.score(none).count() == 0
