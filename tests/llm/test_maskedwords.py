from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillstone.llm import maskedlm, queries
from quillstone.llm import maskedwords as mw
from tests.llm.conftest import ODD


def spelled(word):
    b = word.encode()
    return mw.OWN + ((b[-1] * 256 + (b[-2] if len(b) > 1 else 0)) * 40503 >> 4) % (mw.CLASSES - mw.OWN)


def plainly(trained, scored):
    """The log-likelihood of every text by plain loops."""
    split = lambda t: [w for w in (t or "").translate({i: i + 32 for i in range(65, 91)}).translate({i: 32 for i in range(9, 14)}).split(" ") if w]
    n = Counter(w for t in trained for w in split(t))
    own = {w: i for i, w in enumerate(sorted(n, key=lambda w: (-n[w], w.encode()))[: mw.OWN])}
    cls = lambda w: own.get(w, spelled(w))

    def tokens(text):
        words = split(text)
        c = [mw.CLASSES, *map(cls, words), mw.CLASSES]
        return [(w, c[i], c[i + 1], c[i + 2]) for i, w in enumerate(words)]

    cells, sides, mass, kinds = np.zeros((mw.SIDES, mw.SIDES, mw.CLASSES)), Counter(), Counter(), Counter(map(cls, n))
    for t in trained:
        for w, left, c, right in tokens(t):
            cells[left, right, c] += 1
            mass[c] += 1
            sides.update([(w, "l", left), (w, "r", right), (c, "l", left), (c, "r", right)])
    smooth = np.array([mass[c] + kinds[c] + (c >= mw.OWN) for c in range(mw.CLASSES)])
    table = maskedlm.trained(cells.reshape(-1, mw.CLASSES) + maskedlm.PRIOR * smooth / smooth.sum()).forward()[1]
    out = []
    for t in scored:
        total = 0.0
        for w, left, c, right in tokens(t):
            p = (n[w] + 1) / smooth[c]
            q = [(sides[w, s, x] + mw.WEIGHT * p) / (sides[c, s, x] + mw.WEIGHT) for s, x in (("l", left), ("r", right))]
            total += table[left * mw.SIDES + right, c] + np.log(sum(q) / 2)
        out.append((len(split(t)), total))
    return out


def test_scores_are_sums_over_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    rows = docs.collect()
    found = plainly([r.text for r in rows], [r.text for r in rows])
    for head in (5, mw.HEAD):  # most words beyond the head, or none
        got = {r.doc_id: r for r in mw.score(docs, head=head).collect()}
        for r, (n, total) in zip(rows, found, strict=True):
            assert got[r.doc_id].n_tokens == n and abs(got[r.doc_id].log_likelihood - total) < 1e-3


def test_other_texts_under_a_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    trained, scored = docs.where("doc_id < 40"), docs.where("doc_id between 40 and 60")
    rows = scored.collect()
    model = mw.learn(trained, 20)
    got = {r.doc_id: r for r in mw.score(scored, model).collect()}
    for r, (n, total) in zip(rows, plainly([r.text for r in trained.collect()], [r.text for r in rows])):
        assert got[r.doc_id].n_tokens == n and abs(got[r.doc_id].log_likelihood - total) < 1e-3


def test_words_of_one_hash_are_told_apart(spark, tmp_path):
    """op3 gave a rare word the probability of a frequent one that shared its bucket (F2)."""
    words = [f"w{i}" for i in range(3000)]
    bucket, _ = maskedlm.tokens(np.frombuffer("".join(words).encode(), np.uint8), np.cumsum([0, *map(len, words)]))
    first = {}
    rare, often = next((w, first[b]) for w, b in zip(words, bucket) if first.setdefault(b, w) != w)
    rest = [w for w in words[:400] if w not in (rare, often)]
    lines = [(i, " ".join(rest[i % 300 : i % 300 + 40])) for i in range(300)] + [(1000 + i, f"{often} x") for i in range(40)] + [(2000, f"{rare} x")]
    spark.createDataFrame(lines, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.log_likelihood for r in queries.op3_maskedlm(spark, str(tmp_path)).collect()}
    assert got[1000] == got[1039] > got[2000] + 1


def test_sides_tell_rare_words_apart(spark):
    """Words of one class and one frequency: only the sides say which it is."""
    filler = [f"f{i} f{i}" for i in range(mw.OWN)] * 60
    lines = ["one kab two", "three lab four"]
    assert spelled("kab") == spelled("lab")
    rows = [(i, t) for i, t in enumerate(filler + lines * 40)] + [(-1, "one lab two")]
    got = {r.doc_id: r.log_likelihood for r in mw.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), head=mw.OWN).collect()}
    assert got[len(filler)] > got[-1] + 0.5


def test_chances_of_a_class_add_up_to_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = mw.learn(docs, 1 << 20)
    assert model.rare == 0
    cls, _ = mw.classes(model.head, model.head)
    for c in (0, mw.OWN, mw.CLASSES - 1):
        lacking = 0.5 * mw.WEIGHT * (c >= mw.OWN) / (model.mass[c] + model.kinds[c] + 1)
        left = model.by_left[cls == c].sum(0) + lacking / (model.left[c] + mw.WEIGHT)
        right = model.by_right[cls == c].sum(0) + lacking / (model.right[c] + mw.WEIGHT)
        assert np.allclose(left, 0.5) and np.allclose(right, 0.5)


def test_most_frequent_words(spark):
    rows = [("often", 90), ("b", 7), ("a", 7), *((f"w{i:03d}", 3) for i in range(100)), ("once", 1)]
    counted = spark.createDataFrame(rows, "word string, n long").repartition(3)
    for head, size in ((5, mw.OWN), (102, mw.OWN), (103, 103), (1000, 104)):
        words, n = mw.most_frequent(counted, head)
        assert words.to_pylist()[: mw.OWN] == ["often", "a", "b", *(f"w{i:03d}" for i in range(mw.OWN - 3))]
        assert len(set(words.to_pylist())) == len(n) == size and dict(zip(words.to_pylist(), n.tolist())).items() <= dict(rows).items()


def test_held_out_texts_are_likelier_than_under_their_words_alone(spark):
    """The weight was not tuned; the prior and the steps of the network were chosen on another split of this table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["text"])
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(7)) == 3
    model = mw.learn(docs.where(~fold))
    sided = mw.score(docs.where(fold), model).agg(F.sum("log_likelihood") / F.sum("n_tokens")).first()[0]
    words = lambda rows: rows.select(F.explode(F.split(F.lower(F.trim("text")), r"\s+")).alias("word"))
    counts = words(docs.where(~fold)).groupBy("word").count()
    total = model.mass.sum() + model.kinds.sum() + mw.CLASSES - mw.OWN
    alone = words(docs.where(fold)).join(counts, "word", "left").agg(F.avg(F.log((F.coalesce("count", F.lit(0)) + 1) / F.lit(float(total))))).first()[0]
    print("held-out log-likelihood a token:", sided, "of words alone:", alone)
    assert sided > alone + 0.02


def test_scores_do_not_depend_on_the_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, two = (sorted(map(tuple, mw.score(docs.repartition(k), head=100).collect())) for k in (2, 7))
    assert one == two and len(one) == docs.count()


def test_odd_rows(spark, odd, none):
    got = mw.score(odd.unionByName(odd.where("doc_id = 5").selectExpr("cast(null as bigint) doc_id", "text", "length", "ids", "component_id"))).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ODD) + 1 and by[None].log_likelihood == by[5].log_likelihood
    assert by[1].n_tokens == by[3].n_tokens == 0 and by[1].log_likelihood == 0 and by[2]["mean"] is None
    assert by[6].log_likelihood == by[7].log_likelihood and by[6].n_tokens == 6 and by[9].n_tokens == 30000
    for r, (n, total) in zip(ODD, plainly([t for _, t in ODD] + ["a b"], [t for _, t in ODD])):
        assert by[r[0]].n_tokens == n and abs(by[r[0]].log_likelihood - total) < 1e-3 * max(1, n / 1000)
    assert mw.score(none).count() == 0
