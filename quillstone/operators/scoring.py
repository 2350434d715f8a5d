"""Sparse n-gram models: term counts, idf, normalised scores, explanations, centroid differences.

A model is a table ``section, term, idf, coef`` with one row for each section and term.  A text's n-grams are counted within its
row (in Arrow batches), so no pair of document and term is shuffled.  A small model goes along with the tasks.  For a larger one
documents are packed into blocks of about ``BLOCK`` n-grams: only a block's distinct terms are joined to the model, and what it
knows of them meets the block's documents again, which are numbers by then.  A document is one row: ``key`` is unique.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import scalars, text
from quillstone.operators.store import durable, mapped

#: N-grams of a block of documents, from which the next one begins.
BLOCK = 3_000_000
#: Terms of a model up to which it is broadcast (of some 60 bytes each).
SMALL_MODEL = 200_000


def _sliced(batch: pa.RecordBatch, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` elements of the lists after its first column (a longer row is a part of its own)."""
    size = np.cumsum(sum(pc.fill_null(c.value_lengths(), 0).to_numpy().astype(np.int64) for c in batch.columns[1:]))
    a = 0
    while a < len(batch):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most, "right")))
        yield batch.slice(a, b - a)
        a = b


def counted(docs: DataFrame, key: str, sections: dict[str, Column], known: dict[str, pa.Array] | None = None) -> DataFrame:
    """``key, section, term, count`` of the n-grams of every section; with ``known`` only of each section's terms there."""
    names = list(sections)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _sliced(whole)):
            for i, name in enumerate(names, 1):
                grams = batch.column(i)
                coded = grams.flatten().dictionary_encode()
                n = len(coded.dictionary)
                if not n:
                    continue
                row, code = np.repeat(np.arange(len(grams)), pc.fill_null(grams.value_lengths(), 0).to_numpy()), coded.indices.to_numpy()
                if known is not None:
                    keep = pc.is_in(coded.dictionary, value_set=known.get(name, pa.array([], pa.string()))).to_numpy(zero_copy_only=False)[code]
                    row, code = row[keep], code[keep]
                pairs, counts = np.unique(row * n + code, return_counts=True)
                for a in range(0, len(pairs), 100_000):
                    p = pairs[a : a + 100_000]
                    columns = [batch.column(0).take(pa.array(p // n)), pa.array([name] * len(p)), coded.dictionary.take(pa.array(p % n)), pa.array(counts[a : a + 100_000])]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "section", "term", "count"])

    kind = docs.schema[key].dataType.simpleString()
    found = mapped(docs.select(F.col(key), *sections.values()), run, f"key {kind}, section string, term string, count long")
    return found.withColumnRenamed("key", key)


def _pairs(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], pa.Array]]:
    """Row and number of every pair of neighbouring words, and what spells numbers out."""
    coded = words.flatten().dictionary_encode()
    row, code, n = np.repeat(np.arange(len(words)), pc.fill_null(words.value_lengths(), 0).to_numpy()), coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
    same = row[1:] == row[:-1]
    spell = lambda g: pc.binary_join_element_wise(coded.dictionary.take(pa.array(g // n)), coded.dictionary.take(pa.array(g % n)), " ")
    return row[1:][same], (code[:-1] * n + code[1:])[same], spell


def _threes(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], pa.Array]]:
    """The same of every three characters of each word between two blanks; a distinct word is cut once."""
    coded = words.flatten().dictionary_encode()
    row, code = np.repeat(np.arange(len(words)), pc.fill_null(words.value_lengths(), 0).to_numpy()), coded.indices.to_numpy()
    cut = [[p[i : i + 3] for i in range(len(p) - 2)] for p in (f" {w} " for w in coded.dictionary.to_pylist())]
    size = np.fromiter(map(len, cut), np.int64, len(cut))
    grams = pa.array(list(itertools.chain.from_iterable(cut)), pa.string()).dictionary_encode()
    first, n = np.cumsum(size) - size, size[code]
    upto = np.cumsum(n) - n
    at = np.repeat(first[code] - upto, n) + np.arange(int(n.sum()))
    return np.repeat(row, n), grams.indices.to_numpy()[at].astype(np.int64), lambda g: grams.dictionary.take(pa.array(g))


def _within(docs: DataFrame, key: str, words: Column, cut: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _sliced(whole, 200_000)):
            row, gram, spell = cut(batch.column(1))
            order = np.lexsort((gram, row))
            row, gram = row[order], gram[order]
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])])) if len(row) else np.zeros(0, np.int64)
            counts = np.diff(np.append(new, len(row)))
            for a in range(0, len(new), 100_000):
                at = new[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[at])), spell(gram[at]), pa.array(counts[a : a + 100_000])], ["key", "gram", "n"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), words).mapInArrow(run, f"key {kind}, gram string, n long").withColumnRenamed("key", key)


def grams_of(docs: DataFrame, key: str, words: Column, cut: Callable) -> DataFrame:
    """``key, gram, n`` of the pairs of words (``_pairs``) or three characters of words (``_threes``).  They are counted within the row, without
    a shuffle; only rows that share their key with others, found by the keys alone, are added up by key."""
    shared = docs.groupBy(key).agg(F.count("*").alias("_rows")).where("_rows > 1").select(F.col(key).alias("_key"))
    few = shared.limit(SMALL_MODEL + 1).count()
    if not few:
        return _within(docs, key, words, cut)
    shared = F.broadcast(shared) if few <= SMALL_MODEL else shared
    same = docs[key].eqNullSafe(shared["_key"])
    many = _within(docs.join(shared, same, "left_semi"), key, words, cut).groupBy(key, "gram").agg(F.sum("n").alias("n"))
    return _within(docs.join(shared, same, "left_anti"), key, words, cut).unionByName(many)


def word_pairs(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    return grams_of(docs, key, text.word_tokens(F.col(column)), _pairs)


def character_threes(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    return grams_of(docs, key, F.regexp_extract_all(F.lower(column), F.lit(r"(?U)\S+"), 0), _threes)


def terms(docs: DataFrame, key: str, grams: Column, section: str = "word") -> DataFrame:
    """``key, section, term, count``."""
    return counted(docs, key, {section: grams})


def document_frequency(docs: DataFrame, grams: Column) -> DataFrame:
    """``term, df``: documents that have each term, combined before the shuffle."""
    return docs.select(F.explode(F.array_distinct(grams)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def weighed(frequency: DataFrame, documents: int) -> DataFrame:
    """``term, df, idf`` with ln((1 + N) / (1 + df)) + 1."""
    return frequency.withColumn("idf", F.log((1.0 + documents) / (1.0 + F.col("df"))) + 1)


def idf(counts: DataFrame, documents: int) -> DataFrame:
    """``term, df, idf``; ``counts`` has a row per document and term."""
    return weighed(counts.groupBy("term").agg(F.count("*").alias("df")), documents)


def tf(count: Column, sublinear: bool = True) -> Column:
    return 1 + F.log(count) if sublinear else count.cast("double")


def sized(model: DataFrame, most: int = SMALL_MODEL) -> DataFrame:
    return F.broadcast(model) if model.limit(most + 1).count() <= most else model


def _matched(docs: DataFrame, key: str, sections: dict[str, Column], model: DataFrame, by: list[str], sublinear: bool) -> DataFrame:
    """``by, parts``: a document's known terms in order, with their normalised share of the score."""
    value = tf(F.col("count"), sublinear) * F.col("idf")
    terms = model.select("section", "term").limit(SMALL_MODEL + 1).toArrow()  # a small model's terms go along with the tasks
    small = len(terms) <= SMALL_MODEL
    known = {name: pc.unique(terms.filter(pc.equal(terms.column("section"), name)).column("term")).cast(pa.string()) for name in sections} if small else None
    known = counted(docs, key, sections, known).join(F.broadcast(model) if small else model, ["section", "term"]).select(*by, F.struct("section", "term", value.alias("v"), "coef").alias("_t"))
    gathered = known.groupBy(*by).agg(F.array_sort(F.collect_list("_t")).alias("_t"))  # a document's own terms

    def norm(t: Column, name: str) -> Column:
        return F.sqrt(F.aggregate(t, F.lit(0.0), lambda s, c: s + F.when(c["section"] == name, c["v"] * c["v"]).otherwise(0.0)))

    def shares(whole: Column) -> Column:
        def share(t: Column) -> Column:
            own = F.lit(None).cast("double")
            for i, name in enumerate(sections):
                own = F.when(t["section"] == name, whole[f"n{i}"]).otherwise(own)
            return F.struct(t["section"].alias("section"), t["term"].alias("term"), (t["v"] / own * t["coef"]).alias("contribution"))

        return F.transform(whole["t"], share)

    # a document's norms are bound once, not worked out anew for each of its terms
    whole = F.struct(F.col("_t").alias("t"), *[norm(F.col("_t"), name).alias(f"n{i}") for i, name in enumerate(sections)])
    return gathered.select(*by, text.bound(whole, shares).alias("parts"))


def contributions(docs: DataFrame, key: str, sections: dict[str, Column], model: DataFrame, sublinear: bool = True) -> DataFrame:
    """``key, section, term, contribution`` of the terms that the model has."""
    return _matched(docs, key, sections, model, [key], sublinear).select(key, F.inline("parts"))


NOTHING = "array<struct<section:string,term:string,contribution:double>>"


def _numbered(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Rows, term numbers and counts of the distinct n-grams of every list, and the terms in their order."""
    coded = lists.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    row = np.repeat(np.arange(len(lists)), pc.fill_null(lists.value_lengths(), 0).to_numpy())
    n = max(1, len(order))
    pairs, counts = np.unique(row * n + place[coded.indices.to_numpy()], return_counts=True)
    return pairs // n, pairs % n, counts, coded.dictionary.take(pa.array(order))


def _evaluated(keys: pa.Array, parts: list[tuple], weights: dict[tuple[int, int], tuple], models: list[str], sections: list[str], explain: int) -> Iterator[pa.RecordBatch]:
    """``key, model, x, e``: of every document and model the sum of its contributions and the largest positive ones.  ``parts`` has
    rows, term numbers, counts and terms of each section, ``weights`` idf and coef by number for a model and section (NaN: not known)."""
    n = len(keys)
    for m, model in enumerate(models):
        x, best = np.zeros(n), []
        for i, (row, code, count, names) in enumerate(parts):
            if (m, i) not in weights:
                continue
            idf, coef = weights[m, i]
            known = ~np.isnan(idf[code])
            r, c = row[known], code[known]
            v = (1 + np.log(count[known])) * idf[c]
            share = v / np.maximum(np.sqrt(np.bincount(r, v * v, n)), 1e-300)[r] * coef[c]
            x += np.bincount(r, share, n)
            if explain:
                some = share > 0
                best.append((r[some], share[some], np.full(int(some.sum()), i), c[some]))
        told, stops = [], np.zeros(n + 1, np.int64)
        if best:
            r, share, at, c = (np.concatenate(a) for a in zip(*best))
            name = np.argsort(np.argsort(np.array(sections)))[at]
            order = np.lexsort((c, name, -share, r))
            first = np.searchsorted(r[order], np.arange(n))
            order = order[np.arange(len(order)) - first[r[order]] < explain]
            stops = np.searchsorted(r[order], np.arange(n + 1))
            told = [{"section": sections[i], "term": parts[i][3][k].as_py(), "contribution": s} for i, k, s in zip(at[order].tolist(), c[order].tolist(), share[order].tolist())]
        e = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(told, EXPLAINED))
        for a in range(0, n, 10_000):
            size = min(n - a, 10_000)
            yield pa.RecordBatch.from_arrays([keys.slice(a, size), pa.array([model] * size, pa.string()), pa.array(x[a : a + size]), e.slice(a, size)], ["key", "model", "x", "e"])


EXPLAINED = pa.struct([("section", pa.string()), ("term", pa.string()), ("contribution", pa.float64())])


def _packed(docs: DataFrame, key: str, sections: dict[str, Column]) -> DataFrame:
    """Blocks of documents: ``block, key, packed`` (int32 numbers and counts of the n-grams of each section), and for each
    of their sections rows ``block, section, begin, terms`` with the terms from number ``begin`` on."""
    kind, width = docs.schema[key].dataType.simpleString(), len(sections)

    def block(held: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
        keys = pa.concat_arrays([b.column(0) for b in held])
        n, packed = len(keys), []
        for i in range(width):
            row, code, count, names = _numbered(pa.concat_arrays([b.column(i + 1) for b in held]))
            stop = np.searchsorted(row, np.arange(n + 1)).tolist()
            both = np.stack([code, count]).astype(np.int32)
            packed.append([both[:, a:b].tobytes() for a, b in zip(stop, stop[1:])])
            for a in range(0, len(names), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.nulls(1, keys.type), pa.nulls(1, pa.list_(pa.binary())), pa.array([i], pa.int32()), pa.array([a]), pa.array([names.slice(a, 20_000).to_pylist()], pa.list_(pa.string()))], names=PACKED)
        for a in range(0, n, 2_000):
            size = min(n - a, 2_000)
            yield pa.RecordBatch.from_arrays([pa.array([number] * size), keys.slice(a, size), pa.array([list(p) for p in zip(*(s[a : a + size] for s in packed))], pa.list_(pa.binary())), pa.nulls(size, pa.int32()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.list_(pa.string()))], names=PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            held.append(batch)
            size += sum(len(batch.column(i + 1).flatten()) for i in range(width))
            if size >= BLOCK:
                yield from block(held, number)
                held, size, number = [], 0, number + 1
        if held:
            yield from block(held, number)

    return docs.select(F.col(key), *sections.values()).mapInArrow(run, f"block long, key {kind}, packed array<binary>, section int, begin long, terms array<string>")


PACKED = ["block", "key", "packed", "section", "begin", "terms"]


def _sums(docs: DataFrame, key: str, sections: dict[str, Column], models: DataFrame, names: list[str], explain: int) -> DataFrame:
    """``key, model, x, e`` of every document under every model of ``names``; ``models`` is ``model, section, term, idf, coef``."""
    kind, listed = docs.schema[key].dataType.simpleString(), list(sections)
    out = f"key {kind}, model string, x double, e {NOTHING}"
    number = lambda some, c: F.element_at(F.create_map(*[F.lit(x) for i, name in enumerate(some) for x in (name, i)]), F.col(c))
    wanted = models.where(F.col("model").isin(*names) & F.col("section").isin(*listed)) if names else models.where(F.lit(False))
    wanted = wanted.select(number(names or [""], "model").alias("m"), number(listed, "section").alias("section"), "term", F.col("idf").cast("double"), F.col("coef").cast("double"))
    small = wanted.limit(SMALL_MODEL + 1).toArrow()
    if len(small) <= SMALL_MODEL:
        each = {(m, i): small.filter(pc.and_(pc.equal(small.column("m"), m), pc.equal(small.column("section"), i))).combine_chunks() for m in range(len(names)) for i in range(len(listed))}
        known = {at: (t.column("term").cast(pa.string()).combine_chunks(), t.column("idf").to_numpy(), t.column("coef").to_numpy()) for at, t in each.items() if len(t)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in _sliced(whole)):
                parts, weights = [_numbered(batch.column(i + 1)) for i in range(len(listed))], {}
                for (m, i), (term, idf, coef) in known.items():
                    at = pc.fill_null(pc.index_in(parts[i][3], value_set=term), len(term)).to_numpy()
                    weights[m, i] = np.append(idf, np.nan)[at], np.append(coef, np.nan)[at]
                yield from _evaluated(batch.column(0), parts, weights, names, listed, explain)

        return docs.select(F.col(key), *sections.values()).mapInArrow(run, out).withColumnRenamed("key", key)

    packed = durable(_packed(docs, key, sections))
    asked = packed.where("terms is not null").select("block", "section", "begin", F.posexplode("terms").alias("place", "term")).select("block", "section", (F.col("begin") + F.col("place")).cast("int").alias("code"), "term")
    told = asked.join(wanted, ["section", "term"]).select(F.col("block").alias("own"), "m", "section", "code", "idf", "coef", *(["term"] if explain else []))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, parts, weights = left.column("packed").to_pylist(), [], {}
        for i in range(len(listed)):
            both = [np.frombuffer(r[i], np.int32).reshape(2, -1) for r in rows]
            row = np.repeat(np.arange(len(rows)), [b.shape[1] for b in both])
            code, count = np.concatenate(both, axis=1).astype(np.int64) if both else np.zeros((2, 0), np.int64)
            n = int(code.max(initial=-1)) + 1
            own = right.filter(pc.equal(right.column("section"), i))
            terms = None
            if explain:
                at = np.full(n, len(own))
                at[own.column("code").to_numpy()] = np.arange(len(own))
                terms = pa.concat_arrays([*own.column("term").cast(pa.string()).chunks, pa.nulls(1, pa.string())]).take(pa.array(at))
            parts.append((row, code, count, terms))
            for m in range(len(names)):
                some = own.filter(pc.equal(own.column("m"), m))
                weights[m, i] = idf, coef = np.full(n, np.nan), np.full(n, np.nan)
                idf[some.column("code").to_numpy()], coef[some.column("code").to_numpy()] = some.column("idf").to_numpy(), some.column("coef").to_numpy()
        keys = left.column("key")
        schema = pa.schema([("key", keys.type), ("model", pa.string()), ("x", pa.float64()), ("e", pa.list_(EXPLAINED))])
        return pa.Table.from_batches(_evaluated(pa.concat_arrays(left.column("key").chunks) if len(left) else pa.array([], keys.type), parts, weights, names, listed, explain), schema)

    held = packed.where("terms is null").select("block", "key", "packed")
    return held.groupBy("block").cogroup(told.groupBy("own")).applyInArrow(meet, out).withColumnRenamed("key", key)


def scores(docs: DataFrame, key: str, sections: dict[str, Column], model: DataFrame, intercept: float, explain: int = 8) -> DataFrame:
    """``key, score, explanations``: the probability and the largest positive contributions.  A text
    without known terms has the probability of the intercept."""
    found = _sums(docs, key, sections, model.withColumn("model", F.lit("")), [""], explain)
    return found.select(key, scalars.sigmoid(F.lit(float(intercept)) + F.col("x")).alias("score"), F.col("e").alias("explanations"))


def family_scores(docs: DataFrame, key: str, sections: dict[str, Column], models: DataFrame, intercepts: dict[str, float | None], explain: int = 8) -> DataFrame:
    """``key, model, score, explanations, error`` under every model of ``models`` (``model, section, term, idf, coef``) in one
    pass over the texts.  A model without an intercept, without terms or with a weight that is no finite number gives
    ``error`` and no score, and harms no other."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    state = {r.model: r for r in models.where(F.col("model").isin(*intercepts)).groupBy("model").agg(F.count("*").alias("n"), F.count_if(bad("idf") | bad("coef")).alias("bad")).collect()}  # a row a model
    errors = {}
    for name, intercept in intercepts.items():
        if intercept is None or not math.isfinite(intercept):
            errors[name] = "no intercept"
        elif name not in state:
            errors[name] = "no weights"
        elif state[name].bad:
            errors[name] = f"{state[name].bad} weights are no numbers"
    good = [name for name in intercepts if name not in errors]
    heads = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.lit(None).cast("double").alias("x"), F.array().cast(NOTHING).alias("e")) for n in errors])) if errors else None
    found = _sums(docs, key, sections, models, good, explain)
    if errors:
        found = found.unionByName(docs.select(key, heads.alias("h")).select(key, "h.*"))
    told = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.lit(None if n in errors else b).cast("double").alias("b"), F.lit(errors.get(n)).cast("string").alias("error")) for n, b in intercepts.items()]))
    heads = docs.sparkSession.range(1).select(told.alias("h")).select("h.*")
    found = found.join(F.broadcast(heads), "model")  # a row a model
    score = F.when(F.col("error").isNull(), scalars.sigmoid(F.col("b") + F.col("x")))
    return found.select(key, "model", score.alias("score"), F.col("e").alias("explanations"), "error")


def word_section(column: str = "text", low: int = 1, high: int = 1) -> Column:
    return text.ngrams(text.word_tokens(F.col(column)), low, high)


def centroid_model(docs: DataFrame, key: str, label: str, grams: Column, section: str, most: int, scale: float, least: float = 2e-5) -> DataFrame:
    """``section, term, idf, coef``: mean normalised weight of the positives minus the negatives'."""
    n = docs.count()
    counts = terms(docs, key, grams, section)
    valued = counts.join(idf(counts, n), "term").withColumn("v", tf(F.col("count")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    weights = valued.withColumn("v", F.col("v") / norm).join(docs.select(key, label), key)
    sizes = weights.groupBy(key).agg(F.first(label).alias(label)).agg(F.greatest(F.count_if(label), F.lit(1)).alias("p"), F.greatest(F.count_if(~F.col(label)), F.lit(1)).alias("m"))
    sums = weights.groupBy("term").agg(F.first("idf").alias("idf"), F.sum(F.when(F.col(label), F.col("v")).otherwise(0.0)).alias("pos"), F.sum(F.when(~F.col(label), F.col("v")).otherwise(0.0)).alias("neg"))
    both = sums.crossJoin(F.broadcast(sizes))  # one row
    diff = both.withColumn("diff", F.col("pos") / F.col("p") - F.col("neg") / F.col("m")).where(F.abs("diff") >= least)
    return diff.orderBy(F.desc(F.abs("diff")), F.desc("term")).limit(most).select(F.lit(section).alias("section"), "term", "idf", (F.col("diff") * scale).alias("coef"))


def best_label(candidates: Column, wanted: list[str]) -> Column:
    """The best score among wanted labels of ``array<struct<label, score>>``, 0 if there is none."""
    kept = F.filter(candidates, lambda c: c["label"].isin(*wanted))
    return F.coalesce(F.array_max(F.transform(kept, lambda c: c["score"])), F.lit(0.0))


def argmax_label(candidates: Column) -> Column:
    """The label of the first strict maximum."""
    first = F.struct(F.lit(None).cast("string").alias("label"), F.lit(float("-inf")).alias("score"))
    return F.aggregate(candidates, first, lambda a, c: F.when(c["score"] > a["score"], F.struct(c["label"].alias("label"), c["score"].alias("score"))).otherwise(a))["label"]
