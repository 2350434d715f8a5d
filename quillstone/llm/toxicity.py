"""Toxicity scores of texts whose words may be disguised.

A disguised word is taken for the output of a noisy channel: letters come through, or as look-alike
marks, or several times, or with separators between them.  The Viterbi algorithm finds the likeliest
letters behind what is seen, over the lattice of each mark's possible letters, under a character
language model.  Restored and plain words then give evidence by themselves and by their first
letters; a logistic curve over a text's strongest and summed evidence is its score.

Model and curve are learnt from all labelled rows outside the held-out fold, in four passes over them: words, letters and
beginnings; features of toxic rows; those features in clean rows; evidence, on which Newton's steps are taken as sums over the
tasks.  Tables of at most ``most_features`` weights, one character model and the frequent words with a doubled letter that
look like a feature go to the executors; a feature is in a hundredth of the toxic rows at least, so their number is bounded too.

Cases: null, empty or wordless text has no evidence and gets the curve's lowest score; a text of any
length counts whole; repeated rows score alike; a null id is not held out, and no label is learnt by it;
without labels of both kinds every score is the share of toxic labels (0 without labels); an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import common

#: Letters that a mark may stand for.
LOOKALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c",
}
#: Marks that may be put between the letters of a word.
SEPARATORS = frozenset(" .-_*~'`·,/\\")
#: Tokens of a generation of the memo, of some 200 bytes each.
MEMO = 100_000
#: Log-probabilities of the channel.
KEEP, SWAP, REPEAT, SEPARATE = math.log(0.94), math.log(0.3), math.log(0.2), math.log(0.3)

PLAIN = re.compile(r"[^\W\d_]+").fullmatch
TRIPLE = re.compile(r"(.)\1\1")
DOUBLE = re.compile(r"(.)\1+")
EDGES = re.compile(r"^[\W_]*?(?=[\w@$!|+€£(<])|[.,;:?!\"')\]}]+$|([^\w\s])\1{2,}[.,;:]*$")
#: A mark that may stand alone for a letter; whether a length is that of one.
MARK, ONE = re.compile(r"[\w@$!|+€£]").fullmatch, (1).__eq__
#: Marks by the letter they are folded to (i as l, for the marks that are both), separators dropped.
FOLD = str.maketrans({m: c[-1].replace("i", "l") for m, c in LOOKALIKE.items()} | {"i": "l"} | dict.fromkeys(SEPARATORS))


def _triples(words: Counter) -> Counter:
    """Counts of three letters in a row."""
    found: Counter = Counter()
    for word, n in words.items():
        chain = f"^^{word}\n"
        for i in range(2, len(chain)):
            found[chain[i - 2 : i + 1]] += n
    return found


class CharModel:
    """Trigram model of words with add-k smoothing; ``^`` begins and ``$`` ends a word."""

    def __init__(self, words: Counter, k: float = 0.05):
        self._count(_triples(words), (w for w, n in words.items() if n > 2), k)

    @classmethod
    def counted(cls, triples: dict[str, int], known: Iterable[str]) -> CharModel:
        """Of counts of three letters in a row, with the frequent words that have a doubled letter (others have nothing to restore)."""
        model = cls.__new__(cls)
        model._count(triples, known, 0.05)
        return model

    def _count(self, triples: dict[str, int], known: Iterable[str], k: float) -> None:
        self.triples, self.known, self.k = dict(triples), frozenset(known), k
        pairs: Counter = Counter()
        for triple, n in triples.items():
            pairs[triple[:2]] += n
        self.pairs = dict(pairs)
        self.size = max(2, len({"^", *(t[2] for t in triples)} - {"\n"}))

    def log(self, before: str, c: str) -> float:
        return math.log((self.triples.get(before + c, 0) + self.k) / (self.pairs.get(before, 0) + self.k * self.size))


def viterbi(seen: str, model: CharModel) -> tuple[float, str]:
    """The log-probability of the likeliest word behind ``seen``, and the word.  States are the last
    two letters; each mark either adds one of its letters, repeats the letter before it, or only
    separates; a blank may end a word.  Words are chains of letters, so a step costs the same at any length."""
    paths: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
    last = ""
    for mark in seen:
        letters = [(c, SWAP) for c in LOOKALIKE.get(mark, "")]
        if mark.isalpha():
            letters.append((mark, KEEP))
        step: dict[str, tuple[float, tuple | None]] = {}

        def reach(state: str, score: float, word: tuple | None) -> None:
            if state not in step or score > step[state][0]:
                step[state] = (score, word)

        for state, (score, word) in paths.items():
            for c, cost in letters:
                reach(state[1] + c, score + cost + model.log(state, c), (word, c))
                if mark == last and state[1] == c:
                    reach(state, score + REPEAT, word)
            if mark in SEPARATORS or not letters:
                reach(state, score + SEPARATE, word)
            if mark == " ":
                reach("^^", score + SEPARATE + model.log(state, "\n"), (word, " "))
        paths, last = step, mark if mark not in SEPARATORS else last
    score, _, chain = max(((score + model.log(state, "\n"), state, word) for state, (score, word) in paths.items()), key=lambda p: p[:2])
    out = []
    while chain is not None:
        chain, c = chain
        out.append(c)
    return score, "".join(reversed(out))


def decode(seen: str, model: CharModel) -> str:
    return viterbi(seen, model)[1]


def settled(token: str, model: CharModel) -> str | None:
    """A lower-case token as a plain word where nothing need be decoded."""
    if token.isalpha():
        return token if token in model.known or not DOUBLE.search(token) else None
    for word in (token, EDGES.sub("", token)):
        # known words stay, and letters of which none is doubled have nothing to restore
        if word in model.known or PLAIN(word) and not DOUBLE.search(word):
            return word
    return None


def restored(token: str, model: CharModel) -> str:
    """A lower-case token as a plain word."""
    word = settled(token, model)
    if word is not None:
        return word
    core = EDGES.sub("", token)
    if not any(c.isalpha() or c in LOOKALIKE for c in core):
        return core
    return decode(core, model)


def folded(token: str) -> str:
    """A token's rough shape, alike for a word and all that may be decoded to it."""
    if token.isalpha():  # has no edges, marks or separators
        return DOUBLE.sub(r"\1", token.replace("i", "l"))
    shape = EDGES.sub("", token).translate(FOLD)
    return DOUBLE.sub(r"\1", shape if PLAIN(shape) else "".join(filter(str.isalpha, shape)))


class Shapes:
    """Shapes of features: a token whose shape has none of them cannot be decoded to a word that has one."""

    def __init__(self, features):
        self.whole = frozenset(folded(f) for f in features if f[0] != "^")
        self.prefixes = frozenset(folded(f[1:]) for f in features if f[0] == "^")
        self.lengths = sorted(set(map(len, self.prefixes)))

    def may(self, shape: str) -> bool:
        if shape in self.whole:
            return True
        for n in self.lengths:
            if shape[:n] in self.prefixes:
                return True
        return False


class Memo(dict):
    """What ``learn`` says of tokens, in two generations, so that it stays small."""

    def __init__(self, learn: Callable[[str], tuple]):
        super().__init__()
        self.learn, self.old = learn, {}

    def __missing__(self, token: str) -> tuple:
        known = self.old.get(token)
        if known is None:
            known = self.learn(token)
        if len(self) > MEMO:
            self.old = dict(self)
            self.clear()
        self[token] = known
        return known


def spaced(tokens: list[str]) -> Iterator[str]:
    """Three or more single marks in a row, by blanks."""
    if sum(map(ONE, map(len, tokens))) < 3:
        return
    begin = 0
    for i in [i for i, t in enumerate(tokens) if len(t) != 1 or not MARK(t)] + [len(tokens)]:
        if i - begin > 2:
            yield " ".join(tokens[begin:i])
        begin = i + 1


def word_features(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in (4, 5, 6) if len(word) >= n)]


class Scorer:
    """Evidence of words and scores of texts; ``curve`` is (constant, of the strongest, of the sum)."""

    def __init__(self, model: CharModel, weights: dict[str, float], curve: tuple[float, float, float]):
        self.model, self.weights, self.curve = model, weights, curve
        self.able = Shapes(weights)
        self.whole = frozenset(w for w in self.able.whole if len(w) > 1)
        self.begun = frozenset(w[:n] for w in self.whole for n in range(1, len(w) + 1))
        self.pieces = frozenset(w[a:b] for w in self.whole for a in range(len(w) + 1) for b in range(a, len(w) + 1))
        self.memo = Memo(self._learn)

    def __getstate__(self):
        return self.__dict__ | {"memo": None}

    def __setstate__(self, state: dict):
        self.__dict__.update(state, memo=Memo(self._learn))

    def _learn(self, token: str) -> tuple[float, str, bool] | tuple[()]:
        """A token's evidence, its shape where that may be a part of a word's (else a blank), and whether such a word begins so;
        nothing for a token without either."""
        shape, found = folded(token), 0.0
        if self.able.may(shape):
            word = restored(token, self.model)
            found = max((self.weights.get(f, 0.0) for f in word_features(word)), default=0.0)
        part = shape in self.pieces
        return (found, shape if part else " ", shape in self.begun) if found or part else ()

    def _chunks(self, tokens: list[str], known: list[tuple]) -> Iterator[str]:
        """Words behind neighbouring tokens that together have the shape of a word with evidence."""
        begun = self.begun
        for i in [i for i, k in enumerate(known) if k and k[2]]:
            seen = known[i][1]
            for j in range(i + 1, len(tokens)):
                if not known[j]:
                    break
                seen = DOUBLE.sub(r"\1", seen + known[j][1])
                if seen not in begun:
                    break
                if seen in self.whole and max(map(len, tokens[i : j + 1])) > 1:  # single marks are spaced
                    parts = [EDGES.sub("", p) for p in tokens[i : j + 1]]
                    yield from (w for w in decode(" ".join(parts), self.model).split() if w not in parts)

    def evidence(self, text: str) -> tuple[float, float]:
        """The strongest and the summed evidence of a text's words."""
        tokens = text.lower().split()
        memo = self.memo
        known = list(map(memo.__getitem__, tokens))
        found = [k[0] for k in known if k]
        more = [w for run in spaced(tokens) for w in decode(run, self.model).split()]
        more += self._chunks(tokens, known)
        found += [memo[w][0] for w in more if memo[w]]
        return max(found, default=0.0), math.log1p(math.fsum(found))

    def score(self, text: str) -> float:
        a, b = self.evidence(text)
        x = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1 / (1 + math.exp(-min(700, max(-700, x))))


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and second derivatives of the logistic loss over rows of evidence, one after the other."""
    z = np.column_stack([np.ones(len(x)), x])
    p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
    return np.concatenate([z.T @ (y - p), ((z.T * (p * (1 - p))) @ z).ravel()])


def _curve(sums: Callable[[np.ndarray], np.ndarray], size: int = 3, ridge: float = 0.1) -> tuple[float, float, float]:
    """Logistic regression by Newton's method with a ridge on all but the constant; slopes that
    would punish evidence are set to zero.  ``sums`` gives ``_sums`` of all rows."""
    keep = np.ones(size, bool)
    for _ in range(3):
        w = np.zeros(size)
        penalty = ridge * np.diag([1e-6, *[1.0] * (size - 1)])
        for _ in range(50):
            both = sums(w * keep)
            step = np.linalg.solve(both[size:].reshape(size, size) * np.outer(keep, keep) + penalty, both[:size] * keep - penalty @ w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        if (w[1:] >= 0).all():
            break
        keep[1:] &= w[1:] >= 0
    return tuple(float(v) for v in w * keep)


Rows = Iterable[tuple[str, int]]


def _words(rows: Rows) -> Iterator[Counter]:
    """Counts by kind and item: rows by label, three letters in a row, words with a doubled letter, and for toxic rows
    the beginnings of their tokens' shapes.  At times what is counted so far comes out, so that it stays small."""
    found: Counter = Counter()
    words: Counter = Counter()
    shapes: dict[str, str] = {}

    def told() -> Counter:
        plain = Counter({w: n for w, n in words.items() if PLAIN(w) and not TRIPLE.search(w)})
        found.update({("t", t): n for t, n in _triples(plain).items()})
        found.update({("w", w): n for w, n in plain.items() if DOUBLE.search(w)})
        return found

    for text, y in rows:
        tokens = text.lower().split()
        words.update(tokens)
        found["r", str(y)] += 1
        if y:
            for t in (own := set(tokens)) - shapes.keys():
                shapes[t] = folded(t)[:3]
            found.update({("b", shapes[t]) for t in own})
        if len(words) > MEMO:
            yield told()
            found, words, shapes = Counter(), Counter(), {}
    yield told()


def _features(rows: Rows, model: CharModel, able: Shapes | set[str] | None, only: dict | None = None) -> Iterator[Counter]:
    """In how many rows each feature (of ``only``) is; tokens are decoded where their shape, or its beginning, is ``able`` (None: nowhere)."""
    found: Counter = Counter()

    def of(word: str) -> tuple[str, ...]:
        return tuple(f for f in word_features(word) if only is None or f in only)

    starts = None if only is None else {f.lstrip("^")[:4] for f in only}

    def told(token: str) -> tuple[str, ...]:
        if able is None:  # an alphabetic token is settled as itself or not at all
            return () if token.isalpha() and token[:4] not in starts else of(settled(token, model) or "")
        shape = folded(token)
        return of(restored(token, model)) if (shape[:3] in able if isinstance(able, set) else able.may(shape)) else ()

    memo = Memo(told)
    for text, _ in rows:
        tokens = text.lower().split()
        own: set[str] = set()
        own.update(*filter(None, map(memo.__getitem__, set(tokens))))
        own.update(f for run in (spaced(tokens) if able is not None else ()) for w in decode(run, model).split() for f in of(w))
        found.update(own)
        if len(found) > MEMO:
            yield found
            found = Counter()
    yield found


def _fitted(count: Callable[..., Counter], known: Callable[[set[str]], Iterable[str]], sums: Callable[[Scorer], Callable[[np.ndarray], np.ndarray]], most_features: int) -> Scorer:
    """The steps of learning: ``count(f, label, *args)`` adds up what ``f`` yields over the rows (of one label), ``known`` gives
    frequent words with a doubled letter whose shapes begin as told, ``sums`` what a scorer's curve needs."""
    first = count(_words, None)
    of = lambda kind: {item: n for (k, item), n in first.items() if k == kind}
    labels = of("r")
    n0, n1 = labels.get("0", 0), labels.get("1", 0)
    if not (n0 and n1):
        share = n1 / (n0 + n1) if n0 + n1 else 0.0
        return Scorer(CharModel(Counter()), {}, (math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0, 0.0))
    least = max(3, 0.01 * n1)
    # a feature of so many texts has a shape that begins alike in as many: only such tokens are decoded
    begun = {p for p, n in of("b").items() if n >= least}
    model = CharModel.counted(of("t"), known(begun))
    toxic = {f: n for f, n in count(_features, 1, model, begun, least=least).items() if n >= least}

    def weighed(clean: Counter) -> dict[str, float]:
        return {f: math.log((n + 0.5) / (n1 + 1)) - math.log((clean[f] + 0.5) / (n0 + 1)) for f, n in toxic.items()}

    # clean rows that have a feature without decoding are the least that have it: what is too frequent there can be no evidence
    most = weighed(count(_features, 0, model, None, toxic))
    toxic = {f: n for f, n in toxic.items() if most[f] > 2.5}
    odds = weighed(count(_features, 0, model, Shapes(toxic), toxic))
    best = sorted((f for f in odds if odds[f] > 2.5), key=lambda f: (-odds[f], f))[:most_features]
    scorer = Scorer(model, {f: odds[f] for f in best}, (0.0, 0.0, 0.0))
    # tokens of other shapes are never looked up
    model.known = frozenset(w for w in model.known if scorer.able.may(folded(w)))
    scorer.curve = _curve(sums(scorer))
    scorer.memo = Memo(scorer._learn)
    return scorer


def fit(rows: list[tuple[str, int]], most_features: int = 5000) -> Scorer:
    """Learns from ``(text, label)`` rows that are at hand."""
    counts: Counter = Counter()

    def count(f: Callable, label: int | None, *args, least: float = 1) -> Counter:
        found = sum(f((r for r in rows if label is None or r[1] == label), *args), Counter())
        if f is _words:
            counts.update(found)
        return found

    def known(begun: set[str]) -> Iterable[str]:
        return [w for (kind, w), n in counts.items() if kind == "w" and n > 2 and folded(w)[:3] in begun]

    def sums(scorer: Scorer) -> Callable[[np.ndarray], np.ndarray]:
        x, y = np.array([scorer.evidence(text) for text, _ in rows]), np.array([y for _, y in rows], float)
        return lambda w: _sums(x, y, w)

    return _fitted(count, known, sums, most_features)


def learn(docs: DataFrame, labels: DataFrame, most_features: int = 5000) -> Scorer:
    """Learns from all labelled rows outside the held-out fold; counts and sums come to the driver."""
    rows = common.durable(common.training_rows(docs, labels, "toxic").select("text", "y"))
    context = rows.sparkSession.sparkContext
    words: list[DataFrame] = []

    def count(f: Callable, label: int | None, *args, least: float = 1) -> Counter:
        sent = context.broadcast(args)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts = ((t, y) for batch in batches for part in common.slices(batch, 0) for t, y in zip(*(c.to_pylist() for c in part.columns)))
            for found in f(texts, *sent.value):
                items = list(found.items())
                for a in range(0, len(items), 50_000):
                    part = items[a : a + 50_000]
                    keys = [k if f is _words else ("f", k) for k, _ in part]
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([n for _, n in part], pa.int64())], ["kind", "item", "n"])

        some = rows if label is None else rows.where(F.col("y") == label)
        totals = common.mapped(some, run, "kind string, item string, n long").groupBy("kind", "item").agg(F.sum("n").alias("n"))
        if f is _words:
            totals = common.durable(totals)
            words.append(totals.where("kind = 'w' and n > 2").select("item"))
        found = totals.where((F.col("kind") != "w") & (F.col("n") >= least)).toArrow().to_pydict()
        return Counter({(k, i) if f is _words else i: n for k, i, n in zip(found["kind"], found["item"], found["n"])})

    def known(begun: set[str]) -> Iterable[str]:
        sent = context.broadcast(begun)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([w for w in batch.column(0).to_pylist() if folded(w)[:3] in sent.value], pa.string())], ["item"])

        return common.mapped(words[0], run, "item string").toArrow().column(0).to_pylist()

    def sums(scorer: Scorer) -> Callable[[np.ndarray], np.ndarray]:
        sent = context.broadcast(scorer)

        def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in common.slices(batch, 0):
                    x = [sent.value.evidence(t) for t in part.column(0).to_pylist()]
                    yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in x], pa.float64()), pa.array([e[1] for e in x], pa.float64()), part.column(1).cast(pa.float64())], ["a", "b", "y"])

        held = common.durable(common.mapped(rows, evidence, "a double, b double, y double"))

        def of(w: np.ndarray) -> np.ndarray:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros(12)
                for batch in batches:
                    a, b, y = (c.to_numpy() for c in batch.columns)
                    total += _sums(np.column_stack([a, b]), y, w)
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["s"])

            return np.sum(held.mapInArrow(run, "s array<double>").toArrow().column(0).to_pylist(), axis=0)

        return of

    return _fitted(count, known, sums, most_features)


def score_column(scorer: Scorer, text: Column) -> Column:
    """The score of a text column (null counts as empty)."""

    common.modest(SparkSession.active())

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def run() -> Iterator[pa.Array]:
            for batch in batches:
                column = pa.RecordBatch.from_arrays([batch], names=["text"])
                yield pa.array([scorer.score(t) for part in common.slices(column, 0) for t in part.column(0).to_pylist()], pa.float64())

        yield from common.released(run())

    return score(F.coalesce(text.cast("string"), F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted``."""
    found = common.texts(docs)
    found = found.select("doc_id", score_column(learn(docs, labels), F.col("text")).alias("score"))
    return found.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` below the threshold, with all their columns."""
    return docs.where(score_column(learn(docs, labels), docs["text"]) < threshold)
