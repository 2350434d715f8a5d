import math
import random
import re
from collections import Counter

import pytest

from quillstone.llm import toxicity


@pytest.fixture(scope="module")
def scorer():
    clean = ["the quick brown fox jumps over the lazy dog near the old stone bridge", "what a nice fox you are and such an old bridge in 2024"] * 20
    toxic = [f"you are such a stupid loser and an idiot ass {w}" for w in ("fox", "dog", "stone", "bridge")] * 10
    return toxicity.fit([(t, 0) for t in clean] + [(t, 1) for t in toxic])


@pytest.mark.parametrize("seen", ["stuupid", "ssttuuppiidd", "looser", "stu pid", "st up id", "5tu p1d,", "s\tt\tu\tp\ti\td", "s\nt\nu\np\ni\nd", "stu\npid", "455", "10$3|2"])
def test_whatever_the_disguise(scorer, seen):
    assert scorer.score(f"what a {seen} fox") > 0.7


@pytest.mark.parametrize("seen", ["what a nice fox in 2024", "the old stone bridge 17 and 300", "pid stu", "bookkeeper", "", "12 34 - --"])
def test_plain_text_stays_clean(scorer, seen):
    assert scorer.score(seen) < 0.7


def every_path(seen, model):
    """The best log-probability by trying every path of the channel, nothing merged."""
    best = -math.inf

    def walk(i, state, last, score):
        nonlocal best
        if i == len(seen):
            best = max(best, score + model.log(state, "\n"))
            return
        mark = seen[i]
        letters = [(c, toxicity.SWAP) for c in toxicity.LOOKALIKE.get(mark, "")] + ([(mark, toxicity.KEEP)] if mark.isalpha() else [])
        after = last if mark in toxicity.SEPARATORS else mark
        for c, cost in letters:
            walk(i + 1, state[1] + c, after, score + cost + model.log(state, c))
            if mark == last and state[1] == c:
                walk(i + 1, state, after, score + toxicity.REPEAT)
        if mark in toxicity.SEPARATORS or not letters:
            walk(i + 1, state, after, score + toxicity.SEPARATE)
        if mark == " ":
            walk(i + 1, "^^", after, score + toxicity.SEPARATE + model.log(state, "\n"))

    walk(0, "^^", "", 0.0)
    return best


def test_viterbi_finds_the_best_of_all_paths():
    rng = random.Random(3)
    model = toxicity.CharModel(Counter({"stupid": 9, "all": 5, "good": 7, "idiot": 4, "at": 8}))
    for _ in range(400):
        seen = "".join(rng.choice("stl1!i|0o@aa. -#5$d") for _ in range(rng.randrange(1, 8)))
        score, word = toxicity.viterbi(seen, model)
        assert abs(score - every_path(seen, model)) < 1e-9, seen


def test_long_tokens_take_time_in_proportion():
    model = toxicity.CharModel(Counter({"stupid": 9}))
    assert len(toxicity.decode("st1" * 100_000, model)) > 100_000


def test_single_marks_in_a_row_are_found_among_the_tokens():
    """As by a pattern over the whole text, which costs far more."""
    pattern = re.compile(r"(?<!\S)(?:[\w@$!|+€£]\s+){2,}[\w@$!|+€£](?!\S)")
    rng = random.Random(5)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "é", "$", "-", "7", "ab", "🙂", "_"]) + rng.choice([" ", " ", "\n", "\u00a0\t", "\x1c", ""]) for _ in range(rng.randrange(14)))
        assert list(toxicity.spaced(text.split())) == [" ".join(m.group().split()) for m in pattern.finditer(text)], repr(text)


def test_tokens_without_marks_fold_alike():
    rng = random.Random(6)
    for _ in range(2000):
        token = "".join(rng.choice("aabiilz²ßıé１xⅷ") for _ in range(rng.randrange(1, 9)))
        shape = toxicity.EDGES.sub("", token).translate(toxicity.FOLD)
        assert toxicity.folded(token) == toxicity.DOUBLE.sub(r"\1", shape if toxicity.PLAIN(shape) else "".join(filter(str.isalpha, shape))), token


def test_most_tokens_are_kept_without_evidence(scorer):
    """A token that has none and is no part of such a word is one empty entry of the memo."""
    scorer.score("quick quick bridge stupid")
    assert scorer.memo["bridge"] == () and scorer.memo["stupid"][0] > 0
