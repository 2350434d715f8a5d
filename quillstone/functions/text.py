"""Text as column expressions: cleaning, tokens, n-grams, predicates, hashes, redaction."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes and phrases that mark messages not written by a person.
CONTROL_PREFIXES = (
    "# agents.md instructions",
    "# files mentioned by the user:",
    "# files mentioned by user:",
    "## codex-clipboard-",
    "<codex_internal_context",
    "<environment_context>",
    "<instructions>",
    "<turn_aborted>",
)
CORPUS_CONTROL_PREFIXES = (
    "<environment_context>",
    "<user_instructions>",
    "<developer_instructions>",
    "<system_context>",
    "# AGENTS.md instructions",
    "We need answer",
    "We need respond",
)
# Fixed value: the space separators (Zs), all that DuckDB's ltrim takes off; tabs and line ends stay.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
PASTE_PREFIXES = (
    "# agents.md instructions",
    "<environment_context>",
    "<instructions>",
    "<codex_internal_context",
    "<turn_aborted>",
)
CONTROL_PHRASES = ("continue", "go on", "keep going", "ok", "okay", "yes", "sure", "do it", "sounds good", "whatever")

# Suffixes that stemming removes, with the least length of a word that loses them.
SUFFIXES = (("ing", 6), ("ed", 5), ("es", 5), ("s", 5))

# Patterns of weak categories of complaints.
WEAK_CATEGORIES = {
    "question_confusion": [r"\bwhat'?s\b", r"\bwhy\b", r"\bhow\b", r"\bare you sure\b", r"\bconfused\b", r"\bdid you\b"],
    "ignored_constraints": [
        r"\bwhy didn'?t you\b",
        r"\bdidn'?t\b.*\b(test|read|check|search|use|keep|follow)\b",
        r"\bi told you\b",
        r"\bwho said\b",
        r"\bstop\b.*\bdoing\b",
    ],
    "missing_context_or_docs": [r"\bread\b", r"\bchat history\b", r"\bfull chat\b", r"\bcontext\b", r"\bdocs?\b", r"\btranscript\b"],
    "verification_failure": [r"\btest\b", r"\bverify\b", r"\bproof\b", r"\brepro\b", r"\bscreenshot\b"],
    "scope_or_resume_pressure": [r"\bkeep going\b", r"\bcontinue\b", r"\bfinish\b", r"\bdone\b"],
    "external_or_product_feedback": [r"\bui\b", r"\bux\b", r"\blooks\b", r"\bbutton\b", r"\bpadding\b", r"\berror\b", r"\bcrash\b"],
}
FAILURE_CATEGORIES = ("ignored_constraints", "missing_context_or_docs", "verification_failure", "scope_or_resume_pressure")

# Patterns of what must not leave the machine.
SECRET_PATTERNS = (
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    r"https?://[^\s)>\]}\"']+",
    r"\b(?:sk|pk|phc|pha|ghp|github_pat|xox[baprs]?|dtn|sm)[_-][A-Za-z0-9_=-]{8,}\b",
    r"\bAKIA[0-9A-Z]{16}\b",
)


def _any(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def compact(text: Column, most: int | None = None) -> Column:
    """White space runs become one blank, the ends are trimmed; null is empty."""
    out = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.substring(out, 1, most) if most else out


def first_of(*values: Column) -> Column:
    """The first value that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def is_control(text: Column, more: Iterable[str] = ()) -> Column:
    """The text, left-trimmed and lower-cased, starts as a control message; ``more`` are a host's own (lower-case) beginnings."""
    begin = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+", ""))
    return bound(begin, lambda t: _any(F.startswith(t, F.lit(p)) for p in (*CONTROL_PREFIXES, *more)))


def is_corpus_control(text: Column) -> Column:
    """Empty, a (case-sensitive) control prefix, or one tag that mentions cwd."""
    def holds(t: Column) -> Column:
        tag = F.startswith(t, F.lit("<")) & F.endswith(t, F.lit(">")) & F.contains(t, F.lit("cwd"))
        return (t == "") | _any(F.startswith(t, F.lit(p)) for p in CORPUS_CONTROL_PREFIXES) | tag

    return bound(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""), holds)


def begins_with(text: Column, prefix: str, lowered: bool = False) -> Column:
    """SQL's ``starts_with(ltrim(text), prefix)``, null for a null text; ``lowered`` of the lower-cased text, a character for each as in DuckDB."""
    begin = F.substring(F.ltrim(text, F.lit(SPACES)), 1, len(prefix))
    return F.startswith(F.lower(F.translate(begin, "\u0130", "i")) if lowered else begin, F.lit(prefix))


def is_control_phrase(text: Column) -> Column:
    return F.lower(compact(text)).isin(*CONTROL_PHRASES)


def is_pasted(text: Column, more: Iterable[str] = ()) -> Column:
    """Starts as a paste (or as one of a host's own beginnings), or is long with many lines, or holds two fences."""
    begin = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+", ""))
    fences = (F.length(text) - F.length(F.replace(text, F.lit("```"), F.lit("")))) / 3
    return bound(begin, lambda t: _any(F.startswith(t, F.lit(p)) for p in (*PASTE_PREFIXES, *more))) | ((F.length(text) > 1000) & (line_count(text) > 18)) | ((F.length(text) > 500) & (fences >= 2))


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def word_tokens(text: Column) -> Column:
    """Runs of two or more word characters, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), 0)


def matched_words(text: Column, terms: list[str]) -> Column:
    """Sorted distinct ASCII words of the text that are terms."""
    if len(terms) <= 8:  # looked for one by one, without a list of all words
        own = sorted({t for t in terms if re.fullmatch("[a-z]+", t)})
        found = bound(F.lower(text), lambda t: F.array_compact(F.array(*[F.when(F.contains(t, F.lit(w)) & t.rlike(f"(?<![a-z]){w}(?![a-z])"), F.lit(w)) for w in own]) if own else F.array().cast("array<string>")))
        return F.when(text.isNotNull(), found)
    return F.array_sort(F.array_intersect(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0), F.array(*map(F.lit, terms))))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often (and inside whatever lambda) ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All runs of low..high tokens, joined by blanks, repeats included."""
    def runs(t: Column, n: int) -> Column:
        if n == 1:
            return t
        return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))

    if low == high == 1:
        return tokens
    return bound(tokens, lambda t: F.concat(*[runs(t, n) for n in range(low, high + 1)]))


def char_ngrams(text: Column, low: int, high: int) -> Column:
    """All substrings of low..high characters of each word between two blanks, repeats included."""
    padded = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\S+"), 0), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def runs(n: int) -> Column:
        return F.flatten(F.transform(padded, lambda p: F.when(F.length(p) >= n, F.transform(F.sequence(F.lit(1), F.length(p) - n + 1), lambda i: F.substring(p, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))))

    return F.concat(*[runs(n) for n in range(low, high + 1)])


def stem(token: Column) -> Column:
    out = token
    for suffix, least in reversed(SUFFIXES):
        out = F.when(F.endswith(token, F.lit(suffix)) & (F.length(token) >= least), F.substring(token, F.lit(1), F.length(token) - len(suffix))).otherwise(out)
    return out


def repetition_tokens(text: Column, stopwords: list[str]) -> Column:
    """Lower-case words without quotes at the ends, of two characters or more, no stop words, stemmed."""
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[\w']+\b"), 0), lambda w: F.btrim(w, F.lit("'")))
    return F.transform(F.filter(words, lambda w: (F.length(w) >= 2) & ~F.coalesce(F.array_contains(F.array(*map(F.lit, stopwords)) if stopwords else F.array(F.lit("")), w), F.lit(False))), stem)


def repetition_features(tokens: Column) -> Column:
    """Distinct words ``w:``, pairs ``b:`` and 4-character strings ``c:`` of joined tokens."""
    def chars(joined: Column) -> Column:
        return F.when(F.length(joined) >= 4, F.transform(F.sequence(F.lit(1), F.length(joined) - 3), lambda i: F.concat(F.lit("c:"), F.substring(joined, i, F.lit(4))))).otherwise(F.array().cast("array<string>"))

    def all_of(ts: Column) -> Column:
        words = F.transform(ts, lambda t: F.concat(F.lit("w:"), t))
        pairs = F.transform(ngrams(ts, 2, 2), lambda t: F.concat(F.lit("b:"), t))
        return F.array_distinct(F.concat(words, pairs, bound(F.array_join(ts, " "), chars)))

    return bound(tokens, all_of)


def hashed_features(features: Column, version: str) -> Column:
    """Sorted: the first 20 hex digits of the SHA-256 of version, NUL and feature; what may be kept where words may not."""
    return F.array_sort(F.transform(features, lambda f: F.substring(F.sha2(F.concat(F.lit(version + "\0"), f), 256), 1, 20)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both), F.lit(0.0))


def weak_categories(text: Column) -> Column:
    """Names of the categories of which a pattern occurs, in a fixed order."""
    def matches(t: Column, pattern: str) -> Column:
        # what the pattern needs is looked for first, as a plain string, which costs far less than the pattern
        needed = [part for part in re.split(r"\\b|\.\*|\(.*?\)|.\?", pattern) if len(part) > 1]
        return reduce(and_, [F.contains(t, F.lit(part)) for part in needed]) & t.rlike(pattern)

    def names(t: Column) -> Column:
        return F.array_compact(F.array(*[F.when(_any(matches(t, p) for p in patterns), F.lit(name)) for name, patterns in WEAK_CATEGORIES.items()]))

    return bound(F.lower(text), names)


def weak_label(categories: Column, matches: Column) -> Column:
    return (
        F.when(F.arrays_overlap(categories, F.array(*map(F.lit, FAILURE_CATEGORIES))), "agent_failure_candidate")
        .when((F.size(matches) > 0) & F.array_contains(categories, "question_confusion"), "needs_review")
        .when(F.size(matches) > 0, "trigger_only")
        .otherwise("ordinary")
    )


def key_hash(*parts: Column, length: int = 64) -> Column:
    """SHA-256 (hex, cut to ``length``) of the parts joined by NUL; nulls count as empty."""
    return F.substring(F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, length)


def salted_digest(text: Column, salt: str) -> Column:
    """Empty stays empty."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).otherwise(F.sha2(F.concat(F.lit(salt), F.lit("\0"), text), 256))


def redacted(text: Column, home: str = "", most: int | None = 300) -> Column:
    """The first characters (None: all) with the home folder, user names and secrets masked."""
    out = F.coalesce(text, F.lit(""))
    if most is not None:
        out = F.substring(out, 1, most)
    if home:
        out = F.replace(out, F.lit(home), F.lit("~"))
    out = F.regexp_replace(out, r"/Users/[^/\s]+", "/Users/[user]")
    for p in SECRET_PATTERNS:
        out = F.regexp_replace(out, p, "[redacted]")
    return compact(out)


def without_system_instruction(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"(?s)^\s*<system_instruction>.*?</system_instruction>\s*", "")


def _no_accents(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def plain(s):
        return None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))

    for b in batches:
        yield b.map(plain)


def strip_accents(text: Column) -> Column:
    """NFKD without combining marks.  Spark has no such function, hence an Arrow-batched one."""
    return F.pandas_udf(_no_accents, "string")(text)


def embedded_json(text: Column) -> Column:
    """The outermost braces of a text as a variant, null where they don't parse."""
    return F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))


def classifier_text(prompt: Column, source: Column, old_trigger: Column, matched: Column) -> Column:
    """``source=s old_trigger=True matched=a,b`` on the first line, the compacted prompt below."""
    head = F.concat_ws(
        " ", F.concat(F.lit("source="), F.coalesce(F.nullif(source, F.lit("")), F.lit("unknown"))),
        F.concat(F.lit("old_trigger="), F.when(old_trigger, "True").otherwise("False")),
        F.when(F.size(matched) > 0, F.concat(F.lit("matched="), F.array_join(F.array_sort(matched), ","))),
    )
    return F.concat(head, F.lit("\n"), compact(prompt))
