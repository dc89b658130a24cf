"""Rule-based reward scores as Column expressions (no UDF).

Every function reads the first message's ``content`` of a completion
(``ARRAY<STRUCT<role, content>>``) or a plain content Column, gives 0.0 for malformed
input (no message, no content), and does its arithmetic in DOUBLE in the same order as
the scalar definition, so values are bit-for-bit those of the sequential formula.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Stop words removed from the question in the relevance score (English, Arabic).
RELEVANCE_STOPWORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "have", "has",
    "do", "does", "did", "will", "would", "could", "should", "may", "might",
    "can", "what", "when", "where", "why", "how", "which", "who",
    "في", "من", "إلى", "هذا", "ذلك", "التي", "الذي", "على", "عن",
]
# The four tags of the reasoning format.
FORMAT_TAGS = ["<think>", "</think>", "<answer>", "</answer>"]
# Characters that count as sentence-final punctuation.
FINAL_PUNCT = ".!?؟۔"
ARABIC_CHAR = r"[\x{600}-\x{6ff}]"
ASCII_LETTER = "[A-Za-z]"
DEFAULT_WEIGHTS = {"format": 0.2, "length": 0.2, "relevance": 0.3, "language_quality": 0.3}


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def first_content(completion: Column | str) -> Column:
    """``completion[0].content`` or null when the completion is empty or malformed."""
    return F.get(_c(completion), 0).getField("content")


def _guard(content: Column, score: Column) -> Column:
    return F.when(content.isNull(), F.lit(0.0)).otherwise(score.cast("double"))


def reward_format(content: Column | str) -> Column:
    c = _c(content)
    ok = F.lit(True)
    for tag in FORMAT_TAGS:
        ok = ok & c.contains(tag)
    return _guard(c, F.when(ok, 1.0).otherwise(0.0))


def reward_accuracy(content: Column | str, solution: Column | str) -> Column:
    """1.0 stripped-equal, 0.8 equal up to case, else 0.0. A null solution compares as
    its string form ``None``."""
    c = T.py_strip(_c(content))
    s = T.py_strip(F.coalesce(_c(solution).cast("string"), F.lit("None")))
    return _guard(_c(content), F.when(c == s, 1.0).when(F.lower(c) == F.lower(s), 0.8).otherwise(0.0))


def reward_length(content: Column | str, min_length: int = 10, max_length: int = 500) -> Column:
    c = _c(content)
    n = F.char_length(c).cast("double")
    short = F.greatest(F.lit(0.0), n / F.lit(float(min_length)) * F.lit(0.5))
    long_ = F.greatest(F.lit(0.0), F.lit(1.0) - (n - F.lit(float(max_length))) / F.lit(float(max_length)) * F.lit(0.5))
    score = F.when((n >= min_length) & (n <= max_length), 1.0).when(n < min_length, short).otherwise(long_)
    return _guard(c, score)


def _word_set(text: Column, stop: bool) -> Column:
    ws = F.transform(T.py_split(F.lower(text)), T.strip_punctuation)
    stop_arr = F.array(*[F.lit(w) for w in RELEVANCE_STOPWORDS])
    if stop:
        keep = F.filter(ws, lambda w: (F.char_length(w) > 2) & ~F.array_contains(stop_arr, w))
    else:
        keep = F.filter(ws, lambda w: F.char_length(w) > 2)
    return F.array_distinct(keep)


def reward_relevance(content: Column | str, question: Column | str) -> Column:
    """|Q ∩ C| / |Q| over lower-cased, punctuation-stripped word sets (Q without stop
    words, both only words longer than 2); 0.5 when Q is empty."""
    c = _c(content)
    qw = _word_set(F.coalesce(_c(question), F.lit("")), stop=True)
    cw = _word_set(c, stop=False)
    overlap = F.size(F.array_intersect(qw, cw)).cast("double") / F.size(qw).cast("double")
    score = F.when(F.size(qw) > 0, F.least(F.lit(1.0), overlap)).otherwise(0.5)
    return _guard(c, score)


def reward_non_empty(content: Column | str) -> Column:
    c = _c(content)
    return _guard(c, F.when(T.py_strip(c) != "", 1.0).otherwise(0.0))


def reward_language_quality(content: Column | str, language: Column | str = "arabic") -> Column:
    """0.5 base; -0.1 double space; +0.2 final punctuation; +0.1 more than three words;
    +0.1 script match (arabic: an Arabic-block letter; english: an ASCII letter); clamped."""
    c = _c(content)
    lang = F.lower(F.lit(language) if isinstance(language, str) else language)
    zero = F.lit(0.0)
    last = F.substr(c, F.char_length(c), F.lit(1))
    s = F.lit(0.5)
    s = s - F.when(c.contains("  "), 0.1).otherwise(zero)
    s = s + F.when((F.char_length(c) > 0) & F.array_contains(F.array(*[F.lit(x) for x in FINAL_PUNCT]), last), 0.2).otherwise(zero)
    s = s + F.when(T.count_words(c) > 3, 0.1).otherwise(zero)
    script = F.when(lang == "arabic", c.rlike(ARABIC_CHAR)).when(lang == "english", c.rlike(ASCII_LETTER)).otherwise(False)
    s = s + F.when(script, 0.1).otherwise(zero)
    return _guard(c, F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)))


REWARDS: dict[str, Callable[..., Column]] = {
    "format": reward_format,
    "accuracy": reward_accuracy,
    "length": reward_length,
    "relevance": reward_relevance,
    "non_empty": reward_non_empty,
    "language_quality": reward_language_quality,
}


def reward_composite(
    content: Column | str,
    weights: Mapping[str, float] | None = None,
    question: Column | str | None = None,
    language: Column | str = "arabic",
    min_length: int = 10,
    max_length: int = 500,
) -> Column:
    """Weighted sum of format, length, relevance and language quality with weights divided
    by their total. Names outside those four enlarge the total but add nothing."""
    w = dict(DEFAULT_WEIGHTS if weights is None else weights)
    total = sum(w.values())
    if total == 0:
        raise ValueError("reward weights sum to zero")
    w = {k: v / total for k, v in w.items()}
    c = _c(content)
    parts: list[tuple[str, Column]] = [
        ("format", reward_format(c)),
        ("length", reward_length(c, min_length, max_length)),
        ("relevance", reward_relevance(c, question if question is not None else F.lit(""))),
        ("language_quality", reward_language_quality(c, language)),
    ]
    acc = F.lit(0.0)
    for name, col in parts:
        if name in w and w[name] > 0:
            acc = acc + col * F.lit(w[name])
    return acc
