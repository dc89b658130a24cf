"""Text Column builders with Python ``str`` semantics, written as native Spark expressions.

Spark's ``trim`` removes only U+0020 and ``\\s`` misses some of the characters Python treats
as whitespace, so the whitespace class is spelled out once here. Patterns use the
``\\x{..}`` escape form, which both Java regex and RE2 (the DuckDB oracle) accept, so the
same constants are shared with ``plans.catalog`` oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters for which Python's str.isspace() is true (BMP), as a class body.
PY_WS_BODY = r"\t-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
PY_WS = "[" + PY_WS_BODY + "]"
PY_NON_WS = "[^" + PY_WS_BODY + "]"
STRIP_PATTERN = r"\A" + PY_WS + "+|" + PY_WS + r"+\z"
# The same set as a string, derived by rule (BMP characters Python treats as whitespace),
# for the non-regex trim.
PY_WS_CHARS = "".join(ch for ch in map(chr, range(0x10000)) if ch.isspace())
# Python's string.punctuation (32 ASCII characters) as code-point ranges.
ASCII_PUNCT = r"[\x{21}-\x{2f}\x{3a}-\x{40}\x{5b}-\x{60}\x{7b}-\x{7e}]"
PUNCT_STRIP_PATTERN = r"\A" + ASCII_PUNCT + "+|" + ASCII_PUNCT + r"+\z"
# Sentence-final punctuation (Latin, Arabic question mark, Urdu full stop).
SENTENCE_END = "[.!?؟۔]"
SENTENCE_BREAK = "(" + SENTENCE_END + r"+)[ \t]+"
SENTENCE_MARK = "\u0001"
# Whitespace pre-tokenizer pieces: word runs or runs of other non-space characters.
# (?U) makes \w Unicode-aware (letters, combining marks, digits, connector punctuation).
PRETOKEN_PATTERN = r"(?U)\w+|[^\w\s]+"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col: Column | str) -> Column:
    """``str.strip()``: remove Python whitespace at both ends (a code-generated trim of
    that character set, no regex)."""
    return F.btrim(_c(col), F.lit(PY_WS_CHARS))


def py_split(col: Column | str) -> Column:
    """``str.split()`` with no argument: runs of non-whitespace, empties dropped."""
    return F.regexp_extract_all(_c(col), F.lit(PY_NON_WS + "+"), F.lit(0))


def is_blank(col: Column | str) -> Column:
    """``not s.strip()`` (null counts as blank)."""
    c = _c(col)
    return c.isNull() | ~c.rlike(PY_NON_WS)


def normalize_newlines(col: Column | str) -> Column:
    """Universal-newline translation of Python text mode: ``\\r\\n`` and bare ``\\r`` become ``\\n``."""
    return F.regexp_replace(_c(col), F.lit("\r\n?"), F.lit("\n"))


def clean_text(col: Column | str) -> Column:
    """Strip, then drop everything up to and including the first blank line (header block).

    The remainder is not stripped again; text without a blank line is only stripped.
    """
    s = py_strip(col)
    pos = F.instr(s, "\n\n")
    return F.when(pos > 0, F.substr(s, pos + F.lit(2))).otherwise(s)


def split_paragraphs(col: Column | str) -> Column:
    """Lines of the text that are not blank (not stripped)."""
    return F.filter(F.split(_c(col), "\n"), lambda p: ~is_blank(p))


def split_sentences(col: Column | str) -> Column:
    """Rule-based sentence split of one paragraph: break after a run of sentence-final
    punctuation followed by spaces/tabs; pieces are stripped and blanks dropped."""
    marked = F.regexp_replace(_c(col), F.lit(SENTENCE_BREAK), F.lit("$1" + SENTENCE_MARK))
    pieces = F.transform(F.split(marked, SENTENCE_MARK), lambda s: py_strip(s))
    return F.filter(pieces, lambda s: s != F.lit(""))


def semantic_units(col: Column | str) -> Column:
    """Cleaned text -> ordered array of stripped, non-blank sentences over all paragraphs."""
    return F.flatten(F.transform(split_paragraphs(col), split_sentences))


def count_words(col: Column | str) -> Column:
    """``len(s.split())`` without building the word array: strip, map every whitespace
    character to a space (``translate``), collapse space runs, count the spaces."""
    t = F.translate(py_strip(col), PY_WS_CHARS, " " * len(PY_WS_CHARS))
    t = F.regexp_replace(t, F.lit("  +"), F.lit(" "))
    return F.when(t == "", F.lit(0)).otherwise(
        F.char_length(t) - F.char_length(F.replace(t, F.lit(" "), F.lit(""))) + F.lit(1)
    )


def word_count(col: Column | str, per_unit_overhead: int = 0) -> Column:
    """Default token counter: Python ``len(s.split())`` plus a fixed per-call overhead
    (the count of special tokens a model tokenizer would add)."""
    n = count_words(col)
    return n + F.lit(per_unit_overhead) if per_unit_overhead else n


def pretokenize(col: Column | str) -> Column:
    """Whitespace pre-tokenizer: ``\\w+|[^\\w\\s]+`` pieces, Unicode-aware."""
    return F.regexp_extract_all(_c(col), F.lit(PRETOKEN_PATTERN), F.lit(0))


def strip_punctuation(col: Column | str) -> Column:
    """``s.strip(string.punctuation)``."""
    return F.regexp_replace(_c(col), F.lit(PUNCT_STRIP_PATTERN), F.lit(""))
