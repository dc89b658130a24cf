"""Model-response parsing into question/answer pairs, as native expressions.

JSON route: strip code fences, drop trailing commas, parse as VARIANT; a list gives its
object elements' pairs (each field falls back to its Arabic alias when falsy, pairs
lacking either are dropped); valid JSON that is not a list gives no pairs.
Regex route (only when the text is not valid JSON): split the raw response at question
keys and take the text up to an answer key and the double-quoted answer after it.

Known differences from Python's json module: duplicate object keys make the text invalid
(Python keeps the last one), and a valid value followed by more values of the same kind
(``[1] [2]``) is accepted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

PAIR_TYPE = "array<struct<question:string,answer:string>>"
# Keys of a pair in the JSON route (English, then the Arabic alias).
QUESTION_KEYS = ("question", "سؤال")
ANSWER_KEYS = ("answer", "الإجابة")
WS = T.PY_WS
# The regex route's key patterns. The Arabic answer key takes an optional
# definite article so that both spellings of the key split cleanly.
SPLIT_QUESTION = "(?iu)[\"']?(?:question|سؤال)[\"']?" + WS + "*:"
ANSWER_MATCH = "(?isu)(.*?)(?:[\"']?(?:answer|(?:ال)?إجابة)[\"']?" + WS + "*:)" + WS + '*"(.*?)"'
QUESTION_TRIM = "\\A[\"']?|[\"']?,?\\z"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_code_fence(col: Column | str) -> Column:
    """Strip; drop a leading ```json fence, then a leading ``` fence, then a trailing ```."""
    s = T.py_strip(_c(col))
    s = F.when(s.startswith("```json"), T.py_strip(F.substr(s, F.lit(8)))).otherwise(s)
    s = F.when(s.startswith("```"), T.py_strip(F.substr(s, F.lit(4)))).otherwise(s)
    s = F.when(s.endswith("```"), T.py_strip(F.substr(s, F.lit(1), F.char_length(s) - 3))).otherwise(s)
    return s


def fix_trailing_commas(col: Column | str) -> Column:
    """Remove a comma (and following whitespace) before ``]`` or ``}``, anywhere."""
    return F.regexp_replace(_c(col), F.lit("," + WS + "*([\\]}])"), F.lit("$1"))


def clean_response(col: Column | str) -> Column:
    return fix_trailing_commas(strip_code_fence(col))


def _vtype(v: Column) -> Column:
    return F.schema_of_variant(v)


def variant_truthy(v: Column) -> Column:
    """Python truthiness of a JSON value: null, "", 0, false, [] and {} are false."""
    t = _vtype(v)
    is_num = t.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
    return (
        F.when(v.isNull() | (t == "VOID"), False)
        .when(t == "STRING", F.try_variant_get(v, "$", "string") != "")
        .when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(is_num, F.try_variant_get(v, "$", "double") != 0)
        .when(t.startswith("ARRAY"), F.size(v.cast("array<variant>")) > 0)
        .when(t.startswith("OBJECT"), F.to_json(v) != "{}")
        .otherwise(True)
    )


def variant_text(v: Column) -> Column:
    """String value as is; any other JSON value as its JSON text."""
    return F.when(_vtype(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))


def _first_truthy(m: Column, keys: tuple[str, ...]) -> Column:
    out = F.lit(None).cast("variant")
    for k in reversed(keys):
        val = F.element_at(m, F.lit(k))
        out = F.when(variant_truthy(val), val).otherwise(out)
    return out


def json_is_valid(cleaned: Column) -> Column:
    """Parses, and a text that starts as an array/object also ends as one (rejects
    trailing text, which the lenient parser would ignore)."""
    v = F.try_parse_json(cleaned)
    # Wrapped in brackets, one value stays one element; "v rest" fails or gives more.
    wrapped = F.try_parse_json(F.concat(F.lit("["), cleaned, F.lit("]")))
    single = F.coalesce(F.size(F.try_variant_get(wrapped, "$", "array<variant>")) == 1, F.lit(False))
    opens = cleaned.startswith("[") | cleaned.startswith("{")
    closes = cleaned.endswith("]") | cleaned.endswith("}")
    return v.isNotNull() & single & (~opens | closes)


def parse_qa_json(cleaned: Column) -> Column:
    """Pairs of a valid JSON response (empty when it is not a list)."""
    v = F.try_parse_json(cleaned)
    is_list = F.coalesce(_vtype(v).startswith("ARRAY<"), F.lit(False))
    elems = F.when(is_list, v.cast("array<variant>")).otherwise(F.array().cast("array<variant>"))
    maps = F.transform(
        elems,
        lambda e: F.when(
            _vtype(e).startswith("OBJECT<"), F.try_variant_get(e, "$", "map<string,variant>")
        ),
    )
    pairs = F.transform(
        F.filter(maps, lambda m: m.isNotNull()),
        lambda m: F.struct(
            _first_truthy(m, QUESTION_KEYS).alias("q"),
            _first_truthy(m, ANSWER_KEYS).alias("a"),
        ),
    )
    kept = F.filter(pairs, lambda p: p["q"].isNotNull() & p["a"].isNotNull())
    return F.transform(kept, lambda p: F.struct(variant_text(p["q"]).alias("question"), variant_text(p["a"]).alias("answer")))


def extract_qa_regex(raw: Column | str) -> Column:
    """Fallback pairs from the raw (uncleaned) response."""
    blocks = F.filter(F.split(_c(raw), SPLIT_QUESTION), lambda b: ~T.is_blank(b))
    cand = F.transform(
        blocks,
        lambda b: F.struct(
            b.rlike(ANSWER_MATCH).alias("hit"),
            T.py_strip(
                F.regexp_replace(T.py_strip(F.regexp_extract(b, ANSWER_MATCH, 1)), F.lit(QUESTION_TRIM), F.lit(""))
            ).alias("question"),
            T.py_strip(F.regexp_extract(b, ANSWER_MATCH, 2)).alias("answer"),
        ),
    )
    kept = F.filter(cand, lambda p: p["hit"] & (p["question"] != "") & (p["answer"] != ""))
    return F.transform(kept, lambda p: F.struct(p["question"].alias("question"), p["answer"].alias("answer")))


def qa_with_fallback(raw: Column | str) -> Column:
    """JSON route when the cleaned text is valid JSON, else the regex route."""
    r = _c(raw)
    cleaned = clean_response(r)
    return F.when(r.isNull(), F.array().cast(PAIR_TYPE)).when(json_is_valid(cleaned), parse_qa_json(cleaned)).otherwise(
        extract_qa_regex(r)
    )
