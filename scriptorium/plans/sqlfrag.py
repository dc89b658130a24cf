"""DuckDB SQL fragments used by the oracle queries (``plans.catalog``).

The oracle is independent SQL run by DuckDB; these helpers only spell the same
text rules (Python whitespace, sentence breaks) in DuckDB's dialect. Patterns come from
``functions.text`` so both engines use one definition of each rule.
"""

from __future__ import annotations

from ..functions import text as T


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


NL = "chr(10)"


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, {q(T.STRIP_PATTERN)}, '', 'g')"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, {q(T.PY_NON_WS + '+')})"


def not_blank(x: str) -> str:
    return f"regexp_matches({x}, {q(T.PY_NON_WS)})"


def clean_text(x: str) -> str:
    s = py_strip(x)
    pos = f"instr({s}, {NL} || {NL})"
    return f"(CASE WHEN {pos} > 0 THEN substr({s}, {pos} + 2) ELSE {s} END)"


def paragraphs(x: str) -> str:
    return f"list_filter(string_split({x}, {NL}), lambda p: {not_blank('p')})"


def sentences(x: str) -> str:
    marked = f"regexp_replace({x}, {q(T.SENTENCE_BREAK)}, '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {py_strip('s')}), lambda s: s <> '')"


def units(x: str) -> str:
    return f"flatten(list_transform({paragraphs(x)}, lambda pp: {sentences('pp')}))"


def parts(units_expr: str, max_tokens: int) -> str:
    """Oversize units -> groups of ``max_tokens`` words (additive word counter, overhead 0)."""
    g = max_tokens
    return (
        f"flatten(list_transform({units_expr}, lambda u: CASE WHEN len({words('u')}) <= {max_tokens} "
        f"THEN [{{'text': u, 'n': len({words('u')})::INTEGER}}] "
        f"ELSE list_transform(range(0, CAST(ceil(len({words('u')}) / {g}) AS BIGINT)), lambda i: "
        f"{{'text': array_to_string(({words('u')})[i * {g} + 1 : i * {g} + {g}], ' '), "
        f"'n': least({g}, len({words('u')}) - i * {g})::INTEGER}}) END))"
    )


def pack_cte(parts_table: str, key: str, max_tokens: int) -> str:
    """Recursive CTE body: greedy packing of ``parts_table(key, pos, text, n)``
    -> rows ``(key, pos, chunk_no)``. An independent formulation of the fold."""
    return f"""
    packed AS (
      SELECT {key}, pos, 1 AS chunk_no, n AS cur FROM {parts_table} WHERE pos = 1
      UNION ALL
      SELECT r.{key}, q.pos,
             CASE WHEN r.cur + q.n > {max_tokens} THEN r.chunk_no + 1 ELSE r.chunk_no END,
             CASE WHEN r.cur + q.n > {max_tokens} THEN q.n ELSE r.cur + q.n END
      FROM packed r JOIN {parts_table} q ON q.{key} = r.{key} AND q.pos = r.pos + 1
    )"""


def D(x: float) -> str:
    """DOUBLE literal parsed from its shortest repr (DuckDB decimal literals are exact
    decimals, so arithmetic would not follow IEEE double order otherwise)."""
    return f"'{float(x)!r}'::DOUBLE"


def strip_punct(x: str) -> str:
    return f"regexp_replace({x}, {q(T.PUNCT_STRIP_PATTERN)}, '', 'g')"


def str_list(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


PAIRS_CTE = """pairs AS (
      SELECT conv_id, CAST(turn // 2 AS BIGINT) AS pair_no,
             max(text) FILTER (WHERE turn % 2 = 0) AS instruction,
             max(text) FILTER (WHERE turn % 2 = 1) AS output
      FROM conversations GROUP BY conv_id, turn // 2 HAVING count(*) = 2
    )"""
