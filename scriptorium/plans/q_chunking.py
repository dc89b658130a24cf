"""Queries for the chunking operators over ``documents``."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from . import sqlfrag as S
from .registry import register, table

CORPUS_MAX = 128
PACK_MAX = 64
OVERSIZE_MAX = 16


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_document"), "text")


# Header branch input: a third of the documents get a padded header block.
def _with_header(col_id, col_text):
    return F.when(
        col_id % 3 == 0, F.concat(F.lit(" \u00a0HDR line\n\n"), col_text, F.lit(" \n"))
    ).otherwise(col_text)


HEADER_SQL = "CASE WHEN doc_id % 3 = 0 THEN ' ' || chr(160) || 'HDR line' || chr(10) || chr(10) || text || ' ' || chr(10) ELSE text END"


@register(
    "clean_text",
    f"SELECT doc_id, {S.clean_text('(' + HEADER_SQL + ')')} AS cleaned FROM documents",
)
def q_clean_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.clean_text(_with_header(F.col("doc_id"), F.col("text"))).alias("cleaned"))


@register(
    "split_paragraphs",
    f"""SELECT doc_id, generate_subscripts(ps, 1) AS para_no, unnest(ps) AS paragraph
        FROM (SELECT doc_id, {S.paragraphs(S.clean_text('text'))} AS ps FROM documents)""",
)
def q_split_paragraphs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    e = d.select("doc_id", F.posexplode_outer(T.split_paragraphs(T.clean_text("text")))).where(F.col("col").isNotNull())
    return e.select("doc_id", (F.col("pos") + 1).alias("para_no"), F.col("col").alias("paragraph"))


@register(
    "split_sentences",
    f"""SELECT doc_id, generate_subscripts(us, 1) AS unit_no, unnest(us) AS unit
        FROM (SELECT doc_id, {S.units(S.clean_text('text'))} AS us FROM documents)""",
)
def q_split_sentences(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    e = d.select("doc_id", F.posexplode_outer(T.semantic_units(T.clean_text("text")))).where(F.col("col").isNotNull())
    return e.select("doc_id", (F.col("pos") + 1).alias("unit_no"), F.col("col").alias("unit"))


@register(
    "count_tokens",
    f"SELECT doc_id, CAST(len({S.words(S.clean_text('text'))}) AS INTEGER) AS n_tokens FROM documents",
)
def q_count_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.word_count(T.clean_text("text")).alias("n_tokens"))


@register(
    "split_oversize",
    f"""SELECT doc_id, generate_subscripts(pl, 1) AS part_no, unnest(pl, recursive := true)
        FROM (SELECT doc_id, {S.parts(S.units(S.clean_text('text')), OVERSIZE_MAX)} AS pl FROM documents)""",
)
def q_split_oversize(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    units = d.select("doc_id", T.semantic_units(T.clean_text("text")).alias("u"))
    parts = units.select("doc_id", C.split_oversize(F.col("u"), OVERSIZE_MAX).alias("pl"))
    e = parts.select("doc_id", F.posexplode_outer("pl")).where(F.col("col").isNotNull())
    return e.select("doc_id", (F.col("pos") + 1).alias("part_no"), "col.text", "col.n")


def chunks_cte(max_tokens: int) -> str:
    """``WITH RECURSIVE ... chunks(doc_id, chunk_no, text, token_count_estimate)`` head."""
    return _pack_sql(max_tokens, numbered=None)


def _pack_sql(max_tokens: int, numbered: bool | None) -> str:
    parts = S.parts(S.units(S.clean_text("text")), max_tokens)
    head = f"""
    WITH RECURSIVE
    doc_parts AS (SELECT doc_id, {parts} AS pl FROM documents),
    flat AS (
      SELECT doc_id, pos, p.text AS text, p.n AS n
      FROM (SELECT doc_id, unnest(pl) AS p, generate_subscripts(pl, 1) AS pos FROM doc_parts)
    ),
    {S.pack_cte('flat', 'doc_id', max_tokens).strip()},
    chunks AS (
      SELECT f.doc_id, k.chunk_no,
             string_agg(f.text, chr(10) ORDER BY f.pos) AS text,
             CAST(sum(f.n) AS INTEGER) AS token_count_estimate
      FROM flat f JOIN packed k ON k.doc_id = f.doc_id AND k.pos = f.pos
      GROUP BY f.doc_id, k.chunk_no
    )"""
    if numbered is None:
        return head
    if numbered:
        return head + """
    SELECT text, doc_id AS source_document,
           'chunk_' || CAST(row_number() OVER (ORDER BY doc_id, chunk_no) AS VARCHAR) AS chunk_id,
           token_count_estimate
    FROM chunks"""
    return head + """
    SELECT doc_id AS source_document, CAST(chunk_no AS INTEGER) AS seq, text, token_count_estimate FROM chunks"""


@register("pack_chunks", _pack_sql(PACK_MAX, numbered=False))
def q_pack_chunks(spark, sf_dir):
    return C.chunk_documents(_docs(spark, sf_dir), PACK_MAX)


@register("chunk_corpus", _pack_sql(CORPUS_MAX, numbered=True))
def q_chunk_corpus(spark, sf_dir):
    return C.chunk_corpus(_docs(spark, sf_dir), CORPUS_MAX)


@register("number_chunks", _pack_sql(CORPUS_MAX, numbered=True))
def q_number_chunks(spark, sf_dir):
    # Same numbering, written the explicit way: chunk, then number over (document, seq).
    from ..operators.numbering import number_rows

    chunks = C.chunk_documents(_docs(spark, sf_dir), CORPUS_MAX)
    n = number_rows(chunks, ["source_document", "seq"], "_n")
    return n.select(
        "text",
        "source_document",
        F.concat(F.lit("chunk_"), F.col("_n").cast("string")).alias("chunk_id"),
        "token_count_estimate",
    )


def _chunk_stats_sql() -> str:
    base = _pack_sql(CORPUS_MAX, numbered=False)
    body, _, _ = base.rpartition("SELECT doc_id AS source_document")
    units = S.units(S.clean_text("text"))
    return (
        body
        + f"""
    SELECT (SELECT count(*) FROM documents) AS files_found,
           (SELECT count(*) FROM chunks) AS chunks_written,
           (SELECT CAST(sum(len(list_filter({units}, lambda x: len({S.words('x')}) > {CORPUS_MAX}))) AS BIGINT)
              FROM documents) AS oversize_units,
           (SELECT max(token_count_estimate) FROM chunks) AS max_chunk_tokens"""
    )


@register("chunk_stats", _chunk_stats_sql())
def q_chunk_stats(spark, sf_dir):
    return C.chunk_stats(table(spark, sf_dir, "documents"), CORPUS_MAX)


# ---- counters given by the user --------------------------------------------------------

PIECES_MAX = 48
TOKENS_MAX = 256


def pieces(text):
    """An additive counter: pre-token pieces, which never reach over white space."""
    return F.size(T.pretokenize(text))


PIECES_RE = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+"


def _pieces_sql(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, {S.q(PIECES_RE)})) AS INTEGER)"


@register(
    "chunk_by_pieces",
    f"""
    WITH RECURSIVE
    us AS (SELECT doc_id, {S.units(S.clean_text('text'))} AS ul FROM documents),
    u AS (SELECT doc_id, unit_no, unit, {_pieces_sql('unit')} AS n FROM (SELECT doc_id, generate_subscripts(ul, 1) AS unit_no, unnest(ul) AS unit FROM us)),
    big AS (SELECT row_number() OVER (ORDER BY doc_id, unit_no) AS k, doc_id, unit_no, {S.words('unit')} AS ws FROM u WHERE n > {PIECES_MAX}),
    w AS (SELECT k, pos, word, {_pieces_sql('word')} AS n FROM (SELECT k, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word FROM big)),
    {S.pack_cte('w', 'k', PIECES_MAX).strip().replace('packed', 'groups')},
    parts AS (
      SELECT doc_id, unit_no, 1 AS part_no, unit AS text, n FROM u WHERE n <= {PIECES_MAX}
      UNION ALL
      SELECT any_value(doc_id), any_value(unit_no), chunk_no, string_agg(word, ' ' ORDER BY pos), CAST(sum(n) AS INTEGER)
      FROM w JOIN groups USING (k, pos) JOIN big USING (k) GROUP BY k, chunk_no),
    flat AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY unit_no, part_no) AS pos, text, n FROM parts WHERE n > 0),
    {S.pack_cte('flat', 'doc_id', PIECES_MAX).strip()}
    SELECT doc_id AS source_document, CAST(chunk_no AS INTEGER) AS seq, string_agg(text, chr(10) ORDER BY pos) AS text,
           CAST(sum(f.n) AS INTEGER) AS token_count_estimate
    FROM flat f JOIN packed USING (doc_id, pos) GROUP BY doc_id, chunk_no""",
)
def q_chunk_by_pieces(spark, sf_dir):
    return C.chunk_documents(_docs(spark, sf_dir), PIECES_MAX, counter=pieces)


SEGMENTS_MAX = 24


def clauses(paragraphs: list[str]) -> list[list[str]]:
    """Stand-in sentence model: cuts at commas and semicolons and fails on digits."""
    if any(c in "0123456789" for p in paragraphs for c in p):
        raise ValueError("digits")
    return [re.split("[,;]", p) for p in paragraphs]


CLAUSES_SQL = (
    f"flatten(list_transform({S.paragraphs(S.clean_text('text'))}, lambda pp: CASE WHEN regexp_matches(pp, '[0-9]') THEN [{S.py_strip('pp')}] "
    f"ELSE list_filter(list_transform(regexp_split_to_array(pp, '[,;]'), lambda s: {S.py_strip('s')}), lambda s: s <> '') END))"
)


@register(
    "chunk_by_segmenter",
    f"""
    WITH RECURSIVE
    doc_parts AS (SELECT doc_id, {S.parts(CLAUSES_SQL, SEGMENTS_MAX)} AS pl FROM documents),
    flat AS (SELECT doc_id, pos, p.text AS text, p.n AS n FROM (SELECT doc_id, unnest(pl) AS p, generate_subscripts(pl, 1) AS pos FROM doc_parts)),
    {S.pack_cte('flat', 'doc_id', SEGMENTS_MAX).strip()}
    SELECT doc_id AS source_document, CAST(chunk_no AS INTEGER) AS seq, string_agg(text, chr(10) ORDER BY pos) AS text,
           CAST(sum(f.n) AS INTEGER) AS token_count_estimate
    FROM flat f JOIN packed USING (doc_id, pos) GROUP BY doc_id, chunk_no""",
)
def q_chunk_by_segmenter(spark, sf_dir):
    return C.chunk_documents(_docs(spark, sf_dir), SEGMENTS_MAX, segmenter=clauses)


@register("chunk_by_tokenizer")
def q_chunk_by_tokenizer(spark, sf_dir):
    """Chunks bounded by a model tokenizer's own counts of whole texts (tested against a
    plain loop; SQL has no such tokenizer)."""
    import public_tokenizers

    from ..functions.counters import tokenizer_counter

    count = tokenizer_counter(public_tokenizers.path("word_bpe_49k.json"))
    return C.chunk_documents(_docs(spark, sf_dir), TOKENS_MAX, batch_counter=count)
