"""Queries for the tokenizer and masked-LM data jobs over ``documents``.

The oracle trains the vocabulary in SQL, one materialised step per merge: count pairs over
the distinct words, take the best (count, then ids), replace it. The word table of the last
step is also the encoding of every word, so the encoding queries run with merges and are
checked end to end. The tests compare longer trainings with the public tokenizer library.

SQL can afford few merges, so the queries with an oracle stop early. Those that end in
``_32k`` do the same jobs with a vocabulary of ``VOCAB_SIZE``, without an oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bpe as B
from ..operators import mlm as M
from . import sqlfrag as S
from .registry import register, table

WORD_RE_SQL = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+"
SPECIALS = B.DEFAULT_SPECIALS
MAX_LEN = 64
MASK_ID = SPECIALS.index("[MASK]")
PAD_ID = SPECIALS.index("[PAD]")
SEED = 42
BPE_MERGES = 60
ENCODE_MERGES = 12
VOCAB_SIZE = 32_000


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


WORDS_SQL = f"SELECT doc_id, regexp_extract_all(lower(text), {S.q(WORD_RE_SQL)}) AS ws FROM documents"


@register("normalize_text", "SELECT doc_id, lower(text) AS text FROM documents")
def q_normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", B.normalize_text("text").alias("text"))


@register(
    "pretokenize",
    f"SELECT doc_id, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS piece FROM ({WORDS_SQL})",
)
def q_pretokenize(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", F.posexplode(T.pretokenize(B.normalize_text("text"))).alias("pos", "piece"))


@register(
    "word_frequencies",
    f"SELECT w AS word, count(*) AS freq FROM (SELECT unnest(ws) AS w FROM ({WORDS_SQL})) GROUP BY w",
)
def q_word_frequencies(spark, sf_dir):
    return B.word_frequencies(_docs(spark, sf_dir))


ALPHA_SQL = f"""alpha AS (
      SELECT ch, CAST({len(SPECIALS)} + row_number() OVER (ORDER BY ch) - 1 AS INTEGER) AS id
      FROM (SELECT DISTINCT unnest(string_split(w, '')) AS ch FROM (SELECT unnest(ws) AS w FROM ({WORDS_SQL})))
    )"""


@register(
    "char_alphabet",
    f"""SELECT ch, sum(freq) AS freq FROM (
          SELECT unnest(string_split(w, '')) AS ch, 1 AS freq FROM (SELECT unnest(ws) AS w FROM ({WORDS_SQL})))
        GROUP BY ch""",
)
def q_char_alphabet(spark, sf_dir):
    a = B.char_alphabet(B.word_frequencies(_docs(spark, sf_dir)))
    return a.select("ch", F.col("freq").cast("bigint").alias("freq"))


def _model(spark, sf_dir):
    return B.train_bpe(_docs(spark, sf_dir), vocab_size=1 << 30, num_merges=ENCODE_MERGES, min_frequency=2, special_tokens=SPECIALS)


def _model_32k(spark, sf_dir):
    return B.train_bpe(_docs(spark, sf_dir), vocab_size=VOCAB_SIZE, min_frequency=2, special_tokens=SPECIALS)


def _bpe_sql(merges: int) -> str:
    """CTEs of a training: ``w<i>`` (word, freq, s: its ids as ``<a><b>``) and ``v<i>`` (the
    vocabulary as a list) after ``i`` merges."""
    out = [
        ALPHA_SQL,
        "am AS (SELECT map_from_entries(list(struct_pack(k := ch, v := id))) AS mm FROM alpha)",
        f"""w0 AS MATERIALIZED (
      SELECT w AS word, freq, '<' || array_to_string(list_transform(string_split(w, ''), lambda c: mm[c]), '><') || '>' AS s
      FROM (SELECT w, count(*) AS freq FROM (SELECT unnest(ws) AS w FROM ({WORDS_SQL})) GROUP BY w), am)""",
        f"v0 AS MATERIALIZED (SELECT list_concat([{', '.join(S.q(t) for t in SPECIALS)}], (SELECT list(ch ORDER BY id) FROM alpha)) AS v)",
    ]
    for i in range(1, merges + 1):
        out += [
            f"""p{i} AS MATERIALIZED (
      SELECT x[1] AS l, x[2] AS r, sum(freq) AS c
      FROM (SELECT freq, unnest(list_transform(range(1, len(ids)), lambda k: [ids[k], ids[k + 1]])) AS x
            FROM (SELECT freq, CAST(string_split(s[2:len(s) - 1], '><') AS INTEGER[]) AS ids FROM w{i - 1}) WHERE len(ids) > 1)
      GROUP BY 1, 2 HAVING sum(freq) >= 2 ORDER BY c DESC, l, r LIMIT 1)""",
            f"t{i} AS MATERIALIZED (SELECT l, r, v[l + 1] || v[r + 1] AS tok, coalesce(nullif(list_position(v, v[l + 1] || v[r + 1]), 0) - 1, len(v)) AS id FROM p{i}, v{i - 1})",
            f"v{i} AS MATERIALIZED (SELECT CASE WHEN id = len(v) THEN list_append(v, tok) ELSE v END AS v FROM v{i - 1} LEFT JOIN t{i} ON true)",
            f"w{i} AS MATERIALIZED (SELECT word, freq, coalesce(replace(s, '<' || l || '><' || r || '>', '<' || id || '>'), s) AS s FROM w{i - 1} LEFT JOIN t{i} ON true)",
        ]
    return ",\n    ".join(out)


def _vocab_sql(merges: int) -> str:
    return f"""WITH {_bpe_sql(merges)}
    SELECT token, id, CASE WHEN id < {len(SPECIALS)} THEN 'special' WHEN id < len(v0.v) THEN 'alphabet' ELSE 'merge' END AS kind
    FROM (SELECT unnest(v) AS token, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS id FROM v{merges}), v0"""


ENCODED_SQL = f"""WITH {_bpe_sql(ENCODE_MERGES)},
    enc AS (
      SELECT doc_id, coalesce(flatten(list(ids ORDER BY pos) FILTER (ids IS NOT NULL)), []) AS ids
      FROM (SELECT doc_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word FROM (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [''] ELSE ws END AS ws FROM ({WORDS_SQL})))
      LEFT JOIN (SELECT word, CAST(string_split(s[2:len(s) - 1], '><') AS INTEGER[]) AS ids FROM w{ENCODE_MERGES}) USING (word)
      GROUP BY doc_id
    )"""


def _encoded(spark, sf_dir, model):
    return B.encode_texts(_docs(spark, sf_dir), model).select("doc_id", "ids")


@register("encode_texts", ENCODED_SQL + "\nSELECT doc_id, ids FROM enc")
def q_encode_texts(spark, sf_dir):
    return _encoded(spark, sf_dir, _model(spark, sf_dir))


@register("encode_texts_32k")
def q_encode_texts_32k(spark, sf_dir):
    return _encoded(spark, sf_dir, _model_32k(spark, sf_dir))


PAD_SQL = f"""padded AS (
      SELECT doc_id, list_concat(ids[1:{MAX_LEN}], list_transform(range(0, {MAX_LEN} - len(ids[1:{MAX_LEN}])), lambda i: {PAD_ID})) AS input_ids,
             list_concat(list_transform(range(0, len(ids[1:{MAX_LEN}])), lambda i: 1),
                         list_transform(range(0, {MAX_LEN} - len(ids[1:{MAX_LEN}])), lambda i: 0)) AS attention_mask
      FROM enc
    )"""


@register("truncate_pad", ENCODED_SQL + f",\n    {PAD_SQL}\nSELECT doc_id, input_ids, attention_mask FROM padded")
def q_truncate_pad(spark, sf_dir):
    return _encoded(spark, sf_dir, _model(spark, sf_dir)).select("doc_id", *B.truncate_pad("ids", MAX_LEN, PAD_ID))


@register("truncate_pad_32k")
def q_truncate_pad_32k(spark, sf_dir):
    return _encoded(spark, sf_dir, _model_32k(spark, sf_dir)).select("doc_id", *B.truncate_pad("ids", MAX_LEN, PAD_ID))


U_SQL = f"CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':' || CAST(i AS VARCHAR) || ':{SEED}'), 1, 8)) AS BIGINT) / 4294967296.0"
HIT_SQL = f"({U_SQL} < 0.15 AND input_ids[i + 1] <> {PAD_ID})"
MLM_SQL = (
    ENCODED_SQL
    + f""",
    masked AS (
      SELECT doc_id, input_ids,
             list_transform(range(0, len(input_ids)), lambda i: CASE WHEN {HIT_SQL} THEN {MASK_ID} ELSE input_ids[i + 1] END) AS masked_ids,
             list_transform(range(0, len(input_ids)), lambda i: CASE WHEN {HIT_SQL} THEN input_ids[i + 1] ELSE -100 END) AS labels
      FROM (SELECT doc_id, ids AS input_ids FROM enc)
    )"""
)


def _masked(spark, sf_dir, model):
    # Every token of every text; cutting to a length is truncate_pad's part.
    p = _encoded(spark, sf_dir, model).select("doc_id", F.col("ids").alias("input_ids"))
    return p.select("doc_id", "input_ids", *M.mlm_mask("input_ids", F.col("doc_id"), MASK_ID, PAD_ID, 0.15, SEED))


@register("mlm_mask", MLM_SQL + "\nSELECT doc_id, masked_ids, labels FROM masked")
def q_mlm_mask(spark, sf_dir):
    return _masked(spark, sf_dir, _model(spark, sf_dir)).select("doc_id", "masked_ids", "labels")


@register("mlm_mask_32k")
def q_mlm_mask_32k(spark, sf_dir):
    return _masked(spark, sf_dir, _model_32k(spark, sf_dir)).select("doc_id", "masked_ids", "labels")


@register(
    "mask_stats",
    MLM_SQL
    + f"""
    SELECT CAST(sum(len(list_filter(labels, lambda x: x <> -100))) AS BIGINT) AS masked,
           CAST(sum(len(list_filter(input_ids, lambda x: x <> {PAD_ID}))) AS BIGINT) AS non_pad,
           round(sum(len(list_filter(labels, lambda x: x <> -100))) / sum(len(list_filter(input_ids, lambda x: x <> {PAD_ID}))), 9) AS mask_rate
    FROM masked""",
)
def q_mask_stats(spark, sf_dir):
    return M.mask_stats(_masked(spark, sf_dir, _model(spark, sf_dir)), "labels", "input_ids", PAD_ID)


@register("mask_stats_32k")
def q_mask_stats_32k(spark, sf_dir):
    return M.mask_stats(_masked(spark, sf_dir, _model_32k(spark, sf_dir)), "labels", "input_ids", PAD_ID)


@register(
    "position_ids",
    ENCODED_SQL + "\nSELECT doc_id, CASE WHEN len(ids) > 0 THEN range(0, len(ids)) ELSE [] END AS position_ids FROM enc",
)
def q_position_ids(spark, sf_dir):
    return _encoded(spark, sf_dir, _model(spark, sf_dir)).select("doc_id", M.position_ids("ids").alias("position_ids"))


@register("position_ids_32k")
def q_position_ids_32k(spark, sf_dir):
    return _encoded(spark, sf_dir, _model_32k(spark, sf_dir)).select("doc_id", M.position_ids("ids").alias("position_ids"))


@register("train_bpe", _vocab_sql(BPE_MERGES))
def q_train_bpe(spark, sf_dir):
    """The learned vocabulary: specials, alphabet, BPE_MERGES merges."""
    d = _docs(spark, sf_dir)
    model = B.train_bpe(d, vocab_size=1 << 30, num_merges=BPE_MERGES, min_frequency=2, special_tokens=SPECIALS)
    return B.build_vocab(spark, model)


@register("train_bpe_32k")
def q_train_bpe_32k(spark, sf_dir):
    """The vocabulary learned to VOCAB_SIZE, or until no pair comes twice."""
    return B.build_vocab(spark, _model_32k(spark, sf_dir))


@register("build_vocab", _vocab_sql(ENCODE_MERGES))
def q_build_vocab(spark, sf_dir):
    """A saved and loaded model's vocabulary."""
    return _saved_vocab(spark, _model(spark, sf_dir))


@register("build_vocab_32k")
def q_build_vocab_32k(spark, sf_dir):
    return _saved_vocab(spark, _model_32k(spark, sf_dir))


def _saved_vocab(spark, model):
    import uuid

    from ..session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch/bpe-{uuid.uuid4().hex}"
    B.save_model(spark, model, path)
    return B.build_vocab(spark, B.load_model(spark, path))


@register(
    "corpus_stats",
    f"""SELECT count(*) AS total_words,
           count(*) FILTER (WHERE regexp_matches(w, {S.q(r"[\x{600}-\x{6ff}]")}) AND regexp_matches(w, {S.q(r"[\x{64b}-\x{652}]")})) AS vocalised_words,
           count(*) FILTER (WHERE NOT regexp_matches(w, {S.q(r"[\x{600}-\x{6ff}]")})) AS other_words,
           count(DISTINCT CASE WHEN regexp_matches(w, {S.q(r"[\x{600}-\x{6ff}]")}) THEN regexp_replace(w, {S.q(r"[\x{64b}-\x{652}]")}, '', 'g') END) AS unique_unvocalised,
           count(DISTINCT CASE WHEN regexp_matches(w, {S.q(r"[\x{600}-\x{6ff}]")}) AND regexp_matches(w, {S.q(r"[\x{64b}-\x{652}]")}) THEN w END) AS unique_vocalised,
           round(CAST(count(DISTINCT CASE WHEN regexp_matches(w, {S.q(r"[\x{600}-\x{6ff}]")}) AND regexp_matches(w, {S.q(r"[\x{64b}-\x{652}]")}) THEN w END) AS DOUBLE)
                 / nullif(count(DISTINCT CASE WHEN regexp_matches(w, {S.q(r"[\x{600}-\x{6ff}]")}) THEN regexp_replace(w, {S.q(r"[\x{64b}-\x{652}]")}, '', 'g') END), 0), 6) AS avg_vocalisations
        FROM (SELECT unnest({S.words('text')}) AS w FROM documents)""",
)
def q_corpus_stats(spark, sf_dir):
    """Documented-only metric (dataset card); the driver's documents hold no Arabic, so
    the vocalisation ratio is null there."""
    from ..operators.corpus_stats import corpus_stats

    return corpus_stats(_docs(spark, sf_dir))
