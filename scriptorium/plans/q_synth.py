"""Queries for prompt/request building, the model call, outcome classification,
instruction rows, run counters and resume, over chunks of ``documents``."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators import resume as RES
from ..operators import synth as SY
from ..session import ensure_checkpoint_dir
from . import sqlfrag as S
from .registry import register, table
from .q_chunking import chunks_cte

CHUNK_MAX = 128
N_PAIRS = 3
MODEL = "demo-model"
LANGS = ["arabic", "english", "turkish"]


def _chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_document"), "text", "doc_id")
    c = C.chunk_documents(d.drop("doc_id"), CHUNK_MAX)
    return c.withColumn("chunk_id", C.stable_chunk_id("source_document", "seq"))


CHUNKS_SQL = chunks_cte(CHUNK_MAX) + """,
    ck AS (SELECT doc_id, chunk_no, CAST(doc_id AS VARCHAR) || '#' || CAST(chunk_no AS VARCHAR) AS chunk_id,
                  text, token_count_estimate FROM chunks)"""


def _lang_col():
    return F.element_at(F.array(*[F.lit(x) for x in LANGS]), (F.col("source_document") % 3 + 1).cast("int"))


def _prompt_sql(lang_expr: str, text: str) -> str:
    cases = []
    for name in LANGS:
        a, b, c = SY._template_parts(SY.PROMPT_TEMPLATES[name])
        cases.append(f"WHEN {S.q(name)} THEN {S.q(a)} || '{N_PAIRS}' || {S.q(b)} || {text} || {S.q(c)}")
    return f"(CASE {lang_expr} {' '.join(cases)} END)"


LANG_SQL = "(CASE doc_id % 3 WHEN 0 THEN 'arabic' WHEN 1 THEN 'english' ELSE 'turkish' END)"


@register("build_prompt", CHUNKS_SQL + f"\nSELECT chunk_id, {_prompt_sql(LANG_SQL, 'text')} AS prompt FROM ck")
def q_build_prompt(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    return c.select("chunk_id", SY.build_prompt(_lang_col(), N_PAIRS, F.col("text")).alias("prompt"))


@register(
    "build_request",
    CHUNKS_SQL + f"\nSELECT chunk_id, {S.q(MODEL)} AS model, 'user' AS role, length({_prompt_sql(LANG_SQL, 'text')}) AS content_len FROM ck",
)
def q_build_request(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    req = F.parse_json(SY.build_request(MODEL, SY.build_prompt(_lang_col(), N_PAIRS, F.col("text"))))
    return c.select(
        "chunk_id",
        F.try_variant_get(req, "$.model", "string").alias("model"),
        F.try_variant_get(req, "$.messages[0].role", "string").alias("role"),
        F.char_length(F.try_variant_get(req, "$.messages[0].content", "string")).cast("bigint").alias("content_len"),
    )


def echo_model(prompt: str) -> str:
    """Stand-in model for tests and the bench: one pair read off the prompt (its text and
    length), as a JSON list inside a code fence."""
    body = prompt.split("Text:\n    ", 1)[-1].rsplit("\n\n    The output should", 1)[0]
    pairs = [{"question": "Summarise: " + body[:60], "answer": str(len(prompt))}]
    return "```json\n" + json.dumps(pairs, ensure_ascii=False) + "\n```"


ENGLISH_A, ENGLISH_B, ENGLISH_C = SY._template_parts(SY.PROMPT_TEMPLATES["english"])
PROMPT_LEN_SQL = f"(length(text) + {len(ENGLISH_A) + len(str(N_PAIRS)) + len(ENGLISH_B) + len(ENGLISH_C)})"


def _completions(spark, sf_dir):
    c = _chunks(spark, sf_dir).withColumn("prompt", SY.build_prompt("english", N_PAIRS, F.col("text")))
    # The other columns ride through the call, so the chunks are not recomputed and joined back.
    return SY.map_completions(c, echo_model, "prompt")


@register(
    "map_completions",
    CHUNKS_SQL + f"\nSELECT chunk_id, 'ok' AS status, CAST({PROMPT_LEN_SQL} AS VARCHAR) AS first_answer FROM ck",
)
def q_map_completions(spark, sf_dir):
    r = _completions(spark, sf_dir)
    pairs = SY.with_pairs(r, "response", "qa")
    return pairs.select("chunk_id", "status", F.get("qa", 0)["answer"].alias("first_answer"))


INSTR_COLS = ["instruction", "input", "output", "original_source", "original_chunk_id", "original_text_preview", "reward_score"]


def _flat_instr(df):
    return df.select(
        "instruction", "input", "output", "source_document_info.*", "reward_score"
    )


@register(
    "synthesize_instructions",
    CHUNKS_SQL
    + """
    SELECT 'Summarise: ' || left(text, 60) AS instruction, '' AS input,
           CAST(""" + PROMPT_LEN_SQL + """ AS VARCHAR) AS output,
           CAST(doc_id AS VARCHAR) AS original_source, chunk_id AS original_chunk_id,
           left(text, 200) || '...' AS original_text_preview, CAST(NULL AS DOUBLE) AS reward_score
    FROM ck""",
)
def q_synthesize_instructions(spark, sf_dir):
    r = SY.with_pairs(_completions(spark, sf_dir), "response", "qa_pairs")
    return _flat_instr(SY.to_instruction_rows(r, "qa_pairs", "text", "source_document", "chunk_id"))


# ---- recorded responses: outcomes, counters, first failure ----------------------------

H_SQL = "substr(md5(chunk_id), 1, 1)"


def _recorded(spark, sf_dir):
    # Written once: the recorded table is made from the chunks and joined to them, and an
    # operator may read the result twice.
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch/recorded-{uuid.uuid4().hex}"
    made = _chunks(spark, sf_dir)
    made.write.parquet(path)
    c = spark.read.schema(made.schema).parquet(path)
    h = F.substr(F.md5("chunk_id"), F.lit(1), F.lit(1))
    pair_json = F.to_json(
        F.array(
            F.struct(F.concat(F.lit("What is chunk "), F.col("chunk_id"), F.lit("?")).alias("question"), F.left("text", F.lit(40)).alias("answer")),
            F.struct(F.lit("Which document?").alias("question"), F.col("source_document").cast("string").alias("answer")),
        )
    )
    status = F.when(h == "0", "rate_limited").when(h == "1", "error").otherwise("ok")
    response = F.when(h == "2", F.lit("[]")).when(h == "3", F.lit("no pairs here")).when(h.isin("0", "1"), F.lit(None)).otherwise(pair_json)
    recorded = c.select("chunk_id", status.alias("status"), response.alias("response"))
    return SY.recorded_completions(c, recorded, "chunk_id")


OUTCOME_SQL = f"""CASE WHEN {H_SQL} = '0' THEN 'rate_limited' WHEN {H_SQL} = '1' THEN 'error'
                       WHEN {H_SQL} IN ('2', '3') THEN 'no_pairs' ELSE 'ok' END"""


@register("classify_call_result", CHUNKS_SQL + f"\nSELECT chunk_id, {OUTCOME_SQL} AS outcome FROM ck")
def q_classify_call_result(spark, sf_dir):
    r = SY.with_pairs(_recorded(spark, sf_dir), "response", "qa")
    return r.select("chunk_id", SY.classify_call_result(F.col("text"), F.col("status"), F.col("qa")).alias("outcome"))


@register(
    "recorded_completions",
    CHUNKS_SQL + f"""
    SELECT 'What is chunk ' || chunk_id || '?' AS instruction, left(text, 40) AS output FROM ck WHERE {OUTCOME_SQL} = 'ok'
    UNION ALL SELECT 'Which document?', CAST(doc_id AS VARCHAR) FROM ck WHERE {OUTCOME_SQL} = 'ok'""",
)
def q_recorded_completions(spark, sf_dir):
    r = SY.with_pairs(_recorded(spark, sf_dir), "response", "qa")
    return SY.to_instruction_rows(r, "qa").select("instruction", "output")


@register(
    "to_instruction_rows",
    CHUNKS_SQL
    + f"""
    SELECT 'What is chunk ' || chunk_id || '?' AS instruction, '' AS input, left(text, 40) AS output,
           CAST(doc_id AS VARCHAR) AS original_source, chunk_id AS original_chunk_id,
           left(text, 200) || '...' AS original_text_preview, CAST(NULL AS DOUBLE) AS reward_score
    FROM ck WHERE {OUTCOME_SQL} = 'ok'
    UNION ALL
    SELECT 'Which document?', '', CAST(doc_id AS VARCHAR), CAST(doc_id AS VARCHAR), chunk_id,
           left(text, 200) || '...', CAST(NULL AS DOUBLE)
    FROM ck WHERE {OUTCOME_SQL} = 'ok'""",
)
def q_to_instruction_rows(spark, sf_dir):
    r = SY.with_pairs(_recorded(spark, sf_dir), "response", "qa")
    return _flat_instr(SY.to_instruction_rows(r, "qa"))


@register(
    "generation_metrics",
    CHUNKS_SQL
    + f"""
    SELECT count(*) FILTER (WHERE {OUTCOME_SQL} = 'ok') AS processed_lines,
           count(*) FILTER (WHERE {OUTCOME_SQL} <> 'ok') AS not_written_lines,
           CAST(2 * count(*) FILTER (WHERE {OUTCOME_SQL} = 'ok') AS BIGINT) AS generated_pairs
    FROM ck""",
)
def q_generation_metrics(spark, sf_dir):
    r = SY.with_pairs(_recorded(spark, sf_dir), "response", "qa")
    o = r.select(
        SY.classify_call_result(F.col("text"), F.col("status"), F.col("qa")).alias("outcome"), F.size("qa").alias("n_pairs")
    )
    return SY.generation_metrics(o, "outcome", "n_pairs")


@register(
    "stop_at_first_failure",
    CHUNKS_SQL
    + f"""
    SELECT chunk_id FROM ck
    WHERE doc_id * 100000 + chunk_no < coalesce((SELECT min(doc_id * 100000 + chunk_no) FROM ck WHERE {H_SQL} = '0'), 9223372036854775807)""",
)
def q_stop_at_first_failure(spark, sf_dir):
    r = _recorded(spark, sf_dir).withColumn("line_number", F.col("source_document") * 100000 + F.col("seq"))
    return SY.stop_at_first_failure(r, "line_number", "status").select("chunk_id")


# ---- resume ---------------------------------------------------------------------------


def _existing_output(spark, sf_dir):
    """An earlier run's output: instruction rows for the chunks of every third document."""
    c = _chunks(spark, sf_dir).where(F.col("source_document") % 3 == 0)
    done = c.select(
        "chunk_id", "text", "source_document", F.array(F.struct(F.lit("q").alias("question"), F.lit("a").alias("answer"))).alias("qa")
    )
    return SY.to_instruction_rows(done, "qa")


@register("resume_pending", CHUNKS_SQL + "\nSELECT chunk_id FROM ck WHERE doc_id % 3 <> 0")
def q_resume_pending(spark, sf_dir):
    done = RES.processed_ids(_existing_output(spark, sf_dir))
    return RES.resume_pending(_chunks(spark, sf_dir), done).select("chunk_id")


@register("count_skipped", CHUNKS_SQL + "\nSELECT count(*) AS skipped_lines FROM ck WHERE doc_id % 3 = 0")
def q_count_skipped(spark, sf_dir):
    done = RES.processed_ids(_existing_output(spark, sf_dir))
    return RES.count_skipped(_chunks(spark, sf_dir), done)
