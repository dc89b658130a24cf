"""Queries for whole generation runs over chunks of ``documents``.

Two runs over the same chunks: the first with a model that is rate limited, fails or gives
no pairs by the length of the prompt, the second with one that answers all. What the first
run wrote is skipped by the second."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import generate as G
from ..sources import readers as RD
from ..sources import sinks as SK
from ..streaming.incremental import generate_incrementally
from .q_io import _chunks, scratch
from .q_synth import CHUNKS_SQL, N_PAIRS, PROMPT_LEN_SQL
from .registry import register
from .sqlfrag import D

THRESHOLD = 0.1
CALLERS = 8


class RateLimitError(Exception):
    pass


def steady_model(prompt: str) -> str:
    """Two pairs read off the prompt: its text's beginning and its length."""
    body = prompt.split("Text:\n    ", 1)[-1].rsplit("\n\n    The output should", 1)[0]
    pairs = [{"question": "Summarise: " + body[:60], "answer": str(len(prompt))}, {"question": "How does it begin?", "answer": body[:40]}]
    return "```json\n" + json.dumps(pairs, ensure_ascii=False) + "\n```"


def flaky_model(prompt: str) -> str:
    k = len(prompt) % 5
    if k == 0:
        raise RateLimitError("slow down")
    if k == 1:
        raise ValueError("no answer")
    return "[]" if k == 2 else steady_model(prompt)


def answer_length(questions: list[str], answers: list[str]) -> list[float]:
    """Stand-in reward model: the answer's length over 40."""
    return [min(1.0, len(a) / 40.0) for a in answers]


def _two_runs(spark, sf_dir):
    base = scratch(spark, "generate")
    SK.write_jsonl(_chunks(spark, sf_dir), f"{base}/chunks")
    out = f"{base}/out"

    def run(model):
        chunks = RD.read_chunks_jsonl(spark, f"{base}/chunks", line_numbers=True)
        return G.generate_instructions(spark, chunks, out, f"{base}/work", model, "english", N_PAIRS, CALLERS, answer_length, threshold=THRESHOLD)

    return out, run(flaky_model), run(steady_model)


PAIRS_SQL = f"""pairs AS (
      SELECT doc_id, chunk_id, text, {PROMPT_LEN_SQL} % 5 AS k, 'Summarise: ' || left(text, 60) AS instruction, CAST({PROMPT_LEN_SQL} AS VARCHAR) AS output FROM ck
      UNION ALL SELECT doc_id, chunk_id, text, {PROMPT_LEN_SQL} % 5, 'How does it begin?', left(text, 40) FROM ck),
    kept AS (SELECT * FROM (SELECT *, least({D(1.0)}, length(output) / {D(40.0)}) AS reward_score FROM pairs) WHERE reward_score >= {D(THRESHOLD)})"""


ROWS_SQL = (
    CHUNKS_SQL
    + f""", {PAIRS_SQL}
    SELECT instruction, '' AS input, output, CAST(doc_id AS VARCHAR) AS original_source, chunk_id AS original_chunk_id,
           left(text, 200) || '...' AS original_text_preview, reward_score FROM kept"""
)


def _rows(spark, out):
    rows = spark.read.schema(RD.OUTPUT_SCHEMA).json(out)
    return rows.select("instruction", "input", "output", "source_document_info.*", "reward_score")


@register("generate_instructions", ROWS_SQL)
def q_generate_instructions(spark, sf_dir):
    out, _, _ = _two_runs(spark, sf_dir)
    return _rows(spark, out)


@register("generate_incrementally", ROWS_SQL)
def q_generate_incrementally(spark, sf_dir):
    """Two drops of chunk files, the second with part of the first again, each followed by a
    run with the flaky model; a third run without new files finishes with the steady one."""
    base = scratch(spark, "generate-stream")
    src, out = f"{base}/in", f"{base}/out"
    c, doc = _chunks(spark, sf_dir), F.col("source_document").cast("bigint")

    def run(model):
        generate_incrementally(
            spark, src, out, f"{base}/checkpoint", model, language="english", pairs_per_chunk=N_PAIRS, parallelism=CALLERS, scorer=answer_length, threshold=THRESHOLD
        )

    SK.append_jsonl(c.where(doc % 2 == 0), src, compressed=True)
    run(flaky_model)
    SK.append_jsonl(c.where((doc % 2 == 1) | (doc % 4 == 0)), src, compressed=True)
    run(flaky_model)
    run(steady_model)
    return _rows(spark, out)


@register(
    "generation_outcomes",
    CHUNKS_SQL
    + f""", {PAIRS_SQL},
    n AS (SELECT chunk_id, count(*) AS n_kept FROM kept GROUP BY chunk_id),
    c AS (SELECT chunk_id, {PROMPT_LEN_SQL} % 5 AS k, coalesce(n_kept, 0) AS n_kept FROM ck LEFT JOIN n USING (chunk_id))
    SELECT 1 AS run, chunk_id,
           CASE k WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'error' WHEN 2 THEN 'no_pairs' ELSE CASE WHEN n_kept > 0 THEN 'ok' ELSE 'below_threshold' END END AS outcome,
           CASE WHEN k < 3 THEN 0 ELSE 2 END AS n_pairs, CAST(CASE WHEN k < 3 THEN 0 ELSE n_kept END AS INTEGER) AS n_kept FROM c
    UNION ALL
    SELECT 2, chunk_id, CASE WHEN n_kept > 0 THEN 'ok' ELSE 'below_threshold' END, 2, CAST(n_kept AS INTEGER) FROM c WHERE k < 3 OR n_kept = 0""",
)
def q_generation_outcomes(spark, sf_dir):
    _, first, second = _two_runs(spark, sf_dir)
    rows = [r.outcomes.select(F.lit(i).alias("run"), "chunk_id", "outcome", "n_pairs", "n_kept") for i, r in ((1, first), (2, second))]
    return rows[0].unionByName(rows[1])


@register(
    "generation_run_metrics",
    CHUNKS_SQL
    + f""", {PAIRS_SQL},
    n AS (SELECT chunk_id, count(*) AS n_kept FROM kept GROUP BY chunk_id),
    c AS (SELECT chunk_id, {PROMPT_LEN_SQL} % 5 AS k, coalesce(n_kept, 0) AS n_kept FROM ck LEFT JOIN n USING (chunk_id))
    SELECT 1 AS run, count(*) FILTER (k > 2 AND n_kept > 0) AS processed_lines, count(*) FILTER (k <= 2 OR n_kept = 0) AS not_written_lines,
           CAST(coalesce(sum(n_kept) FILTER (k > 2), 0) AS BIGINT) AS generated_pairs, CAST(0 AS BIGINT) AS skipped_lines FROM c
    UNION ALL
    SELECT 2, count(*) FILTER (k <= 2 AND n_kept > 0), count(*) FILTER (n_kept = 0),
           CAST(coalesce(sum(n_kept) FILTER (k <= 2), 0) AS BIGINT), count(*) FILTER (k > 2 AND n_kept > 0) FROM c""",
)
def q_generation_run_metrics(spark, sf_dir):
    _, first, second = _two_runs(spark, sf_dir)
    return first.metrics.select(F.lit(1).alias("run"), "*").unionByName(second.metrics.select(F.lit(2).alias("run"), "*"))
