"""A whole generation run: chunks in, scored instruction rows out, resumable.

The steps of ``synth``, ``resume`` and ``scores`` in one job: chunks whose id has output
already are skipped (anti join), prompts are built, the model is called, raw responses are
written before anything is parsed, pairs are parsed and scored, pairs below the threshold
go, and what is left is appended as instruction rows. A chunk that failed, was rate
limited, gave no pairs or none that reached the threshold has no output and is offered
again by the next run; a chunk whose scoring fails keeps all its pairs, unscored.

With ``parallelism`` 1 the chunks are sent in line order by one caller, which stops at the
first rate limit; with more, every chunk is sent."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import filter_by_reward, score_pairs
from ..sources.readers import OUTPUT_SCHEMA, path_exists, read_processed_ids
from ..sources.sinks import append_jsonl, write_jsonl
from . import synth
from .resume import count_skipped, resume_pending

SCORED_PAIRS = "array<struct<question:string,answer:string,reward_score:double>>"
Scorer = Callable[[list[str], list[str]], list[float]] | Callable[[Column, Column], Column]


@dataclass
class GenerationRun:
    """What one run did. ``outcomes`` has a row for each chunk that was offered: line_number,
    chunk_id, outcome, n_pairs (parsed), n_kept (written)."""

    outcomes: DataFrame
    metrics: DataFrame


def with_scored_pairs(df: DataFrame, pairs_col: str, scorer, threshold: float, native: bool, out_col: str = "kept_pairs") -> DataFrame:
    """Adds ``out_col``: the pairs whose score reaches ``threshold``, with ``reward_score``.

    ``native`` scorers map two Columns to a Column. Others are called on the executors with
    the questions and answers of a batch of rows; if a call raises, its rows are scored one
    by one, and a row whose own call raises keeps all its pairs without a score."""
    if native:
        p = F.transform(
            pairs_col, lambda x: F.struct(x["question"].alias("question"), x["answer"].alias("answer"), scorer(x["question"], x["answer"]).cast("double").alias("reward_score"))
        )
        scored = df.withColumn("_scored", p)
        return scored.withColumn(out_col, F.filter("_scored", lambda x: x["reward_score"] >= F.lit(threshold))).drop("_scored")

    def scores(rows: list) -> list[float]:
        got = [float(x) for x in scorer([p["question"] for r in rows for p in r], [p["answer"] for r in rows for p in r])]
        if len(got) != sum(map(len, rows)):
            raise ValueError("scorer returned a different number of scores")
        return got

    def run(batches):
        for pdf in batches:
            rows = [[] if r is None else list(r) for r in pdf[pairs_col]]
            try:
                flat: list = scores(rows) if any(rows) else []
            except Exception:
                flat = []
                for r in rows:
                    try:
                        flat += scores([r]) if r else []
                    except Exception:
                        flat += [None] * len(r)
            out, at = [], 0
            for r in rows:
                mine = flat[at : at + len(r)]
                at += len(r)
                out.append([{"question": p["question"], "answer": p["answer"], "reward_score": s} for p, s in zip(r, mine, strict=True) if s is None or s >= threshold])
            pdf = pdf.copy()
            pdf[out_col] = pd.Series(out, index=pdf.index, dtype="object")
            yield pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, `{out_col}` {SCORED_PAIRS}")


def call_in_order(df: DataFrame, model_fn: synth.ModelFn, order_col: str, prompt_col: str = "prompt") -> DataFrame:
    """One caller that sends the rows in ``order_col`` order and stops at the first rate
    limit; the rows after it have status ``not_sent``."""
    keys = [c for c in df.columns if c != prompt_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)

    def call(batches):
        stopped = False
        for pdf in batches:
            statuses, responses = [], []
            for p in pdf[prompt_col]:
                status, response = (synth.STATUS_NOT_SENT, None) if stopped else synth.call_once(model_fn, p)
                stopped = stopped or status == synth.STATUS_RATE_LIMITED
                statuses.append(status)
                responses.append(response)
            out = pdf[keys].copy()
            out["status"] = pd.Series(statuses, dtype="object", index=out.index)
            out["response"] = pd.Series(responses, dtype="object", index=out.index)
            yield out

    ordered = df.select(*keys, prompt_col).repartition(1).sortWithinPartitions(order_col)
    return ordered.mapInPandas(call, f"{schema}, status string, response string")


def generate_instructions(
    spark: SparkSession,
    chunks: DataFrame,
    output_dir: str,
    work_dir: str,
    model_fn: synth.ModelFn,
    language: str = "arabic",
    pairs_per_chunk: int = 3,
    parallelism: int = 1,
    scorer: Scorer | None = None,
    native_scorer: bool = False,
    threshold: float = 0.5,
) -> GenerationRun:
    """Run once over ``chunks`` (line_number, text, source_document, chunk_id) and append to
    ``output_dir``. Raw responses and scored pairs are kept under ``work_dir`` (with the first
    ``synth.PREVIEW`` characters of their texts), a folder of this run's own, so that neither is made twice, whatever is lost or asked again."""
    base = f"{work_dir.rstrip('/')}/run-{uuid.uuid4().hex}"
    offered = chunks.select("line_number", "text", F.col("source_document").cast("string").alias("source_document"), "chunk_id")
    n_skipped = 0
    if path_exists(spark, output_dir):
        done = read_processed_ids(spark, output_dir)
        n_skipped = count_skipped(offered, done).first()[0]  # before this run's rows are there
        offered = resume_pending(offered, done)
    # Callers get the texts; the prompts, which hold them again, are built where they are sent.
    offered = offered.repartition(parallelism) if parallelism > 1 else offered
    prompts = offered.withColumn("prompt", synth.build_prompt(language, pairs_per_chunk, F.col("text")))
    prompts = prompts.withColumn("prompt", F.when(F.col("text") != "", F.col("prompt")))
    # After the call only the preview is asked for.
    prompts = prompts.withColumn("text", F.left("text", F.lit(synth.PREVIEW)))
    if parallelism > 1:
        called = synth.map_completions(prompts, model_fn, "prompt")
    else:
        called = call_in_order(prompts, model_fn, "line_number")
    raw = synth.stored_completions(called, f"{base}/responses")
    parsed = synth.with_pairs(raw.where(F.col("status") != synth.STATUS_NOT_SENT), "response", "qa_pairs")
    if scorer is None:
        unscored = F.transform("qa_pairs", lambda x: F.struct(x["question"].alias("question"), x["answer"].alias("answer"), F.lit(None).cast("double").alias("reward_score")))
        scored = parsed.withColumn("kept_pairs", unscored)
    else:
        scored = with_scored_pairs(parsed, "qa_pairs", scorer, threshold, native_scorer)
    path = f"{base}/pairs"
    scored = scored.drop("response")  # stored already
    scored.write.option("compression", "zstd").parquet(path)
    scored = spark.read.schema(scored.schema).parquet(path)
    append_jsonl(synth.to_instruction_rows(scored, "kept_pairs", score_col="reward_score").drop("pair_no"), output_dir)
    outcome = synth.classify_call_result(F.col("text"), F.col("status"), F.col("qa_pairs"))
    n_kept = F.coalesce(F.size("kept_pairs"), F.lit(0))
    outcomes = scored.select(
        "line_number", "chunk_id", F.when((outcome == synth.STATUS_OK) & (n_kept == 0), F.lit(synth.STATUS_BELOW_THRESHOLD)).otherwise(outcome).alias("outcome"),
        F.coalesce(F.size("qa_pairs"), F.lit(0)).alias("n_pairs"), n_kept.alias("n_kept"),
    )
    metrics = synth.generation_metrics(outcomes, "outcome", "n_kept")
    return GenerationRun(outcomes, metrics.withColumn("skipped_lines", F.lit(n_skipped).cast("long")))


def filter_instruction_file(
    spark: SparkSession, input_path: str, output_path: str, scorer: Scorer, threshold: float = 0.5, native_scorer: bool = False, schema: str = OUTPUT_SCHEMA
) -> DataFrame:
    """Score the instruction rows of JSON lines by (instruction, output) and write those that
    reach ``threshold`` with their ``reward_score``; the rows written. Lines that are no JSON
    object go, and rows whose scoring fails; a missing instruction or output is empty."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(input_path)
    asked = rows.select("*", F.coalesce("instruction", F.lit("")).alias("_q"), F.coalesce("output", F.lit("")).alias("_a"))
    score = scorer(F.col("_q"), F.col("_a")) if native_scorer else (lambda questions, answers, contexts: scorer(questions, answers))
    scored = score_pairs(asked, score, "_q", "_a", out_col="_score").where(~F.col("eval_failed"))
    kept = filter_by_reward(scored.drop("reward_score"), "_score", threshold)
    columns = [*[c for c in rows.columns if c != "reward_score"], "reward_score"]
    write_jsonl(kept.select(columns), output_path)
    return spark.read.schema(kept.select(columns).schema).json(output_path)
