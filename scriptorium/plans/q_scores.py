"""Queries for reward-model response parsing and reward filtering.

Recorded response bodies are derived from ``events``: a number ``s`` in [0, 2) with four
decimals comes from the event's value (``floor(value*100) % 20000 / 10000``) and the body
shape rotates with ``event_id % 8``. The oracle computes the expected score from ``s``
and the shape directly, without parsing any body.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rewards as R
from ..functions import scores as SC
from . import sqlfrag as S
from .registry import register, table
from .sqlfrag import D

THRESHOLD = 0.55


def _s_text():
    r = F.floor(F.col("value") * 100).cast("long") % 20000
    return F.concat((r / 10000).cast("long").cast("string"), F.lit("."), F.lpad((r % 10000).cast("string"), 4, "0"))


S_SQL = "(CAST(CAST(floor(value * 100) AS BIGINT) % 20000 AS DOUBLE) / " + D(10000.0) + ")"
CLAMP_S = f"least({D(1.0)}, greatest({D(0.0)}, {S_SQL}))"


def _vllm_bodies(spark, sf_dir, extra=()):
    e = table(spark, sf_dir, "events")
    s = _s_text()
    k = F.col("event_id") % 8
    body = (
        F.when(k == 0, F.concat(F.lit('{"data": [{"score": '), s, F.lit("}]}")))
        .when(k == 1, F.concat(F.lit('{"score": '), s, F.lit("}")))
        .when(k == 2, F.concat(F.lit('{"scores": ['), s, F.lit("]}")))
        .when(k == 3, F.concat(F.lit('{"scores": [{"score": '), s, F.lit("}]}")))
        .when(k == 4, F.concat(F.lit('{"predictions": [{"probability": '), s, F.lit("}]}")))
        .when(k == 5, F.concat(F.lit('{"choices": [{"message": {"content": " '), s, F.lit(' "}}]}')))
        .when(k == 6, F.concat(F.lit('{"msg": "rated '), s, F.lit(' of 10"}')))
        .otherwise(F.lit('{"error": "overloaded"}'))
    )
    status = F.when((k == 2) & (F.col("user_id") % 5 == 0), F.lit(503)).otherwise(F.lit(200))
    return e.select("event_id", "user_id", *extra, status.alias("http_status"), body.alias("body"))


@register(
    "score_response_vllm",
    f"SELECT event_id, CASE WHEN event_id % 8 = 7 THEN {D(0.0)} ELSE {CLAMP_S} END AS score FROM events",
)
def q_score_response_vllm(spark, sf_dir):
    b = SC.with_vllm_attempt(_vllm_bodies(spark, sf_dir), "http_status", "body", "att")
    return b.select("event_id", F.col("att.score").alias("score"))


@register(
    "take_first_usable_attempt",
    f"""SELECT user_id AS pair_id, coalesce(arg_min(sc, event_id) FILTER (WHERE decided), {D(0.0)}) AS score
        FROM (SELECT user_id, event_id,
                     CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 8 = 7 THEN {D(0.0)}
                          WHEN event_id % 8 = 6 THEN NULL ELSE {CLAMP_S} END AS sc,
                     NOT (event_type = 'error' OR event_id % 8 = 6) AS decided
              FROM events)
        GROUP BY user_id""",
)
def q_take_first_usable_attempt(spark, sf_dir):
    # Attempts of one pair = the user's events in event_id order; request errors
    # (no status) for error events; shape 6 carries no number in this variant.
    b = _vllm_bodies(spark, sf_dir, extra=["event_type"])
    k = F.col("event_id") % 8
    body = F.when(k == 6, F.lit('{"msg": "none"}')).otherwise(F.col("body"))
    status = F.when(F.col("event_type") == "error", F.lit(None).cast("int")).otherwise(F.col("http_status"))
    attempts = b.select(
        F.col("user_id").alias("pair_id"), F.col("event_id").alias("attempt"), status.alias("http_status"), body.alias("body")
    )
    return SC.take_first_usable_attempt(attempts, "pair_id", ("attempt",))


@register(
    "score_response_hf",
    f"""SELECT event_id, CASE WHEN user_id % 7 = 0 THEN {D(0.0)}
                         WHEN event_id % 3 = 0 THEN {S_SQL} ELSE {D(0.5)} END AS score FROM events""",
)
def q_score_response_hf(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = _s_text()
    k = F.col("event_id") % 3
    body = (
        F.when(k == 0, F.concat(F.lit('[{"score": '), s, F.lit(', "label": "LABEL_1"}]')))
        .when(k == 1, F.lit('[{"label": "LABEL_0"}]'))
        .otherwise(F.concat(F.lit('{"score": '), s, F.lit("}")))
    )
    status = F.when(F.col("user_id") % 7 == 0, F.lit(503)).otherwise(F.lit(200))
    return e.select("event_id", SC.score_response_hf(status, body).alias("score"))


@register(
    "score_response_openai",
    f"""SELECT event_id, CASE WHEN user_id % 11 = 0 THEN {D(0.0)}
                         WHEN event_id % 4 = 0 THEN {CLAMP_S} ELSE {D(0.5)} END AS score FROM events""",
)
def q_score_response_openai(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = _s_text()
    k = F.col("event_id") % 4
    content = (
        F.when(k == 0, F.concat(F.lit("  "), s, F.lit("\n")))
        .when(k == 1, F.concat(s, F.lit("/1")))
        .when(k == 2, F.lit(""))
        .otherwise(F.lit(None).cast("string"))
    )
    status = F.when(F.col("user_id") % 11 == 0, F.lit(500)).otherwise(F.lit(200))
    return e.select("event_id", SC.score_response_openai(status, content, content.isNotNull()).alias("score"))


SOFTMAX_SQL = """SELECT vec_id, round(exp(x[2] - m) / list_sum(list_transform(x, lambda v: exp(v - m))), 6) AS score
    FROM (SELECT vec_id, x, list_max(x) AS m FROM (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings))"""


@register("score_softmax", SOFTMAX_SQL)
def q_score_softmax(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(SC.score_softmax("embedding"), 6).alias("score"))


@register(
    "score_dispatch",
    f"""SELECT event_id, CASE event_id % 4
          WHEN 0 THEN (CASE WHEN event_id % 8 = 7 THEN {D(0.0)} ELSE {CLAMP_S} END)
          WHEN 1 THEN (CASE WHEN user_id % 5 = 0 AND event_id % 8 = 2 THEN {D(0.0)} ELSE {D(0.5)} END)
          WHEN 2 THEN (CASE WHEN user_id % 5 = 0 AND event_id % 8 = 2 THEN {D(0.0)} ELSE {D(0.5)} END)
          ELSE {D(0.5)} END AS score FROM events""",
)
def q_score_dispatch(spark, sf_dir):
    b = SC.with_vllm_attempt(_vllm_bodies(spark, sf_dir), "http_status", "body", "att")
    api = F.element_at(F.array(F.lit("VLLM"), F.lit("huggingface"), F.lit("openai"), F.lit("other")), (F.col("event_id") % 4 + 1).cast("int"))
    scores = {
        "vllm": F.col("att.score"),
        "huggingface": SC.score_response_hf(F.col("http_status"), F.col("body")),
        "openai": SC.score_response_openai(F.col("http_status"), F.lit("not a number")),
    }
    return b.select("event_id", SC.score_dispatch(api, scores).alias("score"))


def _scored_pairs(spark, sf_dir):
    """Pairs scored by the composite rule-based reward (question = instruction)."""
    from ..operators.reshape import pair_turns

    p = pair_turns(table(spark, sf_dir, "conversations"))
    return p.withColumn("score", R.reward_composite(F.col("output"), question=F.col("instruction"), language="english"))


def _composite_sql_on_output():
    from .q_instruct import _composite_sql

    return _composite_sql().replace("SELECT *, CASE WHEN pair_no % 3 = 0 THEN '<think>' || instruction || '</think><answer>' || output || '</answer>' ELSE output END AS c FROM pairs", "SELECT *, output AS c FROM pairs")


def _filter_sql() -> str:
    base = _composite_sql_on_output()
    head, _, tail = base.partition("SELECT conv_id, pair_no, ")
    return head + "SELECT conv_id, pair_no, score AS reward_score FROM (SELECT conv_id, pair_no, " + tail + f") WHERE score >= {D(THRESHOLD)}"


@register("filter_by_reward", _filter_sql())
def q_filter_by_reward(spark, sf_dir):
    return SC.filter_by_reward(_scored_pairs(spark, sf_dir), "score", THRESHOLD).select("conv_id", "pair_no", "reward_score")


def _passthrough_sql() -> str:
    base = _composite_sql_on_output()
    head, _, tail = base.partition("SELECT conv_id, pair_no, ")
    return (
        head
        + "SELECT conv_id, pair_no, CASE WHEN conv_id % 10 = 0 THEN NULL ELSE score END AS reward_score FROM (SELECT conv_id, pair_no, "
        + tail
        + f") WHERE conv_id % 10 = 0 OR score >= {D(THRESHOLD)}"
    )


@register("reward_filter_or_passthrough", _passthrough_sql())
def q_reward_filter_or_passthrough(spark, sf_dir):
    # Evaluator failure for every tenth conversation: its pairs pass through unscored.
    p = _scored_pairs(spark, sf_dir).withColumn("eval_failed", F.col("conv_id") % 10 == 0)
    return SC.reward_filter_or_passthrough(p, "score", "eval_failed", THRESHOLD).select("conv_id", "pair_no", "reward_score")


def _summary_sql() -> str:
    base = _composite_sql_on_output()
    head, _, tail = base.partition("SELECT conv_id, pair_no, ")
    return (
        head
        + f"""SELECT count(*) AS evaluated, count(*) FILTER (WHERE score >= {D(THRESHOLD)}) AS kept,
           round(avg(score), 9) AS avg_score, min(score) AS min_score, max(score) AS max_score
           FROM (SELECT conv_id, pair_no, """
        + tail
        + ")"
    )


@register("reward_summary", _summary_sql())
def q_reward_summary(spark, sf_dir):
    s = SC.reward_summary(_scored_pairs(spark, sf_dir), "score", THRESHOLD)
    return s.withColumn("avg_score", F.round("avg_score", 9))


@register(
    "filter_instruction_file",
    _filter_sql().replace(
        "SELECT conv_id, pair_no, score AS reward_score FROM", "SELECT instruction, output, score AS reward_score FROM"
    ).replace("SELECT conv_id, pair_no, (", "SELECT instruction, output, ("),
)
def q_filter_instruction_file(spark, sf_dir):
    """The conversation pairs as an instruction file, with a line that is no JSON beside
    every row; scored, filtered, written and read back."""
    from ..operators.generate import filter_instruction_file
    from ..operators.reshape import pair_turns
    from ..sources import sinks as SK
    from .q_io import scratch

    base = scratch(spark, "instructions")
    rows = pair_turns(table(spark, sf_dir, "conversations")).select("instruction", F.lit("").alias("input"), "output")
    SK.write_jsonl(rows, f"{base}/in")
    rows.select(F.concat(F.lit('{"instruction": '), "output").alias("value")).write.mode("append").text(f"{base}/in")
    kept = filter_instruction_file(
        spark, f"{base}/in", f"{base}/out", lambda q, a: R.reward_composite(a, question=q, language="english"), THRESHOLD, native_scorer=True
    )
    return kept.select("instruction", "output", "reward_score")


@register(
    "resolve_reward_config",
    f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Arabic Reward Model' WHEN 1 THEN 'English Reward Model'
             ELSE 'Multilingual Reward Model' END AS cfg_model_name,
            'huggingface' AS cfg_api_type FROM events""",
)
def q_resolve_reward_config(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    lang = F.element_at(
        F.array(F.lit("Arabic"), F.lit("ENGLISH"), F.lit("multilingual"), F.lit("klingon")), (F.col("event_id") % 4 + 1).cast("int")
    )
    r = SC.resolve_reward_config(e.select("event_id", lang.alias("language")), "language")
    return r.select("event_id", "cfg_model_name", "cfg_api_type")


@register(
    "build_score_request",
    f"""WITH {S.PAIRS_CTE}
    SELECT conv_id, pair_no,
           CASE pair_no % 3 WHEN 0 THEN length(instruction || ' ' || output)
                            WHEN 1 THEN length(instruction) + length(output) ELSE length(instruction) END AS payload_len
    FROM pairs""",
)
def q_build_score_request(spark, sf_dir):
    from ..operators.reshape import pair_turns

    p = pair_turns(table(spark, sf_dir, "conversations"))
    api = F.element_at(F.array(F.lit("huggingface"), F.lit("vllm"), F.lit("openai")), (F.col("pair_no") % 3 + 1).cast("int"))
    req = SC.build_score_request(api, F.col("instruction"), F.col("output"), "nvidia/llama-embed-nemotron-8b")
    v = F.parse_json(req)
    n = (
        F.when(F.col("pair_no") % 3 == 0, F.char_length(F.try_variant_get(v, "$.inputs", "string")))
        .when(
            F.col("pair_no") % 3 == 1,
            F.char_length(F.try_variant_get(v, "$.text_1[0]", "string")) + F.char_length(F.try_variant_get(v, "$.text_2[0]", "string")),
        )
        .otherwise(F.char_length(F.regexp_extract(F.try_variant_get(v, "$.messages[0].content", "string"), "(?s)Question: (.*)\n\nAnswer: ", 1)))
    )
    return p.select("conv_id", "pair_no", n.cast("bigint").alias("payload_len"))


def length_scorer(questions, answers, contexts):
    """Stand-in reward-model client for tests and the bench: answer length over 500."""
    return [min(1.0, len(a) / 500.0) for a in answers]


@register(
    "score_pairs",
    f"""WITH {S.PAIRS_CTE}
    SELECT conv_id, pair_no, least({D(1.0)}, CAST(length(output) AS DOUBLE) / {D(500.0)}) AS score, false AS eval_failed FROM pairs""",
)
def q_score_pairs(spark, sf_dir):
    from ..operators.reshape import pair_turns

    p = pair_turns(table(spark, sf_dir, "conversations")).select(
        "conv_id", "pair_no", F.col("instruction").alias("question"), F.col("output").alias("answer")
    )
    return SC.score_pairs(p, length_scorer).select("conv_id", "pair_no", "score", "eval_failed")
