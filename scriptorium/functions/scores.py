"""Reward-model response parsing, per backend, as native expressions over recorded
responses (``http_status``, ``body``); the HTTP calls themselves stay in user code.

Backends: ``huggingface`` (list body, first element's score), ``vllm`` (probe of common
score shapes, then a 0..1 number anywhere in the body; clamped; attempts over retries
and endpoints), ``openai`` (reply text as a number; clamped) and ``local`` (softmax of
classifier logits). Unknown backends score 0.5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

NUMERIC_TYPE = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL|BOOLEAN)"
# A 0..1 number in free text (the last-resort score pattern).
SCORE_IN_TEXT = r"\b(0(?:\.\d+)?|1(?:\.0+)?)\b"
# Python float() literals: digit groups may be joined by single underscores.
_DIGITS = r"\d(?:_?\d)*"
FLOAT_TEXT = (
    r"(?i)^[+-]?(?:(?:" + _DIGITS + r")?\." + _DIGITS + "|" + _DIGITS + r"\.?)(?:e[+-]?" + _DIGITS + r")?$"
    r"|(?i)^[+-]?(?:nan|inf|infinity)$"
)
NEUTRAL = 0.5


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clamp01(x: Column) -> Column:
    """``max(0, min(1, x))`` with Python's NaN behaviour (NaN -> 1.0)."""
    return F.when(F.isnan(x), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def _num(v: Column, path: str) -> Column:
    """JSON number (or boolean, as Python treats bool as int) at ``path``, else null."""
    x = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(x).rlike(NUMERIC_TYPE), F.try_variant_get(x, "$", "double"))


def py_float(text: Column) -> Column:
    """``float(text.strip())`` or null when Python would raise."""
    s = T.py_strip(text)
    return F.when(s.rlike(FLOAT_TEXT), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))


def _is_dict(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT<"), F.lit(False))


def vllm_parse(body: Column, parsed: Column | None = None, parts: dict | None = None) -> Column:
    """Score from one response body (null when nothing usable), shapes in order:
    data[0].score, score, scores[0], scores[0].score, predictions[0],
    predictions[0].score, predictions[0].probability, then choices[0]: its ``text`` if
    truthy, else ``message.content``, read as number text; then a 0..1 number in the raw
    body. A first choice that is not an object (or a truthy ``message`` that is not one)
    makes the whole body unusable, as the attribute lookup fails there."""
    from .qa_parse import variant_truthy

    v = F.try_parse_json(body) if parsed is None else parsed
    early = F.coalesce(
        _num(v, "$.data[0].score"),
        _num(v, "$.score"),
        _num(v, "$.scores[0]"),
        _num(v, "$.scores[0].score"),
        _num(v, "$.predictions[0]"),
        _num(v, "$.predictions[0].score"),
        _num(v, "$.predictions[0].probability"),
    )
    choices = F.try_variant_get(v, "$.choices", "variant")
    has_choice = F.coalesce(
        F.schema_of_variant(choices).startswith("ARRAY<") & (F.size(F.try_variant_get(choices, "$", "array<variant>")) > 0),
        F.lit(False),
    )
    parts = parts or {}
    c0 = parts.get("c0", F.try_variant_get(v, "$.choices[0]", "variant"))
    text = parts.get("text", F.try_variant_get(c0, "$.text", "variant"))
    msg = parts.get("msg", F.try_variant_get(c0, "$.message", "variant"))
    text_truthy = F.coalesce(variant_truthy(text), F.lit(False))
    msg_truthy = F.coalesce(variant_truthy(msg), F.lit(False))
    abort = has_choice & (~_is_dict(c0) | (~text_truthy & msg_truthy & ~_is_dict(msg)))
    picked = F.when(text_truthy, text).otherwise(F.try_variant_get(msg, "$.content", "variant"))
    choice_score = F.when(
        has_choice & (F.schema_of_variant(picked) == "STRING"), py_float(F.try_variant_get(picked, "$", "string"))
    )
    in_text = F.when(body.rlike(SCORE_IN_TEXT), F.regexp_extract(body, SCORE_IN_TEXT, 1).cast("double"))
    return (
        F.when(v.isNull(), F.lit(None).cast("double"))
        .when(~_is_dict(v), in_text)
        .when(early.isNotNull(), early)
        .when(abort, F.lit(None).cast("double"))
        .otherwise(F.coalesce(choice_score, in_text))
    )


def vllm_attempt(
    http_status: Column | str, body: Column | str, parsed: Column | None = None, parts: dict | None = None
) -> Column:
    """One attempt -> STRUCT<decided BOOLEAN, score DOUBLE>. An ``error`` field in a 2xx
    body decides 0.0; a parsable score decides its clamped value; anything else (request
    error, unparsable body, no score) leaves the attempt undecided. Pass ``parsed`` (the
    body already parsed to a VARIANT column, see ``with_vllm_attempt``) to parse once."""
    st, b = _c(http_status), _c(body)
    v = F.try_parse_json(b) if parsed is None else parsed
    err = _is_dict(v) & F.coalesce(
        F.when(
            F.try_variant_get(v, "$.error", "variant").isNotNull(),
            _truthy_json(F.try_variant_get(v, "$.error", "variant")),
        ),
        F.lit(False),
    )
    value = vllm_parse(b, v, parts)
    ok = st.isNotNull() & (st < 400)
    score = F.when(ok & err, F.lit(0.0)).when(st.isNotNull() & value.isNotNull(), clamp01(value))
    return F.struct(score.isNotNull().alias("decided"), score.alias("score"))


def _truthy_json(x: Column) -> Column:
    from .qa_parse import variant_truthy

    return variant_truthy(x)


def with_vllm_attempt(df: DataFrame, status_col: str, body_col: str, out_col: str = "attempt") -> DataFrame:
    """Adds ``out_col`` = ``vllm_attempt`` with the body parsed once into a VARIANT column
    and the first choice's parts extracted into their own columns first (one parse per
    row, and expressions small enough for whole-stage code generation)."""
    from ..session import ensure_parallelism

    staged = (
        ensure_parallelism(df)
        .withColumn("_v", F.try_parse_json(F.col(body_col)))
        .withColumn("_c0", F.try_variant_get(F.col("_v"), "$.choices[0]", "variant"))
        .withColumn("_text", F.try_variant_get(F.col("_c0"), "$.text", "variant"))
        .withColumn("_msg", F.try_variant_get(F.col("_c0"), "$.message", "variant"))
    )
    parts = {"c0": F.col("_c0"), "text": F.col("_text"), "msg": F.col("_msg")}
    att = vllm_attempt(F.col(status_col), F.col(body_col), F.col("_v"), parts)
    return staged.withColumn(out_col, att).drop("_v", "_c0", "_text", "_msg")


def take_first_usable_attempt(
    attempts: DataFrame, key: str = "pair_id", order: tuple[str, ...] = ("retry", "endpoint"), default: float = 0.0
) -> DataFrame:
    """Per key, the score of the first decided attempt in ``order`` (``default`` when all
    attempts are undecided). One aggregation with map-side partial ``min_by``."""
    a = with_vllm_attempt(attempts, "http_status", "body", "_att")
    # A single ordering column keeps the aggregation buffer fixed-width (hash aggregate);
    # several columns need a struct ordering (sort-based aggregate).
    ordering = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])
    ordkey = F.when(F.col("_att.decided"), ordering)
    g = a.groupBy(key).agg(F.min_by(F.col("_att.score"), ordkey).alias("_s"))
    return g.select(key, F.coalesce(F.col("_s"), F.lit(default)).alias("score"))


def score_response_hf(http_status: Column | str, body: Column | str) -> Column:
    """List body: first element's ``score`` (0.5 when absent, not clamped); other bodies
    0.5; HTTP error, timeout (null status) or an unusable score value 0.0."""
    st, b = _c(http_status), _c(body)
    v = F.try_parse_json(b)
    t = F.schema_of_variant(v)
    first = F.try_variant_get(v, "$[0]", "variant")
    has_list = t.startswith("ARRAY<") & (F.size(F.try_variant_get(v, "$", "array<variant>")) > 0)
    sv = F.try_variant_get(first, "$.score", "variant")
    st_type = F.schema_of_variant(sv)
    first_is_obj = F.coalesce(F.schema_of_variant(first).startswith("OBJECT<"), F.lit(False))
    keys = F.json_object_keys(F.to_json(first))
    score_present = F.coalesce(F.array_contains(keys, "score"), F.lit(False))
    from_first = (
        F.when(~first_is_obj, F.lit(0.0))
        .when(~score_present, F.lit(NEUTRAL))
        .when(st_type.rlike(NUMERIC_TYPE), F.try_variant_get(sv, "$", "double"))
        .when(st_type == "STRING", F.coalesce(py_float(F.try_variant_get(sv, "$", "string")), F.lit(0.0)))
        .otherwise(F.lit(0.0))
    )
    return (
        F.when(st.isNull() | (st >= 400), F.lit(0.0))
        .when(v.isNull(), F.lit(0.0))
        .when(F.coalesce(has_list, F.lit(False)), from_first)
        .otherwise(F.lit(NEUTRAL))
    )


def score_response_openai(http_status: Column | str, content: Column | str, has_choice: Column | None = None) -> Column:
    """Reply text -> clamped float; no choice, empty or unparsable text 0.5; a failed
    call (null/error status) 0.0."""
    st, c = _c(http_status), _c(content)
    hc = has_choice if has_choice is not None else c.isNotNull()
    f = py_float(c)
    return (
        F.when(st.isNull() | (st >= 400), F.lit(0.0))
        .when(~hc, F.lit(NEUTRAL))
        .when(c.isNull(), F.lit(0.0))  # a choice without content text fails the call
        .when(f.isNull(), F.lit(NEUTRAL))
        .otherwise(clamp01(f))
    )


def score_softmax(logits: Column | str, label: int = 1) -> Column:
    """``exp(l[label]) / sum(exp(l))`` computed stably (max subtracted first)."""
    x = F.transform(_c(logits), lambda e: e.cast("double"))
    m = F.array_max(x)
    denom = F.aggregate(x, F.lit(0.0), lambda acc, e: acc + F.exp(e - m))
    return F.exp(F.get(x, label) - m) / denom


def score_dispatch(api_type: Column | str, scores: dict[str, Column], configured: Column | None = None) -> Column:
    """Pick the backend's score by ``api_type`` (lower-cased); unknown -> 0.5. When
    ``configured`` is false (no API key for the hosted backend, no endpoint for vllm),
    the neutral 0.5 is used without looking at any response."""
    t = F.lower(_c(api_type))
    out = None
    for name, col in scores.items():
        out = F.when(t == name, col) if out is None else out.when(t == name, col)
    picked = F.lit(NEUTRAL) if out is None else out.otherwise(F.lit(NEUTRAL))
    if configured is None:
        return picked
    return F.when(F.coalesce(configured, F.lit(False)), picked).otherwise(F.lit(NEUTRAL))


# Reward-model configuration per language (multilingual is the fallback).
REWARD_MODEL_CONFIGS = [
    ("arabic", "Arabic Reward Model", "nvidia/llama-embed-nemotron-8b", "huggingface",
     "Best reward model for Arabic language with multilingual support"),
    ("english", "English Reward Model", "nvidia/llama-embed-nemotron-8b", "huggingface",
     "Best reward model for English language"),
    ("multilingual", "Multilingual Reward Model", "nvidia/llama-embed-nemotron-8b", "huggingface",
     "Supports both Arabic and English"),
]
CONFIG_SCHEMA = "language string, model_name string, model_id string, api_type string, description string"


def resolve_reward_config(df: DataFrame, language_col: str = "language", api_endpoint: str | None = None, api_key: str | None = None) -> DataFrame:
    """Attach the config of the row's lower-cased language, ``multilingual`` when
    unknown, all seven fields. The config table has three rows (a fixed bound), so it is
    broadcast. ``api_key`` is a reference to a key (the name of a secret), never the key."""
    spark = df.sparkSession
    cfg = spark.createDataFrame(REWARD_MODEL_CONFIGS, CONFIG_SCHEMA)
    fallback = [r for r in REWARD_MODEL_CONFIGS if r[0] == "multilingual"][0]
    keyed = df.withColumn("_lang", F.lower(F.col(language_col)))
    j = keyed.join(F.broadcast(cfg.withColumnRenamed("language", "_lang")), on="_lang", how="left")
    out = j
    # fallback tuple layout: language, model_name, model_id, api_type, description
    out = (
        out.withColumn("cfg_model_name", F.coalesce(F.col("model_name"), F.lit(fallback[1])))
        .withColumn("cfg_model_id", F.coalesce(F.col("model_id"), F.lit(fallback[2])))
        .withColumn("cfg_api_type", F.coalesce(F.col("api_type"), F.lit(fallback[3])))
        .withColumn("cfg_description", F.coalesce(F.col("description"), F.lit(fallback[4])))
        .withColumn("cfg_language", F.when(F.col("model_name").isNotNull(), F.col("_lang")).otherwise(F.lit(fallback[0])))
        .withColumn("cfg_api_endpoint", F.lit(api_endpoint).cast("string"))
        .withColumn("cfg_api_key", F.lit(api_key).cast("string"))
    )
    return out.drop("_lang", "model_name", "model_id", "api_type", "description")


def build_score_request(api_type: Column | str, question: Column, answer: Column, model_id: Column | str) -> Column:
    """Backend payload as JSON text: huggingface ``{inputs: "q a"}``, vllm
    ``{model, text_1: [q], text_2: [a]}``, openai a rating prompt."""
    t = F.lower(_c(api_type))
    mid = F.lit(model_id) if isinstance(model_id, str) else model_id
    hf = F.to_json(F.struct(F.concat_ws(" ", question, answer).alias("inputs")))
    vllm = F.to_json(F.struct(mid.alias("model"), F.array(question).alias("text_1"), F.array(answer).alias("text_2")))
    # The rating prompt; the question and the answer stand between its parts.
    prompt = F.concat(
        F.lit("Rate the quality of this answer on a scale of 0 to 1.\n\nQuestion: "),
        question,
        F.lit("\n\nAnswer: "),
        answer,
        F.lit("\n\nProvide only a number between 0 and 1 as your response."),
    )
    openai = F.to_json(
        F.struct(
            mid.alias("model"),
            F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("messages"),
        )
    )
    return F.when(t == "huggingface", hf).when(t == "vllm", vllm).when(t == "openai", openai)


def filter_by_reward(df: DataFrame, score_col: str, threshold: float) -> DataFrame:
    """Keep rows with ``score >= threshold`` (inclusive) and record ``reward_score``."""
    return df.where(F.col(score_col) >= F.lit(threshold)).withColumn("reward_score", F.col(score_col).cast("double"))


def reward_filter_or_passthrough(df: DataFrame, score_col: str, failed_col: str, threshold: float) -> DataFrame:
    """Evaluator failure keeps the pairs unfiltered and without a score."""
    kept = df.where(F.col(failed_col) | (F.col(score_col) >= F.lit(threshold)))
    return kept.withColumn(
        "reward_score", F.when(F.col(failed_col), F.lit(None).cast("double")).otherwise(F.col(score_col).cast("double"))
    )


def reward_summary(df: DataFrame, score_col: str, threshold: float) -> DataFrame:
    """Evaluated and kept counts and the score range, as one global aggregate."""
    s = F.col(score_col)
    return df.agg(
        F.count(F.lit(1)).alias("evaluated"),
        F.count_if(s >= F.lit(threshold)).alias("kept"),
        F.avg(s).alias("avg_score"),
        F.min(s).alias("min_score"),
        F.max(s).alias("max_score"),
    )


def score_pairs(
    df: DataFrame,
    scorer,
    question_col: str = "question",
    answer_col: str = "answer",
    context_col: str | None = None,
    out_col: str = "score",
) -> DataFrame:
    """Score every pair, keeping rows and their order.

    ``scorer`` is either a Column (an expression scorer, e.g. ``rewards.reward_composite``)
    or a Python callable ``fn(questions, answers, contexts) -> list[float]`` that is
    called once per Arrow batch on the executors (a reward-model client). When a call
    raises, its pairs are scored one by one, so that a pair fails by itself, however rows
    are batched or partitioned: such a pair scores 0.0 with ``eval_failed`` true."""
    if isinstance(scorer, Column):
        return df.withColumn(out_col, scorer.cast("double")).withColumn("eval_failed", F.lit(False))

    import pandas as pd

    fields = df.schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    schema += f", `{out_col}` double, eval_failed boolean"

    def called(qs, ans, ctx) -> list[float]:
        scores = [float(x) for x in scorer(qs, ans, ctx)]
        if len(scores) != len(qs):
            raise ValueError("scorer returned a different number of scores")
        return scores

    def run(batches):
        for pdf in batches:
            qs = pdf[question_col].tolist()
            ans = pdf[answer_col].tolist()
            ctx = pdf[context_col].tolist() if context_col else [None] * len(pdf)
            try:
                scores, failed = called(qs, ans, ctx), [False] * len(pdf)
            except Exception:
                scores, failed = [], []
                for one in zip(qs, ans, ctx, strict=True):
                    try:
                        scores += called(*([x] for x in one))
                        failed.append(False)
                    except Exception:
                        scores.append(0.0)
                        failed.append(True)
            out = pdf.copy()
            out[out_col] = pd.Series(scores, dtype="float64", index=pdf.index)
            out["eval_failed"] = failed
            yield out

    return df.mapInPandas(run, schema)
