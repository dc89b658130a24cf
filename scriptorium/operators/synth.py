"""Synthetic question/answer generation around a user-supplied model function.

The Spark work: prompt and request building (expressions), the model call
(``mapInPandas`` over Arrow batches, one call per row inside the user's function, errors
isolated per row), response parsing (``functions.qa_parse``), explode to instruction
rows, run counters. In tests the call is replaced by a join to recorded responses.
"""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import qa_parse as Q
from ..sources.sinks import append_jsonl

# Prompt templates by language; the first {} is the number of pairs, the second the text.
PROMPT_TEMPLATES = {
    "arabic": """استنادًا إلى النص العربي التالي، قم بإنشاء {} أسئلة ثاقبة مع إجاباتها المقابلة.
    يجب أن تكون الأسئلة والإجابات باللغة العربية.
    تأكد من أن الإجابات مستمدة مباشرة من النص المقدم.
    يجب أن يكون الناتج قائمة JSON تحتوي على كائنات، كل كائن بالصيغة التالية:

    النص:
    {}

    يجب أن يكون الناتج قائمة JSON تحتوي على كائنات، كل كائن بالصيغة التالية:
    [
      {{"question": "السؤال الأول هنا", "answer": "الإجابة الأولى هنا"}},
      {{"question": "السؤال الثاني هنا", "answer": "الإجابة الثانية هنا"}}
      // ... وهكذا
    ]
""",
    "english": """Based on the following English text, create {} insightful questions with their corresponding answers.
    The questions and answers should be in English.
    Ensure that the answers are derived directly from the provided text.

    Text:
    {}

    The output should be a JSON list containing objects, each in the following format:
    [
      {{"question": "First question here", "answer": "First answer here"}},
      {{"question": "Second question here", "answer": "Second answer here"}}
      // ... and so on
    ]
""",
    "turkish": """Aşağıdaki Türkçe metne dayanarak, {} içgörücü sorular ve karşılık gelen cevaplarını oluşturun.
    Sorular ve cevaplar Türkçe olmalıdır.
    Cevapların, sağlanan metinden doğrudan türetildiğinden emin olun.

    Metin:
    {}

    Çıktı, aşağıdaki formatta nesneler içeren bir JSON listesi olmalıdır:
    [
      {{"question": "İlk soru burada", "answer": "İlk cevap burada"}},
      {{"question": "İkinci soru burada", "answer": "İkinci cevap burada"}}
      // ... ve devamı
    ]
""",
}

STATUS_OK = "ok"
STATUS_NO_PAIRS = "no_pairs"
STATUS_RATE_LIMITED = "rate_limited"
STATUS_MISSING_TEXT = "missing_text"
STATUS_ERROR = "error"
STATUS_NOT_SENT = "not_sent"
STATUS_BELOW_THRESHOLD = "below_threshold"


def _template_parts(tpl: str) -> list[str]:
    """Literal pieces around the two positional fields (escaped braces resolved)."""
    pieces, cur = [], ""
    for literal, field, _spec, _conv in Formatter().parse(tpl):
        cur += literal
        if field is not None:
            pieces.append(cur)
            cur = ""
    pieces.append(cur)
    return pieces


def build_prompt(language: Column | str, n_pairs: Column | int, text: Column | str) -> Column:
    """Prompt text for the row's language (a plain string is the language itself, a Column
    holds one per row); an unsupported language raises an error."""
    lang = F.lit(language) if isinstance(language, str) else language
    n = F.lit(n_pairs) if isinstance(n_pairs, int) else n_pairs
    t = F.col(text) if isinstance(text, str) else text
    out = None
    for name, tpl in PROMPT_TEMPLATES.items():
        a, b, c = _template_parts(tpl)
        filled = F.concat(F.lit(a), n.cast("string"), F.lit(b), t, F.lit(c))
        out = F.when(lang == name, filled) if out is None else out.when(lang == name, filled)
    return out.otherwise(
        F.raise_error(F.lit("no prompt template for this language (known: " + ", ".join(PROMPT_TEMPLATES) + ")")).cast("string")
    )


def build_request(model: str, prompt: Column) -> Column:
    """Single-user-message chat request as JSON text ``{model, messages}``."""
    msg = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.array(msg).alias("messages")))


ModelFn = Callable[[str], str]
CALLS_TOGETHER = 64


def call_once(model_fn: ModelFn, prompt: str | None) -> tuple[str, str | None]:
    """(status, response) of one call; what it raises is told by the status."""
    if not prompt:
        return STATUS_MISSING_TEXT, None
    try:
        return STATUS_OK, model_fn(prompt)
    except Exception as e:
        return STATUS_RATE_LIMITED if "RateLimit" in type(e).__name__ else STATUS_ERROR, None


def map_completions(
    df: DataFrame,
    model_fn: ModelFn,
    prompt_col: str = "prompt",
    parallelism: int | None = None,
    key_cols: list[str] | None = None,
) -> DataFrame:
    """Call ``model_fn(prompt) -> response text`` once per row on the executors.

    Output: key columns + ``status`` (ok / rate_limited / error) + ``response``. An
    exception whose class name contains ``RateLimit`` marks the row rate-limited; any
    other exception marks it as an error; neither stops the other rows. Rows without a
    prompt are not sent (missing_text). Responses leave the task every ``CALLS_TOGETHER``
    calls. Each evaluation of the result calls the model again: write it once and read it
    for all that follows (``stored_completions``).
    ``parallelism`` caps the number of concurrent callers (partitions)."""
    keys = key_cols or [c for c in df.columns if c != prompt_col]
    src = df.select(*keys, prompt_col)
    if parallelism:
        src = src.repartition(parallelism)
    schema_keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name in keys)
    schema = f"{schema_keys}, status string, response string"

    def call(batches):
        for whole, at in ((b, i) for b in batches for i in range(0, len(b), CALLS_TOGETHER)):
            pdf = whole.iloc[at : at + CALLS_TOGETHER].reset_index(drop=True)
            results = [call_once(model_fn, p) for p in pdf[prompt_col]]  # an error is its row's alone
            statuses, responses = [x for x, _ in results], [x for _, x in results]
            out = pdf[keys].copy()
            out["status"] = pd.Series(statuses, dtype="object")
            out["response"] = pd.Series(responses, dtype="object")
            yield out

    return src.mapInPandas(call, schema)


def stored_completions(df: DataFrame, path: str) -> DataFrame:
    """Write raw responses as compressed JSON lines before anything is parsed, and read them
    back: a later failure, or a second use, never calls the model again."""
    append_jsonl(df, path, compressed=True)
    return df.sparkSession.read.schema(df.schema).json(path)


def recorded_completions(df: DataFrame, recorded: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Test mode: responses come from a recorded table ``(key, status, response)``."""
    # Rows without a key never match; a NUL-prefixed row hash keeps them from sharing
    # one null join key (and one shuffle partition).
    spread = F.concat(F.lit("\u0000"), F.xxhash64(*[F.col(c) for c in df.columns]).cast("string"))
    left = df.withColumn("_k", F.coalesce(F.col(key).cast("string"), spread))
    right = recorded.withColumn("_k", F.col(key).cast("string")).drop(key)
    return left.join(right, on="_k", how="left").drop("_k")


def with_pairs(df: DataFrame, response_col: str = "response", out_col: str = "qa_pairs") -> DataFrame:
    """Parse responses to ``ARRAY<STRUCT<question, answer>>`` (cleaned text materialised
    once per row before the JSON test and the parse)."""
    staged = df.withColumn("_clean", Q.clean_response(F.col(response_col)))
    pairs = (
        F.when(F.col(response_col).isNull(), F.array().cast(Q.PAIR_TYPE))
        .when(Q.json_is_valid(F.col("_clean")), Q.parse_qa_json(F.col("_clean")))
        .otherwise(Q.extract_qa_regex(F.col(response_col)))
    )
    return staged.withColumn(out_col, pairs).drop("_clean")


def classify_call_result(text: Column, status: Column, pairs: Column) -> Column:
    """Outcome per chunk: missing_text / rate_limited / error / no_pairs / ok."""
    return (
        F.when(text.isNull() | (text == ""), F.lit(STATUS_MISSING_TEXT))
        .when(status == STATUS_RATE_LIMITED, F.lit(STATUS_RATE_LIMITED))
        .when(status.isNull() | (status != STATUS_OK), F.lit(STATUS_ERROR))
        .when(F.coalesce(F.size(pairs), F.lit(0)) == 0, F.lit(STATUS_NO_PAIRS))
        .otherwise(F.lit(STATUS_OK))
    )


PREVIEW = 200


def preview(text: Column, n: int = PREVIEW) -> Column:
    """First ``n`` characters followed by ``...`` (always appended)."""
    return F.concat(F.left(F.coalesce(text, F.lit("")), F.lit(n)), F.lit("..."))


def to_instruction_rows(
    df: DataFrame,
    pairs_col: str = "qa_pairs",
    text_col: str = "text",
    source_col: str = "source_document",
    chunk_col: str = "chunk_id",
    score_col: str | None = None,
) -> DataFrame:
    """One instruction row per pair, with nested provenance and an optional score."""
    cols = [F.col(source_col).cast("string").alias("_src"), F.col(chunk_col).alias("_cid"), F.col(text_col).alias("_txt")]
    exploded = df.select(*cols, F.posexplode_outer(pairs_col).alias("pair_no", "_p")).where(F.col("_p").isNotNull())
    info = F.struct(
        F.col("_src").alias("original_source"),
        F.col("_cid").alias("original_chunk_id"),
        preview(F.col("_txt")).alias("original_text_preview"),
    )
    score = F.col("_p").getField(score_col) if score_col else F.lit(None).cast("double")
    return exploded.select(
        F.col("_p.question").alias("instruction"),
        F.lit("").alias("input"),
        F.col("_p.answer").alias("output"),
        info.alias("source_document_info"),
        score.cast("double").alias("reward_score"),
    )


def generation_metrics(outcomes: DataFrame, status_col: str = "outcome", pairs_col: str = "n_pairs") -> DataFrame:
    """processed = chunks with at least one written pair; generated = pairs written."""
    return outcomes.agg(
        F.count_if(F.col(status_col) == STATUS_OK).alias("processed_lines"),
        F.count_if(F.col(status_col) != STATUS_OK).alias("not_written_lines"),
        F.coalesce(F.sum(F.when(F.col(status_col) == STATUS_OK, F.col(pairs_col))), F.lit(0)).cast("long").alias(
            "generated_pairs"
        ),
    )


def stop_at_first_failure(df: DataFrame, order_col: str = "line_number", status_col: str = "status") -> DataFrame:
    """Sequential-mode semantics: keep rows before the first rate-limited one (in order).
    The first failure is one global min, applied as a scalar subquery filter."""
    first = df.where(F.col(status_col) == STATUS_RATE_LIMITED).agg(F.min(order_col))
    return df.where(F.coalesce(F.col(order_col) < first.scalar(), F.lit(True)))
