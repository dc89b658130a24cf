"""Queries over ``conversations`` (pairs, rewards, response parsing, GRPO rows, prompts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import qa_parse as Q
from ..functions import rewards as R
from ..functions import text as T
from ..operators import reshape as RS
from ..operators import synth as SY
from . import sqlfrag as S
from .registry import register, table
from .sqlfrag import D, PAIRS_CTE

LANG = "english"


def _pairs(spark, sf_dir):
    return RS.pair_turns(table(spark, sf_dir, "conversations"))


def _with(sql_body: str) -> str:
    return f"WITH {PAIRS_CTE}\n{sql_body}"


@register("pair_turns", _with("SELECT conv_id, pair_no, instruction, output FROM pairs"))
def q_pair_turns(spark, sf_dir):
    return _pairs(spark, sf_dir)


@register(
    "unpaired_turns",
    "SELECT count(*) FILTER (WHERE n % 2 = 1) AS unpaired_turns FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)",
)
def q_unpaired_turns(spark, sf_dir):
    return RS.unpaired_turns(table(spark, sf_dir, "conversations"))


@register(
    "require_text",
    "SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND text <> ''",
)
def q_require_text(spark, sf_dir):
    return RS.require_text(table(spark, sf_dir, "conversations")).select("conv_id", "turn")


@register(
    "render_chat_prompt",
    _with(f"SELECT conv_id, pair_no, {S.q(RS.REASONING_SYSTEM_PROMPT + chr(10) + 'User: ')} || instruction || {S.q(chr(10) + 'Assistant:')} AS prompt FROM pairs"),
)
def q_render_chat_prompt(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.select("conv_id", "pair_no", RS.render_chat_prompt("instruction").alias("prompt"))


# ---- rewards ------------------------------------------------------------------------

FORMAT_CONTENT_SPARK = lambda: F.when(
    F.col("pair_no") % 3 == 0,
    F.concat(F.lit("<think>"), F.col("instruction"), F.lit("</think><answer>"), F.col("output"), F.lit("</answer>")),
).otherwise(F.col("output"))
FORMAT_CONTENT_SQL = "CASE WHEN pair_no % 3 = 0 THEN '<think>' || instruction || '</think><answer>' || output || '</answer>' ELSE output END"


def _reward_sql(expr: str, content: str = "output") -> str:
    return _with(f"SELECT conv_id, pair_no, {expr.replace('{c}', '(' + content + ')')} AS score FROM pairs")


def _completion(content):
    """Completions in the message-list shape; the reward reads the first message's content."""
    return F.array(F.struct(F.lit("assistant").alias("role"), content.alias("content")))


def _sql_format(c="{c}"):
    tags = " AND ".join(f"contains({c}, {S.q(t)})" for t in R.FORMAT_TAGS)
    return f"CASE WHEN {tags} THEN {D(1.0)} ELSE {D(0.0)} END"


def _sql_length(c="{c}", lo=10, hi=500):
    n = f"CAST(length({c}) AS DOUBLE)"
    return (
        f"CASE WHEN {n} >= {lo} AND {n} <= {hi} THEN {D(1.0)} "
        f"WHEN {n} < {lo} THEN greatest({D(0.0)}, {n} / {D(lo)} * {D(0.5)}) "
        f"ELSE greatest({D(0.0)}, {D(1.0)} - ({n} - {D(hi)}) / {D(hi)} * {D(0.5)}) END"
    )


def _sql_wordset(x: str, stop: bool) -> str:
    ws = f"list_transform({S.words('lower(' + x + ')')}, lambda w: {S.strip_punct('w')})"
    cond = "length(w) > 2" + (f" AND NOT list_contains({S.str_list(R.RELEVANCE_STOPWORDS)}, w)" if stop else "")
    return f"list_distinct(list_filter({ws}, lambda w: {cond}))"


def _sql_relevance(c="{c}", question="instruction"):
    qw, cw = _sql_wordset(question, True), _sql_wordset(c, False)
    return (
        f"CASE WHEN len({qw}) > 0 THEN least({D(1.0)}, CAST(len(list_intersect({qw}, {cw})) AS DOUBLE) / CAST(len({qw}) AS DOUBLE)) "
        f"ELSE {D(0.5)} END"
    )


def _sql_language_quality(c="{c}", language=LANG):
    punct = S.str_list(list(R.FINAL_PUNCT))
    script = {"arabic": f"regexp_matches({c}, {S.q(R.ARABIC_CHAR)})", "english": f"regexp_matches({c}, {S.q(R.ASCII_LETTER)})"}.get(
        language, "false"
    )
    s = D(0.5)
    s = f"({s} - CASE WHEN contains({c}, '  ') THEN {D(0.1)} ELSE {D(0.0)} END)"
    s = f"({s} + CASE WHEN length({c}) > 0 AND list_contains({punct}, right({c}, 1)) THEN {D(0.2)} ELSE {D(0.0)} END)"
    s = f"({s} + CASE WHEN len({S.words(c)}) > 3 THEN {D(0.1)} ELSE {D(0.0)} END)"
    s = f"({s} + CASE WHEN {script} THEN {D(0.1)} ELSE {D(0.0)} END)"
    return f"least({D(1.0)}, greatest({D(0.0)}, {s}))"


@register("reward_format", _reward_sql(_sql_format(), FORMAT_CONTENT_SQL))
def q_reward_format(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumn("completion", _completion(FORMAT_CONTENT_SPARK()))
    return p.select("conv_id", "pair_no", R.reward_format(R.first_content("completion")).alias("score"))


ACC_SOLUTION_SQL = "CASE pair_no % 3 WHEN 0 THEN output WHEN 1 THEN lower(output) ELSE instruction END"


@register(
    "reward_accuracy",
    _with(
        f"""SELECT conv_id, pair_no,
        CASE WHEN {S.py_strip('output')} = {S.py_strip(ACC_SOLUTION_SQL)} THEN {D(1.0)}
             WHEN lower({S.py_strip('output')}) = lower({S.py_strip(ACC_SOLUTION_SQL)}) THEN {D(0.8)}
             ELSE {D(0.0)} END AS score FROM pairs"""
    ),
)
def q_reward_accuracy(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    sol = (
        F.when(F.col("pair_no") % 3 == 0, F.col("output"))
        .when(F.col("pair_no") % 3 == 1, F.lower("output"))
        .otherwise(F.col("instruction"))
    )
    c = R.first_content(_completion(F.col("output")))
    return p.select("conv_id", "pair_no", R.reward_accuracy(c, sol).alias("score"))


@register("reward_length", _reward_sql(_sql_length()))
def q_reward_length(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.select("conv_id", "pair_no", R.reward_length(R.first_content(_completion(F.col("output")))).alias("score"))


@register("reward_relevance", _reward_sql(_sql_relevance()))
def q_reward_relevance(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    c = R.first_content(_completion(F.col("output")))
    return p.select("conv_id", "pair_no", R.reward_relevance(c, F.col("instruction")).alias("score"))


@register("reward_non_empty", _reward_sql(f"CASE WHEN {S.py_strip('{c}')} <> '' THEN {D(1.0)} ELSE {D(0.0)} END"))
def q_reward_non_empty(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.select("conv_id", "pair_no", R.reward_non_empty(R.first_content(_completion(F.col("output")))).alias("score"))


@register("reward_language_quality", _reward_sql(_sql_language_quality()))
def q_reward_language_quality(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    c = R.first_content(_completion(F.col("output")))
    return p.select("conv_id", "pair_no", R.reward_language_quality(c, LANG).alias("score"))


def _composite_sql() -> str:
    w = dict(R.DEFAULT_WEIGHTS)
    total = sum(w.values())
    w = {k: v / total for k, v in w.items()}
    terms = {
        "format": _sql_format("c"),
        "length": _sql_length("c"),
        "relevance": _sql_relevance("c", "instruction"),
        "language_quality": _sql_language_quality("c", LANG),
    }
    acc = D(0.0)
    for name in ["format", "length", "relevance", "language_quality"]:
        if w.get(name, 0) > 0:
            acc = f"({acc} + ({terms[name]}) * {D(w[name])})"
    return _with(f"SELECT conv_id, pair_no, {acc} AS score FROM (SELECT *, {FORMAT_CONTENT_SQL} AS c FROM pairs)")


@register("reward_composite", _composite_sql())
def q_reward_composite(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumn("c", R.first_content(_completion(FORMAT_CONTENT_SPARK())))
    return p.select(
        "conv_id", "pair_no", R.reward_composite(F.col("c"), question=F.col("instruction"), language=LANG).alias("score")
    )


# ---- response parsing ---------------------------------------------------------------

AR_Q, AR_A = Q.QUESTION_KEYS[1], Q.ANSWER_KEYS[1]


def _responses(spark, sf_dir):
    """Model-like responses built from the pairs: five JSON wrappings by conversation,
    plus a quasi-JSON text that only the regex route can read."""
    p = _pairs(spark, sf_dir)
    j = F.to_json(F.array(F.struct(F.col("instruction").alias("question"), F.col("output").alias("answer"))))
    j_ar = F.to_json(F.array(F.struct(F.col("instruction").alias(AR_Q), F.col("output").alias(AR_A))))
    v = F.col("conv_id") % 5
    resp = (
        F.when(v == 0, j)
        .when(v == 1, F.concat(F.lit("```json\n"), j, F.lit("\n```")))
        .when(v == 2, F.concat(F.lit("  ```\n"), j, F.lit("```\n")))
        .when(v == 3, F.regexp_replace(j, F.lit("\\}\\]$"), F.lit(",\n},]")))
        .otherwise(j_ar)
    )
    quasi = F.concat(
        F.lit('{"question": "'), F.col("instruction"), F.lit('", "answer": "'), F.col("output"), F.lit('",,}')
    )
    return p.select("conv_id", "pair_no", j.alias("json"), resp.alias("response"), quasi.alias("quasi"))


PARSED_SQL = _with("SELECT conv_id, pair_no, 0 AS q_no, instruction AS question, output AS answer FROM pairs")


def _exploded(df, pairs_col):
    return df.select("conv_id", "pair_no", F.posexplode_outer(pairs_col).alias("q_no", "p")).where(
        F.col("p").isNotNull()
    ).select("conv_id", "pair_no", "q_no", "p.question", "p.answer")


JSON_SQL = "CAST(to_json([{'question': instruction, 'answer': output}]) AS VARCHAR)"
JSON_AR_SQL = f"CAST(to_json([{{'{AR_Q}': instruction, '{AR_A}': output}}]) AS VARCHAR)"
COMMAS_SQL = f"left({JSON_SQL}, len({JSON_SQL}) - 2) || ',' || chr(10) || '}},]'"


@register(
    "strip_code_fence",
    _with(
        f"""SELECT conv_id, pair_no, CASE conv_id % 5 WHEN 3 THEN {COMMAS_SQL} WHEN 4 THEN {JSON_AR_SQL} ELSE {JSON_SQL} END AS bare
        FROM pairs"""
    ),
)
def q_strip_code_fence(spark, sf_dir):
    return _responses(spark, sf_dir).select("conv_id", "pair_no", Q.strip_code_fence(F.col("response")).alias("bare"))


@register("fix_trailing_commas", _with(f"SELECT conv_id, pair_no, {JSON_SQL} AS fixed FROM pairs"))
def q_fix_trailing_commas(spark, sf_dir):
    """Every pair's JSON with commas put before its closing brackets, and taken out again."""
    r = _responses(spark, sf_dir)
    broken = F.regexp_replace("json", F.lit("\\}\\]$"), F.lit(",\n},]"))
    return r.select("conv_id", "pair_no", Q.fix_trailing_commas(broken).alias("fixed"))


@register("parse_qa_json", PARSED_SQL)
def q_parse_qa_json(spark, sf_dir):
    r = _responses(spark, sf_dir).withColumn("c", Q.clean_response("response"))
    return _exploded(r.select("conv_id", "pair_no", Q.parse_qa_json(F.col("c")).alias("qa")), "qa")


@register("extract_qa_regex", PARSED_SQL)
def q_extract_qa_regex(spark, sf_dir):
    r = _responses(spark, sf_dir)
    return _exploded(r.select("conv_id", "pair_no", Q.extract_qa_regex(F.col("quasi")).alias("qa")), "qa")


@register(
    "qa_with_fallback",
    _with(
        """SELECT conv_id, pair_no, 0 AS q_no, instruction AS question, output AS answer FROM pairs
        UNION ALL SELECT conv_id, pair_no, 0, instruction, output FROM pairs"""
    ),
)
def q_qa_with_fallback(spark, sf_dir):
    r = _responses(spark, sf_dir)
    both = r.select("conv_id", "pair_no", F.col("response").alias("raw")).unionByName(
        r.select("conv_id", "pair_no", F.col("quasi").alias("raw"))
    )
    return _exploded(SY.with_pairs(both, "raw", "qa"), "qa")


# ---- GRPO rows and code-instruction projection ---------------------------------------


def _problem_json(spark, sf_dir):
    """One JSON record per pair; the shape rotates with pair_no: a valid list, a list
    without a valid item, a lone object, a list with a null solution and a non-object."""
    p = _pairs(spark, sf_dir)
    full = F.to_json(F.struct(F.col("instruction").alias("problem"), F.col("output").alias("solution")))
    only_problem = F.to_json(F.struct(F.col("instruction").alias("problem")))
    null_sol = F.to_json(
        F.struct(F.col("instruction").alias("problem"), F.lit(None).cast("string").alias("solution")),
        {"ignoreNullFields": "false"},
    )
    k = F.col("pair_no") % 4
    raw = (
        F.when(k == 0, F.concat(F.lit("["), full, F.lit("]")))
        .when(k == 1, F.concat(F.lit("["), only_problem, F.lit(', "x"]')))
        .when(k == 2, full)
        .otherwise(F.concat(F.lit("["), null_sol, F.lit(", 5]")))
    )
    return p.select("conv_id", "pair_no", raw.alias("value"))


@register(
    "to_grpo_prompt",
    _with(
        f"""SELECT conv_id, pair_no, item_no, sys_ok, user_content, solution FROM (
          SELECT conv_id, pair_no, 0 AS item_no, true AS sys_ok, instruction AS user_content, output AS solution
          FROM pairs WHERE pair_no % 4 = 0
          UNION ALL
          SELECT conv_id, pair_no, 0, true, instruction, NULL FROM pairs WHERE pair_no % 4 = 3
          UNION ALL
          SELECT conv_id, pair_no, -1, true, {S.q(RS.EMPTY_DATASET)}, '' FROM pairs WHERE pair_no % 4 = 1
          UNION ALL
          SELECT conv_id, pair_no, -1, true, {S.q(RS.ERROR_LOADING)}, 'Error' FROM pairs WHERE pair_no % 4 = 2)"""
    ),
)
def q_to_grpo_prompt(spark, sf_dir):
    g = RS.grpo_dataset(_problem_json(spark, sf_dir), "value", ["conv_id", "pair_no"])
    return g.select(
        "conv_id",
        "pair_no",
        F.col("item_no").cast("int").alias("item_no"),
        ((F.get("prompt", 0)["content"] == F.lit(RS.REASONING_SYSTEM_PROMPT)) & (F.get("prompt", 0)["role"] == "system")).alias("sys_ok"),
        F.get("prompt", 1)["content"].alias("user_content"),
        "solution",
    )


@register(
    "validate_problem_rows",
    _with(
        """SELECT conv_id, pair_no, item_no, valid FROM (
          SELECT conv_id, pair_no, 0 AS item_no, true AS valid FROM pairs WHERE pair_no % 4 IN (0, 3)
          UNION ALL SELECT conv_id, pair_no, 1, false FROM pairs WHERE pair_no % 4 = 3
          UNION ALL SELECT conv_id, pair_no, 0, false FROM pairs WHERE pair_no % 4 = 1
          UNION ALL SELECT conv_id, pair_no, 1, false FROM pairs WHERE pair_no % 4 = 1)"""
    ),
)
def q_validate_problem_rows(spark, sf_dir):
    items = RS.problem_rows(_problem_json(spark, sf_dir), "value", ["conv_id", "pair_no"])
    return items.select("conv_id", "pair_no", F.col("item_no").cast("int").alias("item_no"), "valid")


@register(
    "grpo_placeholder",
    _with(
        f"""SELECT conv_id, pair_no, CASE WHEN pair_no % 4 = 1 THEN {S.q(RS.EMPTY_DATASET)} ELSE {S.q(RS.ERROR_LOADING)} END AS user_content
        FROM pairs WHERE pair_no % 4 IN (1, 2)"""
    ),
)
def q_grpo_placeholder(spark, sf_dir):
    g = RS.grpo_dataset(_problem_json(spark, sf_dir), "value", ["conv_id", "pair_no"])
    return g.where(F.col("item_no") == -1).select("conv_id", "pair_no", F.get("prompt", 1)["content"].alias("user_content"))


@register(
    "project_code_instructions",
    _with(
        """SELECT instruction, output, CASE pair_no % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' ELSE NULL END AS programming_language
        FROM pairs WHERE pair_no % 5 <> 4"""
    ),
)
def q_project_code_instructions(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    lang = F.when(F.col("pair_no") % 3 == 0, "python").when(F.col("pair_no") % 3 == 1, "rust")
    with_lang = F.to_json(
        F.struct(F.col("instruction").alias("prompt"), F.col("output").alias("response"), lang.alias("programming_language")),
        {"ignoreNullFields": "false"},
    )
    without = F.to_json(F.struct(F.col("instruction").alias("prompt"), F.col("output").alias("response")))
    raw = p.select(F.when(F.col("pair_no") % 5 == 4, without).otherwise(with_lang).alias("value"))
    return RS.project_code_instructions(raw, "value")
