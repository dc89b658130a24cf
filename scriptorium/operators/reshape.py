"""Reshaping into instruction data: turn pairing, field projection, GRPO prompt rows,
chat prompt rendering, caps and shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The system prompt of the reasoning format used for GRPO rows and chat rendering.
REASONING_SYSTEM_PROMPT = (
    "A conversation between User and Assistant. The user asks a question, and the Assistant solves it. The assistant "
    "first thinks about the reasoning process in the mind and then provides the user with the answer. The reasoning "
    "process and answer are enclosed within <think> </think> and <answer> </answer> tags, respectively, i.e., "
    "<think> reasoning process here </think><answer> answer here </answer>"
)
# Placeholder user messages when the problem file is not a list / has no valid rows.
ERROR_LOADING = "Error loading data."
EMPTY_DATASET = "Empty dataset."


def require_text(df: DataFrame, col: str = "text") -> DataFrame:
    """Drop rows whose text is null or empty (Python falsiness of a string)."""
    return df.where(F.col(col).isNotNull() & (F.col(col) != ""))


def pair_turns(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text"
) -> DataFrame:
    """Long conversation table -> ``(conv, pair_no, instruction, output)``: positions
    (0,1), (2,3), ... The unpaired last turn of an odd-length conversation is dropped.

    ``turn`` must be the 0-based position. One exchange and one sort by (conversation,
    pair, turn), so a very long conversation spreads over many tasks."""
    pair_no = F.floor(F.col(turn_col) / 2).cast("long")
    w = Window.partitionBy(conv_col, "pair_no").orderBy("_turn")
    rows = df.select(conv_col, pair_no.alias("pair_no"), F.col(turn_col).alias("_turn"), F.col(text_col).alias("instruction"))
    led = rows.select("*", F.lead("instruction").over(w).alias("output"), F.lead("_turn").over(w).alias("_next"))
    return led.where((F.col("_turn") % 2 == 0) & F.col("_next").isNotNull()).select(conv_col, "pair_no", "instruction", "output")


def positions(df: DataFrame, conv_col: str, order_col: str, pos_col: str = "turn") -> DataFrame:
    """0-based positions inside each conversation when the order column is not already a
    dense position (a window per conversation: one conversation per task)."""
    w = Window.partitionBy(conv_col).orderBy(order_col)
    return df.withColumn(pos_col, F.row_number().over(w) - 1)


def unpaired_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Count of conversations whose last turn has no partner (odd length)."""
    n = df.groupBy(conv_col).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count_if(F.col("n") % 2 == 1).alias("unpaired_turns"))


def pair_turns_array(turns: Column, value_field: str = "value") -> Column:
    """Array form: ``ARRAY<STRUCT<value>>`` -> ``ARRAY<STRUCT<instruction, output>>``."""
    n = F.size(turns)
    idx = F.sequence(F.lit(0), n - 2, F.lit(2))
    pairs = F.transform(
        idx,
        lambda i: F.struct(
            F.get(turns, i).getField(value_field).alias("instruction"),
            F.get(turns, i + 1).getField(value_field).alias("output"),
        ),
    )
    return F.when(n >= 2, pairs).otherwise(F.array().cast("array<struct<instruction:string,output:string>>"))


def project_code_instructions(raw: DataFrame, json_col: str = "value") -> DataFrame:
    """JSON records -> ``instruction, output, programming_language`` from ``prompt``,
    ``response``, ``programming_language``; a record missing any of the keys is skipped
    (presence is tested on the object's keys, so an explicit null is kept). The last value
    of a repeated key counts."""
    keys = F.json_object_keys(F.col(json_col))
    has_all = F.array_contains(keys, "prompt") & F.array_contains(keys, "response") & F.array_contains(
        keys, "programming_language"
    )
    v = F.from_json(F.col(json_col), "prompt string, response string, programming_language string")
    found = raw.where(F.coalesce(has_all, F.lit(False))).select(v.alias("_v"))
    return found.select(F.col("_v.prompt").alias("instruction"), F.col("_v.response").alias("output"), "_v.programming_language")


def render_chat_prompt(text: Column | str, system: str = REASONING_SYSTEM_PROMPT) -> Column:
    """``system + "\\nUser: " + text + "\\nAssistant:"``."""
    t = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit(system + "\nUser: "), t, F.lit("\nAssistant:"))


def to_grpo_prompt(problem: Column, solution: Column, system: str = REASONING_SYSTEM_PROMPT) -> list[Column]:
    """``prompt = [{system}, {user: problem}]`` and ``solution``."""
    prompt = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), problem.cast("string").alias("content")),
    )
    return [prompt.alias("prompt"), solution.alias("solution")]


def _problem_items(value: Column) -> Column:
    """JSON array text -> ARRAY<STRUCT<valid, problem, solution>> (null when it is no list).

    Items are cut out as their own text, so a solution that is no string keeps the text it
    was written with (``1.0``, the order of an object's keys; white space between its parts goes)."""
    kinds = F.try_parse_json(value).cast("array<variant>")
    texts = F.from_json(value, "array<string>")

    def item(text: Column, i: Column) -> Column:
        keys = F.json_object_keys(text)
        # A string item may hold the text of an object.
        is_obj = F.coalesce(F.schema_of_variant(F.get(kinds, i)).startswith("OBJECT<"), F.lit(True))
        valid = F.coalesce(is_obj & F.array_contains(keys, "problem") & F.array_contains(keys, "solution"), F.lit(False))
        v = F.from_json(text, "problem string, solution string")
        return F.struct(valid.alias("valid"), v["problem"].alias("problem"), v["solution"].alias("solution"))

    is_list = F.coalesce(F.ltrim(value).startswith("["), F.lit(False)) & texts.isNotNull()
    return F.when(is_list, F.transform(texts, item))


def problem_rows(raw: DataFrame, json_col: str = "value", id_cols: list[str] | None = None) -> DataFrame:
    """JSON array text -> its items with ``valid``: objects holding both ``problem`` and
    ``solution`` keys (presence; null allowed). ``solution`` is kept as JSON text when it
    is not a string. Records that are no list give no rows."""
    ids = id_cols or []
    items = raw.select(*ids, _problem_items(F.col(json_col)).alias("_items"))
    rows = items.select(*ids, F.col("_items").isNotNull().alias("is_list"), F.posexplode_outer("_items").alias("item_no", "_item"))
    return rows.where(F.col("_item").isNotNull()).select(*ids, "is_list", "item_no", "_item.valid", "_item.problem", "_item.solution")


def grpo_dataset(raw: DataFrame, json_col: str = "value", id_cols: list[str] | None = None) -> DataFrame:
    """Per input record (one JSON array): GRPO rows for its valid items, or one
    placeholder row: "Error loading data." when the record is not a list, "Empty dataset."
    when the list has no valid item. One pass; the choice is made within the record."""
    ids = id_cols or []
    items = raw.select(*ids, _problem_items(F.col(json_col)).alias("_items"))
    numbered = F.transform("_items", lambda x, i: F.struct(i.alias("item_no"), x["valid"].alias("valid"), x["problem"].alias("problem"), x["solution"].alias("solution")))
    good = F.filter(F.coalesce(numbered, F.array().cast("array<struct<item_no:int,valid:boolean,problem:string,solution:string>>")), lambda x: x["valid"])
    staged = items.select(*ids, F.col("_items").isNotNull().alias("_list"), good.alias("_good"))
    instead = F.array(
        F.struct(
            F.lit(-1).alias("item_no"),
            F.lit(True).alias("valid"),
            F.when(F.col("_list"), F.lit(EMPTY_DATASET)).otherwise(F.lit(ERROR_LOADING)).alias("problem"),
            F.when(F.col("_list"), F.lit("")).otherwise(F.lit("Error")).alias("solution"),
        )
    )
    rows = staged.select(*ids, F.explode_outer(F.when(F.size("_good") > 0, F.col("_good")).otherwise(instead)).alias("_x"))
    return rows.select(*ids, "_x.item_no", *to_grpo_prompt(F.col("_x.problem"), F.col("_x.solution")))


def sample_cap(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """At most ``n`` rows, the first in ``order`` (a deterministic ``max_samples``), rows that
    tie in it by a hash of the whole row. Cut by running number, so no task holds the
    rows that are kept."""
    from .numbering import number_rows

    tie = df.withColumn("_tie", F.xxhash64(*[F.col(c) for c in df.columns]))
    return number_rows(tie, [*order, "_tie"], "_row").where(F.col("_row") <= n).drop("_row", "_tie")


def shuffle_key(cols: list[str], seed: int) -> Column:
    """Deterministic pseudo-random order key (md5 of the key and seed), reproducible in SQL."""
    parts = [F.col(c).cast("string") for c in cols] + [F.lit(str(seed))]
    return F.md5(F.concat_ws(":", *parts))


def shuffle_rows(df: DataFrame, cols: list[str], seed: int = 42) -> DataFrame:
    """Rows in a seeded random order (global sort on the md5 key: range shuffle, no
    single partition)."""
    return df.withColumn("shuffle_key", shuffle_key(cols, seed)).orderBy("shuffle_key")
