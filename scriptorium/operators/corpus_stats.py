"""Corpus statistics of the dataset card (documented only in the source; no code there).

Words are whitespace words. A word is Arabic when it holds an Arabic-block letter and
vocalised when it holds a harakat mark (U+064B..U+0652); other words count as
punctuation / non-Arabic. Unique counts are exact distinct counts (one shuffle of the
distinct forms, combined map-side)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Arabic block and the harakat (vowel marks) range.
ARABIC = r"[\x{600}-\x{6ff}]"
HARAKAT = r"[\x{64b}-\x{652}]"


def corpus_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    from ..session import ensure_parallelism

    words = ensure_parallelism(docs.select(text_col)).select(F.explode(T.py_split(F.col(text_col))).alias("w"))
    # Distinct words with counts first: the patterns run once per word form, and the
    # distinct counts expand over word forms, not over the corpus.
    w = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    arabic = F.col("w").rlike(ARABIC)
    vocal = F.col("w").rlike(HARAKAT)
    stripped = F.regexp_replace("w", F.lit(HARAKAT), F.lit(""))
    agg = w.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_words"),
        F.coalesce(F.sum(F.when(arabic & vocal, F.col("n"))), F.lit(0)).alias("vocalised_words"),
        F.coalesce(F.sum(F.when(~arabic, F.col("n"))), F.lit(0)).alias("other_words"),
        F.count_distinct(F.when(arabic, stripped)).alias("unique_unvocalised"),
        F.count_distinct(F.when(arabic & vocal, F.col("w"))).alias("unique_vocalised"),
    )
    return agg.withColumn(
        "avg_vocalisations", F.round(F.try_divide(F.col("unique_vocalised"), F.col("unique_unvocalised")), 6)
    )
