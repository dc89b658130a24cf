"""Resume / incremental runs: skip chunks whose id is already in the output.

The finished-id set is a DataFrame (anti join), never a driver-side set: Spark picks a
broadcast hash join when the id side is small and a sort-merge join when it is not.
Null or empty ids never match, so such chunks are always processed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTPUT_ID_PATH = "source_document_info.original_chunk_id"


def processed_ids(output: DataFrame, id_path: str = OUTPUT_ID_PATH, id_col: str = "chunk_id") -> DataFrame:
    """Distinct non-empty ids present in an output (instruction rows)."""
    ids = output.select(F.col(id_path).alias(id_col))
    return ids.where(F.col(id_col).isNotNull() & (F.col(id_col) != "")).distinct()


def resume_pending(chunks: DataFrame, done_ids: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Input chunks not yet done (left anti join on the id).

    Chunks with a null or empty id are always pending. Rather than sharing one null join
    key (which would send all of them to one shuffle partition), each gets a key that can
    never match a real id: a NUL-prefixed hash of the row, so they spread like other keys
    and the input is still read once."""
    has_id = F.col(id_col).isNotNull() & (F.col(id_col) != "")
    spread = F.concat(F.lit("\u0000"), F.xxhash64(*[F.col(c) for c in chunks.columns]).cast("string"))
    keyed = chunks.withColumn("_rid", F.when(has_id, F.col(id_col)).otherwise(spread))
    done = done_ids.select(F.col(id_col).alias("_rid")).where(~F.col("_rid").startswith("\u0000"))
    return keyed.join(done, on="_rid", how="left_anti").drop("_rid")


def count_skipped(chunks: DataFrame, done_ids: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Number of input chunks already done (left semi join + count)."""
    keyed = chunks.where(F.col(id_col) != "").select(F.col(id_col).alias("_rid"))
    done = done_ids.select(F.col(id_col).alias("_rid"))
    return keyed.join(done, on="_rid", how="left_semi").agg(F.count(F.lit(1)).alias("skipped_lines"))
