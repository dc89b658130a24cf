"""Incremental generation runs with Structured Streaming.

A file-source stream (``trigger(availableNow=True)``) only discovers chunks: each new file is
consumed once and its chunks go to an inbox table beside the stream's checkpoint, one
folder per micro-batch, so a replayed batch replaces itself. A run then takes *all* chunks
of the inbox whose id is not in the output yet (left anti join), runs the user's batch
function (e.g. model call + parse + explode) and appends. A chunk that failed, was
rate-limited or gave no rows is therefore offered again by every later run, with or
without new files, and a finished one never is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.generate import GenerationRun, generate_instructions
from ..operators.resume import resume_pending
from ..sources.readers import CHUNK_SCHEMA, path_exists, read_processed_ids
from ..sources.sinks import append_jsonl


def discover(spark: SparkSession, input_dir: str, checkpoint_dir: str, max_files_per_trigger: int | None = None) -> DataFrame | None:
    """Move the chunks of files not yet consumed to the inbox; the whole inbox, or None."""
    reader = spark.readStream.schema(CHUNK_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    inbox = f"{checkpoint_dir.rstrip('/')}/inbox"
    chunks = reader.json(input_dir).where(F.col("text").isNotNull() & (F.col("text") != ""))

    def keep(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{inbox}/epoch={epoch_id}")

    q = chunks.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    q.awaitTermination()
    if not path_exists(spark, inbox):
        return None
    return spark.read.schema(CHUNK_SCHEMA).parquet(inbox)


def each_once(seen: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """An id that was delivered twice is offered once; chunks without an id always are."""
    return seen.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).union(seen.where(F.col(id_col).isNull()))


def generate_incrementally(
    spark: SparkSession, input_dir: str, output_dir: str, checkpoint_dir: str, model_fn, max_files_per_trigger: int | None = None, **options
) -> GenerationRun | None:
    """A whole generation run (``operators.generate``) over every chunk seen so far that has
    no output; ``options`` are those of ``generate_instructions``. None before the first
    file. Chunks of a stream have no line numbers: one caller takes them in any order."""
    seen = discover(spark, input_dir, checkpoint_dir, max_files_per_trigger)
    if seen is None:
        return None
    chunks = each_once(seen).withColumn("line_number", F.lit(None).cast("long"))
    return generate_instructions(spark, chunks, output_dir, f"{checkpoint_dir.rstrip('/')}/work", model_fn, **options)


def incremental_run(
    spark: SparkSession,
    input_dir: str,
    output_dir: str,
    checkpoint_dir: str,
    process: Callable[[DataFrame], DataFrame],
    id_col: str = "chunk_id",
    max_files_per_trigger: int | None = None,
) -> None:
    """Process every chunk seen so far that has no output yet; append instruction rows."""
    seen = discover(spark, input_dir, checkpoint_dir, max_files_per_trigger)
    if seen is None:
        return
    one = each_once(seen, id_col)
    if path_exists(spark, output_dir):
        one = resume_pending(one, read_processed_ids(spark, output_dir, id_col), id_col)
    append_jsonl(process(one), output_dir)
