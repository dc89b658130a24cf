"""Queries for sources, sinks, batching, caps and the incremental stream.

Inputs for the file readers are written by Spark from the driver's tables into a fresh
folder under the session's checkpoint directory (a shared folder on a cluster), then
read back with the reader under test.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators import numbering as N
from ..operators import reshape as RS
from ..operators import synth as SY
from ..session import ensure_checkpoint_dir
from ..sources import readers as RD
from ..sources import sinks as SK
from ..streaming.incremental import incremental_run
from . import sqlfrag as S
from .registry import register, table
from .q_synth import CHUNKS_SQL

BATCH = 64
CAP = 100


def scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"


FOLDERS = 64


def _write_files(df, keys: list[str], root: str) -> None:
    """One ``<key>=<value>.txt`` for each key that a task has, with the rows' last column line
    by line, dealt over ``FOLDERS`` folders a task. Spark's writer makes a folder and a file
    for each, starts a program for the permissions of every one and moves them one by one on
    the driver. A task that is tried again replaces its files."""

    def write(rows):
        from itertools import groupby

        from pyspark import TaskContext

        where, base = RD.open_folder(root)
        part, made = TaskContext.get().partitionId(), set()
        for n, (key, group) in enumerate(groupby(rows, key=lambda r: r[:-1])):
            folder = f"{base}/{part:05d}-{n % FOLDERS:02d}"
            if folder not in made:
                where.create_dir(folder, recursive=True)
                made.add(folder)
            name = ",".join(f"{k}={v}" for k, v in zip(keys, key, strict=True))
            with where.open_output_stream(f"{folder}/{name}.txt") as f:
                for r in group:
                    f.write(((r[-1] or "") + "\n").encode("utf-8"))
        yield part

    df.sortWithinPartitions(*keys).rdd.mapPartitions(write).count()


def _chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_document"), "text")
    c = C.chunk_documents(d, 128)
    return c.select(
        "text",
        F.col("source_document").cast("string").alias("source_document"),
        C.stable_chunk_id("source_document", "seq").alias("chunk_id"),
        "token_count_estimate",
    )


@register(
    "read_text_folder",
    "SELECT doc_id, CAST(len(" + S.words(S.clean_text("text")) + ") AS INTEGER) AS n_tokens FROM documents",
)
def q_read_text_folder(spark, sf_dir):
    path = scratch(spark, "txt")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    _write_files(d, ["doc_id"], path)
    files = RD.read_text_folder(spark, f"{path}/*")
    doc = F.regexp_extract("source_document", r"doc_id=(\d+)", 1).cast("bigint")
    from ..functions import text as T

    return files.select(doc.alias("doc_id"), T.word_count(T.clean_text("text")).alias("n_tokens"))


@register("read_chunks_jsonl", CHUNKS_SQL + "\nSELECT chunk_id, text FROM ck")
def q_read_chunks_jsonl(spark, sf_dir):
    path = scratch(spark, "chunks")
    SK.write_jsonl(_chunks(spark, sf_dir), f"{path}/good")
    # Undecodable lines and lines without text, derived from the same chunks.
    c = _chunks(spark, sf_dir)
    bad = c.select(F.concat(F.lit('{"chunk_id": "'), F.col("chunk_id"), F.lit('", "text": ')).alias("value"))
    notext = c.select(F.concat(F.lit('{"chunk_id": "x'), F.col("chunk_id"), F.lit('", "text": ""}')).alias("value"))
    bad.unionByName(notext).write.text(f"{path}/bad")
    return RD.read_chunks_jsonl(spark, f"{path}/*").select("chunk_id", "text")


@register(
    "read_text_arrays_jsonl",
    f"SELECT unnest({S.paragraphs(S.clean_text('text'))}) AS text FROM documents",
)
def q_read_text_arrays_jsonl(spark, sf_dir):
    from ..functions import text as T

    path = scratch(spark, "arrays")
    d = table(spark, sf_dir, "documents")
    recs = F.transform(T.split_paragraphs(T.clean_text("text")), lambda p: F.struct(p.alias("text")))
    d.select(F.to_json(recs).alias("value")).write.text(path)
    return RD.read_text_arrays_jsonl(spark, path)


@register("read_json_array_file", "SELECT conv_id, turn, role, text FROM conversations")
def q_read_json_array_file(spark, sf_dir):
    path = scratch(spark, "arrayfile")
    c = table(spark, sf_dir, "conversations")
    body = F.to_json(F.array(F.struct("conv_id", "turn", "role", "text")))
    _write_files(c.select("conv_id", "turn", body.alias("value")), ["conv_id", "turn"], path)
    rows = RD.read_json_array_file(spark, f"{path}/*", RD.CONVERSATION_SCHEMA)
    return rows.select("conv_id", "turn", "role", "text")


@register("read_jsonl_table", "SELECT conv_id, turn, role, text FROM conversations")
def q_read_jsonl_table(spark, sf_dir):
    path = scratch(spark, "jsonl")
    SK.write_jsonl(table(spark, sf_dir, "conversations"), path)
    return RD.read_jsonl_table(spark, path).select("conv_id", "turn", "role", "text")


@register("read_conversations", "SELECT conv_id, turn, role, text FROM conversations")
def q_read_conversations(spark, sf_dir):
    path = scratch(spark, "conv")
    SK.write_jsonl(table(spark, sf_dir, "conversations"), path)
    return RD.read_conversations(spark, path)


@register("write_jsonl", "SELECT conv_id, turn, role, text FROM conversations")
def q_write_jsonl(spark, sf_dir):
    path = scratch(spark, "out")
    SK.write_jsonl(table(spark, sf_dir, "conversations"), path)
    return spark.read.schema(RD.CONVERSATION_SCHEMA).json(path)


@register(
    "append_jsonl",
    "SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, turn, role, text FROM conversations",
)
def q_append_jsonl(spark, sf_dir):
    path = scratch(spark, "out")
    SK.write_jsonl(table(spark, sf_dir, "conversations"), path)
    SK.append_jsonl(table(spark, sf_dir, "conversations"), path)
    return spark.read.schema(RD.CONVERSATION_SCHEMA).json(path)


DOCS_IN_FILE = 500


@register("read_lines", CHUNKS_SQL + f"""
    SELECT doc_id // {DOCS_IN_FILE} AS file, CAST(3 * row_number() OVER (PARTITION BY doc_id // {DOCS_IN_FILE} ORDER BY doc_id, chunk_no) - 2 AS BIGINT) AS line_number,
           chunk_id, text FROM ck""")
def q_read_lines(spark, sf_dir):
    """Files with the chunks of ``DOCS_IN_FILE`` documents in order, each chunk followed by
    a line that can't be decoded and a blank one; lines are numbered within their file."""
    path = scratch(spark, "lines")
    c = _chunks(spark, sf_dir).withColumn("d", F.col("source_document").cast("long"))
    line = F.to_json(F.struct("text", "source_document", "chunk_id"))
    seq = F.element_at(F.split("chunk_id", "#"), -1).cast("int")
    lines = c.select((F.col("d") / DOCS_IN_FILE).cast("long").alias("file"), "d", seq.alias("seq"), F.posexplode(F.array(line, F.lit("not json"), F.lit(""))).alias("no", "value"))
    lines.repartition("file").sortWithinPartitions("file", "d", "seq", "no").select("file", "value").write.partitionBy("file").text(path)
    rows = RD.read_chunks_jsonl(spark, f"{path}/file=*", line_numbers=True)
    return rows.select(F.regexp_extract("source_file", r"file=(\d+)", 1).cast("long").alias("file"), "line_number", "chunk_id", "text")


@register("read_processed_ids", CHUNKS_SQL + "\nSELECT chunk_id FROM ck")
def q_read_processed_ids(spark, sf_dir):
    path = scratch(spark, "done")
    pairs = _chunks(spark, sf_dir).withColumn("qa", F.array(F.struct(F.lit("q").alias("question"), F.lit("a").alias("answer"))))
    SK.write_jsonl(SY.to_instruction_rows(pairs, "qa"), path)
    spark.createDataFrame([("not json",)], "value string").write.mode("append").text(path)
    return RD.read_processed_ids(spark, path)


@register(
    "read_instruction_source",
    f"WITH {S.PAIRS_CTE} SELECT instruction, output FROM pairs",
)
def q_read_instruction_source(spark, sf_dir):
    path = scratch(spark, "src")
    RS.pair_turns(table(spark, sf_dir, "conversations")).write.parquet(path)
    return RD.read_instruction_source(spark, path).select("instruction", "output")


@register("export_dataset", f"WITH {S.PAIRS_CTE} SELECT instruction, output FROM pairs")
def q_export_dataset(spark, sf_dir):
    root = scratch(spark, "export")
    p = RS.pair_turns(table(spark, sf_dir, "conversations")).select("instruction", "output")
    path = SK.export_dataset(p, root, "owner/instructions")
    return spark.read.parquet(path)


class _FileStore:
    """A document store stand-in: each key is one JSON-lines file of the folder, written
    through the folder's own file system and replaced when the key comes again."""

    def __init__(self, root: str):
        self.root = root

    def __call__(self):
        import json

        where, root = RD.open_folder(self.root)
        where.create_dir(root, recursive=True)

        def insert_many(batch, key):
            with where.open_output_stream(f"{root}/batch-{key}.json") as f:
                f.write("".join(json.dumps(row, ensure_ascii=False) + "\n" for row in batch).encode("utf-8"))

        return insert_many


@register("write_batched", "SELECT doc_id, lang FROM documents")
def q_write_batched(spark, sf_dir):
    root = scratch(spark, "store")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    SK.write_batched(d, _FileStore(root), batch_size=1000)
    return spark.read.schema("doc_id bigint, lang string").json(root)


@register("peek_first", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 1")
def q_peek_first(spark, sf_dir):
    return RD.peek_first(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"])


@register("sample_cap", f"SELECT doc_id FROM documents ORDER BY doc_id LIMIT {CAP}")
def q_sample_cap(spark, sf_dir):
    return RS.sample_cap(table(spark, sf_dir, "documents").select("doc_id"), CAP, ["doc_id"])


@register(
    "shuffle_rows",
    "SELECT conv_id, turn, md5(CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) || ':42') AS shuffle_key FROM conversations",
)
def q_shuffle_rows(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return RS.shuffle_rows(c, ["conv_id", "turn"], 42)


@register(
    "assign_batches",
    f"SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // {BATCH} AS BIGINT) AS batch_id FROM documents",
)
def q_assign_batches(spark, sf_dir):
    return N.assign_batches(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], BATCH)


@register("incremental_run", CHUNKS_SQL + "\nSELECT chunk_id FROM ck")
def q_incremental_run(spark, sf_dir):
    """Three runs over two drops of chunk files (the second drop repeats part of the
    first). The first run fails every third document; the third run has no new file and
    still finishes them; every chunk id is written once."""
    base = scratch(spark, "stream")
    src, out, ckpt = f"{base}/in", f"{base}/out", f"{base}/ckpt"
    c = _chunks(spark, sf_dir)
    doc = F.col("source_document").cast("bigint")

    def process(pending):
        qa = F.array(F.struct(F.lit("q").alias("question"), F.lit("a").alias("answer")))
        return SY.to_instruction_rows(pending.withColumn("qa", qa), "qa")

    def failing(pending):
        return process(pending.where(F.col("source_document").cast("bigint") % 3 != 0))

    c.where(doc % 2 == 0).write.mode("append").json(f"{src}")
    incremental_run(spark, src, out, ckpt, failing)
    c.where((doc % 2 == 1) | (doc % 4 == 0)).write.mode("append").json(f"{src}")
    incremental_run(spark, src, out, ckpt, failing)
    incremental_run(spark, src, out, ckpt, process)
    return spark.read.schema(RD.OUTPUT_SCHEMA).json(out).select(
        F.col("source_document_info.original_chunk_id").alias("chunk_id")
    )
