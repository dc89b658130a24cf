"""Sources: text folders, JSON / JSONL in the shapes the data jobs use, Parquet.

All readers are lazy DataFrame scans; malformed input is dropped or counted with native
JSON functions rather than Python parsing.
"""

from __future__ import annotations

import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

CHUNK_SCHEMA = "text string, source_document string, chunk_id string, token_count_estimate int"
CONVERSATION_SCHEMA = "conv_id bigint, turn bigint, role string, text string"
OUTPUT_SCHEMA = (
    "instruction string, input string, output string, "
    "source_document_info struct<original_source:string,original_chunk_id:string,original_text_preview:string>, "
    "reward_score double"
)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Asked of the path's own file system; what goes wrong there is raised."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)


def open_folder(root: str):
    """(file system, path in it) of a folder, as a task reaches it."""
    from pyarrow import fs

    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root[len("file:"):].lstrip("/")
    return (fs.LocalFileSystem(), root) if "://" not in root else fs.FileSystem.from_uri(root)


# A group of files that one task reads in turn; bytes of them that it holds.
GROUP_FILES, HELD_BYTES = 1_000, 4 << 20


def _roots(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """What the path or pattern names, with whether it is a folder."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    return [(x.getPath().toString(), x.isDirectory()) for x in fs.globStatus(p) or ()]


def _hidden(name: str) -> bool:
    """Names that Spark's file sources skip."""
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def _listed_by_tasks(spark: SparkSession, roots: list[tuple[str, bool]], glob: str) -> DataFrame:
    """``source_document, value`` of the files of the roots. Tasks list the folders and read the
    files by group, so the driver has a row for each root and none for a file."""
    name_like = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()

    def groups(batches):
        from pyarrow import fs

        like = re.compile(name_like)

        def names(where, at: str, below: str):
            for x in where.get_file_info(fs.FileSelector(at)):
                if _hidden(x.base_name):
                    continue
                if x.type == fs.FileType.Directory:
                    if "=" in x.base_name:  # a folder of a partitioned table
                        yield from names(where, x.path, f"{below}{x.base_name}/")
                elif like.fullmatch(x.base_name):
                    yield below + x.base_name

        for batch in batches:
            for root, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if folder:
                    where, at = open_folder(root)
                    found = names(where, at, "")
                else:
                    root, _, name = root.rpartition("/")
                    found = iter([name] if like.fullmatch(name) and not _hidden(name) else [])
                while some := list(itertools.islice(found, GROUP_FILES)):
                    yield pa.RecordBatch.from_pylist([{"root": root, "names": some}])

    def read(batches):
        docs, values, held = [], [], 0
        for batch in batches:
            for r in batch.to_pylist():
                where, at = open_folder(r["root"])
                shown = re.sub("^file:(//)?", "", r["root"]).rstrip("/")
                for name in r["names"]:
                    with where.open_input_stream(f"{at.rstrip('/')}/{name}") as f:
                        value = f.read()
                    if not value:  # Spark's reader gives no row for it
                        continue
                    docs.append(f"{shown}/{name}")
                    values.append(value)
                    held += len(value)
                    if held >= HELD_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(values, pa.binary())], names=["source_document", "value"])
                        docs, values, held = [], [], 0
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(values, pa.binary())], names=["source_document", "value"])

    tasks = spark.sparkContext.defaultParallelism
    rows = spark.createDataFrame(roots, "root string, folder boolean").repartition(max(1, min(len(roots), max(tasks, len(roots) // 16))))
    dealt = rows.mapInArrow(groups, "root string, names array<string>").repartition(max(4 * tasks, len(roots) // 16))
    return dealt.mapInArrow(read, "source_document string, value binary").withColumn("value", F.col("value").cast("string"))


def _opens(path: str) -> bool:
    try:
        open_folder(path)
    except Exception:  # a store that only Spark's readers know
        return False
    return True


def read_text_folder(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """One row per ``*.txt`` file: ``source_document`` (plain path) and ``text`` with
    Python text-mode newlines. Files whose names start with ``_`` or ``.`` are skipped by
    the file source, as are empty ones; undecodable bytes become U+FFFD (flag with ``bad_utf8``).

    Where tasks can open the store (a shared folder, or one that pyarrow knows), they list the
    folders that ``path`` names. In any other store Spark's reader does, whose driver holds a
    record of each file."""
    roots = _roots(spark, path)
    if roots and _opens(roots[0][0]):
        raw = _listed_by_tasks(spark, roots, glob)
    else:
        raw = spark.read.text(path, wholetext=True, pathGlobFilter=glob)
        plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        raw = raw.select(F.regexp_replace(plain, F.lit("^file:(//)?"), F.lit("")).alias("source_document"), "value")
    return raw.select(
        "source_document",
        T.normalize_newlines("value").alias("text"),
        F.col("value").contains("�").alias("bad_utf8"),
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, source_file, line_number`` of text files, lines counted from 1 in each file,
    blank ones too. A line's number is its place in its split and the lines of the splits
    before it, which a first pass counts (a row for each split)."""
    where = [F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block")]
    lines = spark.read.text(path).select("value", *where, F.monotonically_increasing_id().alias("_id"))
    splits = lines.groupBy("source_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    from_ = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1
    # A row for each split, so the lines themselves are not shuffled.
    starts = F.broadcast(splits.select("source_file", "_block", from_.alias("_from")))
    numbered = lines.join(starts, ["source_file", "_block"])
    return numbered.select("value", "source_file", (F.col("_id") + F.col("_from")).alias("line_number"))


def read_chunks_jsonl(spark: SparkSession, path: str, line_numbers: bool = False) -> DataFrame:
    """Chunk JSONL: keeps object lines with a truthy ``text``; undecodable lines and
    lines without text are dropped (``parse_chunk_lines`` keeps and marks them).
    ``line_numbers`` adds ``source_file`` and ``line_number`` (see ``read_lines``)."""
    keep = ["source_file", "line_number"] if line_numbers else []
    lines = read_lines(spark, path) if line_numbers else spark.read.text(path)
    return parse_chunk_lines(lines, keep=keep).where(~F.col("is_bad") & F.col("has_text")).drop("is_bad", "has_text")


def parse_chunk_lines(lines: DataFrame, col: str = "value", keep: list[str] | None = None) -> DataFrame:
    v = F.try_parse_json(F.col(col))
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT<"), F.lit(False))
    text = F.when(is_obj, F.try_variant_get(v, "$.text", "string"))
    return lines.where(~T.is_blank(F.col(col))).select(
        *(keep or []),
        text.alias("text"),
        F.when(is_obj, F.try_variant_get(v, "$.source_document", "string")).alias("source_document"),
        F.when(is_obj, F.try_variant_get(v, "$.chunk_id", "string")).alias("chunk_id"),
        F.when(is_obj, F.try_variant_get(v, "$.token_count_estimate", "int")).alias("token_count_estimate"),
        (~is_obj).alias("is_bad"),
        F.coalesce(text.isNotNull() & (text != ""), F.lit(False)).alias("has_text"),
    )


def read_text_arrays_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Lines holding a JSON array of ``{text}`` records (or a single object): one row per
    record's ``text``. Lines without the substring ``text`` are skipped before parsing."""
    lines = spark.read.text(path).where(F.col("value").contains("text"))
    v = F.try_parse_json(F.col("value"))
    t = F.schema_of_variant(v)
    recs = F.when(t.startswith("ARRAY<"), v.cast("array<variant>")).when(
        t.startswith("OBJECT<"), F.array(v)
    ).otherwise(F.array().cast("array<variant>"))
    out = lines.select(F.explode(recs).alias("r")).select(F.try_variant_get("r", "$.text", "string").alias("text"))
    return out.where(F.col("text").isNotNull())


def read_json_array_file(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file holding one JSON array of objects (each file is read by one task)."""
    r = spark.read.option("multiLine", True)
    if schema:
        r = r.schema(schema)
    return r.json(path)


def read_jsonl_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read
    if schema:
        r = r.schema(schema)
    return r.json(path)


def read_conversations(spark: SparkSession, path: str, schema: str = CONVERSATION_SCHEMA) -> DataFrame:
    """Strict JSONL read: a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_processed_ids(spark: SparkSession, path: str, id_col: str = "chunk_id") -> DataFrame:
    """Ids already present in an output folder; malformed lines are skipped."""
    out = spark.read.schema(OUTPUT_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    ids = out.select(F.col("source_document_info.original_chunk_id").alias(id_col))
    return ids.where(F.col(id_col).isNotNull() & (F.col(id_col) != "")).distinct()


def read_instruction_source(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Local copy of a remote instruction dataset (Parquet or JSON of the same columns)."""
    return spark.read.format(fmt).load(path)


def peek_first(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The first record (by ``order`` when given)."""
    return (df.orderBy(*order) if order else df).limit(1)
