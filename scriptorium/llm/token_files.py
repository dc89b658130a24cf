"""Token-id output: flat unsigned integer files with 64-bit document offsets.

A folder holds, per range of the document key, ``tokens`` (unsigned 16-bit ids where the
vocabulary fits, else 32-bit, little-endian), ``lengths`` (32-bit ids per document),
``keys`` (64-bit document keys) and ``offsets`` (64-bit global starts, one more than
documents), and ``manifest``, a Parquet table of the parts with their bases. A part's base
is the prefix sum of the id counts of the parts before it, so parts are written in
parallel and need no second pass over the tokens.

Documents are in ascending key order; null keys come first (they are stored as key
-2**63 with ``null_keys`` of the manifest telling how many), rows that repeat a key are
ordered by a hash of their text. A null or empty text is a document of the end id alone.
Files of a lost or repeated task attempt are never referred to: only the rows that reach
the manifest count. Other columns of the input are not read, whatever their names."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_bytes, scratch_path, shared_fs, written
from .tokens import encoder

MANIFEST = "part int, stem string, n_docs long, n_tokens long, null_keys long"
NO_KEY = -(2**63)


def id_type(vocab_size: int) -> str:
    return "<u2" if vocab_size <= 1 << 16 else "<u4"


def batches_of(texts: list[str], chars: int = 1 << 20):
    """Slices of a list of texts with a bounded number of characters (one text at least)."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0
) -> DataFrame:
    """Encode every text, append ``end_id``, write the files under ``folder`` and return the
    manifest with ``base``, the number of ids before each part. An empty table gives an
    empty manifest."""

    def encode_part(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        kind = id_type(max(enc.vocab_size, end_id + 1))
        end = np.array([end_id], "<u4").tobytes()
        part, stem = TaskContext.get().partitionId(), None
        n_docs = n_tokens = null_keys = 0
        fs = files = None
        for b in batches:
            if not b.num_rows:
                continue
            if files is None:
                stem = f"part-{part:06d}-{uuid.uuid4().hex[:12]}"
                fs, root = shared_fs(folder)
                fs.create_dir(root, recursive=True)
                files = {x: fs.open_output_stream(f"{root}/{stem}.{x}") for x in ("tokens", "lengths", "keys")}
            keys, texts = b.column(0), b.column(1).to_pylist()
            null_keys += keys.null_count
            files["keys"].write(np.asarray(keys.fill_null(NO_KEY)).astype("<i8").tobytes())
            for lo, hi in batches_of(texts):
                ids = [x + end for x in enc.encode(texts[lo:hi])]
                lengths = np.array([len(x) >> 2 for x in ids], "<u4")
                files["lengths"].write(lengths.tobytes())
                files["tokens"].write(np.frombuffer(b"".join(ids), "<u4").astype(kind).tobytes())
                n_tokens += int(lengths.sum())
            n_docs += b.num_rows
        if files is not None:
            for f in files.values():
                f.close()
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "stem": stem, "n_docs": n_docs, "n_tokens": n_tokens, "null_keys": null_keys}],
                schema=pa.schema([("part", pa.int32()), ("stem", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("null_keys", pa.int64())]),
            )

    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t")).repartitionByRange("k", "h").sortWithinPartitions("k", "h")
    parts = written(rows.select("k", "t").mapInArrow(encode_part, MANIFEST), "token-parts")
    # One row per part: the prefix sum is a small sort, whatever the corpus holds.
    spark = docs.sparkSession
    spark.createDataFrame(_bases(parts), MANIFEST + ", base long").coalesce(1).write.parquet(f"{folder}/manifest")
    _write_offsets(spark, folder)
    return spark.read.parquet(f"{folder}/manifest")


def _bases(parts: DataFrame) -> list[tuple]:
    """The parts in key order with the number of ids before each; one short row per file."""
    out, base = [], 0
    for r in sorted(parts.collect(), key=lambda r: r.part):
        out.append((*r, base))
        base += r.n_tokens
    return out


def _spread(spark: SparkSession, folder: str) -> DataFrame:
    m = spark.read.parquet(f"{folder}/manifest")
    return m.repartition(max(1, m.count()))


def _write_offsets(spark: SparkSession, folder: str) -> None:
    def offsets(batches):
        for b in batches:
            for r in b.to_pylist():
                fs, root = shared_fs(folder)
                n = np.frombuffer(read_bytes(f"{folder}/{r['stem']}.lengths"), "<u4").astype("<i8")
                starts = r["base"] + np.concatenate([[0], np.cumsum(n)])
                # The same bytes whichever attempt writes them.
                with fs.open_output_stream(f"{root}/{r['stem']}.offsets") as f:
                    f.write(starts.astype("<i8").tobytes())
            yield b

    m = _spread(spark, folder)
    m.mapInArrow(offsets, m.schema).write.format("noop").mode("overwrite").save()


def documents_of(folder: str, row: dict, kind: str):
    """(key, start, ids) of a part's documents in file order, from memory-mapped files."""
    starts = np.frombuffer(read_bytes(f"{folder}/{row['stem']}.offsets"), "<i8")
    keys = np.frombuffer(read_bytes(f"{folder}/{row['stem']}.keys"), "<i8")
    ids = np.frombuffer(read_bytes(f"{folder}/{row['stem']}.tokens"), kind)
    for i in range(row["n_docs"]):
        yield None if i < row["null_keys"] else int(keys[i]), int(starts[i]), ids[starts[i] - row["base"] : starts[i + 1] - row["base"]]


def read_token_files(spark: SparkSession, folder: str, kind: str, with_ids: bool = True) -> DataFrame:
    """One row per document read back from the files: doc_id, start, n_tokens, ids_crc32
    (of the ids as little-endian unsigned 32-bit integers) and, if asked for, ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def read(batches):
        names = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
        names += [("ids", pa.list_(pa.int32()))] if with_ids else []
        for b in batches:
            for r in b.to_pylist():
                rows, held = [], 0
                for k, start, ids in documents_of(folder, r, kind):
                    wide = ids.astype("<u4")
                    rows.append((k, start, len(ids), zlib.crc32(wide.tobytes())) + ((wide.astype("i4"),) if with_ids else ()))
                    held += len(ids) if with_ids else 8
                    if held >= 1 << 21:
                        yield _batch(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, names)

    return _spread(spark, folder).mapInArrow(read, schema)


def _batch(rows: list[tuple], names: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*rows), names, strict=True)], schema=pa.schema(names))


def token_file_digests(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the files to the shared folder, read them back and return the digest rows."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    write_token_files(docs, folder, tokenizer, end_id=end_id)
    return read_token_files(spark, folder, id_type(max(encoder(tokenizer).vocab_size, end_id + 1)), with_ids=False)
