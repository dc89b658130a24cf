"""Sinks: JSONL (overwrite / append), batched writes into an external store, dataset export.

Writes go through Spark's committer, so a task retried after an executor loss never
leaves a half-written file behind.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame


# A compressed file is read by one task.
ROWS_IN_FILE = 100_000


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", compressed: bool = False) -> None:
    """UTF-8 JSON lines, non-ASCII kept as is, null fields written as ``null``. ``compressed``:
    by gzip, at most ``ROWS_IN_FILE`` rows in a file."""
    out = df.write.mode(mode).option("ignoreNullFields", "false")
    if compressed:
        out = out.option("compression", "gzip").option("maxRecordsPerFile", ROWS_IN_FILE)
    out.json(path)


def append_jsonl(df: DataFrame, path: str, compressed: bool = False) -> None:
    write_jsonl(df, path, mode="append", compressed=compressed)


def _batched(it: Iterable, n: int):
    it = iter(it)
    while batch := list(itertools.islice(it, n)):
        yield batch


def write_batched(df: DataFrame, open_writer: Callable[[], Callable[[list[dict], str], None]], batch_size: int = 1000) -> None:
    """Insert rows into an external store in batches of ``batch_size`` per task.

    ``open_writer()`` runs on the executor and returns ``insert_many(list_of_dicts, key)``;
    rows stream through the partition iterator, so memory holds one batch. Delivery is at
    least once: a task that is retried sends its batches again, each under the same ``key``
    (partition and batch number), so a store that replaces what it has under a key ends up
    with each row once, given input whose partitions are recomputed alike."""

    def run(rows):
        from pyspark import TaskContext

        insert, part = open_writer(), TaskContext.get().partitionId()
        for n, batch in enumerate(_batched((r.asDict(recursive=True) for r in rows), batch_size)):
            insert(batch, f"{part:06d}-{n:08d}")

    df.foreachPartition(run)


def validate_dataset_name(repo_id: str) -> tuple[str, str]:
    """``owner/name`` with both parts non-empty."""
    if not isinstance(repo_id, str) or len(repo_id.split("/")) != 2 or not all(repo_id.split("/")):
        raise ValueError("dataset name must be in the form 'owner/name'")
    owner, name = repo_id.split("/")
    return owner, name


def export_dataset(df: DataFrame, root: str, repo_id: str, split: str = "train") -> str:
    """Write a publishable dataset layout ``<root>/<owner>/<name>/<split>`` as Parquet."""
    owner, name = validate_dataset_name(repo_id)
    path = f"{root.rstrip('/')}/{owner}/{name}/{split}"
    df.write.mode("overwrite").parquet(path)
    return path
