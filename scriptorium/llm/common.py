"""Helpers shared by the operators: written intermediate tables, files in the shared
folder, and connected components over an edge table."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that the cluster shares (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a lineage cut that
    survives lost executors, and one evaluation of what several later jobs read."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_fs(uri: str):
    """(pyarrow filesystem, path) of a URI in Hadoop's spelling; workers use it to read and
    write files that Spark has no format for. ``file:`` needs a folder all machines mount."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def read_bytes(uri: str) -> memoryview:
    """The file's bytes, memory-mapped where the file system is local."""
    import pyarrow as pa
    from pyarrow import fs

    where, path = shared_fs(uri)
    if isinstance(where, fs.LocalFileSystem):
        if not where.get_file_info(path).size:
            return memoryview(b"")
        with pa.memory_map(path) as f:
            return memoryview(f.read_buffer())
    with where.open_input_file(path) as f:
        return memoryview(f.read_buffer())


def slices(sizes, most: int):
    """(from, to) of consecutive items whose sizes add up to ``most`` or just beyond it."""
    lo = held = 0
    for i, size in enumerate(sizes):
        held += size
        if held >= most:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the undirected edges (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while not np.array_equal(nxt := root[root], root):
            root = nxt
        if np.array_equal(before, root):
            break
        live = root[a] != root[b]
        a, b = a[live], b[live]
    return root


def star_edges(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of the local edges (indexes into ``ids``) as a star around each
    smallest id: at most one edge per node instead of one per link."""
    order = np.argsort(ids, kind="stable")
    at = np.empty(len(ids), np.int64)
    at[order] = np.arange(len(ids))
    root = local_roots(at[a], at[b], len(ids))
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[order][moved], ids[order][root[moved]]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge, component its smallest reachable node.

    Alternating large-star and small-star rounds over long ids; each half round groups by
    node with a partial ``min`` and joins the minimum back, from a written table, so that a
    node with a large share of the edges is an ordinary skewed join that AQE splits. The
    rounds stop when the edge set no longer changes. Edges with a null end and self-loops
    are ignored; an empty table gives an empty one."""
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    e = written(e.distinct(), "cc-edges")
    mark = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == mark:
            break
        mark = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-low")
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(large.where("u != v").distinct(), "cc-large")
        low = written(e.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        joined = e.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))
        )
        e = written(small.where("u != v").distinct(), "cc-small")
    ends = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(e.select(F.col("v"), F.col("v")).distinct())
