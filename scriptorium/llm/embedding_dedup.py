"""Embedding near-duplicates by Euclidean p-stable hashing.

Vectors are scaled to length one, so that cosine c is distance sqrt(2 - 2c). A hash is
floor((a.x + b) / width) with a drawn from the normal distribution; ``hashes`` of them name
a bucket of one of ``tables`` tables. At cosine 0.95 one hash agrees with probability
0.83 (width 1.5), so ten agree with 0.16 and at least one of 40 tables with 0.999; above
that the chance rises quickly. Pairs of a bucket are compared exactly, in double precision.

Buckets are counted first, and those with one vector are left out. A bucket of more than
``block`` vectors is dealt to blocks, and a task compares one block with another (or itself),
so no task holds a bucket and all its pairs are compared. Pairs are not sent anywhere: a
task counts a pair only in the first of the tables in which the two vectors meet (their
bucket names are worked out again from the vectors), and returns counts per vector and a
spanning star of the links. Equal vectors are first collapsed to classes, whose members
link with each other unless their own cosine is not a number.

Rows: one per input row. A vector that is null, empty, zero, or holds a null or non-finite
component, and a vector of another dimension, links with none of the others' (dimensions are
kept apart). A null id is kept, with component null and kept false; repeated ids are rows of
their own that share a component. An empty table gives an empty one. Only the two columns
are read, whatever other columns are called."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, star_edges, written
from .search import _ranges as ranges

SMALL = 64


class Hashes:
    """The hash functions for one dimension; the same in every task."""

    def __init__(self, dim: int, tables: int, hashes: int, width: float, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.a = rng.standard_normal((dim, tables * hashes)) / width
        self.b = rng.random(tables * hashes)
        self.mix = rng.integers(1, 1 << 62, hashes, dtype=np.int64) | 1
        self.shape = (tables, hashes)

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """Names of the buckets of each vector, one per table."""
        # One vector at a time in effect: einsum's sums don't depend on the batch, as a blocked product's may.
        cells = np.floor(np.einsum("ij,jk->ik", unit, self.a) + self.b).astype(np.int64)
        return (cells.reshape(len(unit), *self.shape) * self.mix).sum(axis=2)


def unit_vectors(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    # Scaled by the largest component first, so that neither squares nor length overflow.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def embedding_components(
    rows: DataFrame, least: float = 0.95, tables: int = 40, hashes: int = 10, width: float = 1.5, seed: int = 7, block: int = 2048, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    spark = rows.sparkSession

    def clean(batches):
        for b in batches:
            out = []
            for v in b.column(1).to_pylist():
                x = np.array([np.nan if c is None else c for c in v or ()], np.float64)
                ok = len(x) and np.isfinite(x).all() and x.any()
                out.append((x + 0.0).astype("<f8").tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "v"])

    own = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(clean, "id long, v binary")
    own = written(own, "vectors")
    # A class of equal vectors is named by a 128-bit hash; ties of the hash are as good as impossible.
    name = F.struct(F.xxhash64("v").alias("p"), F.xxhash64("v", F.lit(1)).alias("q"))
    classes = own.where("v IS NOT NULL").groupBy(name.alias("name")).agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("id").alias("low"))
    classes = written(classes.select(F.col("name.p").alias("p"), F.col("name.q").alias("q"), "v", "copies", "low", F.monotonically_increasing_id().alias("c")), "vector-classes")

    def of_dim(dim):
        return Hashes(dim, tables, hashes, width, seed)

    def name_buckets(batches):
        made: dict[int, Hashes] = {}
        for b in batches:
            raw, ids = b.column(1).to_pylist(), np.asarray(b.column(0))
            sizes = np.array([len(x) // 8 for x in raw])
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                h = made.setdefault(int(dim), of_dim(int(dim)))
                names = h.buckets(unit_vectors([raw[i] for i in at]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[at], tables)), pa.array(np.full(len(at) * tables, dim, "i4")), pa.array(np.tile(np.arange(tables, dtype="i4"), len(at))), pa.array(names.ravel())],
                    names=["c", "dim", "t", "bucket"],
                )

    cells = written(classes.select("c", "v").mapInArrow(name_buckets, "c long, dim int, t int, bucket long"), "buckets")
    shared = written(cells.groupBy("dim", "t", "bucket").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "shared-buckets")
    member = cells.join(shared, ["dim", "t", "bucket"]).withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks").cast("long")).cast("int"))
    # Block i meets block j in the task (i, j), i <= j: a vector goes to as many tasks as its bucket has blocks.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = member.select("c", "dim", "t", "bucket", "own", other.alias("with")).select(
        "c", "dim", "t", "bucket", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), (F.col("own") <= F.col("with")).alias("left"), (F.col("own") >= F.col("with")).alias("right")
    )
    dealt = dealt.join(classes.select("c", "v", "copies"), "c")

    def pairs_of(start: np.ndarray, size: np.ndarray, alone: np.ndarray, left: np.ndarray, right: np.ndarray, unit: np.ndarray):
        """Index pairs to compare exactly, some at a time: all of a small group at once with
        the other small groups, candidates of a matrix product for a large one."""
        small = alone & (size <= SMALL)
        rows = ranges(start[small], size[small])
        after = np.repeat(start[small] + size[small], size[small]) - rows - 1
        ends = np.cumsum(after)
        at = 0
        while at < len(rows):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 16), "right")))
            yield np.repeat(rows[at:end], after[at:end]), ranges(rows[at:end] + 1, after[at:end])
            at = end
        for lo, n, same in zip(start[~small].tolist(), size[~small].tolist(), alone[~small].tolist(), strict=True):
            l, r = lo + np.flatnonzero(left[lo : lo + n]), lo + np.flatnonzero(right[lo : lo + n])
            for at in range(0, len(l), 256):
                some = l[at : at + 256]
                a, b = np.nonzero(unit[some] @ unit[r].T >= least - 1e-9)
                a, b = some[a], r[b]
                keep = a < b if same else slice(None)
                a, b = a[keep], b[keep]
                for k in range(0, len(a), 1 << 16):
                    yield a[k : k + (1 << 16)], b[k : k + (1 << 16)]

    def compare(rows: pa.Table, h: Hashes):
        """Links of whole groups of one dimension: counts per class and spanning stars."""
        column = {c: np.asarray(rows.column(c).combine_chunks()) for c in ("c", "t", "bucket", "i", "j", "copies")}
        left, right = (np.asarray(rows.column(c).to_pylist(), bool) for c in ("left", "right"))
        unit = unit_vectors(rows.column("v").to_pylist())
        change = np.zeros(len(unit), bool)
        change[0] = True
        for c in ("t", "bucket", "i", "j"):
            change[1:] |= column[c][1:] != column[c][:-1]
        start = np.flatnonzero(change)
        size = np.diff(np.append(start, len(unit)))
        ids, where = np.unique(column["c"], return_inverse=True)
        links, a_all, b_all = np.zeros(len(ids), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in pairs_of(start, size, column["i"][start] == column["j"][start], left, right, unit):
            near = np.einsum("ij,ij->i", unit[a], unit[b]) >= least
            a, b = a[near], b[near]
            if not len(a):
                continue
            used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            names = h.buckets(unit[used])
            before = np.arange(tables) < column["t"][a][:, None]
            first = ~((names[at[: len(a)]] == names[at[len(a) :]]) & before).any(axis=1)
            a, b = a[first], b[first]
            np.add.at(links, where[a], column["copies"][b])
            np.add.at(links, where[b], column["copies"][a])
            a_all.append(where[a])
            b_all.append(where[b])
        p, q = star_edges(np.concatenate(a_all), np.concatenate(b_all), ids)
        some = np.flatnonzero(links)
        none = np.full(len(some), -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([ids[some], p])), pa.array(np.concatenate([links[some], np.zeros(len(p), np.int64)])), pa.array(np.concatenate([none, q]))], names=["c", "links", "to"]
        )

    def compare_all(batches):
        """Groups come one after the other; the last one of a batch waits for the next."""
        made, waiting = {}, None

        def done(rows):
            for dim in np.unique(np.asarray(rows.column("dim").combine_chunks())).tolist():
                yield from compare(rows.filter(pc.equal(rows.column("dim"), dim)), made.setdefault(dim, of_dim(dim)))

        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b])
            rows = rows if waiting is None else pa.concat_tables([waiting, rows])
            last = [np.asarray(rows.column(c).combine_chunks()) for c in ("dim", "t", "bucket", "i", "j")]
            open_ = np.logical_and.reduce([x == x[-1] for x in last])
            cut = len(open_) - int(np.argmin(open_[::-1])) if not open_.all() else 0
            if cut:
                yield from done(rows.slice(0, cut))
            waiting = rows.slice(cut)
        if waiting is not None and waiting.num_rows:
            yield from done(waiting)

    by = ["dim", "t", "bucket", "i", "j"]
    dealt = dealt.select(*by, "c", "left", "right", "copies", "v").repartition(*by).sortWithinPartitions(*by)
    found = written(dealt.mapInArrow(compare_all, "c long, links long, to long"), "vector-links")
    roots = connected_components(found.where("to >= 0").select(F.col("c").alias("a"), F.col("to").alias("b")))
    counts = found.where("to < 0").groupBy("c").agg(F.sum("links").alias("links"))
    tagged = classes.select("p", "q", "copies", "low", "c").join(roots, F.col("c") == F.col("node"), "left").join(counts, "c", "left")
    tagged = written(tagged.select("p", "q", "low", F.coalesce("component", "c").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "vector-roots")
    low = tagged.groupBy("root").agg(F.min("low").alias("component_id"))
    of = written(tagged.join(low, "root").select("p", "q", "n_links", "component_id"), "vector-components")
    named = own.select("id", F.col("v").isNotNull().alias("ok"), F.xxhash64("v").alias("p"), F.xxhash64("v", F.lit(1)).alias("q"))
    linked = named.where("ok").join(of, ["p", "q"]).select("id", "n_links", "component_id")
    alone = named.where("NOT ok").select("id", F.lit(0).cast("long"), F.col("id"))
    return linked.union(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
