"""SimHash near-duplicates: a Gray-order hierarchical index over 64-bit fingerprints.

Fingerprints: the text is lower-cased (A-Z only), split at ASCII white space and cut into
shingles of ``words`` words; each shingle, repeats included, votes with its XXH64 (UTF-8,
seed 42); a bit is set if it is set in over half the hashes. Texts with fewer words are one
shingle; texts without words (null, empty, blank) have fingerprint zero and are linked like
any other.

Links: the distinct fingerprints are sorted by Gray rank (the position of the bit pattern
in the reflected Gray code, so neighbours in the order differ in few bits) and dealt to
segments by rank. Within a segment, and over the segments themselves, a tree holds in each
node the bits that all fingerprints below it share and that its ancestors have not
compared yet (mask and pattern). A search goes down level by level and adds up the
differing bits; a node whose sum exceeds the limit is left with all that is below it. Each
fingerprint visits its own segment and those later ones that the segment-level tree cannot
rule out, so every pair within the limit meets in exactly one task. Tasks return their
links as spanning stars, at most one edge per visiting fingerprint, which connected
components join up; the search is exact, with no cap on candidates.

Rows: one per input row, with doc_id null where it is null (such a row never names a
component; a component of null ids alone is null). Repeated rows are copies of each other;
an empty table gives an empty one. Only the key and the text are read, whatever other
columns are called."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, star_edges, written

SEED = 42
FAN = 8


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    from xxhash import xxh64_intdigest

    # bytes.lower and bytes.split know ASCII only: A-Z, and space with 0x09-0x0D.
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    line = b" ".join(w)
    if len(w) <= words:
        hashes = [xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
        starts = [0, *ends[: len(w) - words].tolist()]
        hashes = [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
    n, votes = len(hashes), np.zeros(64, np.int64)
    packed = np.array(hashes, "<u8").view(np.uint8).reshape(n, 8)
    for at in range(0, n, 4096):
        votes += np.unpackbits(packed[at : at + 4096], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of unsigned 64-bit patterns in the reflected Gray code."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayTree:
    """Nodes over entries in Gray order; an entry is given by the bits that are one in all
    it stands for (``ones``) and those that are one in any of it (``some``)."""

    def __init__(self, ones: np.ndarray, some: np.ndarray):
        levels = [(ones, some)]
        while len(levels[-1][0]) > FAN:
            o, s = levels[-1]
            at = np.arange(0, len(o), FAN)
            levels.append((np.bitwise_and.reduceat(o, at), np.bitwise_or.reduceat(s, at)))
        self.levels = []
        above = None
        for o, s in reversed(levels):
            shared = ~(o ^ s)
            own = shared if above is None else shared & ~above[np.arange(len(o)) // FAN]
            self.levels.append((own, o & own))
            above = shared

    def search(self, queries: np.ndarray, limit: int, first: np.ndarray | None = None):
        """(query, entry) index pairs whose shared bits differ in ``limit`` or fewer bits;
        ``first`` rules out entries before a position for each query."""
        for at in range(0, len(queries), 1024):
            q = queries[at : at + 1024]
            n = len(self.levels[0][0])
            who, node = np.repeat(np.arange(len(q)), n), np.tile(np.arange(n), len(q))
            apart = np.zeros(len(who), np.uint8)
            for depth, (mask, pattern) in enumerate(self.levels):
                if depth:
                    who, apart = np.repeat(who, FAN), np.repeat(apart, FAN)
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    real = node < len(mask)
                    who, node, apart = who[real], node[real], apart[real]
                apart = apart + np.bitwise_count((q[who] & mask[node]) ^ pattern[node])
                keep = apart <= limit
                if first is not None:
                    step = FAN ** (len(self.levels) - 1 - depth)
                    keep &= (node + 1) * step > first[at : at + 1024][who]
                who, node, apart = who[keep], node[keep], apart[keep]
            yield who + at, node


def fingerprints(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    def of(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t, words) for t in b.column(1).to_pylist()), "<u8", b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view("<i8"))], names=["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(of, "doc_id long, fp long")


def fingerprint_links(distinct: DataFrame, limit: int, segment: int = 1 << 16) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints of a component of the links;
    ``distinct`` has a column ``fp`` without repeats."""
    spark = distinct.sparkSession

    @F.pandas_udf("long")
    def rank(fp):
        # Unsigned order as signed order.
        return pd.Series((gray_rank(fp.to_numpy(np.int64).view(np.uint64)) ^ np.uint64(1 << 63)).view(np.int64))

    n = distinct.count()
    dealt = distinct.select("fp", rank("fp").alias("rank")).repartitionByRange(max(1, -(-n // segment)), "rank")
    # What is written is what counts: the segment numbers stay those of this write.
    seg = written(dealt.select("fp", "rank", F.spark_partition_id().alias("segment")), "gray-segments")
    # One short row per ``segment`` fingerprints, in Gray order.
    nodes = seg.groupBy("segment").agg(F.bit_and("fp").alias("o"), F.bit_or("fp").alias("s")).orderBy("segment").toPandas()
    upper = spark.sparkContext.broadcast({c: nodes[c].to_numpy(np.int64) for c in nodes.columns})

    def route(batches):
        ids = upper.value["segment"]
        tree = GrayTree(upper.value["o"].view(np.uint64), upper.value["s"].view(np.uint64))
        for b in batches:
            fp, own = np.asarray(b.column(0)), np.searchsorted(ids, np.asarray(b.column(1)))
            for who, node in tree.search(fp.view(np.uint64), limit, own):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[node].astype("i4")), pa.array(fp[who]), pa.array(node == own[who])], names=["segment", "fp", "home"]
                )

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        home = np.flatnonzero(pdf["home"].to_numpy(bool))
        home = home[np.argsort(gray_rank(fp[home]))]
        tree, place = GrayTree(fp[home], fp[home]), np.zeros(len(fp), np.int64)
        place[home] = np.arange(len(home))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for who, entry in tree.search(fp, limit, place):
            real = who != home[entry]
            a.append(who[real])
            b.append(home[entry[real]])
        x, y = star_edges(np.concatenate(a), np.concatenate(b), fp.view(np.int64))
        return pd.DataFrame({"a": x, "b": y})

    routed = seg.select("fp", "segment").mapInArrow(route, "segment int, fp long, home boolean")
    return routed.groupBy("segment").applyInPandas(link, "a long, b long")


def simhash_components(docs: DataFrame, words: int = 3, limit: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) for every row of ``docs``."""
    fps = written(fingerprints(docs, words, key, text), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    roots = connected_components(fingerprint_links(distinct.select("fp"), limit))
    tagged = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    tagged = written(tagged, "fingerprint-roots")
    ids = tagged.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = written(tagged.join(ids, "root").select("fp", "component_id"), "fingerprint-components")
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
