"""Exact BM25 top-k search: sharded inverted indexes with block-max WAND pruning.

Index: each task of the scan cuts its documents into shards of a bounded number of
documents and words and writes an inverted index for each, a row of one table. Within a
shard documents are numbered by falling length, so that documents near each other score
alike, and every list is cut into blocks at the same document numbers (``WINDOW`` each). Nothing
is sampled and no text is shuffled.

Scores: sum over the query's distinct terms of idf(t) * tf * (k1 + 1) / (tf + k1 * (1 - b +
b * length / mean length)), idf(t) = ln(1 + (N - n + 0.5) / (n + 0.5)), with N, n and the
mean length over the whole table, not the shard, so scores of different shards compare
and the merged top k is exact. Terms are lower-cased runs of letters, digits and
underscores.

Search: queries are sent to the shards in blocks of a bounded number of terms. Pruning is
by block maxima and windows instead of WAND's document cursors, which a loop in Python
could not afford: postings of rare lists are added up at once, and a window of documents
gets as its bound the best of these sums in it and the block maxima of the query's common
lists. Windows are taken by falling bound; each is scored in full for those queries whose
k-th best score so far its bound may beat (WAND's pivot rule, for a window) and left out
for the others, whose results it can't change. Queries of a shard go through its windows
together, so that a window's common lists are read once for all of them. The documents
that reach the k-th score are scored again term by term. Documents without any term of the
query are no results.

Results: (query_id, rank, doc_id, score), ranks from 1 by falling score, then ascending id
(nulls last), then text hash. A null or empty text has no terms: no results as a query, none
as a document. A null key is never a query; as a document it is found like any other.
Repeated rows are documents of their own; a repeated query key is one query with the terms
of all its rows. An empty table gives no rows. Other columns are not read."""

from __future__ import annotations

import itertools
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WINDOW = 128
# Lists with a document in so many are common; cells of a shard's common rows at most (8 bytes each).
COMMON, COMMON_CELLS = 16, 4_000_000
TOGETHER = 128
SLACK = 1e-9
SHARD_DOCS, SHARD_WORDS = 16_384, 8_000_000
BLOCK_TERMS = 400_000
TERM = re.compile(r"\w+")
SHARD = "n_docs long, n_words long, terms array<string>, dfs array<int>, docs binary, tfs binary, keys binary, lengths binary, hashes binary"
SHARD_ARROW = pa.schema(
    [("n_docs", pa.int64()), ("n_words", pa.int64()), ("terms", pa.list_(pa.string())), ("dfs", pa.list_(pa.int32()))]
    + [(c, pa.binary()) for c in ("docs", "tfs", "keys", "lengths", "hashes")]
)
NO_KEY = np.iinfo(np.int64).max


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").lower())


class Builder:
    """Collects documents and makes a shard's row of them."""

    def __init__(self):
        # A new term gets the next number; nothing here refers to itself, so a shard's terms go with it.
        self.vocab: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        self.parts, self.keys, self.hashes, self.words = [], [], [], 0

    def add(self, key: int | None, text_hash: int, text: str | None) -> None:
        words = terms_of(text)
        self.parts.append(np.fromiter(map(self.vocab.__getitem__, words), np.int32, len(words)))
        self.words += len(words)
        self.keys.append(NO_KEY if key is None else key)
        self.hashes.append(text_hash)

    def row(self) -> pa.RecordBatch:
        lengths = np.array([len(x) for x in self.parts], np.int64)
        n = len(lengths)
        order = np.argsort(-lengths, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        # One number for a document's term: sorted, they are the postings of the lists in turn.
        both = np.concatenate(self.parts).astype(np.int64)
        self.parts = []
        both *= n
        both += np.repeat(place, lengths)
        both.sort()
        first = np.flatnonzero(np.concatenate([np.full(min(1, len(both)), True), both[1:] != both[:-1]]))
        counts, both = np.diff(np.append(first, len(both))), both[first]
        values = {
            "n_docs": n, "n_words": int(lengths.sum()), "terms": list(self.vocab), "dfs": np.bincount(both // n, minlength=len(self.vocab)).astype(np.int32),
            "docs": (both % n).astype(np.int32).tobytes(), "tfs": counts.astype(np.int32).tobytes(), "keys": np.array(self.keys, np.int64)[order].tobytes(),
            "lengths": lengths[order].astype(np.int32).tobytes(), "hashes": np.array(self.hashes, np.int64)[order].tobytes(),
        }
        return pa.RecordBatch.from_pylist([values], schema=SHARD_ARROW)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The table of shards, written to the shared folder."""

    def build(batches):
        b = Builder()
        for batch in batches:
            for k, h, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                b.add(k, h, t)
                if len(b.keys) >= SHARD_DOCS or b.words >= SHARD_WORDS:
                    yield b.row()
                    b = Builder()
        if b.keys:
            yield b.row()

    rows = docs.select(F.col(key).cast("long").alias("k"), F.xxhash64(F.col(text)).alias("h"), F.col(text).cast("string").alias("t"))
    return written(rows.mapInArrow(build, SHARD), "search-shards")


class Shard:
    """A shard made ready to search. Lists that hold one in ``COMMON`` of the documents or
    more are laid out as rows with a column for each document, with the maxima of their
    blocks; the others stay lists of postings."""

    def __init__(self, r: dict, mean_length: float, k1: float, b: float):
        self.n = r["n_docs"]
        self.keys, self.hashes = np.frombuffer(r["keys"], np.int64), np.frombuffer(r["hashes"], np.int64)
        lengths = np.frombuffer(r["lengths"], np.int32)
        self.docs, tfs = np.frombuffer(r["docs"], np.int32), np.frombuffer(r["tfs"], np.int32)
        self.term = {t: i for i, t in enumerate(r.pop("terms"))}
        norm = k1 * (1 - b + b * lengths / mean_length)
        self.impact = tfs * (k1 + 1) / (tfs + norm[self.docs])
        self.dfs = np.array(r["dfs"], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.dfs)])
        self.windows = -(-self.n // WINDOW)
        self.wide = self.windows * WINDOW
        common = np.flatnonzero(self.dfs * COMMON >= self.n)
        common = common[np.argsort(-self.dfs[common], kind="stable")][: COMMON_CELLS // max(1, self.wide)]
        self.row = np.full(len(self.dfs), -1)
        self.row[common] = np.arange(len(common))
        self.common = np.zeros((len(common), self.wide))
        for i, t in enumerate(common.tolist()):
            at = slice(self.first[t], self.first[t + 1])
            self.common[i, self.docs[at]] = self.impact[at]
        self.most = self.common.reshape(len(common), self.windows, WINDOW).max(axis=2)

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms, their idf) the documents and scores that can be among the
        shard's k best, ties at the end included."""
        weights = np.zeros((len(queries), len(self.common)))
        scores = np.zeros((len(queries), self.wide))
        for i, (terms, idf) in enumerate(queries):
            row = self.row[terms]
            weights[i, row[row >= 0]] = idf[row >= 0]
            post, weight = self._postings(terms[row < 0], idf[row < 0])
            scores[i] = np.bincount(self.docs[post], weights=self.impact[post] * weight, minlength=self.wide)
        # A window's bound: the best score by rare lists and the block maxima of the common ones.
        # Rounding must not put a bound below a score that it bounds.
        bound = (weights @ self.most + scores.reshape(len(queries), self.windows, WINDOW).max(axis=2)) * (1 + SLACK)
        best, least = np.zeros((len(queries), k)), np.zeros(len(queries))
        scored = np.zeros(bound.shape, bool)
        for w in np.argsort(-bound.sum(axis=0), kind="stable").tolist():
            # The pivot rule: a window is looked at for the queries whose k-th best score it may beat.
            live = np.flatnonzero((bound[:, w] > 0) & (bound[:, w] >= least))
            if not len(live):
                continue
            at = slice(w * WINDOW, (w + 1) * WINDOW)
            scores[live, at] += weights[live] @ self.common[:, at]
            scored[live, w] = True
            best[live] = np.partition(np.concatenate([best[live], scores[live, at]], axis=1), WINDOW, axis=1)[:, WINDOW:]
            least[live] = best[live].min(axis=1) * (1 - SLACK)
        out = []
        for i, (terms, idf) in enumerate(queries):
            found = np.flatnonzero((scores[i] > 0) & (scores[i] >= least[i]) & np.repeat(scored[i], WINDOW))
            out.append((found, self.exact(terms, idf, found)))
        return out

    def _postings(self, terms: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the postings of the terms' lists and their terms' idf."""
        n = self.dfs[terms]
        return _ranges(self.first[terms], n), np.repeat(idf, n)

    def exact(self, terms: np.ndarray, idf: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Scores added up term by term in the order given, whatever shard a document is in,
        so that equal documents have equal scores."""
        part = np.zeros((len(terms), len(docs)))
        row = self.row[terms]
        part[row >= 0] = self.common[np.ix_(row[row >= 0], docs)] * idf[row >= 0][:, None]
        rare = np.flatnonzero(row < 0)
        post, weight = self._postings(terms[rare], idf[rare])
        column = np.full(self.wide, -1)
        column[docs] = np.arange(len(docs))
        held = np.flatnonzero(column[self.docs[post]] >= 0)
        of = np.searchsorted(np.cumsum(self.dfs[terms[rare]]), held, "right")
        part[rare[of], column[self.docs[post[held]]]] = self.impact[post[held]] * weight[held]
        return np.cumsum(part, axis=0)[-1] if len(terms) else np.zeros(len(docs))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The whole numbers of the ranges (start, count), one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def search(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, key: str = "doc_id", text: str = "text", query_key: str = "doc_id", query_text: str = "text") -> DataFrame:
    """The ``k`` best documents of each query (module docstring)."""
    spark = docs.sparkSession
    shards = build_index(docs, key, text)
    n_docs, n_words = shards.agg(F.sum("n_docs"), F.sum("n_words")).first()
    result = "query_id long, doc_id long, text_hash long, score double"
    if not n_words:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")

    @F.pandas_udf("array<string>")
    def distinct_terms(t: pd.Series) -> pd.Series:
        return t.map(lambda x: sorted(set(terms_of(x))))

    asked = queries.where(F.col(query_key).isNotNull()).select(F.col(query_key).cast("long").alias("query_id"), F.explode(distinct_terms(F.coalesce(F.col(query_text), F.lit("")))).alias("term"))
    asked = written(asked.distinct(), "query-terms")
    wanted = asked.select("term").distinct()
    dfs = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.dfs").alias("df"))
    idf = dfs.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").cast("double").alias("n"))
    idf = written(idf.select("term", F.log(1 + (n_docs - F.col("n") + 0.5) / (F.col("n") + 0.5)).alias("idf")), "query-idf")
    blocks = max(1, -(-asked.count() // BLOCK_TERMS))
    weighted = written(asked.join(idf, "term").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "query-blocks")

    def run(block):
        def find(batches):
            ids, starts, names, terms, weights = block.value
            for batch in batches:
                for r in batch.to_pylist():
                    s = Shard(r, n_words / n_docs, k1, b)
                    own = np.fromiter((s.term.get(x, -1) for x in names), np.int64, len(names))
                    out, asked = [], []
                    for i, q in enumerate(ids):
                        t = own[terms[starts[i] : starts[i + 1]]]
                        here = t >= 0
                        if here.any():
                            asked.append((q, t[here], weights[starts[i] : starts[i + 1]][here]))
                    for lo in range(0, len(asked), TOGETHER):
                        some = asked[lo : lo + TOGETHER]
                        for (q, _, _), (found, scores) in zip(some, s.search([x[1:] for x in some], k), strict=True):
                            if len(found) > k:  # ties beyond the k-th: by id, then text
                                top = np.lexsort((s.hashes[found], s.keys[found], -scores))[:k]
                                found, scores = found[top], scores[top]
                            out.append((np.full(len(found), q), s.keys[found], s.hashes[found], scores))
                    if out:
                        q, d, h, x = (np.concatenate(c) for c in zip(*out, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(d, mask=d == NO_KEY), pa.array(h), pa.array(x)], names=["query_id", "doc_id", "text_hash", "score"])

        return written(shards.mapInArrow(find, result), "search-hits")

    hits = None
    for i in range(blocks):
        # At most about BLOCK_TERMS terms; queries are dealt to blocks by a hash.
        rows = weighted.where(F.col("block") == i).select("query_id", "term", "idf").orderBy("query_id").toArrow()
        # Terms as numbers: the strings of equal terms are one.
        coded = rows.column("term").combine_chunks().dictionary_encode()
        terms, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        ids, starts = np.unique(rows.column("query_id").to_numpy(), return_index=True)
        block = (ids, np.append(starts, rows.num_rows), names, terms.astype(np.int32), rows.column("idf").to_numpy())
        del rows, coded
        sent = spark.sparkContext.broadcast(block)
        del block
        found = run(sent)
        hits = found if hits is None else hits.union(found)
        sent.destroy()
    # Within a query k rows per shard: the merge of the shards' lists.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "text_hash")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
