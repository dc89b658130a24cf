"""Quality by importance resampling: target against raw generative models.

Two bags of hashed events are counted: byte 4-grams in 2**16 buckets, and whether a word
repeats the word before it. The raw model counts every document, the target model the
documents labelled good. A document's log weight is the sum over its events of
log p_target - log p_raw (raw counts scaled to the target's total, ``PRIOR`` added to
both), kept as whole numbers of 2**-20 so that it does not depend on batches. Documents are then sampled without replacement in proportion
to weight ** (1 / temperature) by Gumbel top-k: log weight / temperature plus standard
Gumbel noise, the ``keep`` largest stay.

``keep`` is by default the number of documents that the target model explains better than
the raw one (log weight above zero): what resampling aims at is as large as the part of
the corpus that looks like the target. The threshold, the ``keep``-th largest key, is found
by narrowing histograms; rows that tie with it all stay.

The target model is fitted on at most ``SAMPLE`` labelled documents, the first by a hash of
their id (parameter ``sample``); raw counts, weights and the threshold cover every row. A
document with two different labels is not a good one. Null and empty texts have weight
zero and are not above it; a null key is a key like any other for the noise. Repeated rows
get the same key and share their fate. Without labelled documents there is no
target, all weights are zero and nothing is above it; an empty table gives an empty one."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .ngrams import BLOCK, Texts

SAMPLE = 50_000
BITS, N = 16, 4
REPEAT, OTHER = 1 << BITS, (1 << BITS) + 1
UNIT = 1 << 20
PRIOR = 5.0


def good_documents(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Ids of labelled good documents, ``sample`` at most, chosen by a hash of the id."""
    ids = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    return ids.select(F.col("doc_id").alias("good_id")).orderBy(F.xxhash64("good_id"), "good_id").limit(sample)


def parts_of(texts: pa.Array):
    """(from, to, texts) of ``BLOCK`` bytes at a time (one text at least); the others stay in Arrow."""
    for lo, hi in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), BLOCK):
        yield lo, hi, texts.slice(lo, hi - lo).to_pylist()


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """Log weight of each event, in units of 1 / ``UNIT``."""

    def count(batches):
        raw, target = np.zeros(OTHER + 1, np.int64), np.zeros(OTHER + 1, np.int64)
        for b in batches:
            good = np.asarray(b.column(1).to_pylist(), bool)
            for lo, hi, texts in parts_of(b.column(0)):
                for part, into in ((texts, raw), ([t for t, g in zip(texts, good[lo:hi], strict=True) if g], target)):
                    if not part:
                        continue
                    x = Texts(part)
                    into[:REPEAT] += x.gram_counts(N, BITS)
                    same, other = x.repeats()
                    into[REPEAT] += same.sum()
                    into[OTHER] += other.sum()
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["event", "raw", "target"])

    # At most ``sample`` ids are broadcast.
    good = F.broadcast(good_documents(labels, sample))
    d = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    rows = d.join(good, d["k"] == good["good_id"], "left").select("t", F.col("good_id").isNotNull().alias("g"))
    sums = rows.mapInArrow(count, "event long, raw long, target long").groupBy("event").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(OTHER + 1), np.zeros(OTHER + 1)
    raw[sums["event"]], target[sums["event"]] = sums["raw"], sums["target"]
    return weights_of(raw, target)


def weights_of(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the models, each bag of events by itself. Raw counts are scaled to the
    target's total; both get ``PRIOR``, so that an event too rare to tell has ratio one."""
    weight = np.empty(OTHER + 1)
    for part in (slice(0, REPEAT), slice(REPEAT, OTHER + 1)):
        expected = raw[part] * (target[part].sum() / max(raw[part].sum(), 1.0))
        weight[part] = np.log((target[part] + PRIOR) / (expected + PRIOR))
    return np.round(weight * UNIT).astype(np.int64)


def log_weights(weight: np.ndarray, texts: pa.Array) -> np.ndarray:
    out = []
    for _, _, part in parts_of(texts):
        x = Texts(part)
        same, other = x.repeats()
        out.append(x.gram_sums(weight, N, BITS) + same * weight[REPEAT] + other * weight[OTHER])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def with_keys(docs: DataFrame, weight: np.ndarray, seed: int, temperature: float, key: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """(log weight, Gumbel key) of each row of ``docs`` as columns."""
    shared = docs.sparkSession.sparkContext.broadcast(weight)

    @F.arrow_udf("long")
    def score(t: pa.Array) -> pa.Array:
        return pa.array(log_weights(shared.value, t), pa.int64())

    log_weight = score(F.col(text)) / F.lit(float(UNIT))
    u = (F.shiftrightunsigned(F.xxhash64(F.col(key), F.col(text), F.lit(seed)), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    return log_weight, -F.log(-F.log(u))


def kth_largest(values: DataFrame, k: int, together: int = 50_000) -> float | None:
    """The k-th largest of a column ``x`` without nulls (None if there are fewer, or k < 1):
    histograms of 4096 bins narrow it down; at most ``together`` values are ever collected."""
    lo, hi, n = values.agg(F.min("x"), F.max("x"), F.count("*")).first()
    if k < 1 or n < k:
        return None
    above = 0
    while lo < hi:
        inside = values.where((F.col("x") >= lo) & (F.col("x") <= hi))
        if n <= together:
            return sorted((r[0] for r in inside.select("x").collect()), reverse=True)[k - above - 1]
        bin_ = F.least(F.lit(4095), F.floor((F.col("x") - lo) / (hi - lo) * 4096))
        bins = inside.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        for r in sorted(bins.collect(), key=lambda r: -r.bin):
            if above + r.n >= k:
                lo, hi, n = r.lo, r.hi, r.n
                break
            above += r.n
    return lo


def resample(
    docs: DataFrame, labels: DataFrame, keep: int | None = None, temperature: float = 1.0, seed: int = 42, sample: int = SAMPLE, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, log_weight, gumbel_key) of the documents that the sampling keeps."""
    scored, threshold, _ = _select(docs, labels, keep, temperature, seed, sample, key, text)
    return scored.where(F.lit(False) if threshold is None else F.col("gumbel_key") >= threshold)


def keep_good(
    docs: DataFrame, labels: DataFrame, keep: int | None = None, temperature: float = 1.0, seed: int = 42, sample: int = SAMPLE, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs``, all columns, that the sampling keeps. Keys are worked out again
    beside the rows (whole numbers, so the same) instead of joining texts to the choice."""
    _, threshold, weight = _select(docs, labels, keep, temperature, seed, sample, key, text)
    if threshold is None:
        return docs.where(F.lit(False))
    log_weight, noise = with_keys(docs, weight, seed, temperature, key, text)
    return docs.where(log_weight / temperature + noise >= threshold)


def _select(docs, labels, keep, temperature, seed, sample, key, text):
    if not (temperature > 0 and math.isfinite(temperature)):
        raise ValueError("temperature must be positive")
    weight = fit(docs, labels, sample, key, text)
    log_weight, noise = with_keys(docs, weight, seed, temperature, key, text)
    scored = docs.select(F.col(key).alias("doc_id"), log_weight.alias("log_weight"), noise.alias("noise"))
    scored = written(scored.select("doc_id", "log_weight", (F.col("log_weight") / temperature + F.col("noise")).alias("gumbel_key")), "log-weights")
    if keep is None:
        keep = scored.where("log_weight > 0").count()
    return scored, kth_largest(scored.select(F.col("gumbel_key").alias("x")), keep), weight
