"""Language identification by fusing evidence in Bayes' rule.

For each text and language l

    log P(l | all) = t(l) + log P(declared | l) + log P(l | host) + constant

* ``t``: log likelihood of the text under a model of hashed byte trigrams of that language
  (lower-cased, 2**15 buckets, add-half smoothing), counted over all labelled texts. The
  n-grams overlap and depend on each other, so their sum is scaled by 1 / sqrt(their
  number). Beside the languages stands ``und``, under which every bucket is equally likely:
  text in no known language falls to it.
* declared markup language: right with probability ``reliability``, else any other alike;
  a missing or unknown declaration says nothing.
* host prior: texts' languages by text alone, as fractions of a count, are summed by
  host and by address suffix (grouped aggregation); the prior of a host is its counts plus
  ``strength`` times the prior of its suffix, that of a suffix likewise over the whole
  corpus, that one likewise over equal shares. A row's own fraction is left out at each
  level, so that no text counts twice.

Null and empty texts have no text evidence; a null host or suffix is one of its own (the
empty one). Repeated rows get the same answer. Without labelled texts, or with an empty
table, everything is ``und``. More than ``MOST`` languages are refused."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .ngrams import Texts
from .token_files import batches_of

BITS, N = 15, 3
UNIT = 1 << 16
MOST = 500
UNKNOWN = "und"


class Model:
    """Languages (``und`` last) and, by language and bucket, log probabilities in units of
    1 / ``UNIT``."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = [*languages, UNKNOWN]
        p = counts + 0.5
        p = np.concatenate([p / p.sum(axis=1, keepdims=True), np.full((1, 1 << BITS), 2.0**-BITS)])
        self.logs = np.round(np.log(p) * UNIT).astype(np.int64)

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """Scaled log likelihoods, a row per text."""
        out = [np.zeros((0, len(self.languages)))]
        for lo, hi in batches_of([t or "" for t in texts]):
            x = Texts(texts[lo:hi], lower=True)
            at, n = x.buckets(N, BITS), np.maximum(x.grams(N), 1)
            sums = np.stack([x.sums(row[at], N) for row in self.logs], axis=1) / UNIT
            out.append(sums / np.sqrt(n)[:, None])
        return np.concatenate(out)


def fit(labelled: DataFrame, text: str = "text", language: str = "lang") -> Model:
    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(1).to_pylist(), object)
            texts = np.array(b.column(0).to_pylist(), object)
            for lang in set(langs.tolist()):
                own = texts[langs == lang].tolist()
                into = sums.setdefault(lang, np.zeros(1 << BITS, np.int64))
                for lo, hi in batches_of(own):
                    x = Texts(own[lo:hi], lower=True)
                    into += x.counts(x.buckets(N, BITS), N, 1 << BITS)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])], names=["lang", "bucket", "n"])

    rows = labelled.where(F.col(text).isNotNull() & F.col(language).isNotNull() & (F.col(language) != UNKNOWN)).select(F.col(text).alias("t"), F.col(language).alias("l"))
    sums = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums = written(sums, "language-counts")
    languages = sorted(r[0] for r in sums.select("lang").distinct().limit(MOST + 1).collect())
    if len(languages) > MOST:
        raise ValueError(f"more than {MOST} languages")
    table = sums.toPandas()
    counts = np.zeros((len(languages), 1 << BITS))
    counts[np.searchsorted(languages, table["lang"].to_numpy(str)) if len(table) else [], table["bucket"]] = table["n"]
    return Model(languages, counts)


def identify(
    rows: DataFrame, model: Model, key: str, text: str, declared: Column, host: Column, suffix: Column, reliability: float = 0.9, strength: float = 5.0, also: list[Column] = ()
) -> DataFrame:
    """(key, language, posterior, text_language, declared, host) for every row, and the
    columns ``also``. Texts are read once; what is joined holds scores, not texts."""
    names, size = model.languages, len(model.languages)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def evidence(t: pd.Series) -> pd.Series:
        return pd.Series(list(shared.value.evidence(t.where(t.notna(), None).tolist())))

    @F.pandas_udf("array<double>")
    def shares(e: pd.Series) -> pd.Series:
        x = np.stack(e.to_numpy())
        p = np.exp(x - x.max(axis=1, keepdims=True))
        return pd.Series(list(p / p.sum(axis=1, keepdims=True)))

    scored = rows.select(
        F.col(key).alias("key"),
        evidence(F.col(text)).alias("evidence"),
        F.lower(F.regexp_extract(F.coalesce(declared, F.lit("")), "^[A-Za-z]+", 0)).alias("declared"),
        F.lower(F.coalesce(host, F.lit(""))).alias("host"),
        F.lower(F.coalesce(suffix, F.lit(""))).alias("suffix"),
        *also,
    )
    more = scored.columns[5:]
    scored = written(scored.withColumn("own", shares("evidence")), "language-evidence")
    sums = F.array(*[F.sum(F.col("own")[i]) for i in range(size)])
    merged = F.array(*[F.sum(F.col("counts")[i]) for i in range(size)])
    hosts = written(scored.groupBy("suffix", "host").agg(sums.alias("counts")), "host-languages")
    suffixes = hosts.groupBy("suffix").agg(merged.alias("suffix_counts"))
    whole = np.array(hosts.agg(merged.alias("c")).first()[0], float) if not hosts.isEmpty() else np.zeros(size)
    priors = written(hosts.join(suffixes, "suffix").select("suffix", "host", "counts", "suffix_counts"), "host-priors")

    @F.pandas_udf("language string, posterior double, text_language string")
    def fuse(e: pd.Series, own: pd.Series, host_counts: pd.Series, suffix_counts: pd.Series, said: pd.Series) -> pd.DataFrame:
        e, own = np.stack(e.to_numpy()), np.stack(own.to_numpy())
        prior = np.full_like(own, 1 / size)
        for counts in (np.broadcast_to(whole, own.shape), np.stack(suffix_counts.to_numpy()), np.stack(host_counts.to_numpy())):
            others = np.maximum(counts - own, 0)
            prior = (others + strength * prior) / (others.sum(axis=1, keepdims=True) + strength)
        at = {x: i for i, x in enumerate(names[:-1])}
        spoken = np.array([at.get(x, -1) for x in said])
        like = np.ones_like(own)
        known = spoken >= 0
        if size > 2:
            like[known] = (1 - reliability) / (size - 2)
            like[known, -1] = 1 / (size - 1)
            like[np.flatnonzero(known), spoken[known]] = reliability
        x = e + np.log(prior) + np.log(like)
        p = np.exp(x - x.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return pd.DataFrame({"language": np.array(names, object)[best], "posterior": p[np.arange(len(p)), best], "text_language": np.array(names, object)[own.argmax(axis=1)]})

    out = scored.join(priors, ["suffix", "host"]).withColumn("x", fuse("evidence", "own", "counts", "suffix_counts", "declared"))
    return out.select(F.col("key").alias(key), "x.language", "x.posterior", "x.text_language", "declared", "host", *more)


def page_columns(html: str = "html", url: str = "url") -> dict[str, Column]:
    """Text, declared language, host and address suffix of a web page."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    bare = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return {
        "text": F.regexp_replace(bare, r"&[#A-Za-z0-9]{1,10};|\s+", " "),
        "declared": F.regexp_extract(F.coalesce(F.col(html), F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z\-]+)", 1),
        "host": host,
        "suffix": F.regexp_extract(host, r"\.([^.]+)$", 1),
    }


def keep_known(docs: DataFrame, model: Model, least: float = 0.5, key: str = "doc_id", text: str = "text", declared: str = "lang", host: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known: the rest (language
    ``und``, or a posterior below ``least``) are anti-joined by key and text hash, a small
    table beside the documents."""
    named = identify(
        docs, model, key, text, F.col(declared).cast("string"), F.col(host).cast("string"), F.lit(""), also=[F.xxhash64(F.col(text)).alias("text_hash")]
    )
    out = named.where((F.col("language") == UNKNOWN) | (F.col("posterior") < least)).select(F.col(key).alias("out_key"), F.col("text_hash").alias("out_hash")).distinct()
    out = written(out, "unknown-language")
    same = docs[key].eqNullSafe(out["out_key"]) & (F.xxhash64(docs[text]) == out["out_hash"])
    return docs.join(out, same, "left_anti")
