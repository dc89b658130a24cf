"""Corpus pipeline: the stages that turn ``documents`` into packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet and reads again as the next stage's documents; all but the last return the columns
of ``documents``. No stage can be said in SQL (trained models, fingerprints, a packing), so
each is tested against a brute-force version (``tests/llm``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.llm import importance, language
from scriptorium.llm.common import scratch_path, written
from scriptorium.llm.packing import pack
from scriptorium.llm.queries import TEMPERATURE, table, tokenizer_file
from scriptorium.llm.simhash import simhash_components

SHINGLE_WORDS, MOST_BITS, CAPACITY = 3, 2, 2048


def resample_quality(spark, docs, sf_dir):
    """Quality classifier: what importance resampling does not draw goes."""
    return importance.keep_good(docs, table(spark, sf_dir, "labels"), temperature=TEMPERATURE)


def keep_known_languages(spark, docs, sf_dir):
    """Language ID: documents in no known language go; models are fitted on these documents."""
    return language.keep_known(docs, language.fit(docs))


def drop_near_copies(spark, docs, sf_dir):
    """SimHash near-dedup: of each group one row stays, the one with the smallest id (a row
    without an id only if no row of the group has one), then the smallest text hash. Rows are
    told apart by a written number, as ids and whole rows may be repeated."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "numbered-documents")
    texts = rows.select("row", F.col("doc.doc_id").alias("id"), F.col("doc.text").alias("text"))
    found = simhash_components(texts, SHINGLE_WORDS, MOST_BITS, key="row").select(F.col("doc_id").alias("row"), "component_id")
    first = F.struct(F.col("id").isNull(), "id", F.xxhash64("text"), "row")
    keys = texts.select("row", first.alias("first"))
    stay = found.join(keys, "row").groupBy("component_id").agg(F.min("first").alias("first"))
    return rows.join(stay.select(F.col("first.row").alias("row")), "row", "left_semi").select("doc.*")


def pack_sequences(spark, docs, sf_dir):
    """Best-fit packing of what is left."""
    return pack(docs, tokenizer_file("word_bpe_49k.json"), CAPACITY)


STAGES = [
    ("quality classifier", resample_quality),
    ("language id", keep_known_languages),
    ("simhash near-dedup", drop_near_copies),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
