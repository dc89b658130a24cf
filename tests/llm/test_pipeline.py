"""The pipeline against brute force, and that nothing else needs the subpackage."""

import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import numpy as np
from scriptorium.llm.common import local_roots

from .conftest import SF001, TEXTS
from .test_similar import fingerprint

REPO = Path(__file__).resolve().parents[2]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
    every = {r.doc_id for r in docs.collect()}
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF001)
        assert out.columns == docs.columns
        if n == 2:
            rows = docs.collect()
            fps = np.array([fingerprint(r.text) for r in rows], np.uint64)
            a, b = np.where(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
            root = local_roots(a, b, len(rows))
            low = {}
            for r, x in zip(rows, root, strict=True):
                low[x] = min(low.get(x, r.doc_id), r.doc_id)
            assert {r.doc_id for r in out.collect()} == set(low.values())
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept = {r.doc_id for r in docs.collect()}
        if n == 0:
            # The table is too small for the models to tell languages from quality; see test_quality_of_the_choice.
            assert not kept & {k for k, q in labels.items() if q == 0}
        if n == 1:
            assert kept == every
        every = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF001).collect()
    assert {r.doc_id for r in packed} == every


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF001)
        assert docs.count() == 0


def test_near_copies_of_repeated_rows_and_ids(spark, edge_docs):
    """One row of each group stays: repeated rows, null ids, one id with two texts."""
    fps = np.array([fingerprint(t) for _, t in TEXTS], np.uint64)
    root = local_roots(*np.where(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2), len(TEXTS))
    want = sorted(min((k is None, k or 0) for (k, _), x in zip(TEXTS, root, strict=True) if x == r) for r in set(root))
    out = corpus_pipeline.drop_near_copies(spark, edge_docs, SF001)
    assert out.columns == edge_docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == want
    rows = [(3, "A"), (11, "A"), (11, "B"), (None, "c d"), (None, "c d"), (7, "e"), (7, "e"), (7, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, SF001).collect()]
    assert sorted(got, key=str) == sorted([(3, "A"), (11, "B"), (None, "c d"), (7, "e")], key=str)


def test_the_rest_imports_without_the_subpackage(tmp_path):
    """Without llm and the pipeline the other queries are registered; an error inside is raised."""
    code = """
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("scriptorium.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
q = e.queries()
assert "chunk_corpus" in q and "pipeline" not in q and not any(x.startswith("op") for x in q)
"""
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)
