"""SimHash (op 5), embeddings (op 4) and connected components against brute force."""

import re

import numpy as np
import pytest
import xxhash
from scriptorium.llm import embedding_dedup, simhash
from scriptorium.llm.common import connected_components, local_roots

from .conftest import TEXTS


def classes(pairs):
    """Sets of nodes from (node, name) pairs."""
    out = {}
    for node, name in pairs:
        out.setdefault(name, set()).add(node)
    return sorted(map(sorted, out.values()))


def fingerprint(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64(" ".join(w[i : i + words]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for _, t in TEXTS:
        assert simhash.fingerprint(t) == fingerprint(t)
    assert simhash.fingerprint("A B\x0bC\x0cD É") == fingerprint("A B\x0bC\x0cD É")
    assert simhash.fingerprint("a b c\x1cd") == fingerprint("a b c\x1cd")


def test_gray_rank_orders_the_gray_code():
    n = np.arange(4096, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


@pytest.mark.parametrize("segment", [1 << 16, 90, 13])
def test_links_are_those_of_all_pairs(spark, segment):
    rng = np.random.default_rng(3)
    fps = set(rng.integers(0, 1 << 63, 150, dtype=np.uint64).tolist()) | {0, (1 << 64) - 1, 1 << 63}
    for x in list(fps):
        for _ in range(4):
            for b in rng.integers(0, 64, rng.integers(1, 5)).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
    a, b = np.where(apart <= 2)
    root = local_roots(a, b, len(fps))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {r.node: r.component for r in connected_components(simhash.fingerprint_links(df, 2, segment)).collect()}
    ids = fps.view(np.int64).tolist()
    assert classes((x, found.get(x, x)) for x in ids) == classes(zip(ids, root.tolist(), strict=True))


def test_components_of_a_corpus(spark, small_docs):
    docs = small_docs.collect()
    fps = np.array([fingerprint(r.text) for r in docs], np.uint64)
    a, b = np.where(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    root = local_roots(a, b, len(docs))
    low = {}
    for r, x in zip(docs, root, strict=True):
        low[x] = min(low.get(x, r.doc_id), r.doc_id)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(small_docs).collect()}
    assert got == {r.doc_id: ("%016x" % f, low[x]) for r, f, x in zip(docs, fps.tolist(), root, strict=True)}


def test_simhash_edges(spark, edge_docs, no_docs):
    rows = simhash.simhash_components(edge_docs).collect()
    assert sorted((r.doc_id or -1, r.fingerprint) for r in rows) == sorted((k or -1, "%016x" % fingerprint(t)) for k, t in TEXTS)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    zero = "0" * 16
    assert by[2, "%016x" % fingerprint(TEXTS[1][1])] == 1
    # Null, empty and blank texts share fingerprint zero; a null key never names the group.
    assert {by[3, zero], by[4, zero], by[5, zero], by[None, zero]} == {3}
    assert by[None, "%016x" % fingerprint("a text without a key")] is None
    assert simhash.simhash_components(no_docs).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(1000, 1200)] + [(7, 7), (None, 3), (9, 8), (8, 9)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = dict.fromkeys(range(100, 161), 100) | dict.fromkeys([5, *range(1000, 1200)], 5) | {9: 8, 8: 8}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(vectors, least):
    unit = {k: np.array(v, float) / np.linalg.norm(v) for k, v in vectors.items()}
    ids = list(unit)
    m = np.stack([unit[i] for i in ids])
    near = m @ m.T >= least
    a, b = np.where(near)
    root = local_roots(a, b, len(ids))
    low = {x: min(i for i, y in zip(ids, root, strict=True) if y == x) for x in set(root.tolist())}
    return {i: (int(near[j].sum()) - 1, low[root[j]], i == low[root[j]]) for j, i in enumerate(ids)}


@pytest.mark.parametrize("block", [2048, 40])
def test_embeddings_against_all_pairs(spark, block):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 32))
    rows = [base[i % 60] + rng.standard_normal(32) * rng.choice([0.05, 0.15, 0.25]) for i in range(260)]
    rows += [base[0] + rng.standard_normal(32) * 0.05 for _ in range(150)] + [rows[3]] * 5 + [rows[3] * 2]
    vectors = {i: v.tolist() for i, v in enumerate(rows)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_components(df, block=block).collect()}
    want = brute(vectors, 0.95)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(x[0] for x in got.values()) >= 0.97 * sum(x[0] for x in want.values())
    assert got[0] == want[0] or got[0][0] >= 0.97 * want[0][0]


def test_embedding_edges(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [(1, v), (2, [x * 1e300 for x in v]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]), (7, [1.0, float("nan"), 3.0]), (8, [float("inf"), 1.0, 1.0]), (9, w), (9, w), (None, v), (None, None), (10, [1.0, 2.0]), (11, [-0.0, 1.0, 0.0]), (12, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 1, 1) for r in rows], "vec_id long, embedding array<double>, c int, t int, bucket int")
    got = sorted(((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in embedding_dedup.embedding_components(df).collect()))
    want = [(1, 2, 1, True), (2, 2, 1, False), (-1, 2, 1, False), (-1, 0, -1, False), (9, 1, 9, True), (9, 1, 9, True), (10, 0, 10, True), (11, 1, 11, True), (12, 1, 11, False)]
    want += [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8)]
    assert got == sorted(want)
    assert embedding_dedup.embedding_components(df.limit(0)).count() == 0
