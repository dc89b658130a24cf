"""Top-k search (op 2), sampled segmentations (op 3) and WARC revisits (op 7)."""

import base64
import gzip
import hashlib
import io
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from scriptorium.llm import search, subword_sampling, warc
from scriptorium.llm.common import read_bytes, scratch_path

from .conftest import TEXTS

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def brute_search(docs, queries, k):
    tf = [Counter(re.findall(r"\w+", (t or "").lower())) for _, t in docs]
    size = [sum(c.values()) for c in tf]
    mean, n = sum(size) / len(size), len(docs)
    df = Counter(t for c in tf for t in c)
    out = {}
    for q, terms in queries.items():
        scores = []
        for i, c in enumerate(tf):
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * size[i] / mean)) for t in terms if t in c)
            if s:
                scores.append((-s, docs[i][0] is None, docs[i][0] or 0))
        out[q] = [(None if null else d, -s) for s, null, d in sorted(scores)[:k]]
    return out


def check_search(rows, want):
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert set(got) == {q for q, x in want.items() if x}
    for q, x in got.items():
        assert [round(s, 6) for _, s in x] == [round(s, 6) for _, s in want[q]]
        ties = Counter(round(s, 6) for _, s in want[q])
        assert all(ties[round(s, 6)] > 1 or a == b for (a, s), (b, _) in zip(x, want[q], strict=True))


@pytest.mark.parametrize("shard", [16_384, 30])
def test_search_against_brute_force(spark, small_docs, shard, monkeypatch):
    monkeypatch.setattr(search, "WINDOW", 8)
    rows = [(r.doc_id, r.text) for r in small_docs.collect()]
    asked = {k: set(re.findall(r"\w+", t.lower())) for k, t in rows if k % 20 == 0}
    many = small_docs.repartition(6) if shard == 30 else small_docs
    check_search(search.search(many, small_docs.where("doc_id % 20 = 0"), k=7).collect(), brute_search(rows, asked, 7))


def test_pruned_windows_lose_nothing():
    rng = np.random.default_rng(8)
    b = search.Builder()
    words = [f"w{i}" for i in range(400)]
    p = 1 / np.arange(1, 401)
    for i in range(1500):
        b.add(i, 0, " ".join(rng.choice(words, rng.integers(0, 60), p=p / p.sum())))
    row = b.row().to_pylist()[0]
    s = search.Shard(row, row["n_words"] / row["n_docs"], 1.2, 0.75)
    idf = np.log(1 + 1500 / np.array(row["dfs"]))
    lists = np.repeat(np.arange(len(row["dfs"])), row["dfs"])
    asked = [rng.choice(len(idf), n, replace=False) for n in (1, 3, 40, 200, 1)]
    for t, (found, scores) in zip(asked, s.search([(t, idf[t]) for t in asked], 10), strict=True):
        every = np.zeros(1500)
        for x in t:
            every[s.docs[lists == x]] += s.impact[lists == x] * idf[x]
        top = np.sort(every[every > 0])[::-1][:10]
        assert np.allclose(np.sort(scores)[::-1][: len(top)], top)
        assert np.allclose(every[found], scores)


@pytest.mark.parametrize("common,cells", [(1, 10**6), (10**9, 10**6), (16, 3000)])
def test_results_do_not_depend_on_what_is_a_common_list(monkeypatch, common, cells):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 50))) for _ in range(300)]

    def results():
        b = search.Builder()
        for i, t in enumerate(texts + texts[:40]):
            b.add(i, 0, t)
        row = b.row().to_pylist()[0]
        s = search.Shard(row, row["n_words"] / row["n_docs"], 1.2, 0.75)
        idf = np.log(1 + 340 / s.dfs)
        asked = [np.array([s.term[w] for w in sorted(set(t.split()))]) for t in texts[:20]]
        out = []
        for found, scores in s.search([(t, idf[t]) for t in asked], 5):
            top = np.lexsort((s.keys[found], -scores))[:5]
            out.append((s.keys[found][top].tolist(), scores[top].tolist()))
        return out

    want = results()
    monkeypatch.setattr(search, "COMMON", common)
    monkeypatch.setattr(search, "COMMON_CELLS", cells)
    # Scores are equal to the last bit, and equal documents tie.
    assert results() == want
    ties = [(x[j + 1] - x[j], v[j + 1] == v[j]) for x, v in want for j in range(4) if x[j] < 40]
    assert ties.count((300, True)) > 20 and all(tied for gap, tied in ties if gap == 300)


def test_search_edges(spark, edge_docs, no_docs):
    rows = search.search(edge_docs, edge_docs.where("doc_id in (1, 3, 4, 8, 10, 11) or doc_id is null"), k=3).collect()
    asked = {1: TEXTS[0][1], 8: TEXTS[7][1], 10: "a", 11: "same key, first text same key, second text"}
    check_search(rows, brute_search(TEXTS, {k: set(re.findall(r"\w+", t.lower())) for k, t in asked.items()}, 3))
    assert search.search(no_docs, edge_docs).count() == 0
    assert search.search(edge_docs, no_docs).count() == 0


def segmentations(lat, text):
    out = []

    def go(at, ids, weight):
        if at == len(text):
            out.append((tuple(ids), weight))
        for n in range(1, lat.longest + 1):
            got = lat.pieces.get(text[at : at + n]) if at + n <= len(text) else None
            if got:
                i = got[0]
                go(at + n, [*ids, i], weight + got[1])

    go(0, [], 0.0)
    return out


@pytest.fixture(scope="module")
def lat():
    return subword_sampling.Lattices(MODEL, 10_000.0)


def test_one_number_is_that_of_the_arrays():
    seeds = np.array([0, 5, (1 << 64) - 3], np.uint64)
    for draw, a, b in ((0, 0, 0), (3, 1 << 41, 7), (9, 12, 1 << 30)):
        assert subword_sampling.uniform(seeds, draw, a, b).tolist() == [subword_sampling.number_at(int(x), draw, a, b) for x in seeds]


def test_samples_follow_the_distribution(lat):
    text = lat.lib.normalize("then on")
    every = segmentations(lat, text)
    total = np.logaddexp.reduce([w for _, w in every])
    p = {ids: math.exp(w - total) for ids, w in every}
    n = 6000
    seeds = np.random.default_rng(1).integers(0, 1 << 63, n, dtype=np.uint64)
    drawn, kappas = subword_sampling.sample_batch(lat, seeds, [text] * n, 3)
    first, second, weight = Counter(), Counter(), Counter()
    for got, kappa in zip(drawn, kappas, strict=True):
        ids = [tuple(subword_sampling.ids_of(lat, path).tolist()) for _, path in got]
        values = [v for v, _ in got]
        assert len(set(ids)) == 3 and values == sorted(values, reverse=True) and values[-1] > kappa
        assert all(abs(math.exp(path.logp) - p[i]) < 1e-9 for i, (_, path) in zip(ids, got, strict=True))
        first[ids[0]] += 1
        second[ids[1]] += 1
        for i in ids:
            weight[i] += 1 / (1 - math.exp(-math.exp(math.log(p[i]) - kappa)))
    top = sorted(p, key=p.get)[::-1][:6]
    for i in top:
        then = sum(p[j] * p[i] / (1 - p[j]) for j in p if j != i)
        assert abs(first[i] / n - p[i]) < 4 * math.sqrt(p[i] / n)
        assert abs(second[i] / n - then) < 4 * math.sqrt(then / n)
    # Inverse inclusion probabilities estimate one for each segmentation.
    assert all(abs(weight[i] / n - 1) < 0.15 for i in top[:3])


def test_all_segmentations_of_a_short_text(lat):
    text = lat.lib.normalize("abc")
    every = {ids for ids, _ in segmentations(lat, text)}
    drawn, kappas = subword_sampling.sample_batch(lat, np.arange(30, dtype=np.uint64), [text] * 30, len(every) + 3)
    for got, kappa in zip(drawn, kappas, strict=True):
        assert {tuple(subword_sampling.ids_of(lat, path).tolist()) for _, path in got} == every and len(got) == len(every) and kappa is None


def test_a_batch_looks_each_distinct_word_up_once(lat):
    class Asked(dict):
        times = 0

        def get(self, *args):
            self.times += 1
            return super().get(*args)

    texts = [lat.lib.normalize(x) for x in ["then the then on \u4e2d the\n" * 20, "", "the \U0001f600 then", "on on"] * 30]
    seeds = np.arange(len(texts), dtype=np.uint64)
    lat.clear()
    want, kappas = subword_sampling.sample_batch(lat, seeds, texts, 3)
    lat.at = Asked(lat.at)
    drawn, again = subword_sampling.sample_batch(lat, seeds, texts, 3)
    joined, begins, counts = lat.units(texts)
    words = [x.decode("utf-32-le") for x in (joined[4 * a : 4 * b] for a, b in zip(begins, [*begins[1:], len(joined) // 4], strict=True))]
    assert "".join(words) == "".join(texts) and len(words) == counts.sum() > 20 * len(set(words))
    assert lat.at.times <= len(set(words)) and again == kappas
    # Ids and texts worked out for many paths at once are those of each path alone.
    paths, whole = [p for got in drawn for _, p in got], [t for t, got in zip(texts, drawn, strict=True) for _ in got]
    for (ids, said), path, first, text in zip(subword_sampling.spelt_out(lat, paths), paths, (p for got in want for _, p in got), whole, strict=True):
        assert ids.tolist() == subword_sampling.ids_of(lat, path).tolist() and path.edges.tolist() == first.edges.tolist()
        assert said == subword_sampling.decoded(lat, ids) == text.encode()
    assert subword_sampling.sample_batch(lat, seeds[:2], ["", ""], 2)[1] == [None, None]


@pytest.mark.parametrize("temperature", [10_000.0, 0.02])
def test_mass_of_the_other_edges(temperature):
    lat = subword_sampling.Lattices(MODEL, temperature)
    lat.learn([lat.lib.normalize("then the others on, x\u4e2d")])
    _, cdf, logp, *_ = lat.tables
    rest = lat.rest(np.arange(len(cdf)))
    ends = [0, *(np.flatnonzero(cdf == 2.0) + 1).tolist()]
    sure = 0
    for lo, hi in zip(ends, ends[1:], strict=False):
        for e in range(lo, hi):
            want = np.logaddexp.reduce([logp[x] for x in range(lo, hi) if x != e])
            assert rest[e] == want or abs(rest[e] - want) < 1e-6
            sure += hi > lo + 1 and logp[e] > -1e-6
    assert sure


def test_sampling_edges_and_decoding(spark, edge_docs, no_docs):
    rows = subword_sampling.sample_segmentations(edge_docs, MODEL, k=2, with_ids=True)
    back = subword_sampling.decode(rows, MODEL, "ids", "again").collect()
    assert all(r.decodes for r in back)
    texts = Counter((k, t or "") for k, t in TEXTS)
    for r in back:
        assert (r.doc_id, r.again) in texts or r.again == ""
    # The empty text has one segmentation; 'a' has the few that its lattice holds.
    assert [(r.sample, r.n_tokens, r.log_inclusion) for r in back if r.doc_id in (3, 4)] == [(1, 0, 0.0)] * 2
    same = [[(r.sample, tuple(r.ids)) for r in back if r.doc_id == 10 and r.sample == 1]]
    assert len(same[0]) == 2 and same[0][0] == same[0][1]
    other = subword_sampling.sample_segmentations(edge_docs.repartition(1), MODEL, k=2).collect()
    assert sorted((r.doc_id or -1, r.sample, r.ids_crc32) for r in other) == sorted((r.doc_id or -1, r.sample, r.ids_crc32) for r in back)
    assert subword_sampling.sample_segmentations(no_docs, MODEL).count() == 0


def brute_warc(rows, least):
    body = [(k, (t or "").encode()) for k, t in rows]
    out = []
    for k, b in body:
        most = max((i for i, x in body if x == b and i is not None), default=None)
        revisit = k is not None and len(b) >= least and k != most
        out.append((k or -1, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", most if revisit else -1))
    return sorted(out)


@pytest.mark.parametrize("least", [0, 5])
def test_warc_revisits(spark, least):
    rows = [(1, "<p>a</p>"), (2, "<p>a</p>"), (3, None), (4, ""), (5, "é�\r\n\r\nWARC/1.1"), (6, "x" * 200_000), (7, "<p>a</p>"), (8, "ab"), (9, "ab"), (None, "<p>a</p>"), (None, "q")]
    df = spark.createDataFrame([(k, f"http://h/{k}\r\nX: y" if k == 1 else (None if k == 2 else "http://h/"), t, 1, 1) for k, t in rows], "page_id long, url string, html string, id int, file int")
    files, records = warc.deduplicate(df.repartition(3), "page_id", "url", "html", least)
    got = sorted((r.id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in records.collect())
    assert got == brute_warc(rows, least)
    # The archives are plain gzip members that any reader takes, one after the other.
    data = b"".join(gzip.GzipFile(fileobj=io.BytesIO(bytes(read_bytes(r.file)))).read() for r in files.collect())
    kept = {k: t for k, t in rows if t and any(g[0] == (k or -1) and g[3] == "response" for g in got)}
    assert all(t.encode() in data for t in kept.values())
    assert data.count(b"WARC-Type: revisit") == sum(g[3] == "revisit" for g in got) == data.count(b"WARC-Refers-To: <urn:uuid:")
    assert b"\r\nX: y" not in data
    assert warc.deduplicate(df.limit(0), "page_id", "url", "html")[1].count() == 0


def test_revisits_already_in_an_archive(spark):
    """Records of old archives: a revisit is pointed at the response that stays."""
    folder = scratch_path(spark, "test-warc")
    df = spark.createDataFrame([(1, "u", "same"), (2, "u", "same"), (3, "u", "other")], "page_id long, url string, html string")
    first, _ = warc.deduplicate(df, "page_id", "url", "html")
    headers = warc.scan_headers(spark, first)
    again = warc.rewrite(warc.revisit_decisions(headers), folder)
    got = {r.id: (r.record_type, r.refers_to) for r in warc.resolve_revisits(warc.scan_headers(spark, again)).collect()}
    assert got == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None)}


def test_foreign_archive_keeps_other_records_and_headers(spark):
    folder = scratch_path(spark, "test-foreign")
    http = lambda body: b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\n" + body

    def record(kind, name, block, **more):
        head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Target-URI", f"http://h/{name}"), ("Content-Type", f"application/http; msgtype={kind}")]
        return warc.record_bytes(head + [(k.replace("_", "-"), v) for k, v in more.items()], block)

    fs, root = warc.shared_fs(folder)
    fs.create_dir(root, recursive=True)
    request = record("request", "q1", b"GET / HTTP/1.1\r\n\r\n", WARC_Date="2011-01-01T00:00:00Z")
    parts = [
        record("warcinfo", "i", b"software: x\r\n"), request,
        record("response", "a", http(b""), WARC_Date="2011-01-01T00:00:00Z", X_Row_ID="1"), record("request", "q2", b""),
        record("response", "b", http(b"same"), WARC_Date="2012-02-02T00:00:00Z", WARC_IP_Address="192.0.2.1", X_Row_ID="2"),
        record("response", "c", http(b"same"), WARC_Date="2013-03-03T00:00:00Z", WARC_IP_Address="192.0.2.2", X_Row_ID="3"),
    ]
    with fs.open_output_stream(f"{root}/old.warc.gz", compression=None) as f:
        f.write(b"".join(parts))
    files = spark.createDataFrame([(f"{folder}/old.warc.gz", len(parts))], warc.FILES)
    headers = warc.scan_headers(spark, files)
    new = warc.rewrite(warc.revisit_decisions(headers), folder + "-new").collect()
    data = b"".join(bytes(read_bytes(r.file)) for r in new)
    assert request in data and parts[0] in data and parts[3] in data
    got = {h["warc-target-uri"][-1]: (h, block) for r in new for _, _, h, block, _ in warc.records_of(r.file)}
    kinds = {k: h["warc-type"] for k, (h, _) in got.items()}
    assert kinds == {"i": "warcinfo", "1": "request", "2": "request", "a": "response", "b": "revisit", "c": "response"}
    assert [got[k][0]["warc-date"][:4] for k in "abc"] == ["2011", "2012", "2013"]
    assert [got[k][0]["warc-ip-address"] for k in "bc"] == ["192.0.2.1", "192.0.2.2"]
    assert got["b"][0]["warc-refers-to"] == got["c"][0]["warc-record-id"] and got["c"][1] == http(b"same")


def test_date_of_new_records(spark):
    df = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    for date in ("2001-01-01T00:00:00Z", None):
        before = warc.now()
        files, _ = warc.deduplicate(df, "page_id", "url", "html", date=date)
        (got,) = [h["warc-date"] for r in files.collect() for _, _, h, _, _ in warc.records_of(r.file)]
        assert got == date if date else before <= got <= warc.now()
