"""Importance resampling (op 6), language identification (op 10), license scan (op 9)."""

import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from scriptorium.llm import importance, language, license_scan, ngrams
from scriptorium.llm.ngrams import Texts
from scriptorium.llm.queries import QUERIES
from scriptorium.plans import verify

from .conftest import EXTRA, SF001, TEXTS


def test_gram_counts_sums_and_repeats():
    texts = ["abcde", "", None, "ab", "die die\n die  das Das", "x", "die"]
    x = Texts(texts)
    for n in (3, 4):
        at = x.buckets(n, 16)
        want = [[t.encode()[i : i + n] for i in range(len(t.encode()) - n + 1)] for t in (t or "" for t in texts)]
        one = lambda g: (int.from_bytes(g, "little") * 0x9E3779B1 & 0xFFFFFFFF) >> 16
        counts = x.counts(at, n, 1 << 16)
        flat = [one(g) for w in want for g in w]
        assert counts.sum() == len(flat) and all(counts[b] == flat.count(b) for b in flat)
        values = np.arange(1 << 16)
        assert x.sums(values[at], n).tolist() == [sum(map(one, w)) for w in want]
        assert x.grams(n).tolist() == [len(w) for w in want]
    same, other = x.repeats()
    assert same.tolist() == [0, 0, 0, 0, 2, 0, 0] and other.tolist() == [0, 0, 0, 0, 2, 0, 0]


@pytest.mark.parametrize("block", [1, 5, 64, 1 << 17])
def test_gram_counts_sums_and_repeats_by_block(monkeypatch, block):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["die", "d\u00efe", "a", "", "\n", "longerword" * 3]) for _ in range(rng.randint(0, 60))) for _ in range(40)] + [None, "", "ab", "x" * 300]
    whole = Texts(texts)
    monkeypatch.setattr(ngrams, "BLOCK", 1 << 20)
    repeats = [x.tolist() for x in whole.repeats()]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert repeats[0] == [sum(a == b for a, b in zip(w, w[1:], strict=False)) for w in words]
    monkeypatch.setattr(ngrams, "BLOCK", block)
    values = np.random.default_rng(5).integers(-(1 << 20), 1 << 20, 1 << 16)
    for part in (texts, texts[:1], ["ab"], [None], [""], texts[-1:]):
        x = Texts(part)
        for n in (3, 4):
            at = x.buckets(n, 16)
            assert x.gram_counts(n, 16).tolist() == x.counts(at, n, 1 << 16).tolist()
            assert x.gram_sums(values, n, 16).tolist() == x.sums(values[at], n).tolist()
    assert [x.tolist() for x in whole.repeats()] == repeats


def test_a_long_text_takes_little_more_than_its_own_room():
    text = "meadow window lantern " * 100_000
    weight = np.arange(importance.OTHER + 1)
    small = importance.log_weights(weight, pa.array([text[:1000]]))
    tracemalloc.start()
    x = Texts([text])
    x.repeats()
    got = importance.log_weights(weight, pa.array([text, text[:1000], None]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[1] == small[0] and got[2] == 0
    assert peak < 24 * len(text)


def corpus(spark, n=240, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        words = [rng.choice(["river", "stone", "meadow", "lantern", "window", "garden"]) for _ in range(rng.randint(5, 60))]
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + "."
        rows.append((i, text, "en", "s", len(text), *([0] * len(EXTRA))))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in EXTRA))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def brute_log_weights(docs, good):
    grams = lambda t: [t.encode()[i : i + 4] for i in range(len(t.encode()) - 3)]
    one = lambda g: (int.from_bytes(g, "little") * 0x9E3779B1 & 0xFFFFFFFF) >> 16

    def words(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return [a == b for a, b in zip(w, w[1:], strict=False)]

    raw, target, same_raw, same_target = [0] * 65536, [0] * 65536, [0, 0], [0, 0]
    for k, t in docs:
        for g in grams(t):
            raw[one(g)] += 1
            target[one(g)] += k in good
        for s in words(t):
            same_raw[s] += 1
            same_target[s] += k in good
    of_grams, of_words = sum(target) / sum(raw), sum(same_target) / sum(same_raw)
    gram = lambda i: math.log((target[i] + 5) / (raw[i] * of_grams + 5))
    word = lambda i: math.log((same_target[i] + 5) / (same_raw[i] * of_words + 5))
    return {k: sum(gram(one(g)) for g in grams(t)) + sum(word(s) for s in words(t)) for k, t in docs}


def test_importance_weights_and_choice_against_brute_force(spark):
    docs, labels = corpus(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    want = brute_log_weights(rows, good)
    weight = importance.fit(docs, labels)
    log_weight, noise = importance.with_keys(docs, weight, 42, 0.5)
    scored = {r.doc_id: r for r in docs.select("doc_id", log_weight.alias("w"), noise.alias("g")).collect()}
    assert all(abs(scored[k].w - want[k]) < 1e-2 for k in want)
    for keep in (None, 17):
        n = sum(r.w > 0 for r in scored.values()) if keep is None else keep
        keys = {k: r.w / 0.5 + r.g for k, r in scored.items()}
        chosen = set(sorted(keys, key=keys.get)[-n:])
        assert {r.doc_id for r in importance.resample(docs, labels, keep, temperature=0.5).collect()} == chosen
        kept = importance.keep_good(docs, labels, keep, temperature=0.5)
        assert {r.doc_id for r in kept.collect()} == chosen and kept.columns == docs.columns
    assert not any(k % 6 == 0 for k in (r.doc_id for r in importance.resample(docs, labels, temperature=0.25).collect()))


def test_quality_of_the_choice(spark):
    """Held out: fitted on labels of even documents, judged on those of odd ones."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    kept = importance.resample(docs, labels.where("doc_id % 2 = 0"), temperature=0.25).select("doc_id")
    share = {r.quality: r.s for r in labels.where("doc_id % 2 = 1").join(kept.withColumn("in", F.lit(1)), "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("in", F.lit(0))).alias("s")).collect()}
    assert share[1] >= 0.98 and share[0] <= 0.03


def test_gumbel_top_k_draws_in_proportion(spark):
    # One draw out of rows with weights 1 : 2 : 5, over many seeds.
    hits = dict.fromkeys("abc", 0)
    df = spark.createDataFrame([("a", 0.0), ("b", math.log(2)), ("c", math.log(5))], "id string, w double")
    u = (F.shiftrightunsigned(F.xxhash64("id", F.lit("t"), "seed"), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    rows = df.crossJoin(spark.range(4000).withColumnRenamed("id", "seed")).withColumn("g", F.col("w") - F.log(-F.log(u)))
    for r in rows.groupBy("seed").agg(F.max_by("id", "g").alias("id")).collect():
        hits[r.id] += 1
    assert [round(hits[x] / 4000, 1) for x in "abc"] == [0.1, 0.2, 0.6] or abs(hits["c"] / 4000 - 0.625) < 0.03


@pytest.mark.parametrize("together", [5, 50_000])
def test_kth_largest(spark, together):
    values = [random.Random(2).gauss(0, 1e6) for _ in range(500)] + [3.5] * 40
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 7, 270, 540):
        assert importance.kth_largest(df, k, together) == sorted(values, reverse=True)[k - 1]
    assert importance.kth_largest(df, 541, together) is None and importance.kth_largest(df, 0, together) is None


def test_importance_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (8, 1, 0), (9, 1, 0), (None, 1, 0), (10, None, 0)], "doc_id long, quality int, toxic int")
    kept = importance.keep_good(edge_docs, labels)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(10) in (0, 2) and {8, 9} <= set(ids)
    assert importance.resample(no_docs, labels).count() == 0
    assert importance.keep_good(no_docs, labels.limit(0)).count() == 0
    assert {r.good_id for r in importance.good_documents(labels).collect()} == {8, 9}


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.where("doc_id % 2 = 0"))
    rest = docs.where("doc_id % 2 = 1")
    got = language.identify(rest, model, "doc_id", "text", F.lit(""), F.col("source"), F.lit(""))
    right = got.join(rest.select("doc_id", "lang"), "doc_id").where("language = lang").count()
    assert right >= 0.98 * rest.count()


def brute_identify(rows, logs, languages, reliability=0.9, strength=5.0):
    """rows: (text, declared, host, suffix); Bayes' rule, one row at a time."""
    size = len(languages)
    gram = lambda g: (int.from_bytes(g, "little") * 0x9E3779B1 & 0xFFFFFFFF) >> 17
    ev, own = [], []
    for t, *_ in rows:
        b = (t or "").encode().lower()
        g = [gram(b[i : i + 3]) for i in range(len(b) - 2)]
        e = [sum(logs[j][x] for x in g) / language.UNIT / math.sqrt(max(len(g), 1)) for j in range(size)]
        z = sum(math.exp(x - max(e)) for x in e)
        ev.append(e)
        own.append([math.exp(x - max(e)) / z for x in e])
    out = []
    for i, (_, said, host, suffix) in enumerate(rows):
        prior = [1 / size] * size
        for level in (lambda r: True, lambda r: r[3] == suffix, lambda r: r[3] == suffix and r[2] == host):
            c = [sum(own[j][x] for j in range(len(rows)) if j != i and level(rows[j])) for x in range(size)]
            prior = [(c[x] + strength * prior[x]) / (sum(c) + strength) for x in range(size)]
        like = [1.0] * size
        if said in languages[:-1]:
            like = [reliability if x == said else (1 - reliability) / (size - 2) for x in languages[:-1]] + [1 / (size - 1)]
        s = [math.exp(ev[i][x] - max(ev[i])) * prior[x] * like[x] for x in range(size)]
        out.append((languages[s.index(max(s))], max(s) / sum(s)))
    return out


def test_language_fusion_against_brute_force(spark):
    lab = spark.createDataFrame([("the cat and the dog sat there then", "en"), ("der hund und die katze sassen dort", "de"), ("le chat et le chien sont la", "fr"), (None, "fr"), ("x", None)], "text string, lang string")
    model = language.fit(lab)
    assert model.languages == ["de", "en", "fr", "und"]
    rows = [("the dog", "en", "a.com", "com"), ("die", "", "b.de", "de"), ("", "de", "b.de", "de"), (None, "xx", "b.de", "de"), ("the", "fr", "a.com", "com"), ("中文字符", "", "", ""), ("le chien", "", "c.fr", "fr"), ("q", "", "a.com", "com"), ("the dog", "en", "a.com", "com")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, text string, said string, site string, ending string")
    got = {r.i: r for r in language.identify(df, model, "i", "text", *[df[c] for c in ("said", "site", "ending")]).collect()}
    want = brute_identify(rows, model.logs.tolist(), model.languages)
    for i, (lang, p) in enumerate(want):
        assert got[i].language == lang and abs(got[i].posterior - p) < 1e-6
    assert language.identify(df.limit(0), model, "i", "text", *[df[c] for c in ("said", "site", "ending")]).count() == 0


def test_page_columns(spark):
    df = spark.createDataFrame([("http://u@Www.Example.ORG:80/p", '<HTML class=x lang="De-at"><script>var a="<p>"</script><!-- x --><p>Hallo&amp;Welt</p>'), (None, None), ("no address", "plain")], "url string, html string")
    c = language.page_columns()
    rows = [tuple(r) for r in df.select(*[c[x] for x in ("text", "declared", "host", "suffix")]).collect()]
    assert rows[0][0].split() == ["Hallo", "Welt"] and rows[0][1:] == ("De-at", "www.example.org", "org")
    assert rows[1] == (None, "", "", "") and rows[2] == ("plain", "", "", "")


def test_keep_known_edges(spark, edge_docs, no_docs):
    labelled = spark.read.parquet(f"{SF001}/documents.parquet")
    model = language.fit(labelled)
    known = labelled.where("lang = 'en'").first().text
    edge_docs = edge_docs.withColumn("text", F.when(F.col("doc_id").isin(1, 2, 10), F.lit(known)).otherwise(F.col("text")))
    docs = edge_docs.union(edge_docs.limit(1).withColumn("doc_id", F.lit(77).cast("long")).withColumn("text", F.lit("中文字符" * 50)).withColumn("lang", F.lit("zh")))
    kept = language.keep_known(docs, model)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 77 not in ids and 1 in ids and ids.count(10) == 2
    assert language.keep_known(no_docs, model).count() == 0
    assert language.fit(no_docs).languages == ["und"]


def test_license_scan_matches_sql(spark):
    fn, sql = QUERIES["op9_license_scan"]
    df = fn(spark, SF001)
    cur = verify.duck(SF001).execute(sql)
    want = verify.digest([c[0] for c in cur.description], cur.fetchall())
    assert verify.digest(df.columns, [tuple(r) for r in df.collect()])[0] == want[0]


def test_license_scan_finds_copies_and_changed_copies(spark):
    rng = random.Random(4)
    noise = lambda n: " ".join("".join(rng.choice("bcdfgklmnoprstu") for _ in range(6)) for _ in range(n))
    rows = [(i, f"{noise(rng.randint(0, 40))} {t.upper()} {noise(rng.randint(0, 9))}", name) for i, (name, t) in enumerate(license_scan.TEMPLATES * 4)]
    grant = dict(license_scan.TEMPLATES)["mit-grant"].split()
    changed = [*grant[:30], "gratis", *grant[31:]]
    rows += [(100, " ".join(changed), "mit-grant"), (101, " ".join(grant[:20]), None), (102, noise(300), None)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {(r.doc_id, r.template) for r in license_scan.license_matches(df).collect()}
    assert {(i, n) for i, _, n in rows if n} <= got
    assert not [x for x in got if x[0] in (101, 102)]


def test_license_scan_edges(spark, edge_docs, no_docs):
    got = [(r.doc_id, r.template, r.containment, r.first_word, r.last_word) for r in license_scan.license_matches(edge_docs).collect()]
    assert got == [(9, "mit-line", 1.0, 0, 4)]
    short = license_scan.license_matches(edge_docs, [("letter", "A."), ("fox", TEXTS[0][1])])
    assert sorted((r.doc_id, r.template) for r in short.collect()) == [(1, "fox"), (2, "fox"), (10, "letter")]
    assert license_scan.license_matches(no_docs).count() == 0
    with pytest.raises(ValueError):
        license_scan.license_matches(edge_docs, [("none", " .. ")])
