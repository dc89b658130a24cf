"""Periodic runs (op 12) against a search over every period."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from scriptorium.llm.periodic_runs import LinkCutForest, periodic_runs, repetitions, runs_of, suffix_automaton, without_repeats
from scriptorium.llm.queries import run_digests, with_repeated_tails

from .conftest import TEXTS


def every_run(w, least=24, exponent=3):
    """For each period the stretches that keep it, those with a smaller one left out."""
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            start = i - q
            if j - start >= max(least, exponent * q) and not any(w[start + r : j] == w[start : j - r] for r in range(1, q)):
                out.append((start, j - start, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def made(rng, n, kinds):
    w = [rng.randint(0, kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 3:
            a = rng.randrange(n)
            p, b = rng.randint(1, max(1, (n - a) // 3)), min(n, a + rng.randint(1, n))
            w[a:b] = [w[a + (i - a) % p] for i in range(a, b)]
    return w


@pytest.mark.parametrize("least,exponent", [(24, 3), (6, 2), (9, 3), (2, 2), (40, 4)])
def test_runs_of_random_texts(least, exponent):
    rng, total = random.Random(least), 0
    for _ in range(400):
        w = made(rng, rng.randint(0, 160), rng.choice([1, 2, 4, 60]))
        text = b" \t".join(b"w%d" % x for x in w)
        got = runs_of([text, b"", text], least, exponent)
        want = every_run(w, least, exponent)
        total += len(want)
        assert got[0][1] == got[2][1] == want and got[1] == ([], [])
    assert total > 50


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_automaton_alone_finds_every_run(w):
    found = repetitions(w, 2, 2)
    assert sorted((s, e - s + 1, p) for (s, p), e in found.items()) == sorted(every_run(w, 2, 2))


def test_access_crosses_the_segments_of_last_occurrences():
    w = [0, 1, 0, 0, 1, 0, 1, 1, 0, 0, 1, 0]
    link, length, ends = suffix_automaton(w)
    link[0] = 0
    forest = LinkCutForest(list(link))
    for i, state in enumerate(ends):
        last = {}  # length of a suffix of prefix i -> where it ended last before i
        for n in range(1, i + 2):
            last[n] = max((e for e in range(n - 1, i) if w[e - n + 1 : e + 1] == w[i - n + 1 : i + 1]), default=-1)
        want = {}
        for n, e in last.items():
            if e >= 0:
                want[e] = max(want.get(e, 0), n)
        assert {e: length[v] for v, e in forest.access(state, i) if e >= 0} == want


def brute_row(i, text):
    w = (text or "").encode().split()
    n = len(w)
    if i is not None and n and zlib.crc32(str(i).encode()) % 10 == 0:
        g = zlib.crc32(str(i).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w[a:] = [w[a + (x - a) % p] for x in range(a, n)]
    runs = every_run(w)
    gone = {x for s, n_, q in runs for x in range(s + q, s + n_)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    lines = "".join(f"{s},{n_},{q}\n" for s, n_, q in runs).encode()
    kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(kept))


def test_digests_of_a_corpus_and_of_edges(small_docs, edge_docs, no_docs):
    short = small_docs.where("length(text) < 6000")
    for docs in (short, edge_docs.where("doc_id is null or doc_id <> 6")):
        got = run_digests(periodic_runs(with_repeated_tails(docs))).collect()
        want = [brute_row(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        order = lambda x: tuple(str(y) for y in x)
        assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert run_digests(periodic_runs(with_repeated_tails(no_docs))).count() == 0


def test_long_text_spans_and_other_columns(edge_docs):
    rows = {r.doc_id: r for r in periodic_runs(edge_docs.where("doc_id in (6, 7, 10)").selectExpr("*", "1 as runs", "2 as collapsed")).collect()}
    text = dict(TEXTS)[6]
    words = text.encode().split()
    # Period 977 pairs of words: 30,000 pairs hold thirty of them.
    assert [tuple(r) for r in rows[6].runs] == [(0, 60_000, 1954)] and rows[6].n_words == 60_000
    assert rows[6].collapsed == b" ".join(words[:1954]).decode()
    assert rows[7].n_words == 1 and rows[7].collapsed == "x" * 40_000 and rows[7].runs == []


def test_kept_words():
    assert without_repeats([b"a", b"b", b"a", b"b", b"c"], [(0, 4, 2)]) == b"a b c"
    with pytest.raises(ValueError):
        periodic_runs(None, exponent=1)
