"""Token files (op 1) and packing (op 8) against the tokenizers library and brute force."""

import json
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from scriptorium.llm import packing, token_files
from scriptorium.llm.common import scratch_path
from scriptorium.llm.tokens import SETTLED, WordEncoder, ranked
from tokenizers import Tokenizer

from .conftest import TEXTS

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ENCODERS = {p: (WordEncoder(p), library(p)) for p in (BYTES, WORDS)}
ODD = ["", " ", "  a", "a  b", "a \n b", "\n a", " \nb", "a\t b", "a  b", "Don't x_y 's 'll", "Éa!! Straße,, ªº", "<|endoftext|> y <|startoftext|>", "e ́ ı İ Σ ΑΣ", "\U0001f600 中文 字", "1 22 3.5", "x" * 3000]


@pytest.mark.parametrize("path", [BYTES, WORDS])
@pytest.mark.parametrize("text", ODD)
def test_odd_texts_encode_as_the_library_does(path, text):
    own, lib = ENCODERS[path]
    assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == lib(text)[:-1]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_a_space_after_other_white_space_is_no_cut(path):
    own, lib = ENCODERS[path]
    for text in (" \u00a0 \u00a0 \u0301", "a\n \u4e2d", "a\t b\u0301 c"):
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == lib(text)[:-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aAéß.,'!_ 0 \n\t ́中")), max_size=25))
def test_any_text_encodes_as_the_library_does(text):
    for own, lib in ENCODERS.values():
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == lib(text)[:-1]


def test_token_files_of_a_corpus(spark, small_docs):
    lib, start = library(BYTES), 0
    want = {}
    for r in small_docs.orderBy("doc_id").collect():
        ids = lib(r.text)
        want[r.doc_id] = (start, len(ids), crc(ids))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_file_digests(small_docs, BYTES).collect()}
    assert got == want


def test_token_files_round_trip_on_edges(spark, edge_docs, no_docs):
    folder, lib = scratch_path(spark, "test-tokens"), library(BYTES)
    manifest = token_files.write_token_files(edge_docs, folder, BYTES)
    assert manifest.agg({"null_keys": "sum"}).first()[0] == 2
    rows = token_files.read_token_files(spark, folder, "<u2").orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((k for k, _ in TEXTS), key=lambda k: -1 if k is None else k)
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    assert sorted((r.doc_id or 0, r.ids) for r in rows) == sorted((k or 0, lib(t)) for k, t in TEXTS)
    assert token_files.token_file_digests(no_docs, BYTES).count() == 0


def check_packing(rows, want, capacity):
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for xs in by.values():
        xs.sort()
        assert xs[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(xs, xs[1:], strict=False))
        assert sum(n for _, n in xs) <= capacity
    return len(by)


def pieces(docs, path, capacity):
    lib, want = library(path), defaultdict(list)
    for k, t in docs:
        ids = lib(t)
        want[k] += [(n, a, len(ids[a : a + capacity]), crc(ids[a : a + capacity])) for n, a in enumerate(range(0, len(ids), capacity))]
    return want


def test_packing_of_a_corpus(spark, small_docs):
    want = pieces([(r.doc_id, r.text) for r in small_docs.collect()], WORDS, 2048)
    n = check_packing(packing.pack(small_docs, WORDS, 2048).collect(), want, 2048)
    total = sum(x[2] for v in want.values() for x in v)
    assert n <= -(-total // 2048) + 1


def test_packing_edges(spark, edge_docs, no_docs):
    rows = packing.pack(edge_docs, WORDS, 64, with_ids=True).collect()
    check_packing(rows, pieces(TEXTS, WORDS, 64), 64)
    assert all(crc(r.ids) == r.ids_crc32 and len(r.ids) == r.length for r in rows)
    assert packing.pack(no_docs, WORDS, 64).count() == 0


def fewest(sizes, capacity):
    """The least number of sequences, by exhaustive search."""
    best = len(sizes)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= sizes[i]}):
            j = rooms.index(room)
            put(i + 1, rooms[:j] + [room - sizes[i]] + rooms[j + 1 :])
        put(i + 1, [*rooms, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    put(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_reduction_keeps_the_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 17, 30])
    sizes = [rng.randint(1 + capacity // 6 * (seed % 2), capacity) for _ in range(rng.randint(1, 9))]
    counts = {s: sizes.count(s) for s in sizes}
    fixed, left = packing.reduce_by_dominance(counts, capacity)
    assert all(sum(p) <= capacity for p, _ in fixed)
    used = sum(n for _, n in fixed)
    rest = [s for s, c in left.items() for _ in range(c)]
    assert used + (fewest(rest, capacity) if rest else 0) == fewest(sizes, capacity)


@pytest.mark.parametrize("seed", range(20))
def test_best_fit_by_classes_is_best_fit_one_by_one(seed):
    rng = random.Random(seed)
    left = {rng.randint(1, 40): rng.randint(1, 30) for _ in range(12)}
    rooms = []
    for s in sorted(left, reverse=True):
        for _ in range(left[s]):
            fits = [r for r in rooms if r >= s]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - s)
            else:
                rooms.append(40 - s)
    got = packing.best_fit(left, 40)
    assert sorted(40 - sum(p) for p, n in got for _ in range(n)) == sorted(rooms)


ADDED = ["a<|endoftext|>b", "<|endoftext|>", "one <|startoftext|> two <|endoftext|>", "<|endoftext|><|endoftext|> x", "<|endoftext| > y", "<|ENDOFTEXT|> z"]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_strings_of_added_tokens_have_their_ids(spark, path):
    """Files and packing against the library as it comes."""
    lib = Tokenizer.from_file(path)
    want = {k: [*lib.encode(t, add_special_tokens=False).ids, 0] for k, t in enumerate([*ADDED, *ODD])}
    docs = spark.createDataFrame(list(enumerate([*ADDED, *ODD])), "doc_id long, text string")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_file_digests(docs, path).collect()}
    starts = np.cumsum([0] + [len(want[k]) for k in sorted(want)]).tolist()
    assert got == {k: (starts[k], len(v), crc(v)) for k, v in want.items()}
    packed = {r.doc_id: r.ids for r in packing.pack(docs, path, 4096, with_ids=True).collect()}
    assert packed == want


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_every_settled_character_is_split_as_the_library_does(path):
    own, lib = ENCODERS[path]
    assert own.ranks is not None
    settled = [chr(c) for c in range(0x10000) if SETTLED.match(chr(c))]
    assert len(settled) > 0x250
    texts = [x for c in settled for x in (f"a{c}b {c}1{c}", f"{c}{c} {c}{c}a'{c}s  {c}")]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == lib(t)[:-1], t


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_long_white_space_and_unsettled_characters(path):
    own, lib = ENCODERS[path]
    for t in (" " * 5000 + "a", "a" + "\n" * 2000, "\u4e2d\u6587 \u0e01", "word " * 300, "ab" * 4000, "Don't ROCK'N'ROLL!'s 'still ''ll 12\u00b23 ...--'d", "\u0130stanbul I", "a\x1cb\x85c\xa0d", "x" * 300 + " " + "x" * 300):
        assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == lib(t)[:-1]


def test_files_that_ranks_do_not_tell_have_no_ranks():
    spec = json.loads(open(BYTES, encoding="utf-8").read())
    own = Tokenizer.from_file(BYTES)
    assert ranked(own, spec) is not None
    merges = spec["model"]["merges"]
    swapped = spec | {"model": spec["model"] | {"merges": [merges[1], merges[0], *merges[2:]]}}
    assert ranked(own, swapped) is None
    assert ranked(own, spec | {"model": spec["model"] | {"type": "Unigram"}}) is None
    words = json.loads(open(WORDS, encoding="utf-8").read())
    lib = Tokenizer.from_file(WORDS)
    assert ranked(lib, words) is not None
    model = words["model"]
    inner = next(m for m in reversed(model["merges"]) if not m[-1].endswith("</w>"))
    unmade = [m for m in model["merges"] if m != inner]  # a token that no pair makes
    assert ranked(lib, words | {"model": model | {"merges": unmade}}) is None
