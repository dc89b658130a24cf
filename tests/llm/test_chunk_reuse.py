"""Chunk reuse (op 11) against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from scriptorium.llm import chunk_reuse as cr
from scriptorium.llm.common import scratch_path
from scriptorium.llm.queries import id_digests
from tokenizers import Tokenizer

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(BYTES)
ENCODER = cr.ChunkEncoder(BYTES)


def want(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False))


def prose(rng, n):
    return " ".join("".join(rng.choice(["ta", "ri", "é", "on", "'s", "12", ".", "-", "中"]) for _ in range(rng.randint(1, 5))) for _ in range(n))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcre's1.,é中 \n\t \U0001f600")), max_size=60), st.lists(st.integers(0, 60), max_size=6))
def test_parts_cut_anywhere_are_put_together_as_the_whole(text, at):
    cuts = [0, *sorted({min(x, len(text)) for x in at}), len(text)]
    parts = ENCODER.encode([text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b])
    assert ENCODER.put_together(parts).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_cuts_depend_on_content_alone():
    rng = random.Random(1)
    passage, a, b = prose(rng, 800).encode(), prose(rng, 200).encode(), prose(rng, 333).encode()
    whole = [a + passage, b + passage + a, passage, b"", b"x" * 5000, "é".encode() * 3000]
    cuts = cr.cuts_of(whole)
    assert cuts == [cr.cuts_of([t])[0] for t in whole]
    digests = [cr.digests_of(t, c) for t, c in zip(whole, cuts, strict=True)]
    assert len(set(digests[0]) & set(digests[1])) > 0.5 * len(digests[2])
    for t, c in zip(whole, cuts, strict=True):
        assert (c[-1] if c else 0) == len(t) and all(y - x >= cr.LEAST for x, y in zip([0, *c], c, strict=False) if t[-1:] and len(t) > cr.LEAST)
        for x in c:
            t[:x].decode()


def test_known_chunks_give_the_ids_of_the_whole_and_others_are_refused():
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(1, 900)) for _ in range(30)]
    known, used = {}, []
    for t, cuts in zip(texts, cr.cuts_of([t.encode() for t in texts]), strict=True):
        b = t.encode()
        for x, y, d in zip([0, *cuts], cuts, cr.digests_of(b, cuts), strict=False):
            if rng.random() < 0.6:
                ids = ENCODER.encode([b[x:y].decode()])[0]
                wrong = rng.random() < 0.1
                known[d] = lambda ids=ids[:-1] if wrong else ids: used.append(1) or ids
    got = ENCODER.encode_with([t.encode() for t in texts], known)
    assert used and [g.tolist() for g in got] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_registered_corpus_with_copies(spark, small_docs):
    copies = small_docs.unionByName(small_docs.where("doc_id % 3 = 0").selectExpr("doc_id + 10000 as doc_id", "concat('Copy: ', text, ' end') as text", "lang", "source", "n_chars"))
    rows = copies.select("doc_id", "text").repartition(4)
    folder = scratch_path(spark, "test-copies")
    rows.write.parquet(folder)
    docs = spark.read.parquet(folder)
    got = {r.doc_id: tuple(r)[1:] for r in id_digests(cr.encode_and_decode(docs, BYTES)).collect()}
    assert got == {r.doc_id: want(r.text) for r in rows.collect()}


def test_each_shared_chunk_is_encoded_once_and_laid_out_for_its_partitions(spark):
    rng = random.Random(3)
    passage = prose(rng, 900)
    docs = spark.createDataFrame([(prose(rng, 50) + " " + passage,) for _ in range(8)] + [(prose(rng, 600),)], "t string").repartition(4)
    path = scratch_path(spark, "test-shared")
    docs.write.parquet(path)
    folder = scratch_path(spark, "test-layout")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        cr.lay_out_shared_chunks(spark.read.parquet(path), BYTES, folder, "<u2")
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    asked = [cr.read_part(f"{folder}/asked", p, "<u2") for p in range(16)]
    known = [cr.read_part(f"{folder}/known", p, "<u2") for p in range(16)]
    every = [d for x in asked for d in x]
    assert len(every) == len(set(every)) > 3 and sum(map(bool, known)) > 1
    assert set().union(*known) == set(every)
    chunk = {d: passage for d in every}
    assert all(ENCODER.bytes_from(x[d]()).decode() in chunk[d] for x in known for d in x)


def test_edges(spark, edge_docs, no_docs):
    odd = spark.createDataFrame([(100, "a<|endoftext|>b" * 200), (101, "x <|endoftext|>"), (102, " \n " * 700), (103, "  a" * 500)], "doc_id long, text string")
    docs = edge_docs.select("doc_id", "text").union(odd).union(odd)
    got = sorted((str(r.doc_id), *tuple(r)[1:]) for r in id_digests(cr.encode_and_decode(docs, BYTES)).collect())
    assert got == sorted((str(r.doc_id), *want(r.text)) for r in docs.collect())
    assert cr.encode_and_decode(no_docs, BYTES).count() == 0


@pytest.mark.parametrize("text", ["Hello  Wörld, it's ok", "", "A\nB"])
def test_files_of_other_kinds_are_encoded_whole(spark, text):
    lib = Tokenizer.from_file(WORDS)
    r = cr.encode_and_decode(spark.createDataFrame([(1, text)], "doc_id long, text string"), WORDS).first()
    ids = lib.encode(text, add_special_tokens=False).ids
    assert r.ids == ids and r.decoded == lib.decode(ids, skip_special_tokens=False)
    assert np.array(ids).dtype.kind in "if"
