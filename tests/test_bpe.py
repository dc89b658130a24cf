"""BPE training and encoding: fixture corpora and the public tokenizer library as oracle."""

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import bpe as B


def _texts(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


def test_fixture_merges(spark):
    m = B.train_bpe(_texts(spark, ["cd cd ab ab xy"]), vocab_size=100, min_frequency=2, special_tokens=["[PAD]", "[UNK]"])
    assert m.vocab == ["[PAD]", "[UNK]", "a", "b", "c", "d", "x", "y", "ab", "cd"]
    assert m.merges == [("a", "b"), ("c", "d")]


def test_fixture_encode(spark):
    m = B.train_bpe(_texts(spark, ["bc bc abc abc zb zb"]), vocab_size=100, min_frequency=2, special_tokens=["[PAD]", "[UNK]"])
    assert m.merges == [("b", "c"), ("a", "bc"), ("z", "b")]
    df = _texts(spark, ["abc Q zb zb"])
    enc = B.encode_texts(df, m).select(*B.truncate_pad("ids", 4, 0)).collect()[0]
    assert list(enc["input_ids"]) == [7, 8, 8, 0]
    assert list(enc["attention_mask"]) == [1, 1, 1, 0]


CORPUS = [
    "the cat sat on the mat. the cat ate the rat!",
    "a rat and a cat; the mat is flat, the hat is flat.",
    "that hat, this hat: these hats are flat and fat",
    "hé? héé! café naïve, façade; 2024 and 2025 or 20 25",
    "aaaa aaa aa a bbbb abab baba",
]


@pytest.mark.parametrize("vocab_size,min_freq", [(60, 2), (80, 1), (45, 3)])
def test_matches_tokenizers_library(spark, vocab_size, min_freq):
    tk = pytest.importorskip("tokenizers")
    from tokenizers import Tokenizer
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import Whitespace
    from tokenizers.trainers import BpeTrainer

    specials = ["[PAD]", "[UNK]", "[MASK]"]
    lib = Tokenizer(BPE())
    lib.pre_tokenizer = Whitespace()
    lib.train_from_iterator([t.lower() for t in CORPUS], BpeTrainer(vocab_size=vocab_size, min_frequency=min_freq, special_tokens=specials, show_progress=False))
    ours = B.train_bpe(_texts(spark, CORPUS), vocab_size=vocab_size, min_frequency=min_freq, special_tokens=specials)
    lib_vocab = sorted(lib.get_vocab().items(), key=lambda kv: kv[1])
    assert [t for t, _ in lib_vocab] == ours.vocab
    probe = ["The fat cat sat", "abab aaaa", "naïve café 2024"]
    got = B.encode_texts(_texts(spark, probe), ours).orderBy("id").collect()
    for row, text in zip(got, probe):
        assert list(row["ids"]) == lib.encode(text.lower()).ids


@pytest.mark.parametrize("merges,min_freq", [(300, 2), (120, 1)])
def test_matches_tokenizers_library_on_documents(spark, merges, min_freq):
    """Batched merges on a real corpus (sf0.001 documents) equal the one-at-a-time trainer."""
    pytest.importorskip("tokenizers")
    from tokenizers import Tokenizer
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import Whitespace
    from tokenizers.trainers import BpeTrainer

    from conftest import SF001

    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    specials = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]
    base = B.train_bpe(docs, vocab_size=0, special_tokens=specials)
    vocab_size = len(base.vocab) + merges
    lib = Tokenizer(BPE())
    lib.pre_tokenizer = Whitespace()
    lib.train_from_iterator(
        [t.lower() for t in texts],
        BpeTrainer(vocab_size=vocab_size, min_frequency=min_freq, special_tokens=specials, show_progress=False),
    )
    ours = B.train_bpe(docs, vocab_size=vocab_size, min_frequency=min_freq, special_tokens=specials)
    lib_vocab = [t for t, _ in sorted(lib.get_vocab().items(), key=lambda kv: kv[1])]
    assert lib_vocab == ours.vocab
    sample = docs.orderBy("doc_id").limit(20)
    got = B.encode_texts(sample, ours).orderBy("doc_id").collect()
    for row in got:
        assert list(row["ids"]) == lib.encode(row["text"].lower()).ids


def test_kinds_when_a_merge_reuses_a_token(spark, tmp_root):
    """"abc" is reached twice (a + bc, ab + c): fewer tokens than merges, kinds stay right."""
    m = B.train_bpe(_texts(spark, ["bc " * 9 + "abc " * 8 + "ab " * 20 + "abcd " * 3 + "xab " * 4]), vocab_size=100, min_frequency=1, special_tokens=["[PAD]"])
    kinds = {r["token"]: r["kind"] for r in B.build_vocab(spark, m).collect()}
    assert {t for t, k in kinds.items() if k == "alphabet"} == set("abcdx")
    assert {t for t, k in kinds.items() if k == "merge"} == {a + b for a, b in m.merges}
    B.save_model(spark, m, str(tmp_root / "bpe"))
    again = B.load_model(spark, str(tmp_root / "bpe"))
    assert (again.vocab, again.merges, again.specials, again.n_alphabet) == (m.vocab, m.merges, m.specials, m.n_alphabet)


def test_max_samples_needs_an_order(spark):
    with pytest.raises(ValueError):
        B.train_bpe(_texts(spark, ["a b"]), vocab_size=10, max_samples=1)
    m = B.train_bpe(_texts(spark, ["ab ab", "xy xy"]), vocab_size=100, special_tokens=[], max_samples=1, order_col="id")
    assert m.vocab == ["a", "b", "ab"]


def _library(texts, specials, vocab_size, min_frequency=2):
    from tokenizers import Tokenizer
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import Whitespace
    from tokenizers.trainers import BpeTrainer

    lib = Tokenizer(BPE())
    lib.pre_tokenizer = Whitespace()
    lib.train_from_iterator([t.lower() for t in texts], BpeTrainer(vocab_size=vocab_size, min_frequency=min_frequency, special_tokens=specials, show_progress=False))
    return lib, [t for t, _ in sorted(lib.get_vocab().items(), key=lambda kv: kv[1])]


def test_registered_vocabulary_is_the_librarys(spark):
    """The registered training goes on to its vocabulary size (here: until no pair comes twice)."""
    pytest.importorskip("tokenizers")
    from conftest import SF001

    from scriptorium.plans.catalog import QUERIES
    from scriptorium.plans.q_tokens import SPECIALS, VOCAB_SIZE

    rows = spark.read.parquet(f"{SF001}/documents.parquet").orderBy("doc_id").collect()
    lib, want = _library([r.text for r in rows], SPECIALS, VOCAB_SIZE)
    got = QUERIES["train_bpe_32k"][0](spark, SF001).orderBy("id").collect()
    assert len(want) > 9000 and [r.token for r in got] == want
    ids = {r.doc_id: list(r.ids) for r in QUERIES["encode_texts_32k"][0](spark, SF001).collect()}
    for r in rows:
        assert ids[r.doc_id] == lib.encode(r.text.lower()).ids


@pytest.mark.parametrize("symbols,few", [(60, 2), (400, 2), (0, 8), (10_000, 8)])
def test_rounds_of_any_size_give_one_vocabulary(spark, monkeypatch, symbols, few):
    """Collected rounds over few or many words, and rounds that collect counts only."""
    pytest.importorskip("tokenizers")
    monkeypatch.setattr(B, "MOST_SYMBOLS", symbols)
    monkeypatch.setattr(B, "FEW_PAIRS", few)
    texts = [*CORPUS, "bc " * 9 + "abc " * 8 + "ab " * 20 + "abcd " * 3 + "xab " * 4]
    _, want = _library(texts, ["[PAD]"], 500, 1)
    assert B.train_bpe(_texts(spark, texts), vocab_size=500, min_frequency=1, special_tokens=["[PAD]"]).vocab == want


def test_a_worker_keeps_few_words_and_slices_are_bounded():
    """More words in one batch than a worker keeps, and rows larger than a slice."""
    import pyarrow as pa

    from scriptorium.functions import batches as BT

    words = [f"{i:x}" for i in range(B.WORDS_KEPT + 50_000)] + ["f" * 5000]
    t2i = {c: i for i, c in enumerate("0123456789abcdef")}
    rows, kept = pa.array([words[:10], None, [], words]).slice(1), {}
    got = B._ids_of(rows, kept, t2i, {}).to_pylist()
    assert got == [[], [], [t2i[c] for w in words for c in w]] and len(kept) <= B.WORDS_KEPT and words[-1] not in kept
    rows = pa.array([["x" * (BT.SLICE_BYTES // 3)] * n for n in (1, 2, 1, 5, 0, 1)])
    assert [len(x) for x in BT.slices(rows)] == [2, 1, 1, 2] and pa.concat_arrays(BT.slices(rows)) == rows
    assert list(BT.slices(rows.slice(0, 0))) == []


def test_the_driver_gets_packed_words(spark):
    rows = [(i % 7 + 1, [i % 50, i % 3, 9, 9]) for i in range(5000)]
    words = spark.createDataFrame(rows, B.WORD_TYPE).coalesce(1)
    found = B._words_with(words, [(9, 9)]).collect()
    got = [(f, ids) for r in found for c in [B._unpacked(r["words"])] for f, ids in zip(c[0].to_pylist(), c[1].to_pylist())]
    assert sorted(got) == sorted((f, list(x)) for f, x in rows) and sum(r.symbols for r in found) == 20_000
    assert sum(len(r["words"]) for r in found) < 20_000


def test_distinct_words_of_a_slice_are_looked_up_once():
    import pyarrow as pa

    class Counting(dict):
        asked = 0

        def get(self, *a):
            self.asked += 1
            return super().get(*a)

    tok2id, ranks = {"a": 0, "b": 1, "ab": 2}, {("a", "b"): 0}
    rows = [["ab"] * 500 + ["ba"], None, [], ["b", "x", "abx", "ab"], ["ab"] * 500]
    kept = Counting()
    got = B._ids_of(pa.array(rows, pa.list_(pa.string())).slice(0), kept, tok2id, ranks)
    assert got.to_pylist() == [[2] * 500 + [1, 0], [], [], [1, 2, 2], [2] * 500]
    assert kept.asked == 5  # ab, ba, b, x, abx
    part = pa.array([["b"], *rows], pa.list_(pa.string())).slice(1)
    assert B._ids_of(part, {}, tok2id, ranks).to_pylist() == got.to_pylist()
    assert B._ids_of(part.slice(0, 0), {}, tok2id, ranks).to_pylist() == []


def test_merges_over_all_words_at_once_equal_those_word_by_word():
    import numpy as np

    draw = np.random.default_rng(3)
    words = [draw.integers(0, 3, draw.integers(1, 30)).tolist() for _ in range(300)]
    merges = [(0, 0, 3), (1, 2, 4), (3, 3, 5), (3, 0, 6), (4, 4, 7), (2, 2, 8), (5, 1, 9)]
    rank = {(a, b): k for k, (a, b, _) in enumerate(merges)}
    flat, sizes = B._merged_words(np.array([x for w in words for x in w]), np.array([len(w) for w in words]), merges)
    ends = np.cumsum(sizes)
    assert [flat[e - n : e].tolist() for n, e in zip(sizes, ends)] == [B._merge_ids(w, rank, merges) for w in words]


def test_triples_are_counted_in_batches(spark):
    from collections import Counter

    words = [(3, [1, 2, 1, 2, 2]), (2, [2, 1, 2]), (5, [1, 2]), (7, [4, 1, 2, 4]), (1, [2, 2, 2, 2])]
    pairs = [(1, 2), (2, 1), (2, 2)]
    near = Counter()
    for f, w in words:
        for x, y, z in zip(w, w[1:], w[2:]):
            near[(y, z), 0, x] += f
            near[(x, y), 1, z] += f
    bounds, destroyed = B._neighbour_stats(spark.createDataFrame(words, B.WORD_TYPE), pairs)
    assert bounds == {p: max(c for (q, _, _), c in near.items() if q == p) for p in pairs}
    want = {}
    for (p, side, o), c in near.items():
        q = (p[1], o) if side else (o, p[0])
        if p in pairs and q in pairs:
            want[p, q] = max(want.get((p, q), 0), c)
    assert destroyed == want
