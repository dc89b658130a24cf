"""Whole generation runs, line numbers and counters given by the user."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions.counters import tokenizer_counter
from scriptorium.operators import chunking as C
from scriptorium.operators import generate as G
from scriptorium.operators import synth as SY
from scriptorium.sources import readers as RD

# The model and the scorers below go to the workers by value, not by this module's name.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "line_number long, text string, source_document string, chunk_id string"


class RateLimitError(Exception):
    pass


def model(prompt):
    body = prompt.split("Text:\n    ", 1)[-1].split("\n", 1)[0]
    if body.startswith("limit"):
        raise RateLimitError()
    if body.startswith("fail"):
        raise ValueError("no")
    if body.startswith("none"):
        return "[]"
    return json.dumps([{"question": f"Q {body}?", "answer": body}, {"question": "long?", "answer": body * 3}])


def length_scorer(questions, answers):
    if any(a.startswith("broken") for a in answers):
        raise RuntimeError("scorer down")
    return [min(1.0, len(a) / 12) for a in answers]


def chunks(spark, texts):
    return spark.createDataFrame([(i + 1, t, "doc", f"c{i}" if t != "noid" else None) for i, t in enumerate(texts)], SCHEMA)


def run(spark, df, root, **kw):
    kw = {"parallelism": 3, "scorer": length_scorer, "threshold": 0.5} | kw
    return G.generate_instructions(spark, df, f"{root}/out", f"{root}/work", model, "english", 2, **kw)


def written(spark, root):
    rows = spark.read.schema(RD.OUTPUT_SCHEMA).json(f"{root}/out").collect()
    return sorted(((r.source_document_info.original_chunk_id or "", r.output, r.reward_score) for r in rows), key=str)


def test_runs_resume_and_score(spark, tmp_path):
    df = chunks(spark, ["abcd", "limit", "fail", "none", "broken", "noid", "", "ab"])
    first = run(spark, df, tmp_path)
    got = {r.line_number: (r.outcome, r.n_pairs, r.n_kept) for r in first.outcomes.collect()}
    assert got == {
        1: ("ok", 2, 1), 2: ("rate_limited", 0, 0), 3: ("error", 0, 0), 4: ("no_pairs", 0, 0),
        5: ("ok", 2, 2), 6: ("ok", 2, 1), 7: ("missing_text", 0, 0), 8: ("ok", 2, 1),
    }
    assert first.metrics.first().asDict() == {"processed_lines": 4, "not_written_lines": 4, "generated_pairs": 5, "skipped_lines": 0}
    # A chunk whose scoring fails keeps both pairs, unscored; others keep the pair that reaches the threshold.
    want = [("", "noidnoidnoid", 1.0), ("c0", "abcdabcdabcd", 1.0), ("c4", "broken", None), ("c4", "brokenbrokenbroken", None), ("c7", "ababab", 0.5)]
    assert written(spark, tmp_path) == sorted(want, key=str)
    second = run(spark, df, tmp_path)
    assert second.metrics.first().skipped_lines == 3  # chunks without an id are offered again
    assert {r.line_number for r in second.outcomes.collect()} == {2, 3, 4, 6, 7}


def test_one_caller_stops_at_the_first_rate_limit(spark, tmp_path):
    df = chunks(spark, ["abcd", "fail", "limit", "efgh"]).repartition(4)
    first = run(spark, df, tmp_path, parallelism=1)
    assert {r.line_number: r.outcome for r in first.outcomes.collect()} == {1: "ok", 2: "error", 3: "rate_limited"}
    assert [x[0] for x in written(spark, tmp_path)] == ["c0"]


def test_native_scorer_and_no_scorer(spark, tmp_path):
    df = chunks(spark, ["abcd", "a"])
    run(spark, df, tmp_path / "n", scorer=lambda q, a: F.length(a) / 12.0, native_scorer=True)
    assert written(spark, tmp_path / "n") == [("c0", "abcdabcdabcd", 1.0)]
    run(spark, df, tmp_path / "u", scorer=None)
    assert [x[2] for x in written(spark, tmp_path / "u")] == [None] * 4


def test_empty_input_and_below_threshold(spark, tmp_path):
    r = run(spark, chunks(spark, ["x"]).limit(0), tmp_path)
    assert r.metrics.first().asDict() == {"processed_lines": 0, "not_written_lines": 0, "generated_pairs": 0, "skipped_lines": 0}
    r = run(spark, chunks(spark, ["a"]), tmp_path)
    assert [(x.outcome, x.n_pairs, x.n_kept) for x in r.outcomes.collect()] == [("below_threshold", 2, 0)]


def test_line_numbers_over_splits_and_files(spark, tmp_path):
    for name, n in (("a.jsonl", 4000), ("b.jsonl", 7)):
        lines = [json.dumps({"text": f"t{i}", "chunk_id": f"{name}{i}"}) if i % 3 == 0 else ("" if i % 3 == 1 else "bad") for i in range(n)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = RD.read_chunks_jsonl(spark, str(tmp_path), line_numbers=True).collect()
        assert RD.read_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {(f"{n}{i}", i + 1) for n, k in (("a.jsonl", 4000), ("b.jsonl", 7)) for i in range(0, k, 3)}
    assert {(r.chunk_id, r.line_number) for r in rows} == want


def packed(units, limit, count):
    """The chunks of a document's units by a plain loop."""
    parts = []
    for u in units:
        if count(u) <= limit:
            parts.append(u)
            continue
        cur = ""
        for w in u.split():
            longer = f"{cur} {w}" if cur else w
            if count(longer) <= limit:
                cur = longer
                continue
            if cur:
                parts.append(cur)
            if count(w) > limit:
                parts.append(w)
                cur = ""
            else:
                cur = w
        if cur:
            parts.append(cur)
    out, texts, total = [], [], 0
    for p in parts:
        n = count(p)
        if n == 0:
            continue
        if total + n > limit and texts:
            out.append(("\n".join(texts), total))
            texts, total = [], 0
        texts.append(p)
        total += n
    return out + ([("\n".join(texts), total)] if texts else [])


def sizes(text):
    """A counter that does not add up over words: characters of the joined text and one more."""
    return len(text) + 1


DOCS = [
    (1, "One short. Two words here! " + "longer " * 40 + "end.\nNext " + "x" * 90 + " tail words after it."),
    (2, ""), (3, None), (4, "a b c d e f g h i j k l m n o p."), (5, "word. " * 60),
]


@pytest.mark.parametrize("limit", [12, 30, 200])
def test_batch_counter_recounts_joined_words(spark, limit):
    df = spark.createDataFrame(DOCS, "source_document int, text string")
    units = df.select("source_document", T.semantic_units(T.clean_text("text")).alias("u")).collect()
    got = C.chunk_documents(df, limit, batch_counter=lambda ts: [sizes(t) for t in ts]).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.source_document, r.seq)):
        by.setdefault(r.source_document, []).append((r.text, r.token_count_estimate))
    assert by == {r.source_document: c for r in units if (c := packed(r.u or [], limit, sizes))}


def test_words_that_fit_by_halving_and_one_by_one():
    count = lambda ts: [sizes(t) for t in ts]
    words = [("w" * (1 + i * 7 % 11)) for i in range(200)] + ["y" * 50, "z"]
    for limit in (3, 12, 13, 40, 5000):
        assert C.words_that_fit(words, limit, count, True) == C.words_that_fit(words, limit, count, False)


def test_expression_counter(spark):
    df = spark.createDataFrame(DOCS, "source_document int, text string")
    count = lambda t: len([w for w in t.split()]) * 2
    got = C.chunk_documents(df, 10, counter=lambda c: T.count_words(c) * 2).collect()
    units = {r.source_document: r.u or [] for r in df.select("source_document", T.semantic_units(T.clean_text("text")).alias("u")).collect()}
    by = {}
    for r in sorted(got, key=lambda r: (r.source_document, r.seq)):
        by.setdefault(r.source_document, []).append((r.text, r.token_count_estimate))
    assert by == {k: c for k, u in units.items() if (c := packed(u, 10, count))}


def model_of_sentences(texts):
    if any("!" in t for t in texts):
        raise RuntimeError("segmenter down")
    return [t.split("|") for t in texts]


def test_segmenter_and_its_failures(spark):
    """Units of a sentence model; a paragraph that it fails on stays whole; units above the
    limit are given to it again, and only then cut into words."""
    rows = [(1, "a b | c d\n \nfails! here | x\n|  |\nlong " + "w " * 9 + "| tail"), (2, None), (3, " \n ")]
    df = spark.createDataFrame(rows, "source_document int, text string")
    got = C.chunk_documents(df, 4, segmenter=model_of_sentences).orderBy("seq").collect()
    assert [(r.text, r.token_count_estimate) for r in got] == [
        ("a b\nc d", 4), ("fails! here | x", 4), ("long w w w", 4), ("w w w w", 4), ("w w\ntail", 3),
    ]
    counted = C.chunk_documents(df, 8, segmenter=model_of_sentences, counter=lambda c: T.count_words(c) * 2).orderBy("seq").collect()
    assert [(r.text, r.token_count_estimate // 2) for r in counted] == [(r.text, r.token_count_estimate) for r in got]


def test_segments_of_an_oversize_unit_are_not_stripped():
    assert C.segmented(lambda ts: [t.split(";") for t in ts], ["a; b", "c"]) == [["a", " b"], ["c"]]
    assert C.segmented(lambda ts: [[]], ["a", "b"]) == [[], []]
    assert C.segmented(lambda ts: [], ["a"]) == [["a"]] and C.segmented(None, []) == []


def test_filter_instruction_file(spark, tmp_path):
    lines = [
        '{"instruction": "q1", "input": "", "output": "long enough", "reward_score": 0.9}', '{"instruction": "q2", "output": "short"}', "not json",
        '{"output": "no instruction"}', '{"instruction": "q4"}', '{"instruction": "q5", "output": "broken answer"}', "",
    ]
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    rows = G.filter_instruction_file(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out"), length_scorer, 0.5).collect()
    assert sorted((r.instruction or "", r.output, r.reward_score) for r in rows) == [("", "no instruction", 1.0), ("q1", "long enough", 11 / 12)]


def test_tokenizer_counter_on_documents(spark):
    import public_tokenizers

    from scriptorium.plans.q_chunking import TOKENS_MAX, q_chunk_by_tokenizer

    from conftest import SF001

    count = tokenizer_counter(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    units = docs.select("doc_id", T.semantic_units(T.clean_text("text")).alias("u")).collect()
    got = {}
    for r in q_chunk_by_tokenizer(spark, SF001).orderBy("source_document", "seq").collect():
        got.setdefault(r.source_document, []).append((r.text, r.token_count_estimate))
    assert got == {r.doc_id: packed(r.u, TOKENS_MAX, lambda t: count([t])[0]) for r in units}


def test_statuses_of_one_call():
    assert SY.call_once(model, "Text:\n    limit\n") == ("rate_limited", None)
    assert SY.call_once(model, "Text:\n    fail\n") == ("error", None)
    assert SY.call_once(model, "") == ("missing_text", None)


def test_models_get_a_bounded_part_of_a_batch(spark):
    """Eight documents of a megabyte lie in one Arrow batch; a call gets fewer."""
    from scriptorium.functions.batches import SLICE_BYTES

    df = spark.range(0, 8, 1, 1).select("id", F.array(F.repeat(F.lit("w"), F.lit(1 << 20))).alias("ps"))
    told = C.with_units_by(df, "ps", lambda ts: [[str(sum(map(len, ts)))] for _ in ts])
    assert [int(r["_units"][0]) for r in told.collect()] == [SLICE_BYTES] * 8
    parts = C.with_parts_by(df, "ps", 1 << 30, lambda ts: [sum(map(len, ts))] * len(ts)).select(F.col("_parts")[0]["n"].alias("n"))
    assert [r.n for r in parts.collect()] == [SLICE_BYTES] * 8
