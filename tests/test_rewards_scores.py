"""Reward functions and response-score parsers on the fixture rows."""

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import rewards as R
from scriptorium.functions import scores as SC

CONTENTS = [
    ("This is a well-written, detailed answer about the topic.", 1.0, 0.8999999999999999),
    ("Short.", 0.3, 0.7999999999999999),
    ("This is another comprehensive answer that provides good information.", 1.0, 0.8999999999999999),
]


@pytest.mark.parametrize("content,length,quality", CONTENTS)
def test_length_and_quality(spark, content, length, quality):
    df = spark.createDataFrame([(content,)], "c string")
    row = df.select(R.reward_length("c"), R.reward_language_quality("c", "english")).collect()[0]
    assert row[0] == length and row[1] == quality


def test_length_long_and_malformed(spark):
    df = spark.createDataFrame([("x" * 750,), ("x" * 1500,), (None,)], "c string")
    got = [r[0] for r in df.select(R.reward_length("c")).collect()]
    assert got == [0.75, 0.0, 0.0]


def test_first_content_malformed(spark):
    df = spark.createDataFrame([([],), ([("assistant", None)],)], "c array<struct<role:string,content:string>>")
    got = [r[0] for r in df.select(R.reward_non_empty(R.first_content("c"))).collect()]
    assert got == [0.0, 0.0]


def test_accuracy_and_relevance(spark):
    df = spark.createDataFrame(
        [(" Paris ", "Paris", "What is the capital?"), ("PARIS", "paris", "the a is"), ("Rome", "Paris", "capital of France")],
        "c string, s string, q string",
    )
    rows = df.select(R.reward_accuracy("c", "s"), R.reward_relevance("c", "q")).collect()
    assert [r[0] for r in rows] == [1.0, 0.8, 0.0]
    assert rows[1][1] == 0.5  # only stop words / short words in the question


def test_composite_weights(spark):
    df = spark.createDataFrame([("Short.", "q")], "c string, q string")
    with pytest.raises(ValueError):
        R.reward_composite(F.col("c"), weights={"format": 0.0})
    v = df.select(R.reward_composite("c", {"length": 1.0, "unknown": 1.0}, question="q")).collect()[0][0]
    assert v == 0.3 * 0.5


BODIES = [
    ('{"data":[{"score":0.64}]}', 200, 0.64),
    ('{"score":1.7}', 200, 1.0),
    ('{"score":-0.2}', 200, 0.0),
    ('{"score":true}', 200, 1.0),
    ('{"score":"0.3"}', 200, 0.3),
    ('{"scores":[0.4]}', 200, 0.4),
    ('{"scores":[{"score":0.4}]}', 200, 0.4),
    ('{"predictions":[{"probability":0.2}]}', 200, 0.2),
    ('{"choices":[{"message":{"content":" 0.7 "}}]}', 200, 0.7),
    ('{"msg":"got 1.5 of 10"}', 200, 1.0),
    ('{"error":"x"}', 200, 0.0),
    ('{"scores":[0.4]}', 503, 0.4),
]


@pytest.mark.parametrize("body,status,score", BODIES)
def test_vllm_bodies(spark, body, status, score):
    df = spark.createDataFrame([(status, body)], "s int, b string")
    got = df.select(SC.vllm_attempt("s", "b").alias("a")).collect()[0]["a"]
    assert got["decided"] and got["score"] == score


def test_vllm_undecided_then_default(spark):
    att = spark.createDataFrame(
        [(1, 0, 200, '{"msg":"none"}'), (1, 1, None, None), (2, 0, 200, '{"msg":"none"}'), (2, 1, 200, '{"score":0.9}')],
        "pair_id int, retry int, http_status int, body string",
    )
    got = {r["pair_id"]: r["score"] for r in SC.take_first_usable_attempt(att, "pair_id", ("retry",)).collect()}
    assert got == {1: 0.0, 2: 0.9}


def test_hf_and_openai(spark):
    df = spark.createDataFrame(
        [(200, '[{"score": 0.42}]', " 0.7 "), (200, '[{"label": 1}]', "abc"), (200, '{"score": 0.9}', ""), (500, "[]", "nan")],
        "s int, b string, c string",
    )
    rows = df.select(SC.score_response_hf("s", "b"), SC.score_response_openai("s", "c")).collect()
    assert [r[0] for r in rows] == [0.42, 0.5, 0.5, 0.0]
    assert [r[1] for r in rows] == [0.7, 0.5, 0.5, 0.0]


def test_softmax(spark):
    import math

    df = spark.createDataFrame([([1.0, 3.0],)], "l array<double>")
    got = df.select(SC.score_softmax("l")).collect()[0][0]
    assert abs(got - math.exp(3) / (math.exp(1) + math.exp(3))) < 1e-12


def test_score_pairs_python_scorer_and_failure(spark):
    def _boom(questions, answers, contexts):  # nested: shipped to workers by value
        raise RuntimeError("endpoint down")

    df = spark.createDataFrame([("q1", "a" * 250), ("q2", "b" * 1000)], "question string, answer string")
    from scriptorium.plans.q_scores import length_scorer

    ok = sorted((r["question"], r["score"], r["eval_failed"]) for r in SC.score_pairs(df, length_scorer).collect())
    assert ok == [("q1", 0.5, False), ("q2", 1.0, False)]
    bad = SC.score_pairs(df, _boom).collect()
    assert all(r["score"] == 0.0 and r["eval_failed"] for r in bad)

    def _one_bad(questions, answers, contexts):
        if "q7" in questions:
            raise RuntimeError("bad row")
        return [1.0] * len(questions)

    many = spark.createDataFrame([(f"q{i}", "a") for i in range(40)], "question string, answer string")
    for parts in (1, 10):  # one bad row fails by itself, however rows are dealt
        got = SC.score_pairs(many.repartition(parts), _one_bad).where("eval_failed").collect()
        assert [r["question"] for r in got] == ["q7"]
    col = SC.score_pairs(df, R.reward_length("answer")).collect()
    assert sorted(r["score"] for r in col) == [0.5, 1.0]


EDGE_BODIES = [
    ('{"choices":[{"text":"0.25"}]}', True, 0.25),
    ('{"choices":[{"text":"","message":{"content":"0.6"}}]}', True, 0.6),
    ('{"choices":["0.9"]}', False, None),  # not an object: the lookup fails, no fallback
    ('{"choices":[{"message":"0.9"}]}', False, None),
    ('{"choices":[{"text":5}], "note":"0.3"}', True, 0.3),  # non-string text: fallback regex
    ('[0.45]', True, 0.45),  # not an object: only the regex
]


@pytest.mark.parametrize("body,decided,score", EDGE_BODIES)
def test_vllm_choice_edges(spark, body, decided, score):
    df = spark.createDataFrame([(200, body)], "s int, b string")
    got = df.select(SC.vllm_attempt("s", "b").alias("a")).collect()[0]["a"]
    assert got["decided"] == decided and got["score"] == score


def test_openai_choice_without_content(spark):
    df = spark.createDataFrame([(200, None, True), (200, None, False)], "s int, c string, h boolean")
    got = [r[0] for r in df.select(SC.score_response_openai("s", "c", F.col("h"))).collect()]
    assert got == [0.0, 0.5]


def test_py_float_matches_python(spark):
    vals = ["1_000.5", "1__0", "_1", "1_", "1.2_5e1_0", " 0.7 ", "inf", "-Infinity", "+1e-2", ".5", "5.", "0x10", "1e", ""]
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    for r in df.select("t", SC.py_float(F.col("t")).alias("f")).collect():
        try:
            expected = float(r["t"])
        except ValueError:
            expected = None
        assert r["f"] == expected, r["t"]
