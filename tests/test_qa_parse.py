import pytest
from pyspark.sql import functions as F

from scriptorium.functions import qa_parse as Q

AR_Q, AR_A = "سؤال", "الإجابة"

CASES = [
    ('[{"question":"q","answer":"a"}]', [("q", "a")]),
    ('```json\n[{"question":"q","answer":"a"}]\n```', [("q", "a")]),
    ('```\n[{"question":"q","answer":"a"}]```', [("q", "a")]),
    ('  \n[{"question":"q","answer":"a"}]  ', [("q", "a")]),
    ('[{"question":"q","answer":"a",},]', [("q", "a")]),
    ('[{"' + AR_Q + '":"q","' + AR_A + '":"a"}]', [("q", "a")]),
    ('[{"question":"","' + AR_Q + '":"s","answer":"a"}]', [("s", "a")]),
    ('[{"question":"q"},"x",{"question":"q2","answer":"a2"}]', [("q2", "a2")]),
    ("[]", []),
    ('{"question":"q","answer":"a"}', []),
    ("[1] x", []),
    ('question: "What?", answer: "Yes."', [("What?", "Yes.")]),
    ('QUESTION: x answer: "y" question: z', [("x", "y")]),
    ('{"question": "a", "answer": "b",,}', [("a", "b")]),
    ('answer: "only"', []),
    ('[{"question":0,"' + AR_Q + '":"s","answer":"a"}]', [("s", "a")]),
    ('[{"question":"0","answer":"a"}]', [("0", "a")]),
    ('[{"question":5,"answer":true}]', [("5", "true")]),
    ('"' + AR_Q + '": "س", "' + AR_A + '": "ج"', [("س", "ج")]),
]


@pytest.mark.parametrize("raw,expected", CASES)
def test_qa_with_fallback(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "r string")
    got = df.select(Q.qa_with_fallback(F.col("r")).alias("p")).collect()[0]["p"]
    assert [(p["question"], p["answer"]) for p in got] == expected


def test_fence_and_commas(spark):
    df = spark.createDataFrame([("```json\n[1,2,]\n```",)], "r string")
    assert df.select(Q.clean_response("r")).collect()[0][0] == "[1,2]"
