"""The mask against a plain loop over hashlib."""

import hashlib

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import mlm as M


def _first_bits(key, place, seed):
    name = f"{place}:{seed}" if key is None else f"{key}:{place}:{seed}"
    return int(hashlib.md5(name.encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("seed", ["42", "7" * 30])
def test_first_bits_equal_hashlib(seed):
    from scriptorium.functions.md5 import first_bits

    keys = ["1", None, "é:7", "x" * 25, "y" * 60, "", "123456"]
    counts = [12, 1101, 5, 1001, 9, 0, 40_003]
    got = first_bits([None if k is None else k.encode() for k in keys], counts, seed.encode())
    assert got.tolist() == [_first_bits(k, i, seed) for k, n in zip(keys, counts) for i in range(n)]


def test_mask_equals_a_plain_loop(spark):
    rows = [("a", [5, 0, None, *range(5, 300)]), (None, list(range(5, 60))), ("b", None), ("c", []), ("k" * 70, list(range(9, 40)))]
    df = spark.createDataFrame(rows, "key string, ids array<int>").coalesce(1)
    out = df.select("key", "ids", *M.mlm_mask("ids", "key", 4, 0, 0.15, 42))
    hit = lambda k, i, x: x not in (None, 0) and _first_bits(k, i, 42) / 4294967296.0 < 0.15
    want = [
        (k, x, None if x is None else [4 if hit(k, i, v) else v for i, v in enumerate(x)], None if x is None else [v if hit(k, i, v) else -100 for i, v in enumerate(x)])
        for k, x in rows
    ]
    assert [tuple(r) for r in out.collect()] == want
    flat = [v for *_, labels in want for v in labels or []]
    stats = M.mask_stats(out, "labels", "ids", 0).first()
    assert stats.masked == sum(v != -100 for v in flat)
    assert stats.non_pad == sum(v not in (None, 0) for _, x in rows for v in x or [])


def test_positions_are_hashed_once_and_not_one_by_one(spark):
    """One pass of Python for both columns, no expression evaluated for each position."""
    df = spark.createDataFrame([(1, [7, 8])], "key long, ids array<int>")
    plan = df.select(*M.mlm_mask("ids", F.col("key"), 4))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambda" not in plan and "md5" not in plan
