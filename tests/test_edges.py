"""Inline edge tables from the fixtures: conversations, problem files, resume ids, text folders."""

import os

from pyspark.sql import functions as F

from scriptorium.operators import reshape as RS
from scriptorium.operators import resume as RES
from scriptorium.sources import readers as RD


def test_pair_turns_by_position(spark):
    rows = [
        (1, 0, "user", "u0"), (1, 1, "assistant", "a1"),
        (2, 0, "user", "u0"), (2, 1, "assistant", "a1"), (2, 2, "user", "u2"),
        (3, 0, "user", "u0"), (3, 1, "assistant", "a1"), (3, 2, "user", "u2"), (3, 3, "assistant", "a3"),
        (4, 0, "system", "s0"), (4, 1, "user", "u1"), (4, 2, "assistant", "a2"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in RS.pair_turns(df).collect())
    assert got == [(1, 0, "u0", "a1"), (2, 0, "u0", "a1"), (3, 0, "u0", "a1"), (3, 1, "u2", "a3"), (4, 0, "s0", "u1")]
    assert RS.unpaired_turns(df).collect()[0][0] == 2


def test_pair_turns_array_form(spark):
    df = spark.createDataFrame([([("a",), ("b",), ("c",)],), ([("x",)],)], "instruction array<struct<value:string>>")
    got = [[(p["instruction"], p["output"]) for p in r[0]] for r in df.select(RS.pair_turns_array(F.col("instruction"))).collect()]
    assert got == [[("a", "b")], []]


def test_grpo_rows_and_placeholders(spark):
    files = [
        (1, '[{"problem": "p1", "solution": "s1"}, {"problem": "p2"}, {"problem": "p3", "solution": null}, '
            '{"problem": "p4", "solution": 42}, "not an object"]'),
        (2, '{"problem": "p", "solution": "s"}'),
        (3, "[]"),
    ]
    df = spark.createDataFrame(files, "fid int, value string")
    rows = RS.grpo_dataset(df, "value", ["fid"]).orderBy("fid", "item_no").collect()
    got = [(r["fid"], r["prompt"][1]["content"], r["solution"]) for r in rows]
    assert got == [
        (1, "p1", "s1"),
        (1, "p3", None),
        (1, "p4", "42"),
        (2, RS.ERROR_LOADING, "Error"),
        (3, RS.EMPTY_DATASET, ""),
    ]
    assert all(r["prompt"][0]["content"] == RS.REASONING_SYSTEM_PROMPT for r in rows)


def test_resume_null_and_empty_ids(spark):
    chunks = spark.createDataFrame([("a", "t"), ("b", "t"), (None, "t"), ("", "t")], "chunk_id string, text string")
    done = spark.createDataFrame([("a",), ("",)], "chunk_id string")
    pending = sorted((r[0] is None, r[0]) for r in RES.resume_pending(chunks, done).select("chunk_id").collect())
    assert pending == [(False, ""), (False, "b"), (True, None)]
    assert RES.count_skipped(chunks, done).collect()[0][0] == 1


def test_read_text_folder_details(spark, tmp_root):
    d = tmp_root / "txt"
    d.mkdir()
    (d / "a b.txt").write_bytes("H\r\n\r\nline one\rline two".encode())
    (d / "bom.txt").write_bytes("﻿hello".encode())
    (d / "skip.md").write_text("not read")
    (d / "_hidden.txt").write_text("skipped by the file source")
    got = {os.path.basename(r["source_document"]): r["text"] for r in RD.read_text_folder(spark, str(d)).collect()}
    assert got == {"a b.txt": "H\n\nline one\nline two", "bom.txt": "﻿hello"}


def test_read_text_arrays_and_objects(spark, tmp_root):
    p = tmp_root / "arrays.jsonl"
    p.write_text('[{"text": "a"}, {"text": "b"}]\n\n{"text": "c"}\n[{"other": 1}]\nnot json but text\n')
    got = sorted(r[0] for r in RD.read_text_arrays_jsonl(spark, str(p)).collect())
    assert got == ["a", "b", "c"]


def test_write_batched_batch_sizes(spark, tmp_root):
    from scriptorium.plans.q_io import _FileStore
    from scriptorium.sources import sinks as SK

    root = str(tmp_root / "store")
    df = spark.range(0, 50, numPartitions=3).withColumnRenamed("id", "doc_id")
    SK.write_batched(df, _FileStore(root), batch_size=7)
    sizes = [sum(1 for _ in open(os.path.join(root, f))) for f in os.listdir(root)]
    assert sum(sizes) == 50 and max(sizes) <= 7


def test_export_dataset_name_check(spark, tmp_root):
    import pytest

    from scriptorium.sources import sinks as SK

    df = spark.range(3)
    for bad in ["noslash", "a/b/c", "/name", "owner/"]:
        with pytest.raises(ValueError):
            SK.export_dataset(df, str(tmp_root / "x"), bad)
    path = SK.export_dataset(df, str(tmp_root / "x"), "owner/name")
    assert spark.read.parquet(path).count() == 3


def test_dispatch_not_configured(spark):
    from scriptorium.functions import scores as SC

    df = spark.createDataFrame([("vllm", True), ("vllm", False), ("other", True)], "t string, ok boolean")
    got = [r[0] for r in df.select(SC.score_dispatch("t", {"vllm": F.lit(0.9)}, F.col("ok"))).collect()]
    assert got == [0.9, 0.5, 0.5]


def test_batch_rows(spark):
    from scriptorium.operators.numbering import batch_rows

    df = spark.range(0, 23).withColumnRenamed("id", "k").withColumn("v", F.col("k") * 2)
    rows = batch_rows(df, ["k"], 5, ["k", "v"]).orderBy("batch_id").collect()
    assert [len(r["rows"]) for r in rows] == [5, 5, 5, 5, 3]
    assert [x["k"] for r in rows for x in r["rows"]] == list(range(23))


def test_incremental_run_retries_chunks_without_output(spark, tmp_root):
    """Second run: only new chunks and chunks that produced no rows are processed again."""
    from scriptorium.operators import synth as SY
    from scriptorium.streaming.incremental import incremental_run

    base = tmp_root / "inc"
    src, out, ckpt = str(base / "in"), str(base / "out"), str(base / "ckpt")
    seen = []

    def process(pending):
        rows = pending.select("chunk_id").collect()  # tiny test input only
        seen.append(sorted(r[0] for r in rows))
        qa = F.when(F.col("chunk_id") != "c2", F.array(F.struct(F.lit("q").alias("question"), F.lit("a").alias("answer"))))
        return SY.to_instruction_rows(pending.withColumn("qa", F.coalesce(qa, F.array().cast("array<struct<question:string,answer:string>>"))), "qa")

    schema = "text string, source_document string, chunk_id string, token_count_estimate int"
    spark.createDataFrame([("t1", "d", "c1", 1), ("t2", "d", "c2", 1)], schema).write.json(src, mode="append")
    incremental_run(spark, src, out, ckpt, process)
    spark.createDataFrame([("t1", "d", "c1", 1), ("t2", "d", "c2", 1), ("t3", "d", "c3", 1)], schema).write.json(src, mode="append")
    incremental_run(spark, src, out, ckpt, process)
    assert seen[0] == ["c1", "c2"]
    assert seen[-1] == ["c2", "c3"]  # c1 is done; c2 wrote nothing, so it is retried
    ids = sorted(r[0] for r in spark.read.json(out).select("source_document_info.original_chunk_id").collect())
    assert ids == ["c1", "c3"]
    incremental_run(spark, src, out, ckpt, process)  # no new file: what has no output is still offered
    assert seen[-1] == ["c2"]


def test_incremental_run_raises_on_unreadable_output(spark, tmp_root):
    import pytest

    from scriptorium.streaming.incremental import incremental_run

    base = tmp_root / "inc-bad"
    src, out = str(base / "in"), str(base / "out")
    spark.createDataFrame([("t1", "d", "c1", 1)], "text string, source_document string, chunk_id string, token_count_estimate int").write.json(src)
    os.makedirs(out)
    (base / "out" / "part.json.gz").write_bytes(b"not gzip at all")
    with pytest.raises(Exception):
        incremental_run(spark, src, out, str(base / "ckpt"), lambda df: df)


def test_grpo_without_id_columns_and_solutions_as_written(spark):
    value = '[{"problem": "p1", "solution": 1.0}, {"problem": 7, "solution": {"b": 1, "a": [true, null]}}, {"problem": "p", "solution": true}, {"solution": "s", "problem": "p4"}, "{\\"problem\\": 1, \\"solution\\": 2}"]'
    df = spark.createDataFrame([(value,), ("[]",), ("no list",), (None,)], "value string")
    rows = RS.grpo_dataset(df).collect()
    got = sorted((r["item_no"], r["prompt"][1]["content"], r["solution"]) for r in rows)
    assert got == sorted([
        (0, "p1", "1.0"), (1, "7", '{"b":1,"a":[true,null]}'), (2, "p", "true"), (3, "p4", "s"),
        (-1, RS.EMPTY_DATASET, ""), (-1, RS.ERROR_LOADING, "Error"), (-1, RS.ERROR_LOADING, "Error"),
    ])


def test_code_instructions_with_repeated_keys(spark):
    rows = [('{"prompt": "a", "response": "r", "programming_language": "x", "prompt": "b"}',), ('{"prompt": null, "response": 5, "programming_language": "x"}',), ('{"prompt": "a"}',), ("junk",)]
    got = [tuple(r) for r in RS.project_code_instructions(spark.createDataFrame(rows, "value string")).collect()]
    assert sorted(got, key=str) == sorted([("b", "r", "x"), (None, "5", "x")], key=str)


def test_prompt_languages_and_missing_text(spark):
    import pytest

    from scriptorium.operators import synth as SY

    df = spark.createDataFrame([("some text",), (None,)], "text string")
    with pytest.raises(Exception, match="no prompt template"):
        df.select(SY.build_prompt("french", 2, F.col("text"))).collect()

    def model(prompt):
        return "answered"

    called = SY.map_completions(df.withColumn("prompt", F.col("text")), model).collect()
    assert sorted((r["status"], r["response"]) for r in called if r["response"]) == [("ok", "answered")]
    assert [r["status"] for r in called if r["text"] is None] == [SY.STATUS_MISSING_TEXT]


def test_checkpoint_folder_is_required_off_local():
    import pytest

    from scriptorium.session import ensure_checkpoint_dir

    class Option:
        def isDefined(self):
            return False

    class Stub:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return Stub

        @staticmethod
        def getCheckpointDir():
            return Option()

    class Session:
        sparkContext = Stub

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session)
