"""What inputs built by the queries and work tables of runs hold."""

from pyspark.sql import functions as F

from scriptorium.operators import generate as G
from scriptorium.plans import q_io, q_synth
from scriptorium.sources import readers as RD

from conftest import SF001


def test_files_by_key_in_few_folders(spark, tmp_path):
    n = 3 * q_io.FOLDERS
    df = spark.range(0, n, 1, 2).select((F.col("id") % (n - 1)).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text")).coalesce(1)
    df = df.withColumn("text", F.when(F.col("doc_id") != 5, F.col("text")))
    q_io._write_files(df, ["doc_id"], str(tmp_path / "txt"))
    assert len(list((tmp_path / "txt").iterdir())) == q_io.FOLDERS
    got = {r.source_document.rsplit("/", 1)[-1]: r.text for r in RD.read_text_folder(spark, f"{tmp_path}/txt/*").collect()}
    want = {f"doc_id={i}.txt": f"t{i}\n" for i in range(n - 1)} | {"doc_id=5.txt": "\n"}
    assert sorted(got.pop("doc_id=0.txt").split()) == ["t0", f"t{n - 1}"]
    want.pop("doc_id=0.txt")
    assert got == want


def test_recorded_completions_read_chunks_written_once(spark):
    files = q_synth._recorded(spark, SF001).inputFiles()
    assert files and all("/recorded-" in f for f in files)


def test_a_run_keeps_no_text_twice(spark, tmp_path):
    text = "word " * 100
    chunks = spark.createDataFrame([(1, text, "d", "c")], "line_number long, text string, source_document string, chunk_id string")
    seen = F.regexp_count("response", F.lit("word"))
    G.generate_instructions(spark, chunks, f"{tmp_path}/out", f"{tmp_path}/work", lambda p: '[{"question": "%d", "answer": "a"}]' % p.count("word"), "english", 2, 3)
    raw = spark.read.json(f"{tmp_path}/work/*/responses").select(F.length("text").alias("n"), seen.alias("k")).collect()
    assert [tuple(r) for r in raw] == [(200, 0)]
    assert "response" not in spark.read.parquet(f"{tmp_path}/work/*/pairs").columns
    row = spark.read.schema(RD.OUTPUT_SCHEMA).json(f"{tmp_path}/out").first()
    assert row.instruction == "100" and row.source_document_info.original_text_preview == text[:200] + "..."


def test_line_numbers_do_not_shuffle_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny\n")
    plan = RD.read_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_text_folders_are_listed_by_tasks(spark, tmp_path):
    """The driver knows the folders that the path names, not their files."""
    base = tmp_path / "t"
    for k in range(3):
        (base / f"a {k}").mkdir(parents=True)
        for i in range(40):
            (base / f"a {k}" / f"é+{i}%20.txt").write_bytes(f"{k}\r\n{i}".encode())
    (base / "a 0" / "bad.txt").write_bytes(b"x\xff")
    (base / "a 0" / "empty.txt").write_bytes(b"")
    (base / "a 1" / "k=1").mkdir()
    (base / "a 1" / "plain").mkdir()
    (base / "a 1" / "plain" / "no.txt").write_bytes(b"no")
    files = RD.read_text_folder(spark, f"{base}/*")
    assert files.inputFiles() == []
    want = {f"{base}/a {k}/é+{i}%20.txt": f"{k}\n{i}" for k in range(3) for i in range(40)} | {f"{base}/a 0/bad.txt": "x�"}
    assert {r.source_document: r.text for r in files.collect()} == want and files.count() == len(want)
    one = RD.read_text_folder(spark, f"{base}/a 0/bad.txt").collect()
    assert [(r.source_document, r.text) for r in one] == [(f"{base}/a 0/bad.txt", "x�")]


def test_a_run_compresses_what_it_keeps(spark, tmp_path):
    """The inbox, the raw responses and the pairs; the output stays plain JSON lines."""
    from scriptorium.sources import sinks as SK
    from scriptorium.streaming.incremental import generate_incrementally

    chunks = spark.createDataFrame([("word " * 300, "d", f"c{i}", 1) for i in range(50)], RD.CHUNK_SCHEMA).coalesce(1)
    SK.append_jsonl(chunks, f"{tmp_path}/in", compressed=True)
    model = lambda p: '[{"question": "%d", "answer": "a"}]' % p.count("word")
    run = generate_incrementally(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck", model, language="english", pairs_per_chunk=2, parallelism=2)
    assert run.outcomes.count() == 50 and spark.read.json(f"{tmp_path}/out").count() == 50
    names = lambda at, kind: [p.name for p in tmp_path.glob(f"{at}/{kind}")]
    kept = names("in", "part-*") + names("ck/inbox/*", "part-*") + names("ck/work/*/*", "part-*")
    assert kept and all(x.endswith((".json.gz", ".zstd.parquet")) for x in kept)
    assert all(x.endswith(".json") for x in names("out", "part-*"))
