"""Physical-plan checks: column pruning at the scan, partial aggregation, no codegen-hostile
shapes in the hot paths."""

from scriptorium.plans.catalog import QUERIES

from conftest import SF001


def _plan(spark, name):
    df = QUERIES[name][0](spark, SF001)
    return df._jdf.queryExecution().executedPlan().toString()


def test_word_frequencies_prunes_and_combines(spark):
    plan = _plan(spark, "word_frequencies")
    assert "ReadSchema: struct<text:string>" in plan
    assert "partial_count" in plan


def test_attempts_use_hash_aggregate(spark):
    plan = _plan(spark, "take_first_usable_attempt")
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert "partial_min_by" in plan


def test_reward_query_reads_only_needed_columns(spark):
    plan = _plan(spark, "reward_length")
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,text:string>" in plan


def test_chunking_has_no_inferred_duplicate_filter(spark):
    plan = _plan(spark, "pack_chunks")
    # explode would make the optimizer add "size(chunks) > 0" below the projections and
    # evaluate the whole split twice; the outer form keeps a single evaluation.
    assert "Filter (size(" not in plan and "Filter ((size(" not in plan


def test_numbering_caches_nothing_and_holds_no_literal_offsets(spark):
    plan = _plan(spark, "chunk_corpus")
    assert "InMemoryTableScan" not in plan and "BroadcastExchange" in plan and "element_at" not in plan


def test_pair_turns_sorts_once(spark):
    plan = _plan(spark, "read_instruction_source") + _plan(spark, "pair_turns")
    assert "SortAggregate" not in plan
    assert _plan(spark, "pair_turns").count("Exchange hashpartitioning") == 1
