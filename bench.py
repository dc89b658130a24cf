"""Bench: run the headline queries on $BENCH_SF_DIR (default /root/testdata/sf0.1) with
local[$BENCH_CPUS] and print one JSON line with per-query wall seconds.

Each query is fully evaluated through the no-op sink (every row and column computed,
nothing collected to the driver), after one untimed warm-up run of every query on the
smallest table set (``$BENCH_WARMUP_DIR``, default the sibling ``sf0.001`` folder)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "chunk_corpus",
    "chunk_stats",
    "split_sentences",
    "word_frequencies",
    "encode_texts",
    "mlm_mask",
    "qa_with_fallback",
    "reward_composite",
    "score_response_vllm",
    "take_first_usable_attempt",
    "synthesize_instructions",
    "resume_pending",
    "to_grpo_prompt",
    "train_bpe",
    "score_pairs",
    "number_chunks",
    "pair_turns",
    "corpus_stats",
    "incremental_run",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from scriptorium.plans.catalog import QUERIES
    from scriptorium.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16, app="scriptorium-bench")
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    # Warm-up (not timed): each query once on the smallest table set, so the timed runs
    # measure steady state rather than JIT compilation and Python-worker start-up.
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001"))
    if os.path.isdir(warm_dir):
        for name in names:
            QUERIES[name][0](spark, warm_dir).write.format("noop").mode("overwrite").save()
    else:
        QUERIES["count_tokens"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {timings[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
