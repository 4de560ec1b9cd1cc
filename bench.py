"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR is the input (default /root/testdata/sf0.1), BENCH_CPUS the local cores. Each query
runs once to warm up and once timed (long ones only timed); results go to the no-op sink, so all of them is computed.
"""

from __future__ import annotations

import json
import os
import time

from loomtide.plans.queries import QUERIES
from loomtide.session import session

HEADLINE = ["sync_zoh", "sync_nearest", "sync_timestamp_merge", "tf_buffer", "tf_chain", "delta_transform_target", "shift_future_edge", "topic_timing_metrics", "segment_metrics", "duration_percentile_rank", "segment_assemble", "episode_axes", "list_stats", "task_remap", "episode_renumber"]
try:
    from loomtide.llm import queries as llm
except ImportError as missing:
    if missing.name not in {"loomtide.llm", "loomtide.llm.queries", "corpus_pipeline"}:
        raise
    llm = None
EXTRA = ["op1_embedding_dedup", "op2_packing", "op3_topk_bitsliced", "op4_quality", "op5_secret_scan", "op6_token_counts", "op7_simhash", "op8_toxicity", "op9_pii", "op10_bpe", "pipeline"]


#: Long jobs, timed in their only run.
ONCE = {"op4_quality", "op8_toxicity", "pipeline"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, spark_ui_enabled="false", spark_driver_memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    known = QUERIES | (llm.queries() if llm else {})
    took = {}
    for name in [*HEADLINE, *(EXTRA if llm else [])]:
        for _ in range(1 if name in ONCE else 2):
            began = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
