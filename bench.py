"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs twice. ``queries`` has the second time, building and planning
included; ``first_run`` the first one, which also pays for code generation and
JVM warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shellsieve.plans import load_catalogue  # noqa: E402
from shellsieve.session import build_session  # noqa: E402

HEADLINE = [
    "redteam_summary", "evasion_by_group", "decide_verdict_actions", "attck_derive", "corpus_dedup_first_wins",
    "corpus_dedup_normalized", "leakage_report", "stratified_split", "split_action_floor", "holdout_90_10",
    "token_windows", "segment_merge", "ngram_linear_score", "mask_patterns", "session_rollup", "micro_prf",
    "per_label_prf", "roc_auc", "pr_auc", "threshold_table", "threshold_tune", "key_difference", "batch_score",
]
# rows of the input each throughput figure refers to
COMMANDS = {"ngram_linear_score": "conversations", "decide_verdict_actions": "embeddings", "batch_score": "documents",
            "session_rollup": "events", "redteam_summary": "documents"}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    queries, _ = load_catalogue()
    spark = build_session(f"local[{cpus}]", int(cpus), **{"spark.driver.memory": "16g",
                                                          "spark.python.sql.dataFrameDebugging.enabled": "false"})
    queries["redteam_summary"](spark, folder).write.format("noop").mode("overwrite").save()  # JVM warm-up
    queries["batch_score"](spark, folder).write.format("noop").mode("overwrite").save()

    def timed(name):
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    first, seconds, ms_per_row = {}, {}, {}
    for name in HEADLINE:
        first[name], seconds[name] = timed(name), timed(name)
        if name in COMMANDS:
            rows = spark.read.parquet(f"{folder}/{COMMANDS[name]}.parquet").count()
            ms_per_row[name] = round(1000 * seconds[name] / rows, 4)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "first_run": first, "first_run_total": round(sum(first.values()), 3), "ms_per_row": ms_per_row, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
