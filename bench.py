"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINES = (
    "reward_by_segment", "reward_run", "grade_trajectory", "grade_attempts", "group_summary", "latency_percentiles", "run_summary",
    "matched_comparison", "usage_reconciliation", "latest_attempt_per_case", "running_outlier", "first_seen_failure_signature",
    "prior_duplicate_lookup", "extract_preference_pairs", "validate_transitions", "privacy_findings", "benchmark_leakage_scan", "bandit_dataset",
    "linucb_gram", "replay_compare", "ope_diagnostics", "bootstrap_ci", "metrics_scorecard", "budget_admission_replay",
)


def main() -> None:
    from assaylake.plans import catalog
    from assaylake.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    only = os.environ.get("BENCH_ONLY")
    names = [n for n in HEADLINES if not only or n in only.split(",")]
    spark = local_session("bench", cpus)
    queries = catalog.queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run(names[0])  # warm-up: JVM, codegen and file listing
    seconds = {}
    for name in names:
        seconds[name] = round(statistics.median(run(name) for _ in range(repeats)), 3)
        print(f"{name}: {seconds[name]}s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder.rstrip("/").split("/")[-1]}))


if __name__ == "__main__":
    main()
