"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line with seconds per query.

Two queries over the smallest tables warm the session up; then each query is timed once, cold, from building its plan to its last row.
Results go to a no-op sink, so no rows pass through the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from codefacts.plans.catalog import REGISTRY  # noqa: E402
from codefacts.session import local_session  # noqa: E402

HEADLINE = (
    # change history
    "hotspot_files", "churn_daily", "rolling_churn_90_days", "commit_summary", "commit_authors", "growth_by_file",
    # sizes
    "overview_one_pass", "largest_files", "sloc_by_language", "source_lines",
    # facts and graph
    "python_facts", "symbol_index", "call_graph", "include_resolution", "endpoint_paths", "event_succession_cycles",
    # structure, rules, audit
    "components", "core_modules", "rule_findings", "audit_verdict", "line_rule_hits", "pairing_hits", "ci_findings",
    # queries, diffs, contracts, streams
    "nested_query_flags", "snapshot_diff", "contract_errors", "stream_daily_churn",
)

#: run once over the smallest tables before anything is timed
WARM_UP = ("churn_daily", "python_facts")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n] or list(HEADLINE)
    spark = local_session("codefacts-bench", cpus=cpus, **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
    })
    # start-up is no query's time: code is loaded and one scan with a shuffle and a Python worker has run before the first one
    spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").count().collect()
    small = Path(sf_dir).parent / "sf0.001"
    for name in WARM_UP:
        REGISTRY[name].run(spark, str(small) if small.exists() else sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
