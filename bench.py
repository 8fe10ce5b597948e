"""Time the headline queries and print one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidemark.catalog import load  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINE = (
    "e2e_day1_regret", "e2e_day1_regret_wide", "e2e_02_daily_table", "e2e_01_prepare", "e2e_01_prepare_wide",
    "fea_17_build_features", "fea_20_attach_leads", "lab_10_monthly_oracle_wide", "sel_06_all_policies",
    "sel_07_lead_rules", "agg_03_metrics_with_wealth", "agg_05_oracle_ranges", "agg_06_oracle_profile",
    "sta_02_block_bootstrap", "sta_02_block_bootstrap_library_generator", "sta_03_random_strategy",
    "sta_10_all_strategies", "ml_01_expanding_folds", "ml_07_walk_forward", "e2e_03_strategy_metrics",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus), **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    cases = load()
    timings = {}
    cases["e2e_day1_regret"].run(spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    for name in HEADLINE:
        begun = time.perf_counter()
        cases[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - begun, 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
