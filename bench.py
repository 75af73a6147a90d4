"""Times the headline queries: one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]. Each query is run once to warm
up and then timed over its whole result.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "flagship_lcoe_by_type_year", "capacity_factor_by_unit", "re_usable_min", "vallcoe", "reliability_lolp", "price_lambda_mu", "duration_curve", "lag_features",
    "merit_order_dispatch", "marginal_unit", "cumulative_vintage_capacity", "npv_cashflow", "outage_overlap_factor", "nearest_node", "parallel_line_merge", "eal_by_node",
    "impute_median", "components", "simplex_dispatch", "commitment_kpis", "reduced_chains", "worst_second_losses", "renewable_projects",
]


def main() -> None:
    root = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, root)
    os.environ["PYTHONPATH"] = f"{root}:{os.environ.get('PYTHONPATH', '')}"
    from wattspan import catalog
    from wattspan.session import session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
