"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from lodestone.plans import catalog
from lodestone.session import session

HEADLINE = ["issue_summary", "file_hotspots", "dedupe_max_severity", "debt_payoff_rank", "debt_rating", "churn_per_file", "coupling_metrics", "transitive_closure", "impact_risk", "coverage_rollup", "dead_code", "sanitizer_interval", "term_frequencies", "text_detectors", "normalized_dupes", "clone_links", "rule_engine", "session_windows"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times = {}
    catalog.QUERIES["severity_pivot"](spark, sf).write.format("noop").mode("overwrite").save()  # start-up is not a query's
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline queries, wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
