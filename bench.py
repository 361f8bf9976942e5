"""Headline queries, timed on one machine: median of three warm runs each, one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = ["q9_price_drops", "w6_change_history", "st1_upsert_outcomes", "st4_current_state", "q1_search_all", "f7_search_all_retailers", "o1_page_by_price", "q5_list_retailers", "q6_list_brands_listed", "q8_compare_brand", "a7_compare_market", "q11_matrix", "q12_chart_series", "st3_absences", "t5_clean_title", "n1_prices", "m4_candidates", "m6_decisions"]


def main() -> None:
    path, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 8g pyspark-shell")
    from pricetide.plans.catalogue import QUERIES
    from pricetide.session import session

    spark = session(f"local[{cpus}]", int(cpus), **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    took = {}
    for name in names:
        runs = []
        for _ in range(1 + int(os.environ.get("BENCH_RUNS", "3"))):
            start = time.perf_counter()
            QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(median(runs[1:]), 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": path.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
