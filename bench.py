"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores.
Each query runs once to warm up and then three times; the median counts. Results go to a no-op sink,
so all output rows are produced.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from canvass.plans.catalog import QUERIES
from canvass.session import build_session

HEADLINE = [
    "B0_flagship", "B1_wrangle", "B2_census_tables", "B4_venue_tables", "B6_raw_options", "B7_answer_table",
    "B8_population", "B9_census_dashboard", "B9_dashboard_spending", "B9_dashboard_histogram",
    "B10_battery_by_country", "B10_spending_by_country", "B13_open_answers", "G6_percent_of_cases",
    "G13_mean_by", "G17_density", "G18_profile", "M3_summarise_draws", "M9_fit_ordinal", "U4_enrich_text",
    "W5_batches",
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in HEADLINE:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(3)), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
