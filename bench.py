"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR picks the data, BENCH_CPUS the cores. Each query runs once cold and then
BENCH_REPEATS times (default 3); its value is the median of the warm runs. Results go to the
no-op sink, so every row is produced and none is collected.
"""

import json
import os
import statistics
import sys
import time

from leafmill.plans.registry import registry
from leafmill.session import build_session

HEADLINE = [
    "html_titles",
    "html_nav_links",
    "html_articles",
    "html_tag_counts",
    "catalog_roundtrip",
    "catalog_multisite",
    "page_suggestions",
    "json_props",
    "json_api_roundtrip",
    "json_suggestions",
    "decode_charsets",
    "url_admission",
    "resource_audit",
    "byte_cap_runs",
    "paginate_sites",
    "redirect_chains",
    "robots_admission",
    "politeness",
    "dedupe_documents",
    "natural_sort_preview",
    "fill_report",
    "csv_cells",
    "event_fold",
    "run_results",
    "retention",
    "rule_violations",
    "stream_links",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = registry()
    warm, cold = {}, {}
    for name in sys.argv[1:] or HEADLINE:
        query, _ = found[name]
        times = []
        for _ in range(1 + repeats):
            started = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        cold[name] = round(times[0], 3)
        warm[name] = round(statistics.median(times[1:] or times), 3)
    print(
        json.dumps(
            {
                "metric": "headline query seconds, median of warm runs",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "spark": spark.version,
                "cpus": int(cpus),
                "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
            }
        )
    )


if __name__ == "__main__":
    main()
