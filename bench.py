"""Time the headline queries; prints one JSON line.

Each query is written to the ``noop`` sink, so all rows and columns are computed and nothing is
collected.  The landing of the page tables (test data preparation) is timed on its own.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from adlens.plans import catalog  # noqa: E402
from adlens.session import build_session  # noqa: E402
from adlens.sources import fixtures  # noqa: E402

HEADLINE = [
    "flagship", "prepare_listings", "dedupe_keep_first", "explode_listings", "collect_listings", "pages_until_empty",
    "price_cursor", "item_section", "seller_columns", "median_by_category", "median_by_location", "price_percentiles",
    "price_stats_by_seller", "price_histogram", "boxplot_by_location", "describe_numeric", "missing_fraction",
    "default_title_rules", "feature_correlation", "mutual_information", "daily_counts", "tabular_features",
    "vocabulary", "encode_tokens", "tfidf_documents", "attention_pool", "position_encode", "regression_metrics",
    "predictions", "score_frozen_network", "stream_dedupe",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)

    timed("land_search_pages", lambda: fixtures.search_pages(spark, sf_dir))
    timed("land_item_pages", lambda: fixtures.item_pages(spark, sf_dir))
    for name in HEADLINE:
        timed(name, lambda: catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    queries = {k: v for k, v in times.items() if not k.startswith("land_")}
    print(json.dumps({"metric": "total_headline_query_time", "value": round(sum(queries.values()), 3), "unit": "sec",
                      "queries": times, "n_queries": len(queries), "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
