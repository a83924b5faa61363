"""Headline timings. Prints one JSON line; each query is written to the noop sink, so all columns are computed."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import CHECKS  # noqa: E402
from marketloom.session import build_session  # noqa: E402

HEADLINE = [
    "a11_risk_summary", "w16_technical_features", "w18_sentiment_features", "f02_lexical_scores", "q07_training_frame",
    "m01_model_frame", "a17_column_medians", "m02_time_holdout", "m03_expanding_windows", "m05_ridge_fold_metrics",
    "m06_forest_regressor", "m12_contributions", "w24_feature_drivers", "b01_briefing_mart", "b03_signal_summary", "s05_upsert_prices", "s07_upsert_news", "q05_market_feature_source",
    "q09_latest_prediction", "a03_price_profile",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    timings: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(repeats + 1):  # the first run warms up
            start = time.perf_counter()
            CHECKS[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
            spark.catalog.clearCache()
            if sum(runs) > 90:
                break
        timings[name] = round(statistics.median(runs[1:] or runs), 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
