"""Times headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``, after one warm-up each, and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import load  # noqa: E402
from heatloom.session import session  # noqa: E402

HEADLINE = [
    "missing_points", "gap_spans", "rollup_daily_sum", "iqr_filter", "drop_flat_lines", "split_at_gaps",
    "interpolate_linear", "clean_basic", "clean_interpolated", "join_weather", "holiday_flag", "star_enrich",
    "lag_lead_columns", "supervised_frame", "sliding_windows", "row_index", "split_time", "standardize_per_series",
    "seasonal_naive", "linear_forecast", "metrics_core", "metrics_per_id", "describe_columns", "recipe_features",
    "recipe_prepare", "recipe_electricity", "recipe_traffic",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        for _ in range(2):  # the first run warms up
            begin = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - begin, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
