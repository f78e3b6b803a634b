"""Headline queries on ``$BENCH_SF_DIR``; prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from strideframe.catalog.queries import QUERIES  # noqa: E402
from strideframe.session import local_session  # noqa: E402

HEADLINE = [
    "rolling_stats",
    "rolling_stats_arrow",
    "rolling_stats_blocked",
    "rolling_irregular",
    "rolling_long_trials",
    "feature_extraction",
    "train_test_split",
    "train_test_split_strata",
    "split_balance",
    "standard_scaler",
    "row_position",
    "trial_numbering",
    "channel_select",
    "ingest_trials",
    "classification_scores",
    "regression_scores",
    "regression_histogram",
    "importance_rollup",
    "label_order",
    "class_weights",
    "speed_regressor",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start the session before the clock
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "headline queries, total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
