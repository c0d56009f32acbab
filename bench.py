"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Results go to Spark's
noop sink, so every row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from vitalgrid.queries import load
from vitalgrid.session import get_session

HEADLINE = [
    "axis_features_serving", "axis_features_training", "slope_features", "parse_sensor_records",
    "metric_points", "metric_post_numbers", "keyed_table_upsert", "last_event_per_time", "valid_user_readings",
    "forward_fill", "ordinal_position", "asof_backward", "asof_forward", "asof_nearest", "aligned_sensors",
    "aligned_sensors_by_epoch", "ensemble_slots", "weighted_vote", "majority_vote", "full_outer_by_window",
    "impute_missing_class", "oversample_minorities", "fit_gaussian_nb", "score_gaussian_nb",
    "fit_multinomial_nb", "score_multinomial_nb", "signal_cut_points", "network_fit", "posteriors",
    "novelty_decision", "trailing_novelty_rate", "physio_records", "sensor_forest", "stream_axis_features",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        f"local[{cpus}]", "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()  # start the workers
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(sf.group(1)) if sf else None,
    }))


if __name__ == "__main__":
    main()
