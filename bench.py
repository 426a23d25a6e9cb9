"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = ["kv_live_full", "kv_scan_range", "kv_multi_get", "kv_delete_then_put", "kv_merge_drop_tombstones", "kv_cursor_next_prev", "kv_import_text", "kv_level_stats", "kv_txn_commit", "kv_bloom_membership"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    here = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, here)
    os.environ["PYTHONPATH"] = f"{here}:{os.environ.get('PYTHONPATH', '')}"
    from tidelog import Config, Store
    from tidelog import queries as core
    from tidelog.cli import bench

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    queries = core.queries()
    for name in HEADLINE:
        runs = []
        for _ in range(3):  # the first compiles
            began = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs), 3)
    for _ in range(2):  # the first compiles
        with tempfile.TemporaryDirectory() as d, Store.open(spark, Config(d)) as store:
            for kind, s in bench(store, 100_000).items():
                took[f"store_100k_{kind[:-2]}"] = round(min(s, took.get(f"store_100k_{kind[:-2]}", s)), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
