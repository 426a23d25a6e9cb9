"""Command line: put, get, del, scan, stats, bench, compact, verify, import."""
from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidelog.model import Config
from tidelog.plans.stats import render
from tidelog.store import Store


class Parser(argparse.ArgumentParser):
    def error(self, message: str):
        """An unknown verb or a wrong call ends with 1."""
        self.print_usage(sys.stderr)
        self.exit(1, f"{self.prog}: {message}\n")


def parser() -> argparse.ArgumentParser:
    p = Parser(prog="tidelog", description=__doc__)
    p.add_argument("--dir", default="./tidelog_data")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb, names in {"put": ["key", "value"], "get": ["key"], "del": ["key"], "scan": ["start", "end"], "import": ["file"], "stats": [], "compact": [], "verify": []}.items():
        sub = verbs.add_parser(verb)
        for n in names:
            sub.add_argument(n)
    bench = verbs.add_parser("bench")
    bench.add_argument("--rows", type=int, default=100_000)
    return p


def bench(store: Store, rows: int) -> dict[str, float]:
    """Batch forms of sequential puts, strided gets, a range scan and deletes."""
    spark, out = store.spark, {}

    def timed(name, f):
        began = time.perf_counter()
        f()
        out[name] = time.perf_counter() - began

    key = F.format_string("bench_key_%010d", "id")
    puts = spark.range(rows).select(key.alias("key"), F.col("id").alias("seq"), F.lit(False).alias("is_tombstone"), F.lit("x" * 70).alias("value"))
    timed("puts_s", lambda: store.write_frame(puts))
    timed("flush_s", store.flush)
    timed("gets_s", lambda: store.multi_get(spark.range(0, rows, 10).select(key)).count())
    timed("scan_s", lambda: store.scan(f"bench_key_{rows // 2:010d}", f"bench_key_{rows // 2 + rows // 10:010d}").count())
    timed("deletes_s", lambda: store.write_frame(spark.range(0, rows, 2).select(key.alias("key"), F.col("id").alias("seq"), F.lit(True).alias("is_tombstone"), F.lit(None).cast("binary").alias("value"))))
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tidelog").getOrCreate()
    with Store.open(spark, Config(args.dir)) as store:
        if args.verb == "put":
            store.put(args.key, args.value)
            print("OK")
        elif args.verb == "get":
            value = store.get(args.key)
            if value is None:
                print("(nil)")
                return 1
            print(value.decode(errors="replace"))
        elif args.verb == "del":
            store.delete(args.key)
            print("OK")
        elif args.verb == "scan":
            n = 0
            for n, r in enumerate(store.scan(args.start, args.end).toLocalIterator(), 1):
                print(f"{bytes(r.key).decode(errors='replace')} => {bytes(r.value).decode(errors='replace')}")
            if not n:
                print("(empty)")
        elif args.verb == "import":
            print(f"imported {store.import_text(args.file)} entries")
        elif args.verb == "stats":
            print(render(store.stats()))
        elif args.verb == "compact":
            store.compact()
            print(render(store.stats()))
        elif args.verb == "verify":
            faults = store.verify()
            print("\n".join(faults) or "OK")
            return int(bool(faults))
        elif args.verb == "bench":
            for name, s in bench(store, args.rows).items():
                print(f"{name}: {s:.3f}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
