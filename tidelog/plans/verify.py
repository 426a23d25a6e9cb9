"""Integrity checks that recompute what the manifest and the entries claim."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions.checksum import entry_crc
from tidelog.sources.runs import RUN_FILE_SCHEMA


def verify(store) -> list[str]:
    """Faults found; an empty list means the store is sound."""
    faults, spark, m = [], store.spark, store.manifest
    if m.runs:
        by_path = {r.path: r for r in m.runs}
        found = (
            spark.read.schema(RUN_FILE_SCHEMA).parquet(*by_path)
            .groupBy(F.input_file_name().alias("path"))
            .agg(
                F.count_if(~F.col("crc").eqNullSafe(entry_crc())).alias("bad"),
                F.min("key").alias("lo"),
                F.max("key").alias("hi"),
                F.count("*").alias("n"),
                F.count_distinct("key").alias("keys"),
            )
            .collect()
        )
        for row in found:
            run = by_path[row.path]
            if row.bad:
                faults.append(f"{row.path}: {row.bad} entries fail their checksum")
            if (bytes(row.lo), bytes(row.hi), row.n) != (run.min_key, run.max_key, run.entries):
                faults.append(f"{row.path}: its keys are not those that the manifest states")
            if row.keys != row.n:
                faults.append(f"{row.path}: a key occurs more than once")
        if missing := by_path.keys() - {r.path for r in found}:
            faults.append(f"runs hold no entries: {sorted(missing)}")
    for level in range(1, 1 + max((r.level for r in m.runs), default=0)):
        runs = sorted(m.level(level), key=lambda r: r.min_key)
        faults += [f"level {level}: {a.path} and {b.path} overlap" for a, b in zip(runs, runs[1:], strict=False) if b.min_key <= a.max_key]
    return faults
