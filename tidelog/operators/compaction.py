"""Leveled compaction as manifest and run arithmetic; all of it DataFrame to DataFrame."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.model import MIB


def entry_bytes():
    """What an entry counts for when runs are split: its key and its value."""
    return (F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).cast("long")


def run_meta(ops: DataFrame, *by: str, **more: Column) -> DataFrame:
    """Per run: least and greatest key, entries, newest sequence, and any ``more`` aggregates."""
    return ops.groupBy(*by).agg(
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("entries"), F.max("seq").alias("sequence"), *(c.alias(n) for n, c in more.items())
    )


def overlapping(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """Pairs of runs whose inclusive key ranges meet. Both are manifests: rows per run, not per entry."""
    a = upper.select(F.col("run").alias("upper_run"), F.col("min_key").alias("a_min"), F.col("max_key").alias("a_max"))
    b = lower.select(F.col("run").alias("lower_run"), F.col("min_key").alias("b_min"), F.col("max_key").alias("b_max"))
    return a.join(b, (F.col("b_min") <= F.col("a_max")) & (F.col("b_max") >= F.col("a_min"))).select("upper_run", "lower_run")


def surviving(manifest: DataFrame, start=None, end=None) -> DataFrame:
    """Runs that a scan of [start, end) must read."""
    if start is not None:
        manifest = manifest.where(F.col("max_key") >= F.lit(start))
    return manifest if end is None else manifest.where(F.col("min_key") < F.lit(end))


def level_threshold_expr(level: str = "level", base: int = 10 * MIB, multiplier: int = 10):
    """Null for level 0; otherwise base * multiplier^(level-1) bytes."""
    return F.when(F.col(level) > 0, (F.lit(base) * F.pow(F.lit(multiplier), F.col(level) - 1)).cast("long"))


def levels_to_compact(manifest: DataFrame, trigger: int = 4, base: int = 10 * MIB, multiplier: int = 10) -> DataFrame:
    """Level 0 by its number of runs, the others by their bytes."""
    levels = manifest.groupBy("level").agg(F.count("*").alias("runs"), F.sum("bytes").alias("bytes"))
    due = F.when(F.col("level") == 0, F.col("runs") >= trigger).otherwise(F.col("bytes") > level_threshold_expr("level", base, multiplier))
    return levels.where(due)


def number_runs(entries: DataFrame, max_bytes: int, by: str | None = None) -> DataFrame:
    """Numbers output runs (``output_run``) within each partition as it is sorted, and anew for each value of ``by``.

    A run closes when the next entry would exceed ``max_bytes``; an entry larger than that
    has a run of its own. Filling is sequential, but a run is one search in the running sum.
    """
    held = entries.withColumn("_bytes", entry_bytes())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, run, full = None, 0, 0
        for b in batches:
            sizes = b.column("_bytes").to_numpy()
            names = b.column(by).to_pylist() if by else None
            edges = [0, *(i for i in range(1, len(sizes)) if names[i] != names[i - 1]), len(sizes)] if by else [0, len(sizes)]
            runs = np.empty(len(sizes), np.int32)
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if by and names[lo] != at:
                    at, run, full = names[lo], 0, 0
                sums = np.cumsum(sizes[lo:hi])
                i = 0
                while i < hi - lo:
                    done = int(sums[i - 1]) if i else 0
                    j = int(np.searchsorted(sums, done + max_bytes - full, "right"))
                    if j <= i and full:  # the next entry closes the run
                        run, full = run + 1, 0
                        continue
                    j = max(j, i + 1)
                    runs[lo + i : lo + j] = run
                    full += int(sums[j - 1]) - done
                    i = j
            yield pa.RecordBatch.from_arrays([*(c for c, n in zip(b.columns, b.schema.names, strict=True) if n != "_bytes"), pa.array(runs)], names=[*(n for n in b.schema.names if n != "_bytes"), "output_run"])

    return held.mapInArrow(number, T.StructType([*entries.schema.fields, T.StructField("output_run", T.IntegerType())]))


def split_greedy(entries: DataFrame, max_bytes: int, by: str) -> DataFrame:
    """Numbers output runs in key order within each range that ``by`` names (a guard level's ranges)."""
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.repartition(n, by).sortWithinPartitions(by, "key")
    return number_runs(dealt, max_bytes, by).withColumn("output_range", F.col(by).cast("string"))


def may_drop_tombstones(target_min, target_max, older_runs: list) -> bool:
    """Deletes may go only if no older run outside the compaction can hold their keys."""
    return not any(r.min_key <= target_max and r.max_key >= target_min for r in older_runs)
