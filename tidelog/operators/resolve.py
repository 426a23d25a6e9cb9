"""Last-write-wins resolution: the core of every read, flush and compaction.

``max_by`` aggregates map-side before the one exchange on ``key``. Conditions on
the key may stand below it (Catalyst pushes them to the scan); conditions on the
value or on ``is_tombstone`` must stay above it, or old values would come back.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(ops: DataFrame, key: str = "key", order: str | Column = "seq", payload: tuple[str, ...] = ("is_tombstone", "value")) -> DataFrame:
    """The newest operation of each key, deletes included. ``order`` must be unique within a key."""
    order = F.col(order) if isinstance(order, str) else order
    newest = ops.groupBy(key).agg(F.max_by(F.struct(*payload), order).alias("_newest"))
    return newest.select(key, *(F.col(f"_newest.{c}").alias(c) for c in payload))


def live(resolved: DataFrame, tombstone: str = "is_tombstone") -> DataFrame:
    """Drops deleted keys from a resolved frame."""
    return resolved.where(~F.col(tombstone)).drop(tombstone)


def visible(ops: DataFrame, **kw) -> DataFrame:
    return live(latest(ops, **kw))


def as_of(ops: DataFrame, seq: int) -> DataFrame:
    """The state after replaying the log up to and including ``seq``."""
    return visible(ops.where(F.col("seq") <= seq))


def merge_runs(runs: list[DataFrame], drop_tombstones: bool = False, run_sequence: str | None = None) -> DataFrame:
    """Newest-wins union of runs.

    Later runs in the list win where ``seq`` is equal; give ``run_sequence`` to order
    by a run number before ``seq``. Whole rows survive, whatever their columns. Each task
    keeps one row per key before the exchange.
    """
    tagged = reduce(lambda a, b: a.unionByName(b), (r.withColumn("_source", F.lit(i)) for i, r in enumerate(runs)))
    columns = runs[0].columns
    order = F.struct(*(F.col(c) for c in ([run_sequence] if run_sequence else []) + ["seq", "_source"]))
    top = tagged.groupBy("key").agg(F.max_by(F.struct(*(c for c in columns if c != "key")), order).alias("_top"))
    merged = top.select(*(F.col("key") if c == "key" else F.col("_top").getField(c).alias(c) for c in columns))
    return merged.where(~F.col("is_tombstone")) if drop_tombstones else merged


def superseded(ops: DataFrame) -> DataFrame:
    """Per key, how many operations a compaction would discard."""
    return ops.groupBy("key").agg((F.count("*") - 1).alias("superseded"))
