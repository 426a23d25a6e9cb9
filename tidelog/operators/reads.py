"""Point, multi-key and range reads over a resolved frame or an operation log.

Each function filters on the key first, so that the filter reaches the Parquet
scan below the resolution.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators.resolve import visible
from tidelog.sources.files import scratch


def key_range(df: DataFrame, start=None, end=None, key: str = "key") -> DataFrame:
    """Keys in the half-open range [start, end); None leaves a side open."""
    if start is not None:
        df = df.where(F.col(key) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(key) < F.lit(end))
    return df


def get(ops: DataFrame, key) -> DataFrame:
    """At most one row: the live value of ``key``."""
    return visible(ops.where(F.col("key") == F.lit(key)))


def of_keys(ops: DataFrame, keys: DataFrame) -> DataFrame:
    """Operations on any of ``keys`` (a one-column frame).

    No broadcast is forced: Spark's size estimate chooses between that and a shuffle.
    """
    return ops.join(keys.select(F.col(keys.columns[0]).alias("key")), "key", "left_semi")


def multi_get(ops: DataFrame, keys: DataFrame) -> DataFrame:
    """Live values of all ``keys`` by one semi-join below the resolution."""
    return visible(of_keys(ops, keys))


def scan(ops: DataFrame, start=None, end=None, reverse: bool = False, limit: int | None = None) -> DataFrame:
    """Live pairs of [start, end) in key order; with ``limit`` a top-k without a full sort."""
    out = visible(key_range(ops, start, end)).orderBy(F.desc("key") if reverse else F.asc("key"))
    return out if limit is None else out.limit(limit)


def first(ops: DataFrame) -> DataFrame:
    return scan(ops, limit=1)


def last(ops: DataFrame) -> DataFrame:
    return scan(ops, reverse=True, limit=1)


def ceiling(ops: DataFrame, target) -> DataFrame:
    """The first live pair whose key is at or after ``target``."""
    return scan(ops, start=target, limit=1)


def floor(ops: DataFrame, target) -> DataFrame:
    """The last live pair whose key is at or before ``target``."""
    return visible(ops.where(F.col("key") <= F.lit(target))).orderBy(F.desc("key")).limit(1)


def successor(ops: DataFrame, key) -> DataFrame:
    return visible(ops.where(F.col("key") > F.lit(key))).orderBy("key").limit(1)


def predecessor(ops: DataFrame, key) -> DataFrame:
    return visible(ops.where(F.col("key") < F.lit(key))).orderBy(F.desc("key")).limit(1)


def neighbours(kv: DataFrame, buckets: int | None = None) -> DataFrame:
    """Every live key with the key before and after it.

    The order is global, so a plain window would run in one task. Keys are dealt by range
    and written once with their range's number; each range then needs only the edge keys
    of the others, one row per range.
    """
    spark = kv.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = scratch(spark, "neighbours")
    kv.select("key").repartitionByRange(n, "key").withColumn("_range", F.spark_partition_id()).write.parquet(at)
    dealt = spark.read.schema(T.StructType([kv.schema["key"], T.StructField("_range", T.IntegerType())])).parquet(at)
    edges = dealt.groupBy("_range").agg(F.min("key").alias("_lo"), F.max("key").alias("_hi"))
    order = Window.orderBy("_range")
    edges = edges.select("_range", F.lag("_hi").over(order).alias("_before"), F.lead("_lo").over(order).alias("_after"))
    inside = Window.partitionBy("_range").orderBy("key")
    near = dealt.select("key", "_range", F.lag("key").over(inside).alias("_prev"), F.lead("key").over(inside).alias("_next"))
    # a row per range
    return near.join(F.broadcast(edges), "_range", "left").select(
        "key", F.coalesce("_prev", "_before").alias("prev_key"), F.coalesce("_next", "_after").alias("next_key")
    )


def seek_many(kv: DataFrame, targets: list) -> DataFrame:
    """Ceiling and floor of each of a short list of targets, in one pass over the keys."""
    spark: SparkSession = kv.sparkSession
    at = [F.min(F.when(F.col("key") >= F.lit(t), F.col("key"))).alias(f"c{i}") for i, t in enumerate(targets)]
    below = [F.max(F.when(F.col("key") <= F.lit(t), F.col("key"))).alias(f"f{i}") for i, t in enumerate(targets)]
    if not targets:
        return spark.createDataFrame([], "target string, ceiling_key string, floor_key string")
    one = kv.agg(*at, *below)
    rows = F.array(*(F.struct(F.lit(t).alias("target"), F.col(f"c{i}").alias("ceiling_key"), F.col(f"f{i}").alias("floor_key")) for i, t in enumerate(targets)))
    return one.select(F.inline(rows))
