"""Sorted runs: Parquet files in key order, with zstd pages, a Bloom filter on ``key`` and a checksum column."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.checksum import entry_crc
from tidelog.model import MIB, OPS_SCHEMA, Config
from tidelog.operators.compaction import number_runs
from tidelog.operators.resolve import latest
from tidelog.sources.manifest import Run

#: What a run's file holds; given on every read, so that no footer is read for it.
RUN_FILE_SCHEMA = T.StructType([*OPS_SCHEMA.fields, T.StructField("crc", T.LongType())])
#: Bytes of entries that are worth a task of their own.
RANGE_BYTES = 2 * MIB


def newest(ops: DataFrame) -> DataFrame:
    """Resolved entries that keep their sequence number and their deletes."""
    return latest(ops, payload=("seq", "is_tombstone", "value")).select(*OPS_SCHEMA.fieldNames())


def write_runs(ops: DataFrame, root: str, prefix: str, level: int, sequence: int, config: Config, size: int, entries: int, keep: Column | None = None) -> list[Run]:
    """Resolves operations (``size`` bytes, ``entries`` rows at most) and writes them as runs that don't overlap.

    One exchange deals the operations by key range; they are resolved, sorted and written
    inside their range. However small the runs, there are no more ranges than cores, or than
    RANGE_BYTES go into the whole. If the whole might exceed a run, each range closes a run before the entry that
    would exceed ``max_run_size``. ``keep`` filters resolved entries.
    """
    spark = ops.sparkSession
    cores, ranges = spark.sparkContext.defaultParallelism, math.ceil(size / RANGE_BYTES)
    n = max(1, min(math.ceil(size / config.max_run_size), max(cores, ranges)), min(cores, ranges))
    merged = newest(ops.repartitionByRange(n, "key"))
    merged = (merged if keep is None else merged.where(keep)).withColumn("crc", entry_crc()).sortWithinPartitions("key")
    path, split = f"{root}/runs/{prefix}", size > config.max_run_size
    if split:
        merged = number_runs(merged, config.max_run_size).sortWithinPartitions("output_run", "key")
    writer = (
        merged.write.option("compression", "zstd" if config.compression_enabled else "none")
        .option("parquet.compression.codec.zstd.level", config.compression_level)
        .option("parquet.bloom.filter.enabled#key", "true")
        .option("parquet.bloom.filter.fpp#key", config.bloom_fpp)
        .option("parquet.bloom.filter.expected.ndv#key", max(1000, entries // max(n, math.ceil(size / config.max_run_size))))
    )
    (writer.partitionBy("output_run") if split else writer).parquet(path)
    return described(spark, [path], {path: level}, sequence)


def described(spark: SparkSession, folders: list[str], level: dict[str, int], sequence: int | None) -> list[Run]:
    """The runs in folders, in key order: what they hold is read back. Without a sequence a run's newest operation stands for it."""
    meta = (
        spark.read.schema(RUN_FILE_SCHEMA).option("recursiveFileLookup", "true").parquet(*folders)
        .groupBy(F.input_file_name().alias("path"), F.col("_metadata.file_size").alias("bytes"))
        .agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("entries"), F.max("seq").alias("sequence"))
        .orderBy("min_key")
        .collect()
    )
    of = {f.rstrip("/").rsplit("/", 1)[1]: n for f, n in level.items()}
    return [Run(r.path, of[folder_of(r.path)], bytes(r.min_key), bytes(r.max_key), r.entries, r.bytes, sequence or r.sequence) for r in meta]


def folder_of(path: str) -> str:
    """The folder below ``runs/`` or ``log/`` that a file belongs to."""
    parts = path.rstrip("/").split("/")
    at = max(i for i, x in enumerate(parts) if x in ("runs", "log"))
    return parts[at + 1]


def read_runs(spark: SparkSession, runs: list[Run], crc: bool = False) -> DataFrame:
    """The operations of ``runs``, with ``crc`` their checksums too; an unreadable file raises, it is never skipped."""
    schema = RUN_FILE_SCHEMA if crc else OPS_SCHEMA
    return spark.read.schema(schema).parquet(*(r.path for r in runs)) if runs else spark.createDataFrame([], schema)


def sound(ops: DataFrame) -> DataFrame:
    """Operations without their checksums; one that fails its checksum raises."""
    wrong = F.raise_error(F.concat(F.lit("checksum mismatch at key "), F.hex("key"))).cast("boolean")
    held = F.when(F.col("crc").isNull() | (F.col("crc") == entry_crc()), F.col("is_tombstone")).otherwise(wrong)
    return ops.withColumn("is_tombstone", held).drop("crc")
