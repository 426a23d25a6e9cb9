"""Text import and export."""
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions.text import parse_lines, render

#: A line's number is its file's number and its place in the file: places below 2^40.
FILE_BITS = 40


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in file order: (line, seq); files follow in name order, lines as they stand.

    The place of a line comes from its block's start and its place inside the block, both of
    which are the same however often the file is read. Blocks are counted up within their
    file, so no more than one file's blocks meet in a task.
    """
    raw = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")
    )
    blocks = raw.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    files = blocks.select("_file").distinct().select("_file", (F.row_number().over(Window.orderBy("_file")) - 1).cast("long").alias("_number"))  # a row per file
    placed = starts.join(files, "_file")
    at = F.shiftleft("_number", FILE_BITS) + F.col("_start") + F.col("_at") - F.col("_first")
    return raw.join(placed, ["_file", "_block"]).select("line", at.alias("seq"))


def import_text(spark: SparkSession, path: str) -> DataFrame:
    """Operations of a ``key:value`` file; later lines win when resolved."""
    return parse_lines(read_lines(spark, path))


def export_text(kv: DataFrame, path: str) -> None:
    """Writes live pairs as ``key => value`` lines in key order."""
    kv.orderBy("key").select(render().alias("value")).write.text(path)
