"""Change streams: append to a store, or keep resolving."""
from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.sources.files import Files, scratch
from tidelog.store import Store

#: Rows of a stored table that a replay hands to the stream at a time; its state holds about that many and those still open.
REPLAY_ROWS = 2_000_000


def append_stream(changes: DataFrame, store: Store, checkpoint: str, flush_every: int = 0, name: str | None = None, **trigger) -> StreamingQuery:
    """Commits each micro-batch of operations as one log file; every ``flush_every`` batches it flushes.

    ``seq`` must order operations within a batch; batches follow each other. The commit that
    applies a batch also notes its number for the stream, which is known by ``name``, or else
    by its checkpoint, so a batch is applied once, whatever fails in between, and streams of
    one store don't meet.
    """
    stream = name or checkpoint.rstrip("/")

    def apply(batch: DataFrame, number: int) -> None:
        store.write_frame(batch, (stream, number))
        if flush_every and (number + 1) % flush_every == 0:
            store.flush()

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_per_key(changes: DataFrame, event_time: str, late: str = "1 hour") -> DataFrame:
    """Newest operation per key and hour of a stream, with operations later than ``late`` dropped."""
    seen = changes.withWatermark(event_time, late)
    return (
        seen.groupBy("key", F.window(event_time, "1 hour"))
        .agg(F.max_by(F.struct("seq", "is_tombstone", "value"), F.col("seq")).alias("_newest"))
        .select("key", F.col("window.start").alias("hour"), "_newest.*")
    )


def replayed(table: DataFrame, event_time: str, resolve: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """What ``resolve`` makes of a stored table that comes as a stream, in order of its event time.

    The table is written once, in slices by event time. The stream takes a slice at a time, so
    no row comes late, and the state that a slice has closed is gone before the next one. Its
    rows go to files, never through the driver. ``schema`` is that of the result.
    """
    spark = table.sparkSession
    staged, out = Files(spark, scratch(spark, "staged")), scratch(spark, "replayed")
    at = Files(spark, scratch(spark, "slices"))
    n, us = max(1, math.ceil(table.count() / REPLAY_ROWS)), F.unix_micros(event_time)
    cuts = table.agg(F.percentile_approx(us, [k / n for k in range(1, n)])).first()[0] or [] if n > 1 else []
    slices = sum(((us >= c).cast("int") for c in cuts), F.lit(0))
    table.withColumn("_slice", F.coalesce(slices, F.lit(0))).write.mode("append").partitionBy("_slice").parquet(staged.root)
    for k in range(len(cuts) + 1):
        if staged.exists(f"_slice={k}"):
            staged.move(f"_slice={k}", at.full(str(k)))
        stream = spark.readStream.schema(table.schema).option("recursiveFileLookup", "true").parquet(at.root)
        resolve(stream).writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", f"{out}-check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(out)
