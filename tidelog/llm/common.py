"""What the corpus operators share: materialised stages on shared storage, tables, Arrow helpers."""
from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches handed to Python are cut to about this much text, so long documents don't add up.
BATCH_BYTES = 8 << 20
#: Rows that Spark gathers for Python at once, unless the session says otherwise; its own 10,000 long documents are too many.
BATCH_ROWS = 1000
#: Small tables are written in parts of at least about so many narrow rows, or so many bytes of documents.
PART_ROWS, PART_BYTES = 25_000, 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset and all tasks run on this machine, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tidelog-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, BATCH_ROWS)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001  the session may have ended before the interpreter does
        return


class Stages:
    """Tables written to the shared folder, so that lineage ends there and a lost executor costs no more.

    ``keep`` writes a frame and returns it reread; ``drop`` and ``only`` remove what later
    steps no longer need; the rest goes when the interpreter ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.n, self.held = 0, set()
        bound_batches(spark)
        atexit.register(_delete_at_exit, spark, self.root)

    def keep(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """``rows`` is a bound of the rows to come, if one is known."""
        df = df if rows is None else df.coalesce(max(1, math.ceil(rows / PART_ROWS)))
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        self.held.add(path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self.held.discard(df._stage_path)
            delete(self.spark, df._stage_path)

    def only(self, *frames: DataFrame) -> None:
        """Drops all tables but these."""
        for path in self.held - {df._stage_path for df in frames}:
            delete(self.spark, path)
        self.held = {df._stage_path for df in frames}


def few(df: DataFrame, source: DataFrame) -> DataFrame:
    """``df`` in no more parts than the size of ``source``, from whose rows it comes, needs. Sizes that are unknown count as large."""
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(max(1, size // PART_BYTES)) if size < partitions(df.sparkSession) * PART_BYTES else df


def digest_of(text: str | Column) -> Column:
    """16 bytes that name a text."""
    return F.substring(F.unhex(F.sha2(F.col(text).cast("binary") if isinstance(text, str) else text, 256)), 1, 16)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that ``column`` holds about BATCH_BYTES in each, one row at least."""
    for b in batches:
        n, size = b.num_rows, b.column(b.schema.get_field_index(column)).nbytes
        step = max(1, n * BATCH_BYTES // size) if size > BATCH_BYTES else max(1, n)
        for at in range(0, n, step):
            yield b.slice(at, step)


def rows_out(schema: pa.Schema, f: Callable[[pa.RecordBatch], dict]) -> Callable:
    """A mapInArrow function from one that turns a batch into columns."""

    def apply(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict(f(b), schema=schema)

    return apply


def text_of(value: str | None) -> str:
    return "" if value is None else value


class Memo(dict):
    """A dictionary that computes missing values and holds two generations of ``limit`` entries at most.

    When the young one is full it becomes the old one; what is asked for again moves back.
    """

    def __init__(self, f: Callable, limit: int = 1 << 16):
        super().__init__()
        self.f, self.limit, self.old = f, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        v = self.old.get(key)
        if v is None:
            v = self.f(key)
        self[key] = v
        return v
