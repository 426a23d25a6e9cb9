"""Vector tables in blocks: what both vector searches share.

Rows are dealt at random into blocks of about ``block_rows``. Each block's index is built
once and stored beside its rows as flat arrays. A stated set of queries meets every block:
a block's rows and index go to one task, followed by the queries in small lots, so what
moves is queries times blocks, never pairs, and no index is built or sent twice.
"""
from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import Stages, partitions

BLOCK_ROWS = 8192
#: Queries that move together.
LOT_ROWS = 256
_BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("values", pa.binary()), ("dims", pa.int32())])
_BLOCK_DDL = "block long, ids binary, values binary, dims int"


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, v array<double>) of rows whose vector is there and whose components are all there and finite."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False)))
    return vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(finite)


def apart(spark: SparkSession, count: int) -> int:
    """Partitions that hold about a block each, since Python gets many rows of a partition at once, with room so that few share one."""
    return max(2 * count, partitions(spark))


def blocks(rows: DataFrame, dims: int, count: int) -> DataFrame:
    """Rows (row, id, v) as ``count`` blocks (block, parts), shorter vectors filled with zeros to ``dims``.

    Tasks first pack what they hold of a block, so the shuffle moves flat arrays; a block's
    parts are then joined. Rows are dealt by their number, so neither an id nor a vector that
    repeats makes a block larger than others.
    """

    def part(batches):
        for b in batches:
            which, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            values = matrix(b.column(2), dims)
            for k in np.unique(which):
                at = which == k
                yield pa.RecordBatch.from_pydict({"block": [k], "ids": [ids[at].tobytes()], "values": [values[at].tobytes()], "dims": [dims]}, schema=_BLOCK)

    parts = rows.select(F.pmod(F.xxhash64("row"), F.lit(count)).cast("long").alias("block"), "id", "v").mapInArrow(part, _BLOCK_DDL)
    return parts.repartition(apart(rows.sparkSession, count), "block").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("ids", "values"))).alias("parts"))


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == dims).all():
        return np.ascontiguousarray(flat.reshape(-1, dims), np.float64)
    out = np.zeros((len(sizes), dims))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


def opened(parts: list[dict], dims: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(b"".join(p["ids"] for p in parts), np.int64)
    return ids, np.frombuffer(b"".join(p["values"] for p in parts), np.float64).reshape(len(ids), dims)


def indexed(data: DataFrame, dims: int, build: Callable) -> DataFrame:
    """Blocks with their index: (block, ids binary, values binary, arrays array<binary>)."""
    schema = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("values", pa.binary()), ("arrays", pa.list_(pa.binary()))])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids, values = opened(b.column(1)[i].as_py(), dims)
                arrays = [x.tobytes() for x in build(ids, values)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([ids.tobytes()]), pa.array([values.tobytes()]), pa.array([arrays], pa.list_(pa.binary()))], schema=schema)

    return data.select("block", "parts").mapInArrow(run, "block long, ids binary, values binary, arrays array<binary>")


def search(rows: DataFrame, modulus: int, k: int, build: Callable, load: Callable, stages: Stages, block_rows: int, score: str) -> DataFrame:
    """For ids divisible by ``modulus``, the best ``k`` of all other rows.

    ``build(ids, values)`` gives a block's index as a list of arrays, ``load(ids, values,
    buffers)`` makes a searcher of it: a function from (query ids, query values) to (query
    place, row place, score, size) arrays, at least the best ``k`` of the block for each
    query, or what its index finds. Best is the highest score; of equal scores the highest
    size (the same number in double precision), then the smaller id.
    """
    rows = stages.keep(rows.withColumn("row", F.monotonically_increasing_id()))
    shape = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dims"), F.count_if(F.col("id") % modulus == 0).alias("q")).first()
    count, dims = max(1, math.ceil(shape.n / block_rows)), shape.dims
    stored = stages.keep(indexed(blocks(rows, dims, count), dims, build))
    lots = blocks(rows.where(F.col("id") % modulus == 0), dims, max(1, math.ceil(shape.q / LOT_ROWS)))
    queries = lots.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("block"), F.col("block").alias("lot"), "parts")
    none, one = F.lit(None), F.array(F.struct("ids", "values"))
    first = stored.select("block", F.lit(-1).cast("long").alias("lot"), one.alias("parts"), "arrays")
    dealt = first.unionByName(queries.withColumn("arrays", none.cast("array<binary>"))).repartition(apart(rows.sparkSession, count), "block").sortWithinPartitions("block", "lot")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64() if score == "double" else pa.int64()), ("size", pa.float64())])

    def meet(batches):
        find = ids = None
        for b in batches:
            for i in range(b.num_rows):
                mine, values = opened(b.column(2)[i].as_py(), dims)
                if b.column(1)[i].as_py() < 0:  # a block's own rows come before its queries
                    ids, find = mine, load(mine, values, b.column(3)[i].as_py())
                    continue
                q, r, s, size = find(mine, values)
                yield pa.RecordBatch.from_arrays([pa.array(mine[q]), pa.array(ids[r]), pa.array(s, schema.field(2).type), pa.array(size, pa.float64())], schema=schema)

    met = dealt.mapInArrow(meet, f"query_id long, vec_id long, score {score}, size double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("size"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
