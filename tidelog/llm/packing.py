"""Best-fit packing of documents into sequences, planned over a histogram of lengths.

Best-fit decreasing needs only how many pieces there are of each length, at most
``max_tokens`` counts however large the corpus. The plan gives each length runs of slots
``(sequence, offset)``; a piece takes the slot of its rank among the pieces of its
length. Ranks come from one range sort by (length, hash), so a length that holds a third
of all pieces is spread over many partitions like any other.
"""
from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Stages, partitions, rows_out, slices, text_of
from tidelog.llm.tokens import word_encoder

MAX_TOKENS = 2048
END_OF_DOCUMENT = 0
#: A (length, rank) pair is looked up as one number: lengths below 2^23, ranks below 2^40.
RANK_BITS = 40
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


@dataclass(frozen=True)
class Plan:
    """Runs of slots sorted by (length, rank). Rank r of a run sits in sequence
    ``sequence + (r - rank) // each`` at ``offset + (r - rank) % each * length``."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    def slots(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.length << RANK_BITS | self.rank, length << RANK_BITS | rank, side="right") - 1
        i = rank - self.rank[at]
        return self.sequence[at] + i // self.each[at], self.offset[at] + i % self.each[at] * length


def plan(histogram: dict[int, int], capacity: int = MAX_TOKENS) -> Plan:
    """Best-fit decreasing over counts.

    Open sequences are kept as blocks of equal content, by what room they have left.
    Pieces of one length fill the tightest block first; a block is split only where the
    pieces run out, so blocks number at most a few per length.
    """
    rooms: list[int] = []
    blocks: dict[int, list[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def leave(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in blocks:
                blocks[room] = []
                insort(rooms, room)
            blocks[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not between 1 and {capacity}")
        left, rank = histogram[length], 0
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n = blocks[room].pop()
                if not blocks[room]:
                    del blocks[room]
                    rooms.pop(i)
            else:
                room, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = room // length
            full, rest = divmod(min(left, n * each), each)
            runs.append((length, rank, first, each, capacity - room))
            leave(room - each * length, first, full)
            if rest:
                leave(room - rest * length, first + full, 1)
            leave(room, first + full + bool(rest), n - full - bool(rest))
            rank += full * each + rest
            left -= full * each + rest
    runs.sort()
    columns = np.array(runs, np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences=opened)


def pieces(docs: DataFrame, vocabulary: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Per document its ids and a final END_OF_DOCUMENT, cut into pieces of ``max_tokens``; null text is empty."""

    def cut(batches):
        encode = word_encoder(vocabulary)
        for b in slices(batches, "text"):
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text_of(text)) + END_OF_DOCUMENT.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                    part = ids[at : at + 4 * max_tokens]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 5, _PIECES, strict=True)], schema=_PIECES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Places every document's pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null or empty text gives one piece that holds the final id alone. Rows that repeat,
    also by doc_id, are packed each for themselves; a null doc_id is packed like any
    other. An empty table gives no rows. Columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "pack")
    cut = stages.keep(pieces(docs, vocabulary, max_tokens))
    histogram = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}  # max_tokens rows at most
    planned = plan(histogram, max_tokens)

    salt = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())  # parts rows that repeat, too
    ordered = cut.withColumn("_salt", salt).repartitionByRange(partitions(spark), "length", "_salt").sortWithinPartitions("length", "_salt", "doc_id", "piece")
    ordered = stages.keep(ordered.drop("_salt").withColumn("_at", F.monotonically_increasing_id()))
    sizes = {r.p: r["count"] for r in ordered.groupBy(F.shiftright("_at", 33).alias("p")).count().collect()}  # a row per partition
    stages.drop(cut)
    before = np.zeros(1 + max(sizes, default=0), np.int64)
    for p in sorted(sizes):
        before[p + 1 :] += sizes[p]
    shorter, seen = np.zeros(max_tokens + 2, np.int64), 0
    for n in range(max_tokens + 1):
        shorter[n] = seen
        seen += histogram.get(n, 0)

    schema = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(b: pa.RecordBatch) -> dict:
        at, length = b.column(5).to_numpy(), b.column(3).to_numpy()
        rank = before[at >> 33] + (at & (1 << 33) - 1) - shorter[length]
        sequence, offset = planned.slots(length, rank)
        return {**{n: b.column(i) for i, n in enumerate(_PIECES.names)}, "sequence_id": sequence, "offset": offset}

    return ordered.mapInArrow(rows_out(schema, place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
