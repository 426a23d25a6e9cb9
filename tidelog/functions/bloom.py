"""An explicit Bloom filter over keys: sizing, distributed build, probe.

Parquet's own filters prune scans (``tidelog.sources.runs``); this operator is for
filters that travel: build on one frame, probe another.
"""
from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.model import CorruptionError

# FNV-1a 64-bit offset basis and prime, and the 64-bit finaliser's multipliers.
FNV_BASIS = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
MIX_1 = 0xFF51AFD7ED558CCD
MIX_2 = 0xC4CEB9FE1A85EC53
LEAST_BITS = 64
#: A filter up to this size is gathered on the driver and shipped whole; a larger one stays distributed.
SHIPPED_BYTES = 8 << 20
#: Bits of a larger filter that a task has to do with.
TASK_BITS = 1 << 20


def sizing(capacity: int, fpp: float) -> tuple[int, int]:
    """Bits and hash count for ``capacity`` keys at false-positive rate ``fpp``."""
    if capacity <= 0 or not 0 < fpp < 1:
        raise ValueError("capacity must be positive and fpp between 0 and 1")
    bits = max(LEAST_BITS, int(-capacity * math.log(fpp) / math.log(2) ** 2))
    return bits, max(1, math.floor(bits / capacity * math.log(2) + 0.5))


def sizing_expr(capacity, fpp):
    """The same as Spark columns: (bits, hashes)."""
    bits = F.greatest(F.lit(LEAST_BITS).cast("long"), (-capacity * F.ln(fpp) / F.lit(math.log(2) ** 2)).cast("long"))
    return bits, F.greatest(F.lit(1).cast("long"), F.floor(bits / capacity * F.lit(math.log(2)) + 0.5).cast("long"))


def fnv1a(keys) -> np.ndarray:
    """FNV-1a of each key, column by column over a padded byte matrix."""
    raw = [k if isinstance(k, bytes) else bytes(k) if not isinstance(k, str) else k.encode() for k in keys]
    n = np.fromiter((len(k) for k in raw), np.int64, len(raw))
    h = np.full(len(raw), FNV_BASIS, np.uint64)
    with np.errstate(over="ignore"):
        order = np.argsort(-n, kind="stable")
        flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        at = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(raw) else n
        for j in range(int(n.max(initial=0))):
            rows = order[: np.searchsorted(-n[order], -j, side="left")]
            h[rows] = (h[rows] ^ flat[at[rows] + j]) * np.uint64(FNV_PRIME)
    return h


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(MIX_1)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(MIX_2)
        return h ^ (h >> np.uint64(33))


def positions(keys, bits: int, hashes: int) -> np.ndarray:
    """Bit positions, one row per key, by double hashing."""
    h1 = fnv1a(keys)
    h2 = mix(h1 ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (h1[:, None] + np.arange(hashes, dtype=np.uint64)[None, :] * h2[:, None]) % np.uint64(bits)


def tasks(bits: int) -> int | None:
    """Into how many partitions the words of a filter are dealt, and keys that are asked of it; None for one that is shipped."""
    return None if bits <= 8 * SHIPPED_BYTES else math.ceil(bits / TASK_BITS)


def dealt(df: DataFrame, by: str, n: int | None) -> DataFrame:
    """Dealt by a column before it is aggregated, so that a task holds its share only and not all that its input may hold."""
    return df if n is None else df.repartition(n, by)


def build(keys: DataFrame, bits: int, hashes: int, key: str = "key") -> DataFrame:
    """One row per set 64-bit word: (word, mask). Words of a small filter are or-ed map-side, then once per word."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = np.unique(positions(pdf[key], bits, hashes).ravel())
            mask = np.left_shift(np.uint64(1), p & np.uint64(63)).view(np.int64)
            yield pd.DataFrame({"word": (p >> np.uint64(6)).astype(np.int64), "mask": mask})

    return dealt(keys.select(key).mapInPandas(words, "word long, mask long"), "word", tasks(bits)).groupBy("word").agg(F.bit_or("mask").alias("mask"))


def gathered(filter_words: DataFrame, bits: int) -> np.ndarray:
    """All words of a filter that is small enough, as one array."""
    if bits > 8 * SHIPPED_BYTES:
        raise ValueError(f"a filter of {bits} bits is not gathered on the driver")
    out = np.zeros(-(-bits // 64), np.uint64)
    for r in filter_words.collect():  # bits / 64 rows at most
        out[r.word] = np.int64(r.mask).view(np.uint64)
    return out


def pack(filter_words: DataFrame, bits: int, hashes: int) -> bytes:
    """The filter as bytes: bits and hash count in 8 bytes each, most significant first, then its words, least significant first."""
    return struct.pack(">QQ", bits, hashes) + gathered(filter_words, bits).astype("<u8").tobytes()


def unpack(raw: bytes) -> tuple[np.ndarray, int, int]:
    """Words, bits and hash count of a packed filter."""
    if len(raw) < 16:
        raise CorruptionError("a Bloom filter has 16 bytes at least")
    bits, hashes = struct.unpack(">QQ", raw[:16])
    if not bits or not hashes or len(raw) != 16 + 8 * -(-bits // 64):
        raise CorruptionError("a Bloom filter is not as long as it says")
    return np.frombuffer(raw, "<u8", offset=16).astype(np.uint64), bits, hashes


def may_contain(keys, words: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """Per key whether all of its bits are set; False means surely absent."""
    p = positions(keys, bits, hashes)
    return ((words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)) == 1).all(axis=1)


def probe(keys: DataFrame, filter_words: DataFrame, bits: int, hashes: int, key: str = "key") -> DataFrame:
    """Distinct ``keys`` with ``may_contain``."""
    kind = keys.schema[key].dataType.simpleString()
    asked = dealt(keys.select(key), key, tasks(bits)).distinct()
    if bits <= 8 * SHIPPED_BYTES:
        return probe_words(asked, gathered(filter_words, bits), bits, hashes, key)

    def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = positions(pdf[key], bits, hashes)
            yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), hashes), "word": (p.ravel() >> np.uint64(6)).astype(np.int64), "bit": (p.ravel() & np.uint64(63)).astype(np.int64)})

    # a large filter stays where it is: words are joined, not sent around
    asked = dealt(asked.mapInPandas(wanted, f"{key} {kind}, word long, bit long"), "word", tasks(bits))
    hit = F.coalesce(F.shiftrightunsigned("mask", 0).bitwiseAND(F.expr("shiftleft(1L, cast(bit as int))")) != 0, F.lit(False))
    return dealt(asked.join(filter_words, "word", "left").select(key, hit.alias("_hit")), key, tasks(bits)).groupBy(key).agg(F.every("_hit").alias("may_contain"))


def probe_words(keys: DataFrame, words: np.ndarray, bits: int, hashes: int, key: str = "key") -> DataFrame:
    """Every key with ``may_contain``, against a filter that each task has whole; no exchange."""
    held = keys.sparkSession.sparkContext.broadcast(words)

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "may_contain": may_contain(pdf[key], held.value, bits, hashes)})

    return keys.select(key).mapInPandas(test, f"{key} {keys.schema[key].dataType.simpleString()}, may_contain boolean")
