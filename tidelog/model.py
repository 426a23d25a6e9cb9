"""Schemas, configuration, errors and byte-key helpers."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import wraps

from pyspark.sql import types as T

OPS_SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("is_tombstone", T.BooleanType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)
RUN_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("level", T.IntegerType(), False),
        T.StructField("min_key", T.BinaryType(), False),
        T.StructField("max_key", T.BinaryType(), False),
        T.StructField("entries", T.LongType(), False),
        T.StructField("bytes", T.LongType(), False),
        T.StructField("sequence", T.LongType(), False),
    ]
)
MAX_LEVELS = 7
MIB = 1 << 20


class StoreError(Exception):
    """Any failure of the store."""


class KeyNotFound(StoreError):
    """A key that has to be there is not live."""


class InvalidConfig(StoreError):
    pass


class CorruptionError(StoreError):
    """Stored data or a manifest does not read back as written."""


class CompactionError(StoreError):
    pass


class TransactionError(StoreError):
    """No transaction is active, or it has been finished already."""


class ConflictError(StoreError):
    """Another handle committed the next manifest version first."""


def guarded(f: Callable) -> Callable:
    """Failures that are none of the store's own come out as CorruptionError, with their cause."""

    @wraps(f)
    def call(*args, **kw):
        try:
            return f(*args, **kw)
        except StoreError:
            raise
        except Exception as e:
            raise CorruptionError(f"{f.__name__} failed: {e}") from e

    return call


@dataclass(frozen=True)
class Config:
    """Settings of a store; the ``with_*`` style of change is ``config.but(name=value)``."""

    path: str
    memtable_size_limit: int = 4 * MIB
    max_run_size: int = 64 * MIB
    sync_writes: bool = False
    l0_compaction_trigger: int = 4
    level_size_multiplier: int = 10
    level_base_size: int = 10 * MIB
    compression_enabled: bool = True
    compression_level: int = 3
    bloom_fpp: float = 0.01
    cache_size: int = 64 * MIB
    scan_cache_entries: int = 32
    monitoring_enabled: bool = False
    monitoring_port: int = 8080
    background_threads: int = 2
    #: Versions that stay when flushes collect garbage from time to time; 0 leaves that to the caller.
    keep_versions: int = 64

    def __post_init__(self):
        if not self.path:
            raise InvalidConfig("path is empty")
        if self.memtable_size_limit <= 0 or self.max_run_size <= 0:
            raise InvalidConfig("size limits must be positive")
        if self.l0_compaction_trigger < 1 or self.level_size_multiplier < 2:
            raise InvalidConfig("compaction trigger must be at least 1 and the multiplier at least 2")
        if not 0 < self.bloom_fpp < 1:
            raise InvalidConfig("bloom_fpp must lie between 0 and 1")
        if self.cache_size < 0 or self.scan_cache_entries < 0 or self.background_threads < 1:
            raise InvalidConfig("caches must not be negative and there must be a background thread")
        object.__setattr__(self, "compression_level", min(22, max(1, self.compression_level)))

    def but(self, **changes) -> Config:
        return replace(self, **changes)

    def level_threshold(self, level: int) -> int | None:
        """Bytes beyond which a level is compacted; None for level 0, which goes by run count."""
        return None if level == 0 else self.level_base_size * self.level_size_multiplier ** (level - 1)


def to_bytes(x) -> bytes:
    """Keys and values are bytes; text is taken as UTF-8."""
    if isinstance(x, str):
        return x.encode()
    if isinstance(x, (bytes, bytearray, memoryview)):
        return bytes(x)
    raise TypeError(f"expected bytes or str, not {type(x).__name__}")


def prefix_end(prefix: bytes) -> bytes | None:
    """The least key above every key that starts with ``prefix``; None if there is none."""
    stem = prefix.rstrip(b"\xff")
    return stem[:-1] + bytes([stem[-1] + 1]) if stem else None
