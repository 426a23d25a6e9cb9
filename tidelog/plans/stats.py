"""Statistics of a store: from the manifest, the buffer and the handle's counters."""
from __future__ import annotations

import json
import time
from collections import defaultdict
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.model import MAX_LEVELS


def level_stats(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("level").agg(F.count("*").alias("runs"), F.sum("bytes").cast("long").alias("bytes"), F.sum("entries").cast("long").alias("entries"))


def scalars(levels: DataFrame) -> DataFrame:
    """Totals over ``level_stats``: runs, bytes, active levels, largest level, mean run size (0 if none)."""
    return levels.agg(
        F.coalesce(F.sum("runs"), F.lit(0)).cast("long").alias("total_runs"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("total_bytes"),
        F.count_if(F.col("runs") > 0).alias("active_levels"),
        F.coalesce(F.max("bytes"), F.lit(0)).cast("long").alias("max_level_bytes"),
        F.coalesce(F.try_divide(F.sum("bytes").cast("long"), F.sum("runs").cast("long")), F.lit(0.0)).cast("double").alias("avg_run_bytes"),
    )


def hit_rate(hits: int, misses: int) -> float:
    return hits / (hits + misses) if hits + misses else 0.0


class Timer:
    """Wall clock since it was made or reset."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self._began = time.perf_counter()

    @property
    def elapsed_us(self) -> int:
        return int((time.perf_counter() - self._began) * 1e6)

    @property
    def elapsed_ms(self) -> int:
        return self.elapsed_us // 1000


class Timings:
    """Wall-clock per kind of operation: ``with timings.timed("get")``."""

    def __init__(self):
        self.count, self.micros = defaultdict(int), defaultdict(int)

    @contextmanager
    def timed(self, kind: str):
        timer = Timer()
        try:
            yield timer
        finally:
            self.record(kind, timer.elapsed_us)

    def record(self, kind: str, micros: int) -> None:
        self.count[kind] += 1
        self.micros[kind] += micros

    def average_us(self, kind: str) -> int:
        return self.micros[kind] // self.count[kind] if self.count[kind] else 0

    @property
    def avg_put_us(self) -> int:
        return self.average_us("put")

    @property
    def avg_get_us(self) -> int:
        return self.average_us("get")

    @property
    def avg_scan_us(self) -> int:
        return self.average_us("scan")

    @property
    def avg_flush_ms(self) -> int:
        return self.average_us("flush") // 1000

    @property
    def avg_compact_ms(self) -> int:
        return self.average_us("compact") // 1000

    def reset(self) -> None:
        self.count.clear()
        self.micros.clear()

    def __str__(self) -> str:
        return "\n".join(f"{k}: {x['count']} operations, {x['avg_us']} us on average" for k, x in self.summary().items())

    def summary(self) -> dict:
        return {k: {"count": self.count[k], "avg_us": self.average_us(k)} for k in sorted(self.count)}


def perf_summary(samples: DataFrame, kind: str, micros: str) -> DataFrame:
    """Integer mean per kind of operation, over a frame of recorded durations."""
    return samples.groupBy(kind).agg(F.count("*").alias("n"), F.expr(f"sum({micros}) div count(*)").alias("avg_us"))


def snapshot(store) -> dict:
    m = store.manifest
    runs = [m.level(n) for n in range(MAX_LEVELS)]
    sizes = [sum(r.bytes for r in level) for level in runs]
    total = sum(map(len, runs))
    return {
        "buffer_entries": store.buffered_entries,
        "buffer_bytes": store.buffered_bytes,
        "level_runs": [len(level) for level in runs],
        "level_bytes": sizes,
        **store.counters,
        "log_files": len(m.log),
        "log_bytes": m.log_bytes,
        "cache_hits": store.cache_hits,
        "cache_misses": store.cache_misses,
        "cache_hit_rate": hit_rate(store.cache_hits, store.cache_misses),
        "total_runs": total,
        "total_bytes": sum(sizes),
        "active_levels": sum(bool(level) for level in runs),
        "max_level_bytes": max(sizes, default=0),
        "avg_run_bytes": sum(sizes) / total if total else 0.0,
    }


def to_json(stats: dict) -> str:
    return json.dumps(stats, sort_keys=True)


def render(stats: dict) -> str:
    return "\n".join(f"{k}: {v}" for k, v in stats.items())
