"""Flushes and compactions away from the writer's thread."""
from __future__ import annotations

from concurrent.futures import Future, ThreadPoolExecutor


class BackgroundWorker:
    """Runs a store's upkeep in threads; the store's lock keeps one change at a time."""

    def __init__(self, store, threads: int | None = None):
        self._store = store
        self._pool = ThreadPoolExecutor(max_workers=threads or store.config.background_threads, thread_name_prefix="tidelog")
        self.done = 0

    def __enter__(self) -> BackgroundWorker:
        return self

    def __exit__(self, *_) -> None:
        self.shutdown()

    def flush(self) -> Future:
        return self._run(self._store.flush)

    def compact(self, level: int | None = None) -> Future:
        return self._run(self._store.compact if level is None else lambda: self._store.compact_level(level))

    def _run(self, task) -> Future:
        def call():
            task()
            self.done += 1

        return self._pool.submit(call)

    def shutdown(self) -> None:
        """Waits for what was asked for."""
        self._pool.shutdown(wait=True)
