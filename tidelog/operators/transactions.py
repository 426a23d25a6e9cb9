"""Transactions: the set-wise form over logs with a transaction number, and the driver's pending list."""
from __future__ import annotations

from pyspark.sql import DataFrame

from tidelog.model import TransactionError, to_bytes


def committed(ops: DataFrame, transactions: DataFrame, txn: str = "txn") -> DataFrame:
    """Operations of the transactions listed in ``transactions``, and those outside any (null)."""
    return ops.where(f"{txn} is null").unionByName(ops.join(transactions.select(txn), txn, "left_semi").select(*ops.columns))


def without_aborted(ops: DataFrame, aborted: DataFrame, txn: str = "txn") -> DataFrame:
    return ops.join(aborted.select(txn), txn, "left_anti").select(*ops.columns)


class Transaction:
    """Buffered operations; sequence numbers are given at commit, so commit order decides."""

    def __init__(self):
        self.operations: list[tuple[bytes, bool, bytes | None]] = []
        self.finished = False

    def __len__(self) -> int:
        return len(self.operations)

    @property
    def is_empty(self) -> bool:
        return not self.operations

    @property
    def is_committed(self) -> bool:
        return self.finished

    def put(self, key, value) -> None:
        self._open()
        self.operations.append((to_bytes(key), False, to_bytes(value)))

    def delete(self, key) -> None:
        self._open()
        self.operations.append((to_bytes(key), True, None))

    def finish(self) -> list[tuple[bytes, bool, bytes | None]]:
        self._open()
        self.finished = True
        return self.operations

    def _open(self) -> None:
        if self.finished:
            raise TransactionError("the transaction was committed already")
