"""Exact top-k by integer inner product, with a pivot table.

Inner product becomes distance by one more coordinate: rows get sqrt(M - |x|^2), with M the
largest squared norm of their block, queries get 0; then d(q, x)^2 = |q|^2 + M - 2 q.x. A
block stores the distances of its rows to its pivots. For a query, the largest difference
|d(q, p) - d(x, p)| over the pivots bounds d(q, x) from below. Rows are evaluated in the
order of their bounds until the next bound can't reach the k-th best score; ties count as
reaching it, and a margin covers rounding, so the result is exact.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Stages
from tidelog.llm.vectors import BLOCK_ROWS, search, usable

PIVOTS = 24
#: Rows among which a block's pivots are looked for, spread evenly over the block.
PIVOT_SAMPLE = 1024
#: Rows evaluated at first; each further step doubles.
STEP = 128
SCALE = 64


def choose_pivots(points: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Points far from each other: each next one is the farthest from those chosen."""
    sample = points[:: max(1, len(points) // PIVOT_SAMPLE)]
    chosen = [0]
    far = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


LEAST, MOST = -(1 << 63) + 1, (1 << 63) - 1


def exact_products(rows: np.ndarray, query: np.ndarray, largest: float) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of whole numbers, held to 64 bits, and in double precision; beyond 2^53 by Python's integers.

    ``largest`` bounds the rows' components.
    """
    if largest * float(np.abs(query).max(initial=0)) * max(1, len(query)) < 2**53:
        size = rows @ query
        return size.astype(np.int64), size
    q = [int(x) for x in query]
    whole = [sum(int(a) * b for a, b in zip(r, q, strict=True)) for r in rows.tolist()]
    return np.array([min(MOST, max(LEAST, x)) for x in whole], np.int64), np.array([as_double(x) for x in whole], float)


def as_double(x: int) -> float:
    try:
        return float(x)
    except OverflowError:
        return float("inf") if x > 0 else float("-inf")


class PivotTable:
    """A block's rows with their distances to the block's pivots."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, pivots: np.ndarray, table: np.ndarray):
        self.ids, self.values, self.largest = ids, values, float(np.abs(values).max(initial=0))
        self.most = (values * values).sum(axis=1).max(initial=0.0)
        self.pivots, self.table = pivots, table

    @staticmethod
    def arrays(values: np.ndarray, pivots: int = PIVOTS) -> list[np.ndarray]:
        """The pivots, and the distances to them, one row for each pivot."""
        squares = (values * values).sum(axis=1)
        lifted = np.column_stack([values, np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0))])
        chosen = choose_pivots(lifted, pivots)
        return [chosen, np.stack([np.linalg.norm(lifted - p, axis=1) for p in chosen])]

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Places, scores and sizes of the best k other rows, and how many rows were evaluated."""
        lifted = np.append(query, 0.0)
        bound = np.abs(self.table - np.linalg.norm(self.pivots - lifted, axis=1)[:, None]).max(axis=0)
        square = float(query @ query)
        best_possible = (square + self.most - bound * bound) / 2
        best_possible += 1e-9 * (square + self.most) + 1e-6
        best_possible[~np.isfinite(best_possible)] = np.inf  # squares beyond double precision rule nothing out
        order = np.argsort(-best_possible, kind="stable")
        at, score, size = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        done, step = 0, STEP
        while done < len(order):
            if len(at) >= k and best_possible[order[done]] < size[-1]:
                break
            new = order[done : done + step]
            done, step = done + len(new), 2 * step
            found, sizes = exact_products(self.values[new], query, self.largest)
            near = self.ids[new] != query_id
            if len(at) >= k:
                near &= sizes >= size[-1]
            at, score, size = np.concatenate([at, new[near]]), np.concatenate([score, found[near]]), np.concatenate([size, sizes[near]])
            best = np.lexsort((self.ids[at], -size, -score))[:k]
            at, score, size = at[best], score[best], size[best]
        return at, score, size, done


def top_k(vectors: DataFrame, k: int = 20, modulus: int = 20, id_column: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: per query the k highest inner products of floor(64 x).

    Queries are the rows whose id is divisible by ``modulus``; candidates are all rows but
    the query's own. Ties go to the smaller id. Vectors that are null or hold null, NaN or
    infinite components take no part, nor do rows without an id; shorter vectors count as
    filled up with zeros. floor(64 x) is a double, and rows for which it overflows take no
    part; products are ranked beyond 64 bits too (there in double precision), but the score
    is held to 64 bits. Rows that share an id are candidates each for themselves, except to
    a query of that id; a query id that repeats is answered for all its rows together. An
    empty table gives no rows.
    """
    whole = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)  # noqa: E731  larger ones are whole
    rows = usable(vectors, id_column, vector).select("id", F.transform("v", lambda x: whole(x * SCALE)).alias("v"))
    rows = rows.where(F.forall("v", lambda x: F.abs(x) != F.lit(float("inf"))))

    def load(ids, values, buffers):
        pivots = np.frombuffer(buffers[0], np.float64).reshape(-1, values.shape[1] + 1)
        table = PivotTable(ids, values, pivots, np.frombuffer(buffers[1], np.float64).reshape(len(pivots), len(ids)))

        def find(query_ids, query_values):
            found = [table.top(query_ids[i], query_values[i], k)[:3] for i in range(len(query_ids))]
            q = np.repeat(np.arange(len(found)), [len(a) for a, *_ in found])
            return q, *(np.concatenate(x) for x in zip(*found, strict=True))

        return find

    stages = Stages(vectors.sparkSession, "topk")
    return search(rows, modulus, k, lambda ids, values: PivotTable.arrays(values), load, stages, block_rows, "long")
