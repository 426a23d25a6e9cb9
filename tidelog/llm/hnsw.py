"""Approximate nearest neighbours: one navigable small-world graph per shard, in flat arrays.

Each shard's distinct directions are inserted into a layered graph (Malkov and Yashunin).
Neighbours stand in one int32 matrix per layer, -1 where there is none. The graph is built
once and stored as these flat arrays, with its shard's rows; tasks that search load it.
Every query searches every shard; the shards' best are merged. Rows whose vectors are equal share one
node, so copies, however many, don't crowd a node's neighbours.
"""
from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Stages
from tidelog.llm.vectors import search, usable

SHARD_ROWS = 16_384
LINKS = 12
EF_BUILD, EF_SEARCH = 64, 96
SEED = 7


class Graph:
    """Points are unit vectors; near means a large inner product."""

    def __init__(self, points: np.ndarray, links: int = LINKS, ef: int = EF_BUILD, seed: int = SEED):
        n = len(points)
        self.points, self.links, self.ef = np.ascontiguousarray(points, np.float32), links, ef
        levels = (-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(links)).astype(int)
        self.layers = [np.full((n, (2 if k == 0 else 1) * links), -1, np.int32) for k in range(1 + levels.max(initial=0))]
        self.counts = [np.zeros(n, np.int32) for _ in self.layers]
        self.entry, self.top = -1, -1
        for i in range(n):
            self._insert(i, int(levels[i]))

    def flat(self) -> list[np.ndarray]:
        return [np.array([self.entry, self.top], np.int64), *self.counts, *self.layers]

    @classmethod
    def loaded(cls, points: np.ndarray, buffers: list[bytes]) -> Graph:
        self = cls.__new__(cls)
        self.points, n = np.ascontiguousarray(points, np.float32), (len(buffers) - 1) // 2
        self.entry, self.top = np.frombuffer(buffers[0], np.int64).tolist()
        self.counts = [np.frombuffer(x, np.int32) for x in buffers[1 : 1 + n]]
        self.layers = [np.frombuffer(x, np.int32).reshape(len(points), -1) for x in buffers[1 + n :]]
        return self

    def _near(self, layer: int, query: np.ndarray, entries: list[tuple[float, int]], ef: int) -> list[tuple[float, int]]:
        """The best ``ef`` found from ``entries``, best first, as (similarity, point)."""
        neighbours, counts, points = self.layers[layer], self.counts[layer], self.points
        seen = {i for _, i in entries}
        ahead = [(-s, i) for s, i in entries]
        heapq.heapify(ahead)
        best = list(entries)
        heapq.heapify(best)
        while ahead:
            s, i = heapq.heappop(ahead)
            if len(best) >= ef and -s < best[0][0]:
                break
            new = [j for j in neighbours[i, : counts[i]].tolist() if j not in seen]
            if not new:
                continue
            seen.update(new)
            for t, j in zip((points[new] @ query).tolist(), new, strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (t, j))
                elif t > best[0][0]:
                    heapq.heapreplace(best, (t, j))
                else:
                    continue
                heapq.heappush(ahead, (-t, j))
        return sorted(best, reverse=True)

    def _choose(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours in different directions first: one is passed over if a chosen one is nearer to it than the point is."""
        ids = [i for _, i in found]
        between = self.points[ids] @ self.points[ids].T
        chosen: list[int] = []
        for a in range(len(ids)):
            if len(chosen) == most:
                break
            if not chosen or between[a, chosen].max() < found[a][0]:
                chosen.append(a)
        rest = [a for a in range(len(ids)) if a not in set(chosen)]
        return [ids[a] for a in chosen + rest[: most - len(chosen)]]

    def _link(self, layer: int, i: int, j: int) -> None:
        """Adds j to i's neighbours, choosing anew if they are full."""
        row, n = self.layers[layer][i], self.counts[layer][i]
        if n < len(row):
            row[n] = j
            self.counts[layer][i] = n + 1
            return
        ids = [*row.tolist(), j]
        found = sorted(zip((self.points[ids] @ self.points[i]).tolist(), ids, strict=True), reverse=True)
        row[:] = self._choose(found, len(row))

    def _insert(self, i: int, level: int) -> None:
        if self.entry < 0:
            self.entry, self.top = i, level
            return
        q = self.points[i]
        at = [(float(self.points[self.entry] @ q), self.entry)]
        for layer in range(self.top, level, -1):
            at = self._near(layer, q, at, 1)
        for layer in range(min(level, self.top), -1, -1):
            at = self._near(layer, q, at, self.ef)
            chosen = self._choose(at, self.links)
            self.layers[layer][i, : len(chosen)] = chosen
            self.counts[layer][i] = len(chosen)
            for j in chosen:
                self._link(layer, j, i)
        if level > self.top:
            self.entry, self.top = i, level

    def search(self, query: np.ndarray, k: int, ef: int = EF_SEARCH) -> list[int]:
        if self.entry < 0:
            return []
        query = np.asarray(query, np.float32)
        at = [(float(self.points[self.entry] @ query), self.entry)]
        for layer in range(self.top, 0, -1):
            at = self._near(layer, query, at, 1)
        return [i for _, i in self._near(0, query, at, max(ef, k))[:k]]


def cosine(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """In double precision, each row by itself, so equal rows have equal scores.

    Rows and query are first scaled by powers of two, which changes no digit and keeps squares from overflowing.
    """
    rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0.0))[1][:, None])
    query = np.ldexp(query, -int(np.frexp(np.abs(query).max(initial=0.0))[1]))
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


class Shard:
    """A graph over the distinct vectors of a shard, with each one's row places in the order of their ids."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, buffers: list[bytes] | None = None):
        self.ids, self.values = ids, values
        order = np.argsort(ids, kind="stable")
        raw = np.ascontiguousarray(values[order]).view(np.dtype((np.void, values.shape[1] * 8 or 1))).ravel() if values.shape[1] else np.zeros(len(ids))
        _, first, which = np.unique(raw, return_index=True, return_inverse=True)
        by = np.argsort(which, kind="stable")
        self.members = np.split(order[by], np.cumsum(np.bincount(which, minlength=len(first)))[:-1]) if len(ids) else []
        self.distinct = values[order[first]] if len(ids) else values
        # scaled by the largest component first, so that squares neither overflow nor vanish
        scaled = self.distinct / np.abs(self.distinct).max(axis=1, keepdims=True) if len(ids) else self.distinct
        points = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
        self.graph = Graph(points) if buffers is None else Graph.loaded(points, buffers)

    def nearest(self, query_id: int, query: np.ndarray, k: int, ef: int = EF_SEARCH) -> tuple[np.ndarray, np.ndarray]:
        unit = query / np.abs(query).max()
        found = self.graph.search(unit / np.sqrt((unit * unit).sum()), max(4 * k, k + 1), ef)
        # members are in the order of their ids, so the query's own are left out before the cut
        others = (self.members[i][self.ids[self.members[i]] != query_id][:k] for i in found)
        at = np.concatenate([*others, np.empty(0, np.int64)])
        score = cosine(self.values[at], query)
        keep = np.lexsort((self.ids[at], -score))[:k]
        return at[keep], score[keep]


def nearest(vectors: DataFrame, k: int = 5, modulus: int = 50, id_column: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: per query the k nearest found, by cosine in double precision.

    Queries are the rows whose id is divisible by ``modulus``; candidates are all rows but
    the query's own. Ties go to the smaller id. Vectors that are null, zero or hold null,
    NaN or infinite components take no part, nor do rows without an id; shorter vectors
    count as filled up with zeros. Rows that share an id are candidates each for
    themselves, except to a query of that id. An empty table gives no rows.
    """
    rows = usable(vectors, id_column, vector).where(F.exists("v", lambda x: x != 0))

    def load(ids, values, buffers):
        shard = Shard(ids, values, buffers)

        def find(query_ids, query_values):
            found = [shard.nearest(query_ids[i], query_values[i], k) for i in range(len(query_ids))]
            q = np.repeat(np.arange(len(found)), [len(a) for a, _ in found])
            score = np.concatenate([s for _, s in found])
            return q, np.concatenate([a for a, _ in found]).astype(np.int64), score, score

        return find

    return search(rows, modulus, k, lambda ids, values: Shard(ids, values).graph.flat(), load, Stages(vectors.sparkSession, "hnsw"), shard_rows, "double")
