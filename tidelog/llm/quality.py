"""Quality scores by regularised quadratic discriminant analysis.

Each text gives a few statistics, transformed so that they are roughly normal within a
class. A class has a mean and a covariance shrunk towards the pooled covariance and towards
a multiple of the identity; its Cholesky factor is computed once. The score is the logistic
of the difference of the two log-densities plus the log prior odds.

Means and covariances come from sums over all labelled rows, gathered in one aggregation;
there is no sample.
"""
from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Stages, slices, text_of

TO_POOLED, TO_IDENTITY = 0.3, 0.02
THRESHOLD = 0.3
_EPS = 1e-3
_SYMBOLS = np.frombuffer(b"%$&#*@^~=+<>{}[]\\_`", np.uint8)
_STOPS = np.frombuffer(b".,;:?", np.uint8)
FEATURES = (
    "words", "word_length", "word_spread", "longest_word", "distinct_words", "distinct_pairs", "top_word", "upper", "digits", "stops",
    "exclaims", "symbols", "bars", "other_bytes", "spaces", "lines", "line_length", "line_copies", "short_lines", "entropy", "symbol_ends", "capital_starts",
)


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text; an empty text has them too."""
    raw = text.encode()
    n = max(1, len(raw))
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    k = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = len(set(lines))
    upper, letters = int(h[65:91].sum()), int(h[65:91].sum() + h[97:123].sum())
    p = h[h > 0] / n
    ends = sum(1 for w, c in counts.items() for _ in range(c) if not w[-1].isalnum() and w[-1] not in ".,;:?")
    log = lambda x: math.log(x + _EPS)
    return [
        math.log1p(len(words)), math.log1p(sizes.mean()), math.log1p(sizes.std()), math.log1p(sizes.max()),
        log(len(counts) / k), log(len(set(zip(words, words[1:], strict=False))) / max(1, k - 1)), log(max(counts.values(), default=0) / k),
        log(upper / max(1, letters)), log(h[48:58].sum() / n), log(h[_STOPS].sum() / n), log(h[33] / n), log(h[_SYMBOLS].sum() / n), log(h[124] / n),
        log(h[128:].sum() / n), log((h[32] + h[9] + h[10] + h[13]) / n), log(len(lines) / k), math.log1p(len(words) / max(1, len(lines))),
        log(1 - distinct / max(1, len(lines))), log(sum(len(x) < 40 for x in lines) / max(1, len(lines))), float(-(p * np.log(p)).sum()) if raw else 0.0,
        log(ends / k), log(sum(c for w, c in counts.items() if w[0].isupper()) / k),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Per class: mean, inverse Cholesky factor of the covariance, log-determinant; and the log prior odds of class 1."""

    scale: tuple[np.ndarray, np.ndarray]
    mean: tuple[np.ndarray, np.ndarray]
    whiten: tuple[np.ndarray, np.ndarray]
    logdet: tuple[float, float]
    odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.scale[0]) / self.scale[1]
        d = [((z - self.mean[c]) @ self.whiten[c].T) for c in (0, 1)]
        log = [-(d[c] * d[c]).sum(axis=1) / 2 - self.logdet[c] / 2 for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0] + self.odds, -700, 700)))


@dataclass(frozen=True)
class Constant:
    """What is learned without two classes: the share of label 1, or a half without labels."""

    value: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def fit(count: np.ndarray, total: np.ndarray, product: np.ndarray, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY):
    """From per-class counts (2), sums (2, d) and sums of products (2, d, d)."""
    if count.min() < 2:
        return Constant(0.5 if not count.sum() else float(count[1] / count.sum()))
    n = count.sum()
    centre = total.sum(axis=0) / n
    spread = np.sqrt(np.maximum(np.diag(product.sum(axis=0)) / n - centre**2, 1e-12))
    mean = (total / count[:, None] - centre) / spread
    own = []
    for c in (0, 1):
        m = total[c] / count[c]
        own.append((product[c] / count[c] - np.outer(m, m)) / np.outer(spread, spread))
    pooled = (own[0] * count[0] + own[1] * count[1]) / n
    eye = np.eye(len(centre))
    whiten, logdet = [], []
    for c in (0, 1):
        s = (1 - to_pooled - to_identity) * own[c] + to_pooled * pooled + to_identity * np.trace(pooled) / len(centre) * eye
        low = np.linalg.cholesky(s + 1e-9 * eye)
        whiten.append(np.linalg.inv(low))
        logdet.append(2 * float(np.log(np.diag(low)).sum()))
    return Discriminant((centre, spread), tuple(mean), tuple(whiten), tuple(logdet), math.log(count[1] / count[0]))


def held_out(doc_id: Column) -> Column:
    """Rows that no training sees; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null text is empty. Labels that are null or not 0 or 1 are left out, as are labels of
    held-out ids and of ids without a document; a document labelled more than once counts
    once per label. With fewer than two rows of a class every score is the share of label 1
    (0.5 without labels). Rows with a null doc_id are scored and count as held out.
    """
    stages = Stages(docs.sparkSession, "quality")
    d = len(FEATURES)
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def measure(batches):
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([statistics(text_of(t)) for t in b.column(1).to_pylist()], schema.field(1).type)], schema=schema)

    x = stages.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(measure, "doc_id long, x array<double>"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))

    sums = pa.schema([("y", pa.int32()), ("i", pa.int32()), ("v", pa.float64())])

    def gather(batches):
        acc = np.zeros((2, 1 + d + d * d))
        for b in batches:
            y = b.column(0).to_numpy()
            m = b.column(1).flatten().to_numpy().reshape(-1, d)
            for c in (0, 1):
                mc = m[y == c]
                acc[c] += np.concatenate([[len(mc)], mc.sum(axis=0), (mc.T @ mc).ravel()])
        for c in (0, 1):
            yield pa.RecordBatch.from_pydict({"y": np.full(acc.shape[1], c, np.int32), "i": np.arange(acc.shape[1], dtype=np.int32), "v": acc[c]}, schema=sums)

    parts = x.join(known, "doc_id").select("y", "x").mapInArrow(gather, "y int, i int, v double")
    acc = np.zeros((2, 1 + d + d * d))
    for r in parts.groupBy("y", "i").agg(F.sum("v").alias("v")).collect():  # 2 * (1 + d + d * d) rows
        acc[r.y, r.i] = r.v
    model = fit(acc[:, 0], acc[:, 1 : 1 + d], acc[:, 1 + d :].reshape(2, d, d))

    def apply(batches):
        for b in batches:
            m = b.column(1).flatten().to_numpy().reshape(-1, d)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(m))], names=["doc_id", "score"])

    scored = x.mapInArrow(apply, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
