"""Byte-level BPE: encoding by a priority queue of merges over a doubly linked list, and decoding.

A text is cut into pretokens; each pretoken's bytes form a linked list of symbols, and a
heap holds the merges that are possible, by rank and place. A merge that was popped is
stale if either symbol has changed since; stale entries are skipped. Ids of short
pretokens are remembered, since they recur.
"""
from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Memo, slices, text_of
from tidelog.llm.tokens import byte_alphabet, vocabulary

# Fixed value: the pretoken pattern that goes with the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for texts of printable ASCII, Latin-1 letters and plain white space only.
SIMPLE_TEXT = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*").fullmatch
SIMPLE_PRETOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\t\n\r A-Za-z0-9À-ÖØ-öø-ÿ]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+").findall
REMEMBERED_BYTES = 48
ID_BITS, ID, PLACE = 20, (1 << 20) - 1, (1 << 32) - 1


class Bpe:
    """Encoder and decoder for one vocabulary file in the tokenizers library's JSON format."""

    def __init__(self, name_or_path: str):
        with open(vocabulary(name_or_path), encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, model = byte_alphabet(), spec["model"]
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.strings = {i: raw(s) for s, i in model["vocab"].items()}
        ids = {b: i for i, b in self.strings.items()}
        self.bytes_ids = [ids.get(bytes([b])) for b in range(256)]
        self.merges: dict[int, int] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = (raw(s) for s in (m.split(" ") if isinstance(m, str) else m))
            self.merges[ids[a] << ID_BITS | ids[b]] = rank << ID_BITS | ids[a + b]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.strings |= {i: s.encode() for s, i in special.items()}
        self._split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self._pretokens = regex.compile(PATTERN).findall
        self._memo = Memo(self._short, 1 << 17)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pretoken. Heap entries are one number each: rank, then merged id, then place."""
        sym = [i for b in piece if (i := self.bytes_ids[b]) is not None]  # bytes without an entry are passed over
        n = len(sym)
        get = self.merges.get
        heap = [m << 32 | i for i in range(n - 1) if (m := get(sym[i] << ID_BITS | sym[i + 1])) is not None]
        if not heap:
            return sym
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        while heap:
            e = pop(heap)
            i, m = e & PLACE, e >> 32
            j = after[i]
            if j < 0 or sym[i] < 0 or get(sym[i] << ID_BITS | sym[j]) != m:
                continue  # stale
            new = m & ID
            sym[i], sym[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (m := get(new << ID_BITS | sym[k])) is not None:
                    push(heap, m << 32 | i)
            h = before[i]
            if h >= 0 and (m := get(sym[h] << ID_BITS | new)) is not None:
                push(heap, m << 32 | h)
        return [s for s in sym if s >= 0]

    def _short(self, piece: str) -> tuple[int, ...]:
        return tuple(self.merge(piece.encode()))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        extend, memo = out.extend, self._memo
        for k, part in enumerate(self._split_special.split(text) if self._split_special else [text]):
            if k % 2:
                out.append(self.special[part])
                continue
            for p in SIMPLE_PRETOKENS(part) if SIMPLE_TEXT(part) else self._pretokens(part):
                extend(memo[p] if len(p) <= REMEMBERED_BYTES else self.merge(p.encode()))
        return out

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings joined; bytes that form no UTF-8 become U+FFFD."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def bpe(name_or_path: str) -> Bpe:
    return Bpe(name_or_path)


def encode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", key: str = "doc_id") -> DataFrame:
    """Per row: key, ids array<int>, decoded string. Null text is taken as empty."""
    schema = pa.schema([(key, pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches):
        coder = bpe(vocabulary)
        for b in slices(batches, "text"):
            ids = [coder.encode(text_of(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([coder.decode(i) for i in ids], pa.string())], schema=schema)

    return docs.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text")).mapInArrow(run, f"{key} long, ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256.

    The same encoder and decoder as ``encode``, without sending the ids back to Spark.
    Null text is empty; every row gives a row, repeated and null ids included.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        coder = bpe(vocabulary)
        decimal = [b""] * (1 + max(coder.strings))
        for i in coder.strings:
            decimal[i] = b"%d" % i
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for b in slices(batches, "text"):
            n, of_ids, of_text = [], [], []
            for t in b.column(1).to_pylist():
                ids = coder.encode(text_of(t))
                n.append(len(ids))
                of_ids.append(sha(b",".join([decimal[i] for i in ids])))
                of_text.append(sha(coder.decode(ids).encode()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
