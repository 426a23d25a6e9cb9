"""Removal of long repeated strings, by enhanced suffix arrays over anchored neighbourhoods.

A text is a sequence of units, bytes or words. A string of ``length`` units that also
starts anywhere else is a repeat, and every unit that a repeat covers goes.

1. Anchors. In every window of ``length`` units the leftmost least hash among its strings of
   ``gram`` units is the window's anchor, so equal windows have equal anchors at equal
   places. An anchor's neighbourhood is the stretch of all windows that it anchors: at most
   2 * length - gram units around it.
2. Anchors are counted, map-side first; those that occur once hold no repeat. Neighbourhoods
   that are equal are one entry of the suffix array, and a leaf of several suffixes: as a
   whole they are repeats.
3. The different neighbourhoods of one anchor are sorted into suffix arrays that start at the
   places where left contexts part, with the lengths of common prefixes beside them; a stack
   scan over these gives the tree of common-prefix intervals. An interval of ``length`` or
   more whose members differ in the unit before is a maximal repeat, and all its members
   are occurrences, not only neighbours in the order.
4. An anchor with over GROUP different neighbourhoods is parted first. Its windows are dealt
   into PARTS by how far they reach to the left of the anchor; all windows of a part share
   a longer core around the anchor, and equal windows have equal cores, so entries are
   grouped anew by their core and count as equal if they agree in what the part covers. A
   part of one window is its own core, so this ends after three rounds at the latest.

Texts are known by a digest, so equal texts share their places, whatever their ids.
Covered stretches meet their text again in a join by digest.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Stages, digest_of, partitions, slices

#: Different entries of one group that a task holds, each under 2 * length units.
GROUP = 250
#: Partitions times this is how many neighbourhoods at most are broadcast, 16 bytes each.
HOT = 10
#: A group with more of them is parted into so many.
PARTS = 7
#: Units of a text that are hashed at once; longer texts go through in pieces that overlap.
CHUNK = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Unit:
    """What texts are made of, and from which length on a string that occurs twice is a repeat."""

    words: bool
    length: int
    gram: int


BYTES, WORDS = Unit(False, 400, 64), Unit(True, 50, 8)
UNITS = (BYTES, WORDS)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


with np.errstate(over="ignore"):
    _BYTES = _mix(np.arange(1, 257, dtype=_U) * _U(0xA0761D6478BD642F))


class Hasher:
    """Hashes of all strings of a sequence, from one prefix sum (mod 2^64)."""

    def __init__(self, size: int = 1 << 16):
        self._grow(size)

    def _grow(self, n: int) -> None:
        self.powers = np.cumprod(np.concatenate([np.ones(1, _U), np.full(n, _BASE, _U)]))
        self.inverses = np.cumprod(np.concatenate([np.ones(1, _U), np.full(n, _U(pow(_BASE, -1, 1 << 64)), _U)]))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Sums of value * base^i; strings compare by differences of these."""
        if len(values) >= len(self.powers):
            self._grow(2 * len(values))
        out = np.zeros(len(values) + 1, _U)
        np.cumsum(values * self.powers[: len(values)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return _mix((prefix[end] - prefix[start]) * self.inverses[: len(prefix)][start])

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One hash per word, CHUNK bytes at a time."""
        out = np.empty(len(starts), _U)
        lo = 0
        while lo < len(starts):
            begin = int(starts[lo])
            hi = max(lo + 1, int(np.searchsorted(ends, begin + CHUNK, "right")))
            if int(ends[lo]) - begin > CHUNK:  # a word longer than a chunk, by parts
                total = _U(0)
                for k in range(begin, int(ends[lo]), CHUNK):
                    total += self.prefix(_BYTES[data[k : min(k + CHUNK, int(ends[lo]))]])[-1] * _U(pow(_BASE, k - begin, 1 << 64))
                out[lo], hi = _mix(np.array([total]))[0], lo + 1
            else:
                sums = self.prefix(_BYTES[data[begin : int(ends[hi - 1])]])
                out[lo:hi] = self.of(sums, starts[lo:hi] - begin, ends[lo:hi] - begin)
            lo = hi
        return out


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words, which are what stands between \\x20 and \\x09-\\x0D."""
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def sequences(unit: Unit, data: np.ndarray, hasher: Hasher) -> Iterator[tuple[int, np.ndarray]]:
    """The text as pieces (start, values): every window of the text lies in one piece."""
    if unit.words:
        starts, ends = word_places(data)
        values = hasher.words(data, starts, ends) if len(starts) >= unit.length else starts
    else:
        values = data
    for at in range(0, len(values) - unit.length + 1, CHUNK):
        piece = values[at : at + CHUNK + unit.length - 1]
        yield at, piece if unit.words else _BYTES[piece]


def anchors(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For windows of ``width`` consecutive hashes: each distinct place of a leftmost least
    hash, with the first and the last window that it serves."""
    n = len(hashes) - width + 1
    if n <= 0:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    # least of each window from running minima inside blocks of the window's width, both ways
    pad = -len(hashes) % width
    h = np.concatenate([hashes, np.full(pad, np.iinfo(np.uint64).max, _U)]).reshape(-1, width)
    forward = np.minimum.accumulate(h, axis=1).ravel()
    backward = np.minimum.accumulate(h[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(backward[:n], forward[width - 1 : width - 1 + n])
    # windows with the same least hash in a row share its leftmost place until that place is left
    change = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    starts, ends, at = [], [], []
    last = np.append(change[1:], n) - 1
    for s, e, v in zip(change.tolist(), last.tolist(), least[change].tolist(), strict=True):
        hits = np.flatnonzero(hashes[s : e + width] == v) + s
        w = s
        for p in hits.tolist():
            if p < w:
                continue
            served = min(e, p)
            at.append(p)
            starts.append(w)
            ends.append(served)
            w = served + 1
            if w > e:
                break
    return np.array(at, np.int64), np.array(starts, np.int64), np.array(ends, np.int64)


_FOUND = pa.schema([("digest", pa.binary()), ("unit", pa.int32()), ("anchor", pa.int64()), ("around", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])
_FOUND_DDL = "digest binary, unit int, anchor long, around long, at int, first int, last int"


def neighbourhoods(texts: DataFrame, units: tuple[Unit, ...]) -> DataFrame:
    """Per anchor of each (digest, raw): the unit's number in ``units``, the anchor's hash, the hash of its
    neighbourhood, its place, and the first and last window it serves."""

    def run(batches):
        hasher = Hasher()
        with np.errstate(over="ignore"):
            for b in slices(batches, "raw"):
                cols: list[list] = [[] for _ in _FOUND]
                for digest, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    data = np.frombuffer(raw.as_buffer(), np.uint8)
                    for k, unit in enumerate(units):
                        salt = _mix(np.array([k + 1], _U))
                        for start, values in sequences(unit, data, hasher):
                            sums = hasher.prefix(values)
                            n = len(values) - unit.gram + 1
                            grams = hasher.of(sums, slice(0, n), slice(unit.gram, unit.gram + n))
                            at, first, last = anchors(grams, unit.length - unit.gram + 1)
                            around = hasher.of(sums, first, last + unit.length) ^ _mix((last - first).astype(_U))
                            m = len(at)
                            for c, v in zip(cols, ([digest] * m, [k] * m, (grams[at] ^ salt).view(np.int64), around.view(np.int64), at + start, first + start, last + start), strict=True):
                                c.extend(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FOUND, strict=True)], schema=_FOUND)

    return texts.mapInArrow(run, _FOUND_DDL)


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def intervals(lcp: list[int], least: int) -> list[tuple[int, int, int]]:
    """The common-prefix interval tree of a suffix array, by a stack scan: (length, first, last)
    for every interval of at least ``least``. lcp[i] is between entries i and i + 1."""
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []
    for i, v in enumerate([*lcp, 0]):
        first = i
        while stack and stack[-1][0] > v:
            length, first = stack.pop()
            if length >= least:
                out.append((length, first, i))
        if v and (not stack or stack[-1][0] < v):
            stack.append((v, first))
    return out


def maximal_repeats(texts: list[tuple[bytes, int]], length: int, width: int = 1) -> list[tuple[int, int, list[int]]]:
    """Maximal repeats around a shared anchor: (offset from the anchor, length, members), in units of ``width`` bytes.

    Each text comes with its anchor's place in it. Suffixes are sorted only from the
    offsets at which two left contexts part, which is where maximal repeats can start.
    """
    left = [t[: a * width][::-1] for t, a in texts]
    order = sorted(range(len(texts)), key=left.__getitem__)
    parts = {common_prefix(left[i], left[j]) // width for i, j in zip(order, order[1:], strict=False)}
    out = []
    for back in parts:
        array = sorted((t[(a - back) * width :], i) for i, (t, a) in enumerate(texts) if a >= back and len(t) >= (length + a - back) * width)
        lcp = [common_prefix(x[0], y[0]) // width for x, y in zip(array, array[1:], strict=False)]
        for n, first, last in intervals(lcp, length):
            members = [array[k][1] for k in range(first, last + 1)]
            before = [left[i][back * width : (back + 1) * width] for i in members]
            if b"" in before or len(set(before)) > 1:  # left-diverse
                out.append((-back, n, members))
    return out


def numbered(texts: list[bytes]) -> list[bytes]:
    """Texts of words as strings of four bytes per word, equal for equal words."""
    known: dict[bytes, bytes] = {}
    return [b"".join([known.setdefault(w, len(known).to_bytes(4, "big")) for w in t.split()]) for t in texts]


_COVER = "digest binary, unit int, start int, end int"
_COVER_SCHEMA = pa.schema([("digest", pa.binary()), ("unit", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])


def covers(groups: DataFrame, units: tuple[Unit, ...]) -> DataFrame:
    """Of entries (key, unit, digest, at, first, text), those of one key standing together: the stretches that repeats cover."""

    def close(rows: list[tuple]) -> list[tuple]:
        unit, texts = units[rows[0][0]], [r[-1] for r in rows]
        if unit.words:
            texts = numbered(texts)
        spans: list[list[tuple[int, int]]] = [[] for _ in rows]
        for offset, n, members in maximal_repeats([(t, at - first) for t, (_, _, at, first, _) in zip(texts, rows, strict=True)], unit.length, 4 if unit.words else 1):
            for i in members:
                at = rows[i][2] + offset
                spans[i].append((at, at + n))
        return [(digest, k, s, e) for (k, digest, *_), own in zip(rows, spans, strict=True) for s, e in merge(own)]

    def run(batches):
        key, rows = None, []
        for b in batches:
            found = []
            for a, *row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if a != key:
                    if len(rows) > 1:
                        found += close(rows)
                    key, rows = a, []
                rows.append(tuple(row))
            if found:
                yield _batch(found, _COVER_SCHEMA)
        if len(rows) > 1 and (found := close(rows)):
            yield _batch(found, _COVER_SCHEMA)

    n = partitions(groups.sparkSession)
    dealt = groups.select("key", "unit", "digest", "at", "first", "text").repartition(n, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, _COVER)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


_ENTRY = pa.schema([("key", pa.int64()), ("unit", pa.int32()), ("kinds", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("digest", pa.binary()), ("at", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("text", pa.binary())])
_ENTRY_DDL = "key long, unit int, kinds long, lo int, hi int, digest binary, at int, first int, last int, text binary"


def entries(texts: DataFrame, kinds: DataFrame, units: tuple[Unit, ...]) -> DataFrame:
    """The wanted neighbourhoods with their content; words stand one space apart."""

    def run(batches):
        for b in slices(batches, "raw"):
            rows = []
            for digest, raw, places in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                raw = raw.as_py()
                starts, ends = word_places(np.frombuffer(raw, np.uint8)) if any(units[p["unit"]].words for p in places) else ((), ())
                for p in places:
                    unit = units[p["unit"]]
                    lo, hi = p["first"], p["last"] + unit.length
                    text = b" ".join(raw[starts[lo] : ends[hi - 1]].split()) if unit.words else raw[lo:hi]
                    rows.append((p["anchor"], p["unit"], p["kinds"], 0, unit.length - unit.gram, digest, p["at"], p["first"], p["last"], text))
            for at in range(0, len(rows), 4096):
                yield _batch(rows[at : at + 4096], _ENTRY)

    wanted = kinds.groupBy("digest").agg(F.collect_list(F.struct("unit", "anchor", "kinds", "at", "first", "last")).alias("places"))
    once = texts.groupBy("digest").agg(F.any_value("raw").alias("raw"))
    return once.join(wanted, "digest").select("digest", "raw", "places").mapInArrow(run, _ENTRY_DDL)


def parts_of(crowd: DataFrame, units: tuple[Unit, ...]) -> DataFrame:
    """Every entry with the windows of each part of its group's reach, keyed by what all of that part's windows share."""
    schema = pa.schema([*_ENTRY, ("around", pa.int64())])

    def hashed(*parts) -> int:
        return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "big", signed=True)

    def run(batches):
        for b in slices(batches, "text"):
            rows = []
            for key, k, _, lo, hi, digest, at, first, last, text in zip(*(b.column(i).to_pylist() for i in range(10)), strict=True):
                unit, step = units[k], -(-(hi - lo + 1) // PARTS)
                seq = text.split() if unit.words else text
                for x in range(lo, hi + 1, step):
                    y = min(x + step - 1, hi)
                    near, far = max(x, at - last), min(y, at - first)  # how far its own windows of this part reach to the left
                    if near <= far:
                        f, e = at - far, at - near
                        core, own = seq[at - x - first : at - y + unit.length - first], seq[f - first : e - first + unit.length]
                        rows.append((hashed(key, x, y, core), k, 0, x, y, digest, at, f, e, b" ".join(own) if unit.words else own, hashed(near, far, own)))
            yield _batch(rows, schema)

    return crowd.select(*_ENTRY.names).mapInArrow(run, _ENTRY_DDL + ", around long")


def _end(units: tuple[Unit, ...]) -> Column:
    """Where the last window of a row ends."""
    return (F.col("last") + F.element_at(F.array(*(F.lit(u.length) for u in units)), F.col("unit") + 1)).alias("end")


def covered(texts: DataFrame, units: tuple[Unit, ...], stages: Stages) -> tuple[DataFrame, int]:
    """Of (digest, raw), the stretches (digest, unit, start, end) that repeats cover, in units; they may overlap.
    With a bound of how many texts there are."""
    found = stages.keep(neighbourhoods(texts, units))
    met = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("around").alias("low"), F.max("around").alias("high")).where("n > 1")
    total = found.count()
    met = stages.keep(met, total)  # stored, so that an anchor of many places can be parted when it is joined
    again = stages.keep(found.join(met.select("anchor", (F.col("low") == F.col("high")).alias("alike")), "anchor"), total)
    stages.drop(found)
    # merged joins below: Spark parts a key of very many rows there, but not once it has dealt them for a broadcast
    span = ("digest", "unit", F.col("first").alias("start"), _end(units))

    several = again.where(~F.col("alike"))
    kinds = stages.keep(several.groupBy("anchor", "around").agg(F.count("*").alias("n"), F.min(F.struct("digest", "unit", "at", "first", "last")).alias("one")), total)
    out = again.where("alike").select(*span)
    # Neighbourhoods of very many places are met where these lie: each has so large a share of all places that at most HOT
    # times as many as there are partitions can be such. The others meet in a shuffle.
    many = F.col("n") > max(1, total // (HOT * partitions(texts.sparkSession)))
    hot = F.broadcast(kinds.where(many).select("anchor", "around"))
    others = kinds.where((F.col("n") > 1) & ~many).select("anchor", "around").hint("merge")
    key = ["anchor", "around"]
    out = out.unionByName(several.join(hot, key, "left_semi").select(*span))
    out = out.unionByName(several.join(hot, key, "left_anti").join(others, key, "left_semi").select(*span))

    sizes = stages.keep(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")), total)
    cut = stages.keep(entries(texts, kinds.select("anchor", "one.*").join(sizes, "anchor"), units), total)
    while True:
        out = out.unionByName(covers(cut.where(F.col("kinds") <= GROUP), units))
        crowd = cut.where(F.col("kinds") > GROUP)
        held = PARTS * crowd.count()
        if not held:
            return out, total
        parted = stages.keep(parts_of(crowd, units), held)
        alike = parted.groupBy("key", "around").agg(F.count("*").alias("n"), F.min(F.struct("unit", "lo", "hi", "digest", "at", "first", "last", "text")).alias("one"))
        alike = stages.keep(alike, held)
        out = out.unionByName(parted.join(alike.where("n > 1").select("key", "around").hint("merge"), ["key", "around"], "left_semi").select(*span))
        sizes = stages.keep(alike.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1"), held)
        cut = stages.keep(alike.select("key", "one.*").join(sizes, "key").select(*_ENTRY.names), held)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _placed(docs: DataFrame, units: tuple[Unit, ...]) -> DataFrame:
    """(row, raw, places): each row of ``docs`` as a struct, its text in UTF-8, and its covered stretches."""
    stages = Stages(docs.sparkSession, "suffixes")
    # other columns stay inside the struct, so their names can't clash
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), raw.alias("raw")).withColumn("digest", digest_of("raw"))
    spans, most = covered(rows.select("digest", "raw"), units, stages)
    places = stages.keep(spans.groupBy("digest").agg(F.collect_set(F.struct("unit", "start", "end")).alias("places")), most)
    stages.only(places)
    return rows.join(places, "digest", "left").select("row", "raw", "places")


def runs(raw: bytes, places: list[dict] | None, units: tuple[Unit, ...]) -> list[list[tuple[int, int]]]:
    """Per unit, the maximal stretches that repeats cover, in units."""
    return [merge([(p["start"], p["end"]) for p in places or () if p["unit"] == k]) for k in range(len(units))]


def in_bytes(raw: bytes, gone: list[list[tuple[int, int]]], units: tuple[Unit, ...]) -> list[tuple[int, int]]:
    """The same as stretches of bytes, over all units."""
    out = []
    for unit, spans in zip(units, gone, strict=True):
        if unit.words and spans:
            starts, ends = word_places(np.frombuffer(raw, np.uint8))
            spans = [(int(starts[s]), int(ends[e - 1])) for s, e in spans]
        out += spans
    return merge(out)


def remaining(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for s, e in gone:
        kept.append(raw[at:s])
        at = e
    return b"".join([*kept, raw[at:]])


def without_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes), n_passage_words.

    Removed is what 400-byte strings that also start anywhere else cover. n_passage_words
    counts the words in passages of 50 words or more that also stand anywhere else, however
    their words are spaced; they stay in ``kept`` unless they are such strings too. Null
    text is empty. Rows that repeat, also by doc_id, are documents of their own and repeat
    each other. A null doc_id is like any other. An empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("n_passage_words", pa.int64())])

    def run(batches):
        for b in slices(batches, "raw"):
            rows = []
            for doc, raw, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                gone, passages = runs(raw, places, UNITS)
                rows.append((doc, len(raw), sum(e - s for s, e in gone), len(gone), remaining(raw, gone), sum(e - s for s, e in passages)))
            yield _batch(rows, schema)

    placed = _placed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), UNITS).select("row.doc_id", "raw", "places")
    return placed.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_passage_words long")


def cut(docs: DataFrame, units: tuple[Unit, ...] = UNITS) -> DataFrame:
    """The rows with their repeats, of any of the ``units``, cut from ``text``, all other columns kept.

    All occurrences go, also those of rows that repeat. A character cut in two is dropped;
    a null text stays null, and null ids are like any other; ``n_chars``, if there is such
    a column, follows the text of every row. Other columns may have any names. An empty table gives no rows.
    """
    columns = docs.columns
    at = columns.index("text")

    def run(batches):
        for b in slices(batches, "raw"):
            rows = b.column(0)
            fields = rows.flatten()
            texts = []
            for text, raw, places in zip(fields[at].to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                if places and text is not None:
                    raw = raw.as_py()
                    text = remaining(raw, in_bytes(raw, runs(raw, places, units), units)).decode("utf-8", "ignore")
                texts.append(text)
            fields[at] = pa.array(texts, fields[at].type)
            yield pa.RecordBatch.from_arrays(fields, names=columns)

    out = _placed(docs, units).mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out
