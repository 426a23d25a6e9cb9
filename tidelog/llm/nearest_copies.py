"""Near-duplicate documents: fast similarity sketches, banding, and exact confirmation.

Sketch (Dahlgaard, Knudsen and Thorup's fast similarity sketching): round i < t throws
every shingle into one of t bins with a value in [i, i + 1); rounds t..2t-1 throw all of
them into bin i - t. A bin keeps its least value, so every coordinate is filled after 2t
rounds for certain and after about ln(t) * t throws in expectation, and the share of equal
coordinates is concentrated around the Jaccard similarity. Coordinates are banded;
documents that agree on a band are candidates, and candidates are confirmed on their full
shingle sets.

Copies with equal shingle sets form one class, so they are never compared. Within a band
not all pairs are made. First each member meets the band's least one, the pivot. Bands that
then hold several components are handed to reference sets: a band's reference is its largest
component, whose set R holds the shingles that most of its members have. For texts x and y

    |x & y| <= min(|x & R|, |y & R|) + |(x - R) & (y - R)|

so x and y of different components can be similar only if min(|x & R|, |y & R|) alone
reaches the share needed, or if they share a shingle outside R. Both kinds are found by joins:
the first on the reference, among the few with that much of R, the second on rare shingles
outside R, of which a text needs only its rarest (prefix filtering: it must share at least r,
so one of all but r - 1 of them). Every other pair is proven not similar, so no link between
different texts is lost, and a text just under the threshold doesn't meet a whole group.

With COORDINATES = 160 in bands of 4, a pair at similarity 0.75 shares no band with
probability (1 - 0.75^4)^40 < 3e-7.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Memo, Stages, digest_of, partitions, rows_out, slices, text_of
from tidelog.llm.components import components

SHINGLE_WORDS = 5
COORDINATES, BAND = 160, 4
SIMILAR = (75, 100)
#: Band entries of one reference that are dealt out together; larger ones go to several tasks.
SLOT_ENTRIES = 1000
#: A row that is made with a set of shingles weighs like so many others.
WIDE = 5
_U = np.uint64
_WORD_AT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _U)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; arrays wrap around."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Shingler:
    """Sorted distinct 64-bit fingerprints of a text's shingles."""

    def __init__(self):
        import xxhash

        self._memo = Memo(xxhash.xxh3_64_intdigest)

    def __call__(self, text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
        # bytes.lower and bytes.split know ASCII letters and \x20 \x09-\x0d only, which is what is asked for
        parts = text.encode().lower().split()
        if not parts:
            return np.empty(0, _U)
        h = np.fromiter(map(self._memo.__getitem__, parts), _U, len(parts))
        n = max(1, len(parts) - words + 1)
        s = np.full(n, len(parts) if len(parts) < words else 0, _U)
        for j in range(min(words, len(parts))):
            s += mix(h[j : j + n] ^ _WORD_AT[j % 5]) * (_WORD_AT[(j + 1) % 5] | _U(1)) + _U(j)
        return np.unique(mix(s))


def sketch(shingles: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """t coordinates of a non-empty set: the round in the high bits, the hash below."""
    bins = np.full(t, np.iinfo(np.uint64).max, _U)
    n, at, low = len(shingles), 0, _U((1 << 52) - 1)
    while at < t:
        rounds = min(t - at, max(1, -(-3 * t // n)))  # more rounds than needed change nothing: their values are larger
        r = np.arange(at, at + rounds, dtype=_U)[:, None]
        h = mix(shingles[None, :] ^ mix(r + _U(0x51ED270B)))
        np.minimum.at(bins, ((h >> _U(52)) * _U(t) >> _U(12)).astype(np.int64).ravel(), (r << _U(52) | h & low).ravel())
        at += rounds
        if bins.max() != np.iinfo(np.uint64).max:
            return bins
    for j in np.flatnonzero(bins == np.iinfo(np.uint64).max):
        h = mix(shingles ^ mix(_U(t + j) + _U(0x51ED270B)))
        bins[j] = _U(t + j) << _U(52) | (h & low).min()
    return bins


def bands(coordinates: np.ndarray, width: int = BAND) -> np.ndarray:
    """One key per band, different between bands."""
    c = coordinates.reshape(-1, width)
    key = np.arange(1, len(c) + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    for j in range(width):
        key = mix(key ^ c[:, j]) + _U(j)
    return key.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """Of (doc_id, digest, text): (doc_id, digest, n, class binary, bands array<long>); null class and bands for texts without words."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("class", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        cut = Shingler()
        with np.errstate(over="ignore"):
            for b in slices(batches, "text"):
                n, cls, keys = [], [], []
                for text in b.column(2).to_pylist():
                    s = cut(text_of(text))
                    n.append(len(s))
                    cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    keys.append(bands(sketch(s)) if len(s) else None)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    return docs.select("doc_id", "digest", "text").mapInArrow(run, "doc_id long, digest binary, n long, class binary, bands array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """Of (node, text): (node, shingles binary), each text's sorted fingerprints."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        cut = Shingler()
        with np.errstate(over="ignore"):
            for b in slices(batches, "text"):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([cut(text_of(t)).tobytes() for t in b.column(1).to_pylist()], pa.binary())], schema=schema)

    return texts.select("node", "text").mapInArrow(run, "node long, shingles binary")


def similar(pairs: DataFrame) -> DataFrame:
    """Of (a, b, x binary, y binary) the (a, b) whose sets are similar enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    need, of = SIMILAR

    def run(b: pa.RecordBatch) -> dict:
        left = []
        for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
            x, y = (np.frombuffer(v.as_buffer(), _U) for v in (x, y))
            small, large = (x, y) if len(x) < len(y) else (y, x)
            at = np.searchsorted(large, small)
            both = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
            if of * both >= need * (len(x) + len(y) - both):
                left.append(i)
        return {"a": b.column(0).take(pa.array(left, pa.int64())), "b": b.column(1).take(pa.array(left, pa.int64()))}

    return pairs.select("a", "b", "x", "y").mapInArrow(lambda bs: rows_out(schema, run)(slices(bs, "x")), "a long, b long")


def close(a: str, b: str) -> F.Column:
    """Whether sizes allow the similarity."""
    need, of = SIMILAR
    return of * F.least(F.col(a), F.col(b)) >= need * F.greatest(F.col(a), F.col(b))


def shared_at_least(n: F.Column, other: F.Column) -> F.Column:
    """How many shingles texts of these sizes must share."""
    need, of = SIMILAR
    return F.ceil(need * (n + other) / (need + of))


def referenced(labelled: DataFrame) -> DataFrame:
    """Of entries (band, node, n, label), those in bands of several labels, by reference:
    (ref, slot, slots, own, least, node, n, label, weight). ``own`` is the sum of ``weight``
    over the reference's own members, ``least`` the smallest n that its bands hold."""
    votes = labelled.groupBy("band", "label").agg(F.count("*").alias("entries"), F.min("n").alias("least"))
    top = F.max(F.struct("entries", (-F.col("label")).alias("minus"))).alias("top")
    mixed = votes.groupBy("band").agg(top, F.count("*").alias("labels"), F.sum("entries").alias("entries"), F.min("least").alias("least")).where("labels > 1")
    mixed = mixed.select("band", (-F.col("top.minus")).alias("ref"), F.col("top.entries").alias("own"), "entries", "least")
    refs = mixed.groupBy("ref").agg(F.sum("own").alias("own"), F.min("least").alias("least"), (1 + F.floor(F.sum("entries") / SLOT_ENTRIES)).alias("slots"))
    found = labelled.join(mixed.select("band", "ref").join(refs, "ref"), "band")
    slot = F.pmod(F.xxhash64("node"), "slots").alias("slot")
    return found.groupBy("ref", "slots", "own", "least", "node", "n", "label").agg(F.count("*").alias("weight")).select("*", slot)


def with_sets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    return rows.join(sets, "node")


def reference_sets(group: DataFrame, sets: DataFrame) -> DataFrame:
    """(ref, core array<long>): the shingles that most of a reference's own members have, by weight."""
    schema = pa.schema([("ref", pa.int64()), ("own", pa.int64()), ("weight", pa.int64()), ("shingle", pa.int64())])

    def run(batches):
        for b in slices(batches, "shingles"):
            for ref, own, weight, s in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
                s = np.frombuffer(s.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(s), v)) for v in (ref, own, weight)), pa.array(s)], schema=schema)

    members = with_sets(group.where("label = ref").select("node", "n", "ref", "own", "weight"), sets)
    held = members.select("ref", "own", "weight", "shingles").mapInArrow(run, "ref long, own long, weight long, shingle long")
    most = held.groupBy("ref", "own", "shingle").agg(F.sum("weight").alias("weight")).where("2 * weight > own")
    return most.groupBy("ref").agg(F.collect_list("shingle").alias("core"))


_PARTED = "ref long, slot long, slots long, least long, node long, n long, label long, inside long, outside array<long>"


def parted(group: DataFrame, sets: DataFrame) -> DataFrame:
    """Each text against its reference set: how many shingles lie inside, and which outside."""
    schema = pa.schema([*((c, pa.int64()) for c in ("ref", "slot", "slots", "least", "node", "n", "label", "inside")), ("outside", pa.list_(pa.int64()))])
    empty = np.empty(0, np.int64)

    def run(batches):
        at, core = None, empty
        for b in batches:
            places, inside, outside = [], [], []
            for i, (ref, slot, c, s) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(7), b.column(8), strict=True)):
                if (ref, slot) != at:
                    at, core = (ref, slot), empty
                if c.is_valid:  # a slot's reference set comes before its texts
                    core = c.values.to_numpy().copy()
                    continue
                s = np.frombuffer(s.as_buffer(), np.int64)
                hit = np.isin(s, core)
                places.append(i)
                inside.append(int(hit.sum()))
                outside.append(s[~hit])
            left = b.take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(left.column(i) for i in range(7)), pa.array(inside, pa.int64()), pa.array(outside, pa.list_(pa.int64()))], schema=schema)

    # every task that holds a slot of a large reference gets one copy of its set
    texts = with_sets(group, sets).select("ref", "slot", "slots", "least", "node", "n", "label", F.lit(None).cast("array<long>").alias("core"), "shingles")
    core = group.select("ref", "slot").distinct().join(reference_sets(group, sets), "ref")
    core = core.select("ref", "slot", *(F.lit(None).cast("long").alias(c) for c in ("slots", "least", "node", "n", "label")), "core", F.lit(None).cast("binary").alias("shingles"))
    n = partitions(group.sparkSession)
    dealt = core.unionByName(texts).repartition(n, "ref", "slot").sortWithinPartitions("ref", "slot", F.col("core").isNull())
    return dealt.mapInArrow(run, _PARTED)


def _meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of different labels that agree on ``keys`` (``ref`` is one), each pair from one side. The left side is not of the
    reference's label, so the members of a large reference don't meet each other."""
    x = left.where("label <> ref").select(*keys, *(F.col(c).alias(f"a_{c}") for c in ("node", "n", "label", "inside")))
    y = right.select(*keys, *(F.col(c).alias(f"b_{c}") for c in ("node", "n", "label", "inside")))
    once = (F.col("b_label") == F.col("ref")) | (F.col("a_node") < F.col("b_node"))
    return x.join(y, keys).where(F.col("a_label") != F.col("b_label")).where(once).where(close("a_n", "b_n"))


def residual_pairs(labelled: DataFrame, sets: DataFrame, stages: Stages, entries: int) -> DataFrame:
    """Pairs (a, b) of different labels in a band of (band, node, n, label), at most ``entries`` rows, that the reference sets don't rule out."""
    need, of = SIMILAR
    held = stages.keep(parted(stages.keep(referenced(labelled), entries), sets), WIDE * entries)
    smallest = F.greatest(F.col("least"), F.ceil(F.col("n") * need / of))
    rows = held.withColumn("wanted", shared_at_least(F.col("n"), smallest) - F.col("inside"))

    alone = rows.where("wanted <= 0")
    dealt = alone.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
    inside = _meet(dealt, alone, ["ref", "slot"]).where(F.least("a_inside", "b_inside") >= shared_at_least(F.col("a_n"), F.col("b_n")))

    text = ["ref", "node", "n", "label", "inside", "wanted"]
    loose = rows.select(*text, F.explode("outside").alias("shingle"))
    shared = loose.groupBy("ref", "shingle").agg(F.count("*").alias("times"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("ref", "shingle", "times")
    rarest = loose.join(shared, ["ref", "shingle"]).groupBy(*text).agg(F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("shared"))
    prefix = F.slice("shared", F.lit(1), F.greatest(F.lit(0), F.size("shared") + 1 - F.greatest(F.col("wanted"), F.lit(1))).cast("int"))
    outer = stages.keep(rarest.select(*text, F.explode(prefix).alias("s")).select(*text, "s.shingle"))
    found = inside.select("a_node", "b_node").unionByName(_meet(outer, outer, ["ref", "shingle"]).select("a_node", "b_node"))
    return found.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Of pairs (a, b) those of different labels: (a, b, a_label, b_label)."""
    for c in ("a", "b"):
        of = labels.select(F.col("node").alias(f"{c}_node"), F.col("label").alias(f"{c}_label"))
        pairs = pairs.join(of, F.col(c) == F.col(f"{c}_node"), "left").withColumn(f"{c}_label", F.coalesce(f"{c}_label", c)).drop(f"{c}_node")
    return pairs.where("a_label <> b_label")


def joined(labels: DataFrame, edges: DataFrame, stages: Stages, nodes: int) -> DataFrame:
    """The labels after more edges (a, b): components of the graph between labels, then the old labels' new ones."""
    if not edges.limit(1).count():
        return labels
    between = stages.keep(apart(edges, labels).select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct(), nodes)
    to = components(between, stages, nodes).select(F.col("node").alias("label"), F.col("label").alias("to"))
    # labels that had no link before name themselves
    new = labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return stages.keep(new.unionByName(to.join(labels.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("to").alias("label"))), nodes)


def near_copies(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    A null text is empty; a row without words is linked with nothing and is its own
    component. Other rows that share a doc_id are linked, whatever their texts. Rows with a
    null doc_id are documents of their own, linked by their texts alone. component_id is the
    smallest doc_id reachable, null where no row of the component has one; kept says whether
    it equals doc_id, null equalling null. An empty table gives no rows.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("digest", digest_of("text"))
    rows = stages.keep(signatures(docs))
    # a node is a class of texts with equal shingle sets; it is known by a number, since ids may be null or repeat
    found = rows.where("n > 0").groupBy("class").agg(F.min("digest").alias("digest"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    total = rows.count()
    classes = stages.keep(found.withColumn("node", F.monotonically_increasing_id()), total)
    placed = stages.keep(rows.select("doc_id", "n", "class").join(classes.select("class", "node"), "class", "left").select("doc_id", "n", "node"), total)
    stages.drop(rows)

    entries = classes.select("node", "n", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.min(F.struct("node", "n")).alias("first"), F.count("*").alias("members")).where("members > 1")
    # stored, so that a band of many members can be parted when it is joined
    shared = stages.keep(shared.select("band", "first"))
    members = stages.keep(entries.join(shared, "band").select("band", "node", "n", F.col("first.node").alias("pivot"), F.col("first.n").alias("pivot_n")))
    held = members.count()

    meets = members.where(F.col("node") > F.col("pivot")).where(close("n", "pivot_n")).groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("agree"))
    meets = stages.keep(meets, held)
    # rows of one doc_id belong together, also where their texts differ
    named = placed.where("doc_id is not null and node is not null").select("doc_id", "node")
    several = stages.keep(named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z"), total)
    own = named.join(several.select("doc_id", "a"), "doc_id").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    # equal texts are cut into shingles once
    texts = docs.where("text is not null").groupBy("digest").agg(F.any_value("text").alias("text"))
    wanted = classes.select("digest", "node").join(members.select("node").distinct(), "node", "left_semi")
    sets = stages.keep(shingle_sets(texts.join(wanted, "digest")))

    def confirmed(p):
        x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        return similar(p.join(x, "a").join(y, "b"))

    # each class first meets the pivot that it agrees with most; other pivots matter only where labels still differ
    best = meets.groupBy("b").agg(F.max_by("a", F.struct("agree", -F.col("a"))).alias("a")).select("a", "b")
    # what is confirmed comes out of joins with whole sets, so it is written in more parts than its rows need
    edges = stages.keep(own.unionByName(confirmed(stages.keep(best, total))), WIDE * total)
    labels = components(edges, stages, total)
    rest = apart(meets.select("a", "b"), labels).select("a", "b")
    labels = joined(labels, stages.keep(confirmed(stages.keep(rest, held)), WIDE * held), stages, total)
    # the pivots met every member; what is left matters where components still differ
    left = members.where("node <> pivot").select("band", "node", "n")
    labelled = stages.keep(left.join(labels, "node", "left").select("band", "node", "n", F.coalesce("label", "node").alias("label")), held)
    late = stages.keep(confirmed(stages.keep(residual_pairs(labelled, sets, stages, held), held)), WIDE * held)
    stages.drop(labelled)
    labels = joined(labels, late, stages, total)
    stages.only(classes, placed, labels)

    # (node, label) of every class; labels has those with links only
    of_node = classes.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    least = placed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")).join(of_node, "node")
    components_of = least.groupBy("label").agg(F.min("least").alias("component_id")).join(of_node, "label").select("node", "component_id")
    out = placed.join(components_of, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
