"""Toxicity by a noisy channel: restore disguised words, then score the restored text.

Disguised stretches (look-alike signs, letters set apart, letters repeated) become a
lattice of what each sign may stand for, or whether a word ends there. A Viterbi search
finds the likeliest words under a character trigram model, whose counts come from every
document, and a cost per change. It keeps every state (the last two letters, so at most
ORDER^2) and is linear in the stretch, however long that is. Its letters are also parted
into the words known from the labelled rows.
Ordinary words are a lattice of one path and stay as they are. When texts are scored, a
lattice is searched only if one of its paths can begin a word that weighs anything.

The score of a document is a logistic function of the summed weights of its distinct
restored words. Weights are log-odds of words and word beginnings, learned from every
labelled document that is not held out. Near copies of one label count once: a row goes if
its min-hash sketch agrees in most coordinates with that of the first row of one of its bands.
"""
from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Memo, Stages, few, slices, text_of

#: All labels are learned from, unless a number is set here: then so many, the least by hash of their id.
TRAINING_ROWS: int | None = None
#: The share of all words of the labelled rows that a known word must make up, so there are at most 1 / KNOWN_SHARE of them.
KNOWN_SHARE = 5e-6
#: Labelled rows are near copies if their sketches agree in this share of the coordinates; BAND of them make a band.
COORDINATES, COPY, BAND = 64, 0.75, 4
#: Bits that say which ids may have a label, whatever their number; the labels decide.
MARKS = 1 << 25
THRESHOLD = 0.5
#: Stretches up to this length are remembered, and tried for beginnings that weigh; longer ones are restored each time.
REMEMBERED = 64
ORDER = 28  # boundary, a-z, any other letter

# What a sign may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¡": "i", "%": "x",
}
APART = " .-_*~'`/\\,:;#^=&"
CHANGE, DROP_SIGN, DROP_APART, DROP_REPEAT, DROP_LONG_REPEAT, PER_LETTER = 0.8, 4.0, 0.2, 3.0, 0.1, 2.6
WORD_END = 1.0  # of a sign set apart that ends a word
#: The eager search: letters are seldom meant twice, signs among spaced letters are letters.
EAGER_REPEAT, EAGER_SIGN = 0.3, 8.0
#: A letter outside known words, when letters without word ends are parted.
UNKNOWN = 7.0

# Letters, digits and signs of LOOKS, one by one; _HINT is how every such run begins.
_MEMBER = "(?:[^\\W_]|[" + re.escape("".join(c for c in LOOKS if not c.isalnum())) + "])"
_HINT = re.compile(rf"(?<!\S){_MEMBER}[ .\-_*]{{1,2}}{_MEMBER}[ .\-_*]{{1,2}}{_MEMBER}[ .\-_*]")
_SPACED = re.compile(rf"(?<!\S)(?:{_MEMBER}[ .\-_*]{{1,2}}){{3,}}{_MEMBER}(?![^\W_])")
_LETTERS = re.compile(r"[^\W\d_]+")
_DOUBLED = re.compile(r"([^\W\d_])\1")
_SIGNS = re.compile("[" + re.escape("".join(LOOKS)) + re.escape(APART) + "]")


def letter(c: str) -> int:
    """The place of a lower-case character in the model's alphabet."""
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def trigrams(text: str) -> np.ndarray:
    """Trigram counts of the text's letters; anything else is a boundary."""
    out = np.zeros(ORDER**3, np.int64)
    if not _CODES:
        # by code point: what letter() says of each character
        _CODES.append(np.fromiter((letter(chr(i)) for i in range(0x110000)), np.uint8, 0x110000))
    for at in range(0, len(text), 1 << 20):  # pieces that share two letters
        piece = text[max(0, at - 2) : at + (1 << 20)].lower()
        codes = _CODES[0][np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
        if not at:
            codes = np.concatenate([[0, 0], codes])
        if at + (1 << 20) >= len(text):
            codes = np.concatenate([codes, [0]])
        out += np.bincount((codes[:-2] * ORDER + codes[1:-1]) * ORDER + codes[2:], minlength=ORDER**3)
    return out


_SALTS = np.random.default_rng(9).integers(0, 2**63, COORDINATES, dtype=np.int64).astype(np.uint64)
_APART_SET = frozenset(APART)
_CODES: list[np.ndarray] = []


class Channel:
    """Restores stretches under a character model given by trigram counts, and parts letters into words of given counts."""

    def __init__(self, counts: np.ndarray, words: dict[str, int] | None = None):
        words = words or {}
        total = math.log(sum(words.values()) or 1)
        self.words = {w: total - math.log(n) for w, n in words.items()}
        self.lengths = sorted({len(w) for w in words})
        c = counts.reshape(ORDER, ORDER, ORDER).astype(float)
        two, one = c.sum(axis=0), c.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + ORDER)
        p2 = (two + 8 * p1) / (two.sum(axis=1, keepdims=True) + 8)
        p3 = (c + 8 * p2[None]) / (c.sum(axis=2, keepdims=True) + 8)
        self.cost = (-np.log(p3)).ravel().tolist()

    @staticmethod
    def options(s: str, eager: bool) -> list[list[tuple[str, float]]]:
        """What each position may emit, a word's end as a space, with the channel's cost."""
        named = [i for i, c in enumerate(s) if c.isalnum()]
        first, last = (named[0], named[-1]) if named else (len(s), -1)
        out = []
        for i, c in enumerate(s):
            if c.isalpha():
                here = [(c, 0.0)]
                if i and s[i - 1] == c:
                    long = s[max(0, i - 2) : i + 1] == c * 3 or s[i - 1 : i + 2] == c * 3
                    here.append(("", DROP_LONG_REPEAT if long else EAGER_REPEAT if eager else DROP_REPEAT))
            else:
                here = [(x, CHANGE) for x in LOOKS.get(c, "")]
                edge = i <= first or i >= last
                spaced = eager and here and s[i - 1 : i] in _APART_SET and s[i + 1 : i + 2] in _APART_SET
                here.append(("", EAGER_SIGN if spaced else DROP_APART if c in APART or edge and not c.isdigit() else DROP_SIGN))
                if c in APART and not edge:
                    here.append((" ", WORD_END))
            out.append(here)
        return out

    def restore(self, s: str, eager: bool = False) -> str:
        """The likeliest words behind a lower-case stretch, joined by spaces."""
        return self.likeliest(s, eager)[1]

    def likeliest(self, s: str, eager: bool = False) -> tuple[float, str]:
        """The least cost of all paths, and what that path says."""
        # last two letters -> cost, and the letters so far as a linked list
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        costs = self.cost
        for here in self.options(s, eager):
            new: dict[int, tuple[float, tuple | None]] = {}
            for emit, change in here:
                k = letter(emit) if emit else -1
                gain = change - PER_LETTER if k > 0 else change
                for key, (cost, out) in states.items():
                    to = key
                    if k < 0:
                        total = cost + gain
                    else:
                        if not k and not key % ORDER:
                            continue  # a word has ended already
                        to = key % ORDER * ORDER + k
                        total = cost + gain + costs[key * ORDER + k]
                        out = (out, emit)
                    was = new.get(to)
                    if was is None or total < was[0]:
                        new[to] = (total, out)
            states = new
        total, out = min(((cost + costs[key * ORDER], out) for key, (cost, out) in states.items()), key=lambda x: x[0])
        word = []
        while out:
            out, emit = out
            word.append(emit)
        return total, "".join(reversed(word))

    def parted(self, letters: str) -> list[str]:
        """The likeliest known words that letters without word ends consist of; what lies between them is left out."""
        best, back = [0.0], [0]
        for end in range(1, len(letters) + 1):
            cost, start = best[-1] + UNKNOWN, end
            for n in self.lengths:
                if (at := end - n) < 0:
                    break
                known = self.words.get(letters[at:end])
                if known is not None and best[at] + known < cost:
                    cost, start = best[at] + known, at
            best.append(cost)
            back.append(start)
        out, end = [], len(letters)
        while end:
            if back[end] < end:
                out.append(letters[back[end] : end])
            end = min(back[end], end - 1)
        return out[::-1]


def undecorated(token: str) -> str:
    """Without the signs around a word that only decorate it: runs of one sign, opening signs before and sentence marks behind."""
    lo, hi = 0, len(token)
    while lo < hi and not (token[lo].isalnum() or token[lo] == "_"):
        end = lo + 1
        while end < hi and token[end] == token[lo]:
            end += 1
        if end - lo == 1 and token[lo] not in "\"'([":
            break
        lo = end
    while lo < hi and not (token[hi - 1].isalnum() or token[hi - 1] == "_"):
        start = hi - 1
        while start > lo and token[start - 1] == token[hi - 1]:
            start -= 1
        if hi - start == 1 and token[start] not in ".,;:?!\"')]":
            break
        hi = start
    return token[lo:hi]


def possible(starts) -> re.Pattern:
    """Matches every stretch of which some path of the lattice has a word that begins with one of ``starts``.

    Between two letters of a word a path drops only repeats of the first of them and signs,
    so no other letter of the alphabet stands there.
    """
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    may = {c: "[" + re.escape(c + "".join(k for k, v in LOOKS.items() if c in v)) + "]" for c in set("".join(starts))}
    between = {c: "[^" + alphabet.replace(c, "") + "]*" for c in may}
    tree: dict = {}
    for x in sorted(starts):
        if any(x[:k] in starts for k in range(1, len(x))):
            continue
        at = tree
        for c in x:
            at = at.setdefault(c, {})

    def pattern(tree: dict) -> str:
        last = "".join(may[c][1:-1] for c, x in tree.items() if not x)
        return "|".join([f"[{last}]"] * bool(last) + [f"{may[c]}{between[c]}(?:{pattern(x)})" for c, x in tree.items() if x])

    return re.compile(pattern(tree) or "(?!)")


def forms_of(token: str, channel: Channel, worth: re.Pattern | None = None) -> tuple[str, ...]:
    """Word forms of one lower-case token: what stands there, and what it may have been, unless nothing that it may have been is worth it."""
    core = token if token.isalpha() else undecorated(token)
    if core.isalpha() and not _DOUBLED.search(core):
        return (core,)
    out = [w for w in _LETTERS.findall(core) if len(w) > 2]
    if any(c.isalpha() for c in core) and (_SIGNS.search(core) or _DOUBLED.search(core)) and (worth is None or len(core) > REMEMBERED or worth.search(core)):
        for said in dict.fromkeys((channel.restore(core), channel.restore(core, eager=True))):
            words = said.split()
            words += channel.parted("".join(words))
            out += dict.fromkeys(w for w in words if len(w) > 2 and w not in out)
    return tuple(out)


class Restorer:
    """What ``of`` makes of the restored word forms of each token of a text, joined; tokens are remembered.

    Words that begin with none of ``starts``, if these are given, may be missing.
    """

    def __init__(self, counts: np.ndarray, of=tuple, words: dict[str, int] | None = None, starts=None):
        channel = Channel(counts, words)
        worth = None if starts is None else possible(starts)
        self._of = lambda t: of(forms_of(t, channel, worth))
        self._memo = Memo(self._of)  # two workers of an executor hold two generations each

    def __call__(self, text: str) -> set:
        text = text.lower()
        tokens = set(text.split())
        if _HINT.search(text):
            tokens.update(m.rstrip(" .-_*") for m in _SPACED.findall(text))
        memo = self._memo
        out: set = set()
        for t in tokens:
            if found := memo[t] if len(t) <= REMEMBERED else self._of(t):
                out.update(found)
        return out


def beginnings(word: str) -> list[str]:
    """The word itself, and its beginnings of three letters or more, marked by a star."""
    return [word, *(word[:k] + "*" for k in range(3, min(len(word), 10)))]


class Weights:
    """Log-odds by form; a word weighs as its weightiest form."""

    def __init__(self, by_form: dict[str, float], slope: float, base: float):
        self.by_form, self.slope, self.base = by_form, slope, base
        self.starts = {f[:3] for f in by_form}

    def weighed(self, words) -> tuple[tuple[str, float], ...]:
        """The (word, weight) of those that weigh anything."""
        of = self.by_form
        found = ((w, max(of.get(f, 0.0) for f in beginnings(w))) for w in words if w[:3] in self.starts)
        return tuple(x for x in found if x[1])

    def evidence(self, weighed) -> float:
        return sum(x for _, x in sorted(weighed))

    def score(self, weighed) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.base + self.slope * self.evidence(weighed)))))


def weights_of(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Log-odds of the forms that tell, from the numbers of rows that have them."""

    def odds(f: str) -> float:
        return math.log((toxic[f] + 0.5) / (n_toxic + 1)) - math.log((clean.get(f, 0) + 0.5) / (n_clean + 1))

    return {f: w for f in toxic if (w := odds(f)) > math.log(8)}


def common_forms(weight: dict[str, float], toxic: dict[str, int], n_toxic: int) -> set[str]:
    return {f for f in weight if toxic[f] >= max(4, 0.015 * n_toxic) and weight[f] > math.log(40)}


def cover(weight: dict[str, float], left: list[tuple[frozenset, int]], n_toxic: int) -> set[str]:
    """A greedy cover of the toxic rows without a common form: sets of forms, and how many rows have just these."""
    chosen: set[str] = set()
    while left:
        covered: Counter = Counter()
        for d, n in left:
            for f in d:
                covered[f] += n
        best = max(covered, key=lambda f: (covered[f] * weight[f], f), default=None)
        if best is None or covered[best] < max(2, 0.004 * n_toxic):
            break
        chosen.add(best)
        left = [(d, n) for d, n in left if best not in d]
    return chosen


def calibrate(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and base of a logistic regression on one number, lightly held towards zero; ``n`` rows have each x and y."""
    a, b = 1.0, math.log(((n * y).sum() + 0.5) / ((n * (1 - y)).sum() + 0.5))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = n * (p * (1 - p) + 1e-6)
        off = n * (y - p)
        g = np.array([(off * x).sum() - 0.5 * (a - 1), off.sum()])
        h = np.array([[(w * x * x).sum() + 0.5, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def character_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all texts: ORDER^3 numbers, added up in Spark."""
    schema = pa.schema([("k", pa.int32()), ("n", pa.int64())])

    def count(batches):
        acc = np.zeros(ORDER**3, np.int64)
        for b in slices(batches, "text"):
            for t in b.column(0).to_pylist():
                if t:
                    acc += trigrams(t)
        k = np.flatnonzero(acc)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(acc[k])], schema=schema)

    out = np.zeros(ORDER**3, np.int64)
    for r in docs.select("text").mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r.k] = r.n
    return out


def marked(df: DataFrame, place, by: DataFrame, by_place) -> DataFrame:
    """Rows whose place, a number, is one of those in ``by``: 64 places are a row of what is sent out."""
    bits = by.select(F.shiftright(by_place, 6).alias("word"), (by_place % 64).cast("int").alias("bit")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    near = df.select("*", F.shiftright(place, 6).alias("word"), (place % 64).cast("int").alias("bit"))
    return near.join(F.broadcast(bits), "word").where("shiftright(bits, bit) & 1 = 1").drop("word", "bit", "bits")


def labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``docs`` with their labels, y; most that have none are left out before anything is exchanged."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS))  # so at most MARKS / 64 rows are sent out
    return marked(docs, place, known, place).join(known, "doc_id")


def without_near_copies(marks: DataFrame) -> DataFrame:
    """The rows of y, copy, sketch that near_copies_of, on all of one y in order of copy, leaves."""
    bands = (F.xxhash64(F.lit(i), F.substring("sketch", 4 * i + 1, 4 * BAND)) for i in range(0, COORDINATES, BAND))
    bands = marks.select("y", "copy", F.explode(F.array(*bands)).alias("band"))
    first = bands.groupBy("y", "band").agg(F.min("copy").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = bands.join(first, ["y", "band"]).where("copy <> first").select("y", "copy", "first").distinct()
    pairs = pairs.join(marks.select("y", "copy", "sketch"), ["y", "copy"]).join(marks.select("y", F.col("copy").alias("first"), F.col("sketch").alias("other")), ["y", "first"])
    same = F.filter(F.sequence(F.lit(1), F.lit(4 * COORDINATES), F.lit(4)), lambda i: F.substring(F.col("sketch"), i, F.lit(4)) == F.substring(F.col("other"), i, F.lit(4)))
    return marks.join(pairs.where(F.size(same) >= COPY * COORDINATES).select("y", "copy").distinct(), ["y", "copy"], "left_anti")


def train(docs: DataFrame, labels: DataFrame, counts: np.ndarray, stages: Stages, label: str = "toxic") -> tuple[Weights | float, dict[str, int]]:
    """Learns weights, or without both classes the share of label 1 (0 without labels); with the known words and their counts.

    What the driver gets are forms that a share of the rows have, and counts by distinct sets or sums of them.
    """
    from tidelog.llm.quality import held_out

    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()
    if TRAINING_ROWS is not None:
        known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(TRAINING_ROWS)
    # stored, since row numbers would differ when computed again
    rows = stages.keep(few(labelled(docs, known).select("y", F.monotonically_increasing_id().alias("number"), "text"), docs))
    spelt = stages.keep(few(rows.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where(F.length("word") > 0).groupBy("word").agg(F.count("*").alias("n")), docs))
    often = max(2, math.ceil(KNOWN_SHARE * (spelt.agg(F.sum("n")).first()[0] or 0)))
    known_words = {r.word: r.n for r in spelt.where(F.col("n") >= often).collect()}

    def sketched(batches):
        for b in slices(batches, "text"):
            texts = [text_of(t) for t in b.column(2).to_pylist()]
            sketches = [sketch(t) for t in texts]
            copies = [xxhash.xxh3_64_intdigest(x) >> 1 for x in sketches]
            keys = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(copies, pa.int64()), pa.array(sketches, pa.binary())], names=["y", "number", "key", "copy", "sketch"])

    marks = rows.mapInArrow(sketched, "y int, number long, key binary, copy long, sketch binary")
    marks = marks.groupBy("y", "copy").agg(F.min("sketch").alias("sketch"), F.min(F.struct("key", "number")).alias("row"))
    marks = stages.keep(marks.select("y", "copy", "sketch", F.col("row.number").alias("number")), rows.count())
    # numbers are dense within a part, so the marks take about a bit for each row
    texts = stages.keep(few(marked(rows, F.col("number"), without_near_copies(marks), F.col("number")).select("y", "text"), docs))
    stages.only(texts)
    n = {r.y: r["count"] for r in texts.groupBy("y").count().collect()}
    if not n.get(0) or not n.get(1):
        return float(n.get(1, 0) > 0 and n.get(1, 0) / sum(n.values())), known_words

    def restored(y: int, among: frozenset | None = None) -> DataFrame:
        """The words of each row of a class; of those without a form in ``among`` only some."""

        def run(batches):
            read = Restorer(counts, tuple, known_words) if among is None else Restorer(counts, _holding(among), known_words, {f[:3] for f in among})
            for b in slices(batches, "text"):
                yield pa.RecordBatch.from_arrays([pa.array([sorted(read(text_of(t))) for t in b.column(0).to_pylist()], pa.list_(pa.string()))], names=["words"])

        return stages.keep(texts.where(F.col("y") == y).select("text").mapInArrow(run, "words array<string>"))

    def counted(df: DataFrame, of, least: float) -> dict[str, int]:
        """The rows that have what ``of`` makes of a value, where these are ``least`` or more."""

        column = df.columns[0]

        def run(batches):
            c, made = Counter(), of()
            for b in slices(batches, column):
                for x in b.column(0).to_pylist():
                    c.update(made(x))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["form", "n"])

        return {r.form: r.n for r in df.mapInArrow(run, "form string, n long").groupBy("form").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()}

    least = max(2, math.ceil(0.002 * n[1]))
    words = {1: restored(1)}
    toxic = counted(words[1], lambda: _forms(None), least)
    # words that stand plainly in clean rows rule out most forms, first alone, then by their beginnings; the others are counted with every disguise
    given = texts.where("y = 0").select("text")
    fewest: dict[str, int] = {}
    for w, k in counted(given, lambda: _plain, least * n[0] / n[1] / 16).items():
        for f in beginnings(w):
            fewest[f] = max(k, fewest.get(f, 0))
    among = frozenset(weights_of(toxic, fewest, n[1], n[0]))
    fewest = counted(given, lambda: _plain_forms(among), 1)
    among = frozenset(weights_of({f: toxic[f] for f in among}, fewest, n[1], n[0]))
    words[0] = restored(0, among)
    clean = counted(words[0], lambda: _forms(among), 1)
    weight = weights_of({f: toxic[f] for f in among}, clean, n[1], n[0])
    chosen = common_forms(weight, toxic, n[1])

    def uncommon(batches):
        forms = _forms(frozenset(weight))
        for b in batches:
            found = [forms(ws) for ws in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sorted(x) for x in found if x and not x & chosen], pa.list_(pa.string()))], names=["forms"])

    left = words[1].mapInArrow(uncommon, "forms array<string>").groupBy("forms").count().collect()  # a row for each distinct set
    chosen |= cover(weight, sorted(((frozenset(r.forms), r["count"]) for r in left), key=lambda x: sorted(x[0])), n[1])
    weights = {f: weight[f] for f in sorted(chosen)}

    def evidence(batches):
        w = Weights(weights, 1, 0)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w.evidence(w.weighed(ws)) for ws in b.column(0).to_pylist()], pa.float64())], names=["x"])

    # a row for each distinct sum
    xyn = sorted((r.x, y, r["count"]) for y in (0, 1) for r in words[y].mapInArrow(evidence, "x double").groupBy("x").count().collect())
    slope, base = calibrate(*np.array(xyn, float).T)
    return Weights(weights, slope, base), known_words


def _forms(among: frozenset | None):
    """A function from words to their forms, of which only those ``among``."""
    memo = Memo(lambda w: frozenset(beginnings(w)) if among is None else among.intersection(beginnings(w)), 1 << 14)
    return lambda words: set().union(*map(memo.__getitem__, words))


def _holding(among: frozenset):
    """A function that leaves the words with a form ``among``."""
    return lambda words: tuple(w for w in words if not among.isdisjoint(beginnings(w)))


def _plain(text: str | None) -> list[str]:
    """Words of the text that Restorer finds whatever else it finds."""
    return [t for t in set(text_of(text).lower().split()) if len(t) > 2 and t.isalpha()]


def _plain_forms(among: frozenset):
    forms = _forms(among)
    return lambda text: forms(_plain(text))


def sketch(text: str) -> bytes:
    """Least hashes of the text's word triples, one for each of COORDINATES mixings."""
    w = text.split()
    triples = zip(w, w[1:], w[2:], strict=False) if len(w) > 2 else [w]
    h = np.array([xxhash.xxh3_64_intdigest(" ".join(x)) for x in triples], np.uint64)
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 1024):
        x = (h[None, at : at + 1024] ^ _SALTS[:, None]) * np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, (x ^ (x >> np.uint64(32))).astype(np.uint32).min(axis=1), out=least)
    return least.astype("<u4").tobytes()


def near_copies_of(rows: list) -> list:
    """The rows whose sketch agrees in COPY of the coordinates or more with that of the first row of one of their bands."""
    first: dict[tuple[int, bytes], np.ndarray] = {}
    out = []
    for r in rows:
        raw = bytes(r.sketch)
        mine = np.frombuffer(raw, "<u4")
        of = [first.setdefault((i, raw[i : i + 4 * BAND]), mine) for i in range(0, len(raw), 4 * BAND)]
        if any(x is not mine and (mine == x).mean() >= COPY for x in of):
            out.append(r)
    return out


def _scorer(docs: DataFrame, labels: DataFrame, label: str):
    """A function that makes a function from texts to scores, in each task anew. ``docs`` has doc_id and text only."""
    counts = character_counts(docs)
    stages = Stages(docs.sparkSession, "toxicity")
    model, known_words = train(docs, labels, counts, stages, label)
    stages.only()

    def scorer():
        if not isinstance(model, Weights):
            return lambda texts: [model] * len(texts)
        weights = Weights(model.by_form, model.slope, model.base)
        read = Restorer(counts, weights.weighed, known_words, weights.starts)
        return lambda texts: [weights.score(read(text_of(t))) for t in texts]

    return scorer


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null text is empty and scores as a text without evidence. Labels that are null or not
    0 or 1 are left out, as are labels of held-out ids and of ids without a document. With
    labels of one class only, every score is the share of label 1 (0 without labels). Rows
    with a null doc_id are scored and count as held out.
    """
    from tidelog.llm.quality import held_out

    docs = _texts(docs)
    scorer = _scorer(docs, labels, label)

    def apply(batches):
        score = scorer()
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(b.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    scored = few(docs.mapInArrow(apply, "doc_id long, score double"), docs)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """The rows that score_toxicity predicts 0 for, each judged by itself, all columns kept."""
    scorer = _scorer(_texts(docs), labels, label)

    def apply(batches):
        score = scorer()
        for b in slices(batches, "text"):
            yield b.filter(pa.array([x < THRESHOLD for x in score(b.column("text").to_pylist())], pa.bool_()))

    return docs.mapInArrow(apply, docs.schema)
