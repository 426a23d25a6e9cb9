"""Corpus operators over texts, against brute force, the tokenizers library and planted cases."""
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelog.llm import bpe, nearest_copies, packing, personal_data, quality, suffixes, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " ", "İSTANBUL ΣΑΣ á ́x", "<|endoftext|>x<|startoftext|> don't DON'T", "a\x1cb\x85c　\r\n\t  x", "日本語 한국어 🙂👨‍👩‍👧", "x" * 5000, "ab " * 4000, "\x00\x01"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", None) for i, t in enumerate(ODD)] + [(3, ODD[3], None, None, 1), (3, "other text", "en", "s", 1), (None, "no id", "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS).withColumn("label", F.lit("clash")).withColumn("score", F.lit(1))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# -- packing --------------------------------------------------------------------


def check_packed(rows, source, capacity=2048):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, x in source:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), capacity):
            part = np.array(ids[k : k + capacity], "<u4")
            want.append((d, k // capacity, k, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r[:5] for r in map(tuple, rows)), key=repr) == sorted(want, key=repr)
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= capacity
    return len(filled)


def test_packing(docs, odd, empty):
    n = check_packed(packing.pack(docs).collect(), texts(docs))
    total = sum(r.length for r in packing.pack(docs).collect())
    assert n <= 1.03 * total / 2048 + 1
    check_packed(packing.pack(odd).collect(), texts(odd))
    assert packing.pack(empty).count() == 0


def test_plan_is_best_fit():
    rng = random.Random(3)
    for _ in range(50):
        cap = rng.randrange(5, 60)
        lengths = [rng.randrange(1, cap + 1) for _ in range(rng.randrange(1, 200))]
        rooms = []
        for n in sorted(lengths, reverse=True):
            fits = [r for r in rooms if r >= n]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else cap) - n)
        histogram = {n: lengths.count(n) for n in lengths}
        p = packing.plan(histogram, cap)
        assert p.sequences == len(rooms)
        ln = np.repeat(list(histogram), list(histogram.values()))
        rank = np.concatenate([np.arange(c) for c in histogram.values()])
        seq, off = p.slots(ln, rank)
        at = {}
        for s, o, n in sorted(zip(seq.tolist(), off.tolist(), ln.tolist(), strict=True)):
            assert at.get(s, 0) == o
            at[s] = o + n
        assert max(at.values()) <= cap


# -- BPE ------------------------------------------------------------------------


def test_bpe(docs, odd, empty):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (docs, odd):
        got = sorted((tuple(r) for r in bpe.digests(df).collect()), key=repr)
        want = []
        for d, x in texts(df):
            ids = t.encode(x or "", add_special_tokens=False).ids
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            want.append((d, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
        assert got == sorted(want, key=repr)
    assert bpe.digests(empty).count() == 0
    assert all(r.decoded == (r.text or "") for r in bpe.encode(docs).join(docs, "doc_id").collect())


# -- near copies ----------------------------------------------------------------


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            one = rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]
            if both and 100 * both >= 75 * len(sets[i] | sets[j]) or one:
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 62), 1 << 62 if d is None else d)
    c = [None if least[find(i)] == 1 << 62 else least[find(i)] for i in range(len(rows))]
    c = [x if sets[i] else rows[i][0] for i, x in enumerate(c)]
    return sorted(((d, len(s), c[i], c[i] == d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def near(df):
    return sorted((tuple(r) for r in nearest_copies.near_copies(df).collect()), key=repr)


def test_near_copies_of_the_table(docs):
    assert near(docs) == brute_components(texts(docs))


def test_near_copies_in_a_chain_and_a_crowd(spark, odd):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):  # copies of copies, each with a few words changed
        base = list(base)
        base[rng.randrange(120)] = f"x{i}"
        rows.append((100 + i, " ".join(base)))
    common = [f"c{i}" for i in range(100)]
    for i in range(40):  # alike, but partly under the threshold
        w = list(common)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(100)] = f"y{rng.randrange(10**6)}"
        rows.append((300 + i, " ".join(w)))
        if i % 10 == 0:  # rows of one doc_id with different texts
            rows.append((300 + i, " ".join(f"z{i}-{j}" if j < 50 else x for j, x in enumerate(w))))
    rows += [(500 + i, t) for i, t in enumerate(["one two", "ONE  two", "one", "", None, "one two three four five", "a b c d e f g h", "b c d e f g h"])]
    rows += texts(odd)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near(df) == brute_components(rows)
    assert near(df.where("false")) == []


def test_near_copies_on_both_sides_of_the_threshold(spark):
    """Groups without their original, with edits out of few words, so that texts meet through what they changed alike."""
    rng, rows = random.Random(8), []
    for group in range(12):
        base = [f"g{group}w{i}" for i in range(rng.choice((40, 90, 150)))]
        for _ in range(45):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 18)):
                at, kind = rng.randrange(len(w)), rng.randrange(4)
                w[at : at + (kind != 1)] = [f"e{group}-{rng.randrange(4)}"] if kind != 2 else []
            rows.append((rng.randrange(10**6), " ".join(w[: rng.choice((len(w), len(w), len(w) * 4 // 5))])))
    assert near(spark.createDataFrame(rows, "doc_id long, text string")) == brute_components(rows)


def test_null_ids_are_documents_of_their_own(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    big = (1 << 62) - 1
    rows = [(5, a), (7, b), (None, a), (None, b), (None, c), (None, c), (None, ""), (None, None), (big, "x y z"), (big + 9, "x y z"), (-3, b + " more"), (7, ""), (7, a + " tail")]
    got = near(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute_components(rows)
    assert sum(r == (None, 36, None, True) for r in got) == 2 and (big + 9, 1, big, False) in got
    # the same without the last row, which joins 5 and 7
    got = near(spark.createDataFrame(rows[:-1], "doc_id long, text string"))
    assert (7, 36, -3, False) in got and (5, 36, 5, True) in got and (None, 36, 5, False) in got


def test_many_pivots(spark):
    """Two halves that only a chain of near copies joins, numbered against their order."""
    rng, rows = random.Random(11), []
    base = [f"w{i}" for i in range(100)]
    for step in range(40):
        base = list(base)
        base[rng.randrange(100)] = f"n{step}"
        for k in range(6):
            w = list(base)
            w[rng.randrange(100)] = f"m{step}-{k}"
            rows.append((10_000 - 10 * step - k, " ".join(w)))
    assert near(spark.createDataFrame(rows, "doc_id long, text string")) == brute_components(rows)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    with np.errstate(over="ignore"):
        for n in (3, 40, 2000):
            x = rng.integers(0, 2**63, 4 * n, dtype=np.int64).astype(np.uint64)
            a, b = nearest_copies.sketch(np.sort(x[: 3 * n])), nearest_copies.sketch(np.sort(x[n:]))
            assert abs((a == b).mean() - 0.5) < 0.2 and a.max() < np.uint64(2**64 - 1)


# -- repeats --------------------------------------------------------------------


def brute_repeats(rows, n=400):
    seen = {}
    raws = [(t or "").encode() for _, t in rows]
    for raw in raws:
        for i in range(len(raw) - n + 1):
            seen[raw[i : i + n]] = seen.get(raw[i : i + n], 0) + 1
    out = []
    for (d, _), raw in zip(rows, raws, strict=True):
        gone = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - n + 1):
            if seen[raw[i : i + n]] > 1:
                gone[i] += 1
                gone[i + n] -= 1
        c = np.cumsum(gone)[:-1] > 0
        runs = int((c[1:] & ~c[:-1]).sum() + (c[0] if len(c) else 0))
        out.append((d, len(raw), int(c.sum()), runs, bytes(np.frombuffer(raw, np.uint8)[~c])))
    return sorted(out, key=repr)


def repeats(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.without_repeats(df).collect()), key=repr)


def planted(spark, odd):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(6))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(90)
    rows = [(i, prose(rng.randrange(5, 60)) + " " + passage[rng.randrange(80) :] + prose(20)) for i in range(30)]
    rows += [(100, "a" * 900), (101, "ab" * 600), (102, prose(80) * 2), (103, "x" * 399), (104, "x" * 399), (105, "y" * 400), (106, "y" * 400)]
    return rows + texts(odd)


def test_repeats_of_the_table(docs, empty):
    assert repeats(docs) == brute_repeats(texts(docs))
    assert repeats(empty) == []


def test_registered_queries_have_their_columns(spark, docs):
    from tidelog.llm import queries

    by = queries.queries()
    out = by["op10_suffix_array_dedup"](spark, SF)
    assert out.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kept = {d: (n, removed, spans, hashlib.sha256(left).hexdigest()) for d, n, removed, spans, left in brute_repeats(texts(docs))}
    words = dict(brute_passages(texts(docs)))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()} == kept
    assert {r.doc_id: r.n_passage_words for r in out.collect()} == words
    assert by["op2_minhash_near_dedup"](spark, SF).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert by["op7_personal_data"](spark, SF).columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"]


@pytest.mark.parametrize("group", [250, 3])
def test_planted_repeats(spark, odd, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP", group)
    rows = planted(spark, odd)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert repeats(df) == brute_repeats(rows)


def brute_passages(rows, n=50):
    """Words in stretches of n words that stand anywhere else."""
    seen = Counter()
    split = [(t or "").encode().split() for _, t in rows]
    for w in split:
        seen.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for (d, _), w in zip(rows, split, strict=True):
        hit = np.zeros(len(w), bool)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                hit[i : i + n] = True
        out.append((d, int(hit.sum())))
    return sorted(out, key=repr)


def passages(df):
    return sorted(((r.doc_id, r.n_passage_words) for r in suffixes.without_repeats(df).collect()), key=repr)


def test_passages_of_the_table(docs):
    assert passages(docs) == brute_passages(texts(docs))


@pytest.mark.parametrize("group", [250, 2])
def test_planted_passages(spark, odd, monkeypatch, group):
    """Passages of 50 to 70 words and 250 to 390 bytes, all under the byte rule; clean documents stay as they are."""
    monkeypatch.setattr(suffixes, "GROUP", group)
    rng, rows = random.Random(12), []
    prose = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(10**4)}" for _ in range(n)]
    planted = [[f"{x[:4]}" for x in prose(rng.randrange(50, 71))] for _ in range(6)]
    assert all(250 <= len(" ".join(x)) + 20 and len(" ".join(x)) <= 390 for x in planted)
    for i in range(40):
        w = prose(rng.randrange(5, 80))
        if i < 24:
            at = rng.randrange(len(w))
            w[at:at] = planted[i % 6]
        rows.append((1000 + i, rng.choice((" ", "  ", "\n")).join(w) if i % 3 else " ".join(w)))
    rows += [(1100 + i, " ".join(planted[0][:49])) for i in range(3)] + texts(odd)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = passages(df)
    assert got == brute_passages(rows)
    assert all((n >= 50) == (d < 1024) for d, n in got if d is not None and d >= 1000)
    cut = {r.doc_id: r.text for r in suffixes.cut(df.where("doc_id >= 1000")).collect()}
    for i, t in rows[:43]:
        assert (cut[i] == t) == (i >= 1024)
        assert i >= 1024 or " ".join(planted[i % 1000 % 6]) not in " ".join(cut[i].split())


def test_halves_of_a_crowd_agree_with_the_whole(spark, monkeypatch):
    """One passage amid many contexts, so that its anchors have more neighbourhoods than a group may hold, at every split."""
    rng = random.Random(13)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    core = noise(430)
    rows = [(i, noise(rng.randrange(300)) + core[rng.randrange(3) * 10 : 430 - rng.randrange(3) * 10] + noise(rng.randrange(300))) for i in range(60)]
    monkeypatch.setattr(suffixes, "GROUP", 4)
    assert repeats(spark.createDataFrame(rows, "doc_id long, text string")) == brute_repeats(rows)


def test_long_texts_go_through_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    rng = random.Random(14)
    prose = lambda n: " ".join("".join(rng.choice("abcdé") for _ in range(5)) for _ in range(n))
    shared = prose(150)
    rows = [(1, prose(900) + shared + prose(300)), (2, shared + prose(700)), (3, prose(10) + "x" * 3000 + prose(10)), (4, "y" + "x" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert repeats(df) == brute_repeats(rows) and passages(df) == brute_passages(rows)


def test_cut_keeps_columns_of_any_name(spark):
    names = ["row", "raw", "digest", "places", "_id", "_places", "unit", "start", "end", "a.b", "key"]
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, f"one {long}", *range(11)), (2, f"{long} two", *range(11)), (None, None, *range(11)), (None, "short", *[None] * 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = suffixes.cut(df)
    assert got.columns == df.columns and got.schema == df.schema
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "one ", *range(11)), (2, " two", *range(11)), (None, None, *range(11)), (None, "short", *[None] * 11)], key=repr)
    assert suffixes.cut(df.where("false")).count() == 0


def test_maximal_repeats_have_all_occurrences():
    a = b"Q" * 5 + b"0123456789" + b"R" * 5
    found = suffixes.maximal_repeats([(a, 7), (b"ZZ" + a[2:], 7), (a[:-3] + b"ZZZ", 7)], 10)
    assert all(len(m) >= 2 for _, _, m in found) and any(len(m) == 3 for _, _, m in found)
    assert suffixes.intervals([3, 5, 2], 3) == [(5, 1, 2), (3, 0, 2)]


# -- classifiers ----------------------------------------------------------------


@pytest.mark.parametrize("f, label, sf", [(quality.score_quality, "quality", "sf0.01"), (toxicity.score_toxicity, "toxic", "sf0.1")])
def test_classifiers_on_held_out_rows(spark, f, label, sf):
    """Precision and recall of label 1 and of label 0, on rows that no training saw."""
    d, lab = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = f(d, lab).join(lab.select("doc_id", F.col(label).alias("y")), "doc_id").where("held_out").collect()
    for y in (0, 1):
        named, meant = [r for r in rows if r.predicted == y], [r for r in rows if r.y == y]
        right = sum(r.y == y for r in named)
        assert len(meant) > 5 and right >= 0.85 * len(meant) and right >= 0.85 * len(named)
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_is_the_discriminant(spark, docs):
    """The same scores from class means and covariances that numpy takes of all labelled rows at once."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    y = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    rows = texts(docs)
    x = np.array([quality.statistics(t or "") for _, t in rows])
    at = [np.array([i for i, (d, _) in enumerate(rows) if y.get(d) == c]) for c in (0, 1)]
    both = x[np.concatenate(at)]
    z = (x - both.mean(axis=0)) / both.std(axis=0)
    own = [np.cov(z[a].T, bias=True) for a in at]
    pooled = sum(c * len(a) for c, a in zip(own, at, strict=True)) / len(both)
    log = []
    for c, a in zip(own, at, strict=True):
        s = 0.68 * c + 0.3 * pooled + 0.02 * np.trace(pooled) / len(pooled) * np.eye(len(pooled)) + 1e-9 * np.eye(len(pooled))
        off = z - z[a].mean(axis=0)
        log.append(-np.einsum("ij,ij->i", off, np.linalg.solve(s, off.T).T) / 2 - np.linalg.slogdet(s)[1] / 2 + np.log(len(a)))
    want = 1 / (1 + np.exp(-np.clip(log[1] - log[0], -700, 700)))
    got = {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
    assert np.allclose([got[d] for d, _ in rows], want, atol=1e-6)


def test_classifiers_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(10)] + [(None, 1, None), (99, 1, 1), (2, None, 7)], "doc_id long, quality int, toxic int")
    for f in (quality.score_quality, toxicity.score_toxicity):
        assert f(odd, labels).count() == odd.count()
        assert f(odd, labels.where("false")).count() == odd.count()
        assert f(empty, labels).count() == 0
        assert f(odd, labels).where("doc_id is null and held_out").count() == 1


def test_disguises():
    text = "the worst is a pathetic stupid idiot and a loser or moron in the trash " * 200
    channel = toxicity.Channel(toxicity.trigrams(text))
    for said, meant in {"id1ot": "idiot", "l0ser": "loser", "$tupid": "stupid", "looooser": "loser", "i.d.i.o.t": "idiot", "p4th3t1c": "pathetic", "tr@sh": "trash", "m o r o n": "moron"}.items():
        assert channel.restore(said) == meant
    assert toxicity.forms_of("idiot$$$", channel) == ("idiot",)


INSULTS = "you are the worst he is a pathetic stupid idiot and a loser or moron in the trash " * 200


def read(text):
    return toxicity.Restorer(toxicity.trigrams(INSULTS), words=Counter(INSULTS.split()))(text)


def test_long_stretches_and_word_ends():
    assert {"stupid", "moron", "loser"} <= read("y o u a r e a s t u p i d m o r o n a n d l o s e r")
    assert {"stupid", "moron"} <= read(" ".join("youareastupidmoron" * 40))
    assert "moron" in read("he is a m o r o n") and "loser" in read("he is a l o s e r")
    assert "loser" in read("l" + "o" * 60 + "ser")
    assert {"stupid", "moron", "loser"} <= read("y0u4r34stup1dm0r0n4nd4l0s3r1nth3tr4shy0u4r3th3w0rst")


@pytest.mark.parametrize("text, word", [("so m. o. r. o. n. it is", "moron"), ("m  o  r  o  n", "moron"), ("an i d ! o t!!", "idiot"), ("$ t u p i d", "stupid"), ("iddiioott", "idiot"), ("a sstuupidd one", "stupid")])
def test_disguises_that_gates_let_through(text, word):
    assert word in read(text)


@pytest.mark.parametrize("sign", [*toxicity.APART, *toxicity.LOOKS])
def test_runs_of_signs_take_linear_time(sign):
    import time

    channel = toxicity.Channel(toxicity.trigrams(INSULTS), Counter(INSULTS.split()))
    began = time.perf_counter()
    for token in ("a" + sign * 10_000 + "b", sign * 10_000, sign * 10_000 + "idiot", "idiot" + sign * 10_000, ("a" + sign) * 3_000):
        toxicity.forms_of(token, channel)
    assert time.perf_counter() - began < 3
    began = time.perf_counter()
    toxicity.forms_of("a" + sign * 10_000 + "b", channel)
    assert time.perf_counter() - began < 1


def test_decoration():
    for token, core in {"idiot!!": "idiot", "***idiot***": "idiot", '("idiot")': "idiot", "$idiot": "$idiot", "idiot$": "idiot$", "--": "", "-": "-", "_a_": "_a_", "": "", "a.": "a", "==>a": ">a"}.items():
        assert toxicity.undecorated(token) == core


def test_lattice_search_is_exact():
    """Of all paths of small lattices the search finds the cheapest."""
    from itertools import product

    channel, rng = toxicity.Channel(toxicity.trigrams(INSULTS)), random.Random(15)
    for _ in range(150):
        s = "".join(rng.choice("idiotms10!$@.- ooss") for _ in range(rng.randrange(1, 8)))
        for eager in (False, True):
            least = float("inf")
            for path in product(*channel.options(s, eager)):
                a = b = 0
                cost = 0.0
                for emit, change in path:
                    k = toxicity.letter(emit) if emit else -1
                    if k == 0 and b == 0:
                        cost = float("inf")
                    cost += change - (toxicity.PER_LETTER if k > 0 else 0)
                    if k >= 0:
                        cost += channel.cost[(a * toxicity.ORDER + b) * toxicity.ORDER + k]
                        a, b = b, k
                least = min(least, cost + channel.cost[(a * toxicity.ORDER + b) * toxicity.ORDER])
            assert channel.likeliest(s, eager)[0] == pytest.approx(least)


def test_skipped_lattices_could_not_weigh():
    """What is not searched when texts are scored has no path with a beginning that weighs."""
    starts, rng = {"idi", "mor", "los", "stu"}, random.Random(16)
    channel, worth = toxicity.Channel(toxicity.trigrams(INSULTS), Counter(INSULTS.split())), toxicity.possible({"idi", "mor", "los", "stu"})
    found = 0
    for _ in range(3000):
        w = list(rng.choice(["idiot", "moron", "loser", "stupid", "then", "nndstnd"]))
        for _ in range(rng.randrange(6)):
            w.insert(rng.randrange(len(w) + 1), rng.choice("".join(toxicity.LOOKS) + toxicity.APART.strip() + "iioorrsséß²"))
        every = [x for x in toxicity.forms_of("".join(w), channel) if x[:3] in starts]
        assert every == [x for x in toxicity.forms_of("".join(w), channel, worth) if x[:3] in starts]
        found += bool(every)
    assert found > 500


def test_counts_and_decoder_see_the_same_letters():
    for text, codes in {"Üa—é": [27, 1, 0, 27], "x🙂1y": [24, 0, 0, 25], "": []}.items():
        want = np.zeros(toxicity.ORDER**3, int)
        c = [0, 0, *codes, 0]
        for i in range(2, len(c)):
            want[(c[i - 2] * 28 + c[i - 1]) * 28 + c[i]] += 1
        assert (toxicity.trigrams(text) == want).all() or not text


def test_training_rows(spark, monkeypatch, tmp_path):
    """Repeated labels and labels without a document take no place; only near copies count once."""
    monkeypatch.setattr(toxicity, "TRAINING_ROWS", 40)
    header = " ".join(f"header{i}" for i in range(30))
    rows = [(i, f"{header} " + " ".join(f"own{i}x{j}" for j in range(40)) + (" stupid" if i % 2 else "")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60) for _ in range(30)] + [(i, 1) for i in range(1000, 9000)], "doc_id long, toxic int")
    model, words = toxicity.train(docs, labels, toxicity.character_counts(docs), toxicity.Stages(spark, "training"))
    assert words["header"] == 40 * 30
    assert any("stupid".startswith(f.rstrip("*")) for f in model.by_form)
    Row = type("Row", (), {})
    made = []
    for _, text in [*rows[:10], (0, rows[0][1] + " end")]:
        made.append(Row())
        made[-1].sketch = toxicity.sketch(text)
    assert toxicity.near_copies_of(made) == made[10:]


def test_training_sees_every_label(spark):
    """All labelled rows that are not held out count, however many; the same from repeated rows."""
    n = 26_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("header "), F.when(F.col("id") % 2 == 1, "stupid ").otherwise("other "), F.conv("id", 10, 2)).alias("text"))
    labels = spark.range(2 * n).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    seen = [i for i in range(n) if zlib.crc32(str(i).encode()) % 5]
    assert len(seen) > 20_000
    model, words = toxicity.train(docs, labels, toxicity.character_counts(docs), toxicity.Stages(spark, "training"))
    assert words == {"header": len(seen), "stupid": sum(i % 2 for i in seen), "other": sum(1 - i % 2 for i in seen)}
    assert "stupid" in model.by_form


def test_near_copies_of_labelled_rows(spark):
    """The join finds what the rule on a list finds, within a class."""
    rng = random.Random(17)
    texts = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(400)) for _ in range(80)) for _ in range(12)]
    texts += [t + f" end{k}" for t in texts[:6] for k in range(5)] + [t[: rng.randrange(200, len(t))] for t in texts[:8] for _ in range(4)]
    rows = [(y, int.from_bytes(toxicity.sketch(t)[:7], "big"), bytearray(toxicity.sketch(t))) for y, part in ((0, texts), (1, texts[::3])) for t in set(part)]
    df = spark.createDataFrame(rows, "y int, copy long, sketch binary").dropDuplicates(["y", "copy"])
    listed = df.orderBy("y", "copy").collect()
    gone = [(r.y, r.copy) for y in (0, 1) for r in toxicity.near_copies_of([r for r in listed if r.y == y])]
    left = [(r.y, r.copy) for r in toxicity.without_near_copies(df).collect()]
    assert gone and sorted(left + gone) == [(r.y, r.copy) for r in listed]


def test_scores_of_a_small_table_are_few_parts(spark, docs, tmp_path):
    docs.repartition(30).write.parquet(f"{tmp_path}/documents.parquet")
    scored = toxicity.score_toxicity(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert scored.rdd.getNumPartitions() == 1 and scored.count() == docs.count()


# -- personal data --------------------------------------------------------------

PERSONAL = [
    "a@b.com@d.org x@y.c_d@e.f q@r.ss+t@u.vv a@b..c a@b.c..d a@.b a@b.-", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4 0000255.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111-",
    "+1 (017) 555-7713. ++49 30 1234567 +1 +1.2.3.4.5.6.7.8.9+12 34 56 78 90", "\x01a@b.co\x01 \x02", "1 " * 9000, "1" * 9000, "é🙂 a@b.com 🙂 4111111111111111",
    "call (212) 555-1234 now, joe [at] example.com", "5500000000000004 5500-0000 0000-0004", "a@" + "b." * 9000 + "c", "x" * 50000 + " @a.b",
]


def brute_base(t):
    t = t or ""
    luhn = lambda s: sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate([int(c) for c in s][::-1])) % 10 == 0
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(g := re.sub(r"\D", "", m[0])) <= 19 and luhn(g)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]


def test_personal_data(spark, docs, odd, empty):
    planted = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(PERSONAL)], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text").where("doc_id is null or doc_id > 3").withColumn("doc_id", F.col("doc_id") + 5000)).unionByName(planted)
    by = dict(texts(df))
    for r in personal_data.digests(df).collect():
        base = brute_base(by[r.doc_id])
        listed = [":".join(map(str, x)) for x in base]
        assert hashlib.sha256(",".join(listed).encode()).hexdigest() == r.base_sha256
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in base) for k in personal_data.KINDS]
        assert set(listed) <= set(r.spans.split(",")) and r.n_spans == len([x for x in r.spans.split(",") if x])
    assert personal_data.digests(empty).count() == 0
    plan = personal_data.digests(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_masking(odd, spark):
    df = spark.createDataFrame([(1, "mail é🙂 a@b.com or 10.0.0.1", 7), (2, None, 8), (3, "clean", 9)], "doc_id long, text string, base int")
    got = {r.doc_id: r.text for r in personal_data.masked(df).collect()}
    assert got == {1: "mail é🙂 <EMAIL> or <IP>", 2: None, 3: "clean"} and personal_data.masked(df).columns == df.columns


def test_masking_of_overlaps(spark):
    texts = {
        "write 123.45.67.89.joe.smith@example.com now": "write <EMAIL> now",
        "+49 30 12345678.jane.doe@example.com": "<EMAIL>",
        "+14155552671@example.com, 10.0.0.1": "<EMAIL>, <IP>",
        "é🙂 1.2.3.4.5.6.7.8": "é🙂 <IP>.<IP>",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.text for r in personal_data.masked(df).orderBy("doc_id").collect()] == list(texts.values())


def test_columns_of_any_name(spark):
    names = ["base", "spans", "_found", "_t", "_p0", "_as_is", "_by", "row", "a.b"]
    df = spark.createDataFrame([(1, "a@b.com", *range(9)), (None, None, *[None] * 9), (1, "a@b.com", *range(9))], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = personal_data.masked(df)
    assert got.columns == df.columns and [t for _, t in got.dtypes] == [t for _, t in df.dtypes]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "<EMAIL>", *range(9))] * 2 + [(None, None, *[None] * 9)], key=repr)
    found = personal_data.find(df)
    assert found.columns == ["doc_id", "text", *names[2:], "base", "spans"] and found.where("doc_id = 1").first().base[0].kind == "email"
    assert personal_data.masked(df.where("false")).count() == 0


def test_many_matches_in_one_text(spark):
    """More matches than are walked at once, in every place of a lot."""
    text = "é " + " ".join(f"u{i}@x{i}.com 10.0.{i % 256}.1 +4930{1000000 + i}" for i in range(900))
    r = personal_data.digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    listed = ",".join(":".join(map(str, x)) for x in brute_base(text))
    assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and r.n_email == 900


# -- WARC -----------------------------------------------------------------------


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://x/", "<html lang=en><title>T&amp;x</title><p>a<br>b<script>x</script><a href='/l'>c</a>"), (2, None, None), (None, "http://y/", "plain"), (1, "http://x/", "")], "page_id long, url string, html string")
    source = warc.responses(pages)
    got = [r.asDict() for r in warc.derivatives(source).collect()]
    assert len(got) == 8
    ids = {r.record_id: r for r in source.collect()}
    for r in got:
        assert r["refers_to"] in ids and r["payload_digest"] == ids[r["refers_to"]].payload_digest and r["content_length"] == len(r["block"])
    first = next(r for r in got if r["key"] == 1 and r["record_type"] == "conversion" and r["block"])
    assert bytes(first["block"]) == b"T&x\na\nbc"
    assert b'"links": ["/l"]' in bytes(next(r for r in got if r["refers_to"] == first["refers_to"] and b"/l" in bytes(r["block"]))["block"])
    (tmp_path / "f.warc.gz").write_bytes(b"".join(warc.serialise(r) for r in got))
    back = [r.asDict() for r in warc.read_warc(spark, str(tmp_path / "f.warc.gz")).collect()]
    strip = lambda rs: sorted(({k: bytes(v) if k == "block" else v for k, v in r.items() if k != "key" and v} for r in rs), key=repr)
    assert strip(back) == strip(got)
    assert warc.derivatives(source.where("false")).count() == 0


def test_warc_query_returns_whole_records(spark):
    pages = spark.createDataFrame([(1, "http://x/", "<title>T</title><p>a<br>b"), (None, None, None)], "page_id long, url string, html string")
    got = warc.digest_table(pages)
    assert set(warc.derivatives(warc.responses(pages)).columns) - {"key"} <= set(got.columns)
    rows = got.collect()
    assert len(rows) == 4 and all(r.date and hashlib.sha256(bytes(r.block)).hexdigest() == r.block_sha256 for r in rows)
    assert sorted(bytes(r.block) for r in rows if r.record_type == "conversion") == [b"", b"T\na\nb"]


class Reader(__import__("html.parser").parser.HTMLParser):
    """What a page shows, by the standard library's parser."""

    BREAKS = {"p", "div", "br", "li", "ul", "title", "head", "body", "html"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.gone, self.links, self.heads, self.lang = [], 0, [], [], None

    def handle_starttag(self, tag, attrs):
        self.out.append("\n" if tag in self.BREAKS else "")
        self.gone += tag in ("script", "style")
        if not self.gone and tag == "a" and "href" in dict(attrs):
            self.links.append(dict(attrs)["href"])
        if tag == "html":
            self.lang = dict(attrs).get("lang")
        self.inside = tag

    def handle_endtag(self, tag):
        self.out.append("\n" if tag in self.BREAKS else "")
        self.gone -= tag in ("script", "style")
        self.inside = None

    def handle_data(self, data):
        if not self.gone:
            self.out.append(data)
            if getattr(self, "inside", None) == "title":
                self.heads.append(data)

    def text(self):
        lines = (re.sub(r"[ \t\r\f\v\xa0]+", " ", x).strip() for x in "".join(self.out).split("\n"))
        return "\n".join(x for x in lines if x)


def test_derivatives_agree_with_a_parser(spark):
    import json

    rng = random.Random(17)
    words = ["one", "&amp;", "caf&eacute;", "two  three", "é", "<b>bold</b>", "<a href='/x?a=1&amp;b=2'>link</a>", '<a class=c href="y">z</a>', "<br>", "<p>para</p>", "<div>d<ul><li>i</li></ul></div>", "<script>var x = 1 < 2;</script>", "<style>p{}</style>", "<!-- no -->"]
    pages = [(i, f"http://x/{i}", f"<html lang=de><head><title>T&amp;{i}</title></head><body>" + " ".join(rng.choice(words) for _ in range(rng.randrange(30))) + "</body></html>") for i in range(60)]
    got = {}
    for r in warc.derivatives(warc.responses(spark.createDataFrame(pages, "page_id long, url string, html string"))).collect():
        got.setdefault(r.key, {})[r.record_type] = bytes(r.block).decode()
    for key, _, page in pages:
        reader = Reader()
        reader.feed(page)
        reader.close()
        about = json.loads(got[key]["metadata"])
        assert got[key]["conversion"] == reader.text()
        assert about["links"] == reader.links and about["title"] == "".join(reader.heads) and about["lang"] == reader.lang


def test_warc_files_that_break_off(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>page {i}") for i in range(3)], "page_id long, url string, html string")
    records = [r.asDict() for r in warc.responses(pages).orderBy("key").collect()]
    for zipped in (True, False):
        raw = b"".join(warc.serialise(r, zipped) for r in records)
        whole = [r["record_id"] for r in warc.parse(raw)]
        assert len(whole) == 3
        for cut in range(0, len(raw), 37):
            found = [r["record_id"] for r in warc.parse(raw[:cut])]
            assert found == whole[: len(found)]
        assert len(list(warc.parse(raw[: len(raw) - 20]))) >= 2
    assert list(warc.parse(b"")) == [] and list(warc.parse(b"\x1f\x8bnot gzip")) == [] and list(warc.parse(b"WARC/1.1\r\nContent-Length: x")) == []
    (tmp_path / "f.warc").write_bytes(raw[:-30])
    assert warc.read_warc(spark, str(tmp_path / "f.warc")).count() == 2


def test_bodies_are_read_as_their_headers_say():
    import gzip
    import zlib as z

    page = "<title>Käse</title><p>süß"
    latin = page.encode("latin-1")
    chunks = lambda b: b"%x;x=1\r\n" % 5 + b[:5] + b"\r\n%X\r\n" % (len(b) - 5) + b[5:] + b"\r\n0\r\n\r\n"
    for head, body in (
        ("Content-Type: text/html; charset=ISO-8859-1", latin), ("Content-Type: text/html; charset=\"latin-1\"\r\nTransfer-Encoding: chunked", chunks(latin)), ("Content-Encoding: gzip", gzip.compress(page.encode())),
        ("Content-Encoding: deflate", z.compress(page.encode())), ("Content-Encoding: gzip\r\nTransfer-Encoding: chunked", chunks(gzip.compress(page.encode()))), ("Content-Type: text/html; charset=no-such", page.encode()), ("Content-Encoding: gzip", page.encode()), ("Transfer-Encoding: chunked", page.encode()),
    ):
        record = {"key": 1, "record_id": "<r>", "target_uri": "u", "date": "d", "payload_digest": "p", "block": b"HTTP/1.1 200 OK\r\n" + head.encode() + b"\r\n\r\n" + body}
        assert bytes(warc.derive(record)[1][-1]).decode() == "Käse\nsüß", head


def test_hostile_pages_take_linear_time():
    import time

    began = time.perf_counter()
    for part in ("<title>", "<title ", "<a ", "<a href", "<html ", "<", "<p", "<!--", "<script>", "</script   "):
        page = (part * 200_000)[:400_000].encode()
        record = {"key": 1, "record_id": "<r>", "target_uri": "u", "date": "d", "payload_digest": "p", "block": b"HTTP/1.1 200 OK\r\n\r\n" + page}
        assert len(warc.derive(record)) == 2
    assert time.perf_counter() - began < 20


def test_bytes_without_a_vocabulary_entry():
    coder = bpe.Bpe("byte_bpe_50k.json")
    ids = coder.merge(b"hello")
    coder.bytes_ids[ord("q")] = None
    assert coder.merge(b"q") == [] and coder.merge(b"heqllo") == ids


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from tidelog.llm.common import shared_folder

    conf = SimpleNamespace(get=lambda k, d: None, set=lambda k, v: None)
    with pytest.raises(ValueError):
        shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://x:7077")))
    assert shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[2]"))).startswith("file:/")
