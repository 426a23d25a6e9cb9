"""Personal data by weak supervision, in DataFrame expressions only.

Proposals come from patterns: the base kinds (email, ip, card, phone), which always stay,
and looser forms of them. Three labelers vote on each proposal or abstain: its form, a
gazetteer (top-level domains, reserved networks, issuer and country prefixes) and the
words before it. Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is; its posteriors then train a logistic span classifier, which
decides on the looser proposals. Votes are categories, so the pattern table has a bounded
number of rows however large the corpus; only that table comes to the driver.

Places are found by marking matches with a control character, cutting there and adding up
lengths. Patterns start only where a match can start and don't nest repetition, so long
texts neither take quadratic time nor exhaust the matcher's stack.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Stages

KINDS = ("email", "ip", "card", "phone")
MARK, SPARE = "\x01", "\x02"
CONTEXT = 32
ADD_AT = 0.5
EM_ROUNDS = 100

# Equal to the base patterns, match for match; see the module's note on starts and nesting.
_LOCAL = "[A-Za-z0-9._%+-]"
_LABEL = "[A-Za-z0-9-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@(?={_LABEL}++\.{_LABEL})[A-Za-z0-9.-]+?(?!{_LABEL}|\.{_LABEL})"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD_EDGES = r"(?<![0-9])(?<![0-9][\x20-])(?=[0-9])|(?<=[0-9])(?![0-9])(?![\x20-][0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
LOOSE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]{1,63}(?:\.|\x20?(?:\[dot\]|\(dot\))\x20?)[A-Za-z]{2,24}"
LOOSE_PHONE = r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"

# Gazetteers.
DOMAINS = "com|org|net|edu|gov|int|mil|info|io|dev|app|biz|de|fr|es|uk|eu|it|nl|ch|at|be|us|ca|au|jp|br|in|example|test"
RESERVED = r"^0*(?:0|10|127|255)\.|^0*192\.0*168\.|^0*169\.0*254\.|^0*172\.0*(?:1[6-9]|2[0-9]|3[01])\."
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6011|65|64[4-9]|62|35)"
COUNTRIES = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
FOR = {
    "email": "e-?mail|mail|contact|write|reach|correo|courriel",
    "ip": r"\bip\b|host|server|address|client|adresse|direcci",
    "card": "card|visa|master|amex|credit|payment|karte|carte|tarjeta",
    "phone": r"phone|\btel|call|mobile|fax|telefon|t[eé]l[eé]phone|llam",
}
AGAINST = r"token|version|licen[sc]e|isbn|issn|\bdoi\b|\brfc\b|order|invoice|serial|hash|commit"


#: Parts of a text that are walked at once; an even number, so that every lot begins outside of matches.
LOT = 256


def _spans(parts: str, kind: str, strict: bool | None) -> Column:
    """Every second part is a match: (kind, start, end, s, before, strict) of each.

    Lists that grow are copied at each step, so parts are walked in lots of LOT.
    """
    kept = "null" if strict is None else str(strict).lower()
    empty = "cast(array() as array<struct<kind:string,start:int,end:int,s:string,before:string,strict:boolean>>)"
    lots = f"transform(sequence(0, (size({parts}) - 1) div {LOT}), k -> slice({parts}, k * {LOT} + 1, {LOT}))"
    starts = "aggregate(o.lots, named_struct('at', 0, 'out', cast(array() as array<int>)), (a, l) -> named_struct('at', a.at + aggregate(l, 0, (n, x) -> n + char_length(x)), 'out', concat(a.out, array(a.at))), a -> a.out)"
    walk = (
        f"aggregate(l, named_struct('odd', false, 'at', s[i], 'before', '', 'out', {empty}),"
        f" (a, x) -> named_struct('odd', not a.odd, 'at', a.at + char_length(x), 'before', if(a.odd, '', right(x, {CONTEXT})),"
        f" 'out', if(a.odd, concat(a.out, array(named_struct('kind', '{kind}', 'start', a.at, 'end', a.at + char_length(x), 's', x, 'before', a.before, 'strict', cast({kept} as boolean)))), a.out)),"
        " a -> a.out)"
    )
    # arrays of one element name what is used twice: the lots, and where each of them starts
    return F.expr(f"flatten(transform(array(named_struct('lots', {lots})), o -> flatten(transform(array({starts}), s -> flatten(transform(o.lots, (l, i) -> {walk}))))))")


def _parts(pattern: str, there: Column, zero_width: bool = False) -> Column:
    """The text cut around the matches; uncut where a cheap test shows that there are none."""
    marked = F.regexp_replace("_t", pattern, MARK if zero_width else f"{MARK}$0{MARK}")
    return F.when(there, F.split(marked, MARK, -1)).otherwise(F.array(F.col("_t")))


def proposals(docs: DataFrame) -> DataFrame:
    """Adds ``_found`` to (row, text): the proposals of each text, base ones strict."""
    t = F.col("_t")
    df = docs.withColumn("_t", F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), MARK, SPARE))
    df = df.withColumns(
        {
            "_p0": _parts(EMAIL, F.contains(t, F.lit("@"))),
            "_p1": _parts(IP, t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
            "_p2": _parts(CARD_EDGES, t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), True),
            "_p3": _parts(PHONE, F.contains(t, F.lit("+"))),
            "_p4": _parts(LOOSE_EMAIL, F.contains(t, F.lit("at]")) | F.contains(t, F.lit("at)"))),
            "_p5": _parts(LOOSE_PHONE, t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}")),
        }
    )
    df = df.withColumns({"_s0": _spans("_p0", "email", True), "_s1": _spans("_p1", "ip", True), "_s2": _spans("_p2", "card", None), "_s3": _spans("_p3", "phone", True), "_s4": _spans("_p4", "email", False), "_s5": _spans("_p5", "phone", False)})
    n = lambda x: F.length(F.translate(x["s"], " -", ""))
    figures = lambda x: F.length(F.regexp_replace(x["s"], "[^0-9]", ""))
    ips = F.filter("_s1", lambda x: x["s"].rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
    cards = F.transform(F.filter("_s2", lambda x: (n(x) >= 13) & (n(x) <= 19)), lambda x: x.withField("strict", F.call_function("luhn_check", F.translate(x["s"], " -", ""))))
    phones = F.filter("_s3", lambda x: (figures(x) >= 9) & (figures(x) <= 15))
    df = df.withColumn("_base", F.concat("_s0", ips, F.filter(cards, lambda x: x["strict"]), phones))
    loose = F.concat(F.filter(cards, lambda x: ~x["strict"]), "_s4", "_s5")
    apart = F.filter(loose, lambda x: ~F.exists("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    # of loose proposals that overlap each other, the first of the list stays
    df = df.withColumn("_loose", apart)
    first = F.filter("_loose", lambda x, i: ~F.exists(F.slice("_loose", 1, i), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return df.withColumn("_found", F.concat("_base", first)).drop("_t", "_base", "_loose", *(f"_{c}{i}" for c in "ps" for i in range(6)))


def votes(x: Column) -> Column:
    """A proposal with its votes: 1 for, 0 against, null abstains; and a bucket of its length."""
    s, kind = x["s"], x["kind"]
    plain = F.translate(s, " -", "")
    gazetteer = (
        F.when(kind == "email", F.lower(s).rlike(rf"(?:\.|dot[\])]\x20?)(?:{DOMAINS})$").cast("int"))
        .when(kind == "ip", (~s.rlike(RESERVED)).cast("int"))
        .when(kind == "card", plain.rlike(ISSUERS).cast("int"))
        .otherwise(F.when(s.startswith("+"), s.rlike(COUNTRIES).cast("int")))
    )
    before = F.lower(x["before"])
    wanted = F.lit(False)
    for k, words in FOR.items():
        wanted = wanted | ((kind == k) & before.rlike(words))
    context = F.when(wanted, 1).when(before.rlike(AGAINST), 0)
    form = F.when(x["strict"], 1).otherwise(F.when(kind == "card", 0))
    return F.struct(kind.alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["strict"].alias("strict"), form.alias("form"), gazetteer.alias("gazetteer"), context.alias("context"), F.least(F.lit(3), F.floor(F.length(s) / 8)).cast("int").alias("size"))


LABELERS = ("form", "gazetteer", "context")


def reliabilities(patterns: list[tuple[tuple, float]], rounds: int = EM_ROUNDS) -> tuple[float, list[list[list[float]]], list[float]]:
    """Expectation-maximisation for a hidden yes or no behind independent votes.

    Patterns are (votes, count). Gives the prior, per labeler P(vote | truth) for votes
    0, 1 and abstain, and each pattern's posterior. Starts from votes being right more often than not.
    """
    code = {0: 0, 1: 1, None: 2}
    table = [[[0.6, 0.1, 0.3], [0.1, 0.6, 0.3]] for _ in LABELERS]
    prior, posterior = 0.5, [0.5] * len(patterns)
    for _ in range(rounds):
        posterior = []
        for v, _n in patterns:
            logs = []
            for z in (0, 1):
                p = prior if z else 1 - prior
                logs.append(math.log(p) + sum(math.log(table[j][z][code[x]]) for j, x in enumerate(v)))
            posterior.append(1 / (1 + math.exp(max(-700, min(700, logs[0] - logs[1])))))
        total = sum(n for _, n in patterns)
        prior = min(0.99, max(0.01, (sum(q * n for q, (_, n) in zip(posterior, patterns, strict=True)) + 1) / (total + 2)))
        for j in range(len(LABELERS)):
            for z in (0, 1):
                # a few pseudo-votes keep a labeler from ending worse than a coin, which would swap yes and no
                seen = [3.0, 0.5, 1.0] if z == 0 else [0.5, 3.0, 1.0]
                for q, (v, n) in zip(posterior, patterns, strict=True):
                    seen[code[v[j]]] += n * (q if z else 1 - q)
                table[j][z] = [x / sum(seen) for x in seen]
    return prior, table, posterior


def features(kind: str, size: int, v: tuple) -> list[float]:
    return [1.0, *(float(kind == k) for k in KINDS), *(float(size == k) for k in range(4)), *(float(x == y) for x in v for y in (0, 1))]


def train_classifier(rows: list[tuple[str, int, tuple, float, float]], rounds: int = 300) -> list[float]:
    """Logistic regression on (kind, size, votes, posterior, count) by gradient steps; counts weigh by their square root."""
    xs = [features(k, s, v) for k, s, v, _, _ in rows]
    w = [0.0] * (1 + len(KINDS) + 4 + 2 * len(LABELERS))
    total = sum(math.sqrt(n) for *_, n in rows) or 1
    for _ in range(rounds):
        g = [-0.01 * x for x in w]
        for x, (_, _, _, q, n) in zip(xs, rows, strict=True):
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(w, x, strict=True))))))
            for i, b in enumerate(x):
                if b:
                    g[i] += (q - p) * math.sqrt(n) / total
        w = [a + 2 * b for a, b in zip(w, g, strict=True)]
    return w


def score_expr(x: Column, w: list[float]) -> Column:
    z = F.lit(w[0])
    for i, k in enumerate(KINDS):
        z = z + F.when(x["kind"] == k, w[1 + i]).otherwise(0.0)
    for i in range(4):
        z = z + F.when(x["size"] == i, w[5 + i]).otherwise(0.0)
    for j, name in enumerate(LABELERS):
        for y in (0, 1):
            z = z + F.when(x[name] == y, w[9 + 2 * j + y]).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def located(docs: DataFrame) -> DataFrame:
    """(row, base, spans): every row as a struct, with arrays of (kind, start, end), by kind as listed, then start.

    The struct keeps the columns of ``docs`` apart, so they may have any names.
    """
    stages = Stages(docs.sparkSession, "personal")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("text"))
    voted = proposals(packed).drop("text").withColumn("_found", F.transform("_found", votes))
    voted = stages.keep(voted)
    counts = voted.select(F.explode("_found").alias("x")).groupBy("x.kind", "x.size", *(f"x.{n}" for n in LABELERS)).agg(F.count("*").alias("n"))
    table = sorted(counts.collect(), key=repr)  # kinds * sizes * 3 votes for each labeler: 432 rows at most
    patterns = [(tuple(r[n] for n in LABELERS), float(r.n)) for r in table]
    if patterns:
        *_, posterior = reliabilities(patterns)
        w = train_classifier([(r.kind, r.size, v, q, n) for r, (v, n), q in zip(table, patterns, posterior, strict=True)])
        sure = F.filter("_found", lambda x: x["strict"] | (score_expr(x, w) >= ADD_AT))
    else:
        sure = F.col("_found")
    place = {k: i for i, k in enumerate(KINDS)}
    rank = lambda x: F.coalesce(*(F.when(x["kind"] == k, i) for k, i in place.items()))
    inside = lambda a: F.transform(F.array_sort(F.transform(a, lambda x: F.struct(rank(x).alias("r"), x["start"].alias("start"), x["end"].alias("end")))), lambda x: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), x["r"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return voted.withColumns({"base": inside(F.filter("_found", lambda x: x["strict"])), "spans": inside(sure)}).drop("_found")


def find(docs: DataFrame) -> DataFrame:
    """Every row with ``base`` and ``spans``: arrays of (kind, start, end), by kind as listed, then start.

    Places are code points, the end exclusive. Null text is empty; rows that repeat and
    null ids are like any other; other columns stay as they are, except that ones named base
    or spans give way. An empty table gives no rows.
    """
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("base", "spans")]
    return located(docs).select(*own, "base", "spans")


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, a count of base spans per kind, base_sha256, all spans as a string, and n_spans, how many these are."""
    found = find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def counted(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(counted, KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def masked(docs: DataFrame) -> DataFrame:
    """The rows with every span of ``text`` replaced by its kind in angle brackets.

    Spans that overlap go as one, under the kind of the longest (of equally long ones, the
    first). Null text stays null, rows that repeat and null ids are like any other, and all
    other columns stay as they are, whatever their names. An empty table gives no rows.
    """
    found = located(docs).withColumn("_as_is", F.col("row.text").cast("string"))
    found = found.withColumn("_by", F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))))
    # at: the end of what is written; start, end, size, kind: the open stretch, the length and kind of its longest span
    opened = "'start', x.start, 'end', x.end, 'size', x.end - x.start, 'kind', x.kind"
    written = "concat(a.out, array(substring(_as_is, a.at + 1, a.start - a.at), concat('<', upper(a.kind), '>')))"
    text = F.expr(
        "aggregate(_by, named_struct('at', 0, 'start', 0, 'end', 0, 'size', 0, 'kind', cast(null as string), 'out', cast(array() as array<string>)),"
        " (a, x) -> case when a.kind is null then named_struct('at', a.at, " + opened + ", 'out', a.out)"
        " when x.start < a.end then named_struct('at', a.at, 'start', a.start, 'end', greatest(a.end, x.end), 'size', greatest(a.size, x.end - x.start), 'kind', if(x.end - x.start > a.size, x.kind, a.kind), 'out', a.out)"
        " else named_struct('at', a.end, " + opened + ", 'out', " + written + ") end,"
        " a -> concat(array_join(" + written + ", ''), substring(_as_is, a.end + 1)))"
    )
    changed = F.when(F.size("_by") > 0, text).otherwise(F.col("_as_is"))
    return found.select(*(changed.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
