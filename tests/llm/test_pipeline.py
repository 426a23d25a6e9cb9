import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import nearest_copies, suffixes, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """What each stage was given and what it made."""
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    root = tmp_path_factory.mktemp("stages")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{root}/{k}")
        made = spark.read.parquet(f"{root}/{k}")
        out.append((name, docs, made))
        docs = made
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_take_effect(spark, staged):
    by = {name: (given, made) for name, given, made in staged}
    for name, (given, made) in by.items():
        if name != "packing":
            assert made.columns == given.columns
    given, made = by["toxicity"]
    scores = toxicity.score_toxicity(given, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(made) == ids(scores.where("predicted = 0")) and made.count() < given.count()
    given, made = by["near_copies"]
    assert ids(made) == ids(nearest_copies.near_copies(given).where("kept")) and made.count() < given.count()
    given, made = by["repeats"]
    before = {r.doc_id: r for r in suffixes.without_repeats(given).join(given.select("doc_id", "text"), "doc_id").collect()}
    for r in made.collect():
        b = before[r.doc_id]
        assert (r.text == b.text) == (not b.n_removed and not b.n_passage_words) and len(r.text.encode()) <= len(b.kept)
    assert suffixes.without_repeats(made).where("n_removed > 0 or n_passage_words > 0").count() == 0
    assert made.where("n_chars <> length(text)").count() == 0
    given, made = by["personal_data"]
    assert ids(made) == ids(given) and made.where(F.col("text").rlike(r"[a-z0-9]@[a-z0-9]+\.[a-z]")).count() == 0
    given, made = by["packing"]
    assert sorted(set(ids(made))) == ids(given)


def test_run(spark, staged):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() == staged[-1][2].count() and "sequence_id" in got.columns


def test_repeated_rows_and_null_ids(spark, tmp_path):
    """One row of each content reaches packing, and toxic rows without an id go."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    prose = lambda k: " ".join(f"word{k}x{i}" for i in range(90))
    toxic = toxicity.score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1")
    bad = docs.join(toxic, "doc_id", "left_semi").select("text").first().text
    rows = [(900001, prose(1))] * 3 + [(900002, prose(2)), (None, prose(2))] + [(None, prose(3))] * 2
    rows += [(900003, prose(4)), (900003, prose(5)), (None, bad), (900004, None), (900004, None)]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    docs.unionByName(more, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")

    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, given, str(tmp_path))
    assert clean.columns == given.columns and clean.where(F.col("text") == bad).count() == 0
    left = corpus_pipeline.drop_near_copies(spark, clean, str(tmp_path))
    planted = left.where("doc_id > 900000 or doc_id is null").select("doc_id", "text").collect()
    want = [(900001, prose(1)), (900002, prose(2)), (None, prose(3)), (900003, prose(4)), (900003, prose(5)), (900004, None), (900004, None)]
    assert sorted(map(tuple, planted), key=repr) == sorted(want, key=repr)

    packed = corpus_pipeline.run(spark, str(tmp_path)).where("doc_id > 900000 or doc_id is null").collect()
    assert sorted((r.doc_id for r in packed), key=repr) == sorted((d for d, _ in want), key=repr)
    assert all(r.length > 90 for r in packed if r.doc_id != 900004)


ODD_COLUMNS = ["row", "raw", "digest", "places", "_row", "base", "spans", "_found", "score", "label", "_id", "component_id", "kept"]


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i}x" for i in range(30_000))
    passage = " ".join(f"p{i}" for i in range(55))
    one, two = (" ".join(f"{k}{i}" for i in range(40)) for k in ("one", "two"))
    texts = [None, "", " ", None, "-" * 60 + "Title", "a" + "!" * 10_000 + "b", long, "日本語 한국어 🙂👨‍👩‍👧", "\x00\x01", f"{one} {passage} .", f"{two} {passage} .", "mail a@b.com", "mail a@b.com", "1 " * 9000]
    ids = [1, 2, 3, None, 5, 6, 7, 8, 9, 10, None, 12, 12, None]
    rows = [(i, t, None if k % 3 else "en", "s", None if k % 2 else k, *[k] * len(ODD_COLUMNS)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in ODD_COLUMNS))


def key(r):
    return repr((r.doc_id, r.row))


def test_odd_rows_through_each_stage(spark, odd):
    """Nulls, empty, long and hostile texts, repeated rows and columns of any name: what each stage makes of them."""
    given = sorted(odd.collect(), key=key)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, odd, SF)
        assert made.columns == odd.columns and [t for _, t in made.dtypes] == [t for _, t in odd.dtypes]
        rows = sorted(made.collect(), key=key)
        same = [[getattr(r, c) for c in ODD_COLUMNS] + [r.doc_id, r.lang, r.source] for r in rows]
        was = {r.row: r for r in given}
        assert all(x == [getattr(was[r.row], c) for c in ODD_COLUMNS] + [was[r.row].doc_id, was[r.row].lang, was[r.row].source] for x, r in zip(same, rows, strict=True))
        if name == "toxicity":
            assert rows == given
        elif name == "near_copies":
            gone = {r.row for r in given} - {r.row for r in rows}
            assert len(gone) == 1 and gone < {11, 12} and all(r == was[r.row] for r in rows)
        elif name == "repeats":
            now = {r.row: r.text for r in rows}
            assert now.pop(9).startswith("one0 one1") and now.pop(10).startswith("two0 two1") and not any("p1 p2" in (t or "") for t in now.values())
            assert now.pop(13).strip() == "" and "!!!!" not in now.pop(5)  # each repeats itself
            assert all(t == was[k].text for k, t in now.items())
        else:
            now = {r.row: r.text for r in rows}
            assert now.pop(11) == now.pop(12) == "mail <EMAIL>"
            assert all(t == was[k].text for k, t in now.items())
        if name in ("repeats", "personal_data"):
            assert all(r.n_chars == len(r.text or "") for r in rows)
    packed = corpus_pipeline.pack(spark, odd, SF).collect()
    assert sorted({(r.doc_id, r.piece) for r in packed if r.start == 0}, key=repr) == sorted({(r.doc_id, 0) for r in given}, key=repr)
    assert sum(r.piece == 0 for r in packed) == len(given)


def test_empty_table_through_each_stage(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, odd.where("false"), SF)
        assert made.count() == 0 and (name == "packing" or made.columns == odd.columns)
