import numpy as np
import pytest

from pyspark.sql import functions as F

from tests.oracle import assert_same, connect
from tidelog.llm import hnsw, pivots, vectors
from tidelog.llm import queries as corpus

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as id", "2 as score")


def brute(rows, modulus, k, score):
    out = []
    for q, x in rows:
        if q % modulus == 0:
            best = sorted((-score(x, y), c) for c, y in rows if c != q)[:k]
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(best)]
    return sorted(out)


def test_top_k_matches_sql(spark):
    assert_same(corpus.queries()["op3_exact_top_k"](spark, SF), connect(SF), corpus.oracle_sql()["op3_exact_top_k"])


@pytest.mark.parametrize("block_rows", [7, 8192])
def test_top_k_with_ties_and_odd_rows(spark, block_rows):
    rng = np.random.default_rng(2)
    good = [(i, rng.integers(-3, 4, 5).astype(float) / 2) for i in range(0, 120)] + [(200 + i, np.ones(5)) for i in range(50)]
    bad = [(300, None, 1), (301, [None, 1.0], 1), (302, [float("nan")] * 5, 1), (303, [float("inf")] * 5, 1), (None, [1.0] * 5, 1)]
    df = frame(spark, [(i, [float(v) for v in x], 0) for i, x in good] + bad)
    got = sorted(tuple(r) for r in pivots.top_k(df, block_rows=block_rows).collect())
    ints = [(i, np.floor(64 * x).astype(int)) for i, x in good]
    assert got == brute(ints, 20, 20, lambda x, y: int(x @ y))
    assert pivots.top_k(df.where("false")).count() == 0


def test_few_candidates_and_short_or_huge_vectors(spark):
    df = frame(spark, [(0, [1.0, 2.0], 0), (1, [1.0], 0), (2, [], 0), (40, [3e38, 3e38], 0)])
    got = {(r.query_id, r.vec_id): r.score for r in pivots.top_k(df).collect()}
    assert got[0, 1] == 64 * 64 and got[0, 2] == 0 and got[40, 0] == (1 << 63) - 1 and len(got) == 6


def test_graph_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in df.collect()]
    unit = np.stack([x / np.linalg.norm(x) for _, x in rows])
    ids = np.array([i for i, _ in rows])
    for shard_rows in (100, 4096):
        got = hnsw.nearest(df, shard_rows=shard_rows).collect()
        hits = total = 0
        for q in ids[ids % 50 == 0]:
            s = unit @ unit[ids == q][0]
            best = [i for i in ids[np.lexsort((ids, -s))] if i != q][:5]
            mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
            assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
            assert all(a.score >= b.score for a, b in zip(mine, mine[1:], strict=False))
            hits, total = hits + len(set(best) & {r.vec_id for r in mine}), total + 5
        assert hits >= 0.9 * total


def test_graph_recall_over_several_full_shards(spark):
    """20,500 rows in clusters, in shards of the production size: each query against brute force."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(300, 24))
    x = (centres[rng.integers(0, 300, 20_500)] + 0.6 * rng.normal(size=(20_500, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(8)
    assert len(x) > hnsw.SHARD_ROWS
    got = {}
    for r in hnsw.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    unit = x.astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 20_500, 50):
        s = unit @ unit[q]
        s[q] = -2
        best = np.lexsort((np.arange(len(s)), -s))[:5]
        mine = sorted(got[q])
        assert len(mine) == 5 and all(abs(s[v] - c) < 1e-12 for _, v, c in mine)
        hits, total = hits + len({v for _, v, _ in mine} & set(best.tolist())), total + 5
    assert hits >= 0.9 * total


def test_graph_is_stored_as_flat_arrays():
    rng = np.random.default_rng(8)
    values = rng.normal(size=(300, 6))
    ids = np.arange(300)
    built = hnsw.Shard(ids, values)
    again = hnsw.Shard(ids, values, [a.tobytes() for a in built.graph.flat()])
    for i in range(0, 300, 7):
        assert [x.tolist() for x in built.nearest(i, values[i], 5)] == [x.tolist() for x in again.nearest(i, values[i], 5)]


def test_cosine_of_extreme_components(spark):
    rows = [(0, [1e160, 1e160], 0), (1, [1e-200, 1e-200], 0), (2, [1e300, 0.0], 0), (50, [3.0, 3.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {(r.query_id, r.vec_id): r.score for r in hnsw.nearest(df).collect()}
    assert got[0, 50] == pytest.approx(1) and got[50, 1] == pytest.approx(1) and got[0, 2] == pytest.approx(0.5**0.5)


def test_products_beyond_64_bits_are_ranked(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e25, 0.0]), (2, [1e28, 0.0]), (3, [1e27, 0.0]), (4, [1e17, 0.0]), (5, [1e400, 0.0]), (6, [-1e30, 0.0]), (7, [1e307, 0.0])]
    got = pivots.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [2, 3, 1, 4, 6] and {r.score for r in got[:4]} == {(1 << 63) - 1} and got[4].score == -(1 << 63) + 1


def test_rows_of_one_id_or_one_vector_are_spread(spark):
    """Half of all rows share an id and a vector; blocks stay of one size, and the answers right."""
    rng = np.random.default_rng(9)
    rows = [(40, [1.0, 2.0, 0.5], 0)] * 200 + [(i, [float(v) for v in rng.integers(-4, 5, 3)], 0) for i in range(100, 300)]
    got = sorted(tuple(r) for r in pivots.top_k(frame(spark, rows), k=3, block_rows=50).collect())
    ints = [(i, np.floor(64 * np.array(x)).astype(int)) for i, x, _ in rows]
    want = []
    for q in {i for i, _ in ints if i % 20 == 0}:  # a query id that repeats is answered for all its rows together
        pairs = sorted((-int(x @ y), c) for i, x in ints if i == q for c, y in ints if c != q)[:3]
        want += [(q, i + 1, c, -s) for i, (s, c) in enumerate(pairs)]
    assert got == sorted(want)
    blocks = pivots.usable(frame(spark, rows), "vec_id", "embedding").withColumn("row", F.monotonically_increasing_id())
    sizes = [sum(len(p.ids) // 8 for p in r.parts) for r in vectors.blocks(blocks, 3, 8).collect()]
    assert sum(sizes) == 400 and max(sizes) < 100


def test_graph_with_copies_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 1.0, 1.0], 0) for i in range(100)] + [(100 + i, [float(x) for x in rng.normal(size=3)], 0) for i in range(50)]
    rows += [(400, [0.0] * 3, 0), (450, None, 0), (451, [float("nan")] * 3, 0), (500, [1e-30, 1e-30, 1e-30], 0)]
    got = hnsw.nearest(frame(spark, rows), shard_rows=40).collect()
    of = lambda q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q]
    assert of(0) == [1, 2, 3, 4, 5] and of(50) == [0, 1, 2, 3, 4] and of(400) == [] and len(of(100)) == 5
    assert hnsw.nearest(frame(spark, rows).where("vec_id = 100")).count() == 0


def test_equal_vectors_behind_a_repeated_query_id():
    ids = np.array([50] * 8 + [60, 61, 62, 70, 71], np.int64)
    values = np.array([[1.0, 2.0]] * 11 + [[2.0, 1.0]] * 2)
    at, score = hnsw.Shard(ids, values).nearest(50, values[0], 5)
    assert ids[at].tolist() == [60, 61, 62, 70, 71] and score[:3] == pytest.approx(1)
