import zlib

import pytest

from tidelog.functions import bloom
from tidelog.functions.checksum import entry_crc
from tidelog.model import CorruptionError
from tidelog.operators.compaction import split_greedy
from tidelog.operators.resolve import latest, live, merge_runs


def test_fnv_known_values():
    assert [int(x) for x in bloom.fnv1a([b"", b"a", b"foobar"])] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]


def test_bloom_rates(spark):
    bits, hashes = bloom.sizing(1000, 0.01)
    assert (bits, hashes) == (9585, 7)
    members = spark.range(1000).selectExpr("concat('key-', id) as key")
    words = bloom.build(members, bits, hashes)
    assert bloom.probe(members, words, bits, hashes).where("not may_contain").count() == 0
    others = spark.range(10_000, 20_000).selectExpr("concat('key-', id) as key")
    assert bloom.probe(others, words, bits, hashes).where("may_contain").count() < 500
    with pytest.raises(ValueError):
        bloom.sizing(0, 0.01)


def test_crc_is_ieee(spark):
    df = spark.createDataFrame([(b"ab", b"cd"), (b"", None)], "key binary, value binary").select(entry_crc().alias("c"))
    assert [r.c for r in df.collect()] == [zlib.crc32(b"abcd"), 0]


def test_merge(spark):
    schema = "key string, seq long, is_tombstone boolean, value string"
    old = spark.createDataFrame([("a", 1, False, "old"), ("b", 1, False, "b")], schema)
    new = spark.createDataFrame([("a", 2, False, "new"), ("b", 1, True, None)], schema)
    got = {r.key: r.value for r in merge_runs([old, new], drop_tombstones=True).collect()}
    assert got == {"a": "new"}
    assert live(latest(old.where("false"))).count() == 0


def test_splits(spark):
    import random

    rng = random.Random(1)
    sizes = [rng.choice((1, 5, 20, 49, 50, 51, 80)) for _ in range(400)]
    df = spark.createDataFrame([(f"{i:05d}", "x" * n, f"r{i // 100}") for i, n in enumerate(sizes)], "key string, value string, part string")
    got = {r.key: r.output_run for r in split_greedy(df, 55, by="part").collect()}
    for start in range(0, 400, 100):
        run = full = 0
        for i in range(start, start + 100):
            n = 5 + sizes[i]
            if full and full + n > 55:
                run, full = run + 1, 0
            full += n
            assert got[f"{i:05d}"] == run


def test_packed_filters(spark, monkeypatch):
    keys = spark.range(2000).selectExpr("concat('key-', id) as key")
    bits, hashes = bloom.sizing(1000, 0.01)
    words = bloom.build(keys.limit(1000), bits, hashes)
    raw = bloom.pack(words, bits, hashes)
    assert len(raw) == 16 + 8 * -(-bits // 64)
    shipped = {r.key: r.may_contain for r in bloom.probe_words(keys, *bloom.unpack(raw)).collect()}
    assert shipped == {r.key: r.may_contain for r in bloom.probe(keys, words, bits, hashes).collect()}
    monkeypatch.setattr(bloom, "SHIPPED_BYTES", 1)
    assert shipped == {r.key: r.may_contain for r in bloom.probe(keys, words, bits, hashes).collect()}
    for bad in (b"", raw[:-1], raw + b"x"):
        with pytest.raises(CorruptionError):
            bloom.unpack(bad)


def test_large_filters_are_dealt_by_their_size(spark, monkeypatch):
    from pyspark.sql import functions as F

    keys = spark.range(2000).selectExpr("concat('key-', id) as key")
    bits, hashes = bloom.sizing(1000, 0.01)
    small = {r.key: r.may_contain for r in bloom.probe(keys, bloom.build(keys.limit(1000), bits, hashes), bits, hashes).collect()}
    monkeypatch.setattr(bloom, "SHIPPED_BYTES", 1)
    monkeypatch.setattr(bloom, "TASK_BITS", 1000, raising=False)
    words = bloom.build(keys.limit(1000), bits, hashes)
    found = bloom.probe(keys, words, bits, hashes).withColumn("task", F.spark_partition_id()).collect()
    assert {r.key: r.may_contain for r in found} == small
    # more tasks than shuffle partitions: a task's share does not grow with the filter
    assert len({r.task for r in found}) > 4
    assert words.select(F.spark_partition_id()).distinct().count() > 4
