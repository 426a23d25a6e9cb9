import random

import pytest

from tidelog import Config, Store
from tidelog.model import ConflictError, CorruptionError, InvalidConfig, TransactionError, prefix_end
from tidelog.operators.reads import neighbours


def contents(store, **kw):
    return [(bytes(r.key), bytes(r.value)) for r in store.scan(**kw).collect()]


@pytest.fixture
def store(spark, tmp_path):
    with Store.open(spark, Config(str(tmp_path / "db"))) as s:
        yield s


def test_put_overwrite_delete(store):
    store.put("k", "v1")
    store.put("k", "v2")
    assert store.get("k") == b"v2"
    store.delete("k")
    store.delete("absent")
    assert store.get("k") is None and contents(store) == []
    store.put(b"", b"")
    assert store.get(b"") == b""


def test_byte_order_and_ranges(store):
    keys = [b"", b"\x00", b"\x7f", b"\x80", b"\xff", b"\xff\x00", b"\xff\xff"]
    store.write_batch([(k, b"x") for k in reversed(keys)])
    assert [k for k, _ in contents(store)] == keys
    assert [k for k, _ in contents(store, reverse=True, limit=2)] == keys[::-1][:2]
    assert contents(store, start="z", end="a") == [] and contents(store, start="a", end="a") == []
    assert [bytes(r.key) for r in store.prefix_scan(b"\xff").collect()] == keys[4:]
    assert prefix_end(b"a\xff") == b"b" and prefix_end(b"\xff") is None


def test_batch_last_wins_and_reopen(spark, tmp_path):
    c = Config(str(tmp_path / "db"))
    with Store.open(spark, c) as s:
        s.write_batch([("k", "1"), ("k", "2"), ("a", "1")])
    with Store.open(spark, c) as s:
        assert contents(s) == [(b"a", b"1"), (b"k", b"2")]
        s.flush()
        s.delete("a")
        s.sync()
        version = s.manifest.version
        s.put("late", "x")
    with Store.open(spark, c, version=version) as past:
        assert contents(past) == [(b"k", b"2")]
        with pytest.raises(ConflictError):
            past.put("x", "y")
    with pytest.raises(CorruptionError):
        Store.open(spark, c, version=999)


def test_transactions(store):
    for f in (store.commit, store.rollback, lambda: store.tx_put("a", "b")):
        with pytest.raises(TransactionError):
            f()
    store.begin()
    store.tx_put("k", "tx")
    store.begin()
    assert store.has_transaction and store.get("k") is None
    store.put("k", "plain")
    store.commit()
    assert store.get("k") == b"tx"
    store.begin()
    store.tx_delete("k")
    store.rollback()
    assert store.get("k") == b"tx"
    store.begin()
    store.commit()


def test_cursor(store):
    store.write_batch([(f"k{i}", str(i)) for i in range(0, 10, 2)])
    c = store.iterator()
    assert c.key == b"k0"
    c.prev()
    assert c.key == b"k0"
    c.seek("k3")
    assert c.key == b"k4" and c.value == b"4"
    c.next()
    assert c.key == b"k6"
    c.seek_for_prev("k5")
    assert c.key == b"k4"
    c.seek_for_prev("k4")
    assert c.key == b"k4"
    c.seek("z")
    assert not c.valid and c.key is None
    c.seek_to_last()
    assert c.key == b"k8"
    assert [k for k, _ in store.iterator(reverse=True)] == [b"k8", b"k6", b"k4", b"k2", b"k0"]
    assert store.iterator(reverse=True).key == b"k8"


def test_compaction_keeps_deletes_until_safe(store):
    store.write_batch([(f"k{i:03d}", "v") for i in range(50)])
    store.flush()
    store.compact_level(0)
    store.compact_level(1)
    store.write_batch([("k001", "new")])
    store.delete("k002")
    store.flush()
    store.compact_level(0)
    assert store.get("k002") is None and store.get("k001") == b"new"
    assert any(r.is_tombstone for r in store.ops().collect())
    before = contents(store)
    store.compact_level(1)
    assert contents(store) == before and len(before) == 49
    assert not any(r.is_tombstone for r in store.ops().collect())
    assert store.verify() == []
    assert store.collect_garbage(keep=1) == []  # young files stay
    assert store.collect_garbage(keep=1, grace=0) and contents(store) == before


def test_policy_runs_by_itself(spark, tmp_path):
    with Store.open(spark, Config(str(tmp_path / "db"), memtable_size_limit=512, l0_compaction_trigger=2)) as s:
        for i in range(3):
            s.write_batch([(f"key{j:04d}", f"value{i}") for j in range(60)])
        assert s.stats()["compactions"] >= 1 and s.stats()["flushes"] == 3
        assert len(contents(s)) == 60 and s.get("key0007") == b"value2"


def test_conflicting_handles(spark, tmp_path):
    c = Config(str(tmp_path / "db"))
    a, b = Store.open(spark, c), Store.open(spark, c)
    a.put("x", "1")
    b.put("y", "2")
    a.sync()
    with pytest.raises(ConflictError):
        b.sync()


def test_verify_finds_a_flipped_value(spark, store):
    from pyspark.sql import functions as F

    store.write_batch([("a", "1"), ("b", "2")])
    store.flush()
    run = store.manifest.runs[0]
    bad = spark.read.parquet(run.path).withColumn("value", F.when(F.col("key") == F.lit(b"a"), F.lit(b"9")).otherwise(F.col("value"))).collect()
    schema = spark.read.parquet(run.path).schema
    folder = run.path.rsplit("/", 1)[0]
    spark.createDataFrame(bad, schema).coalesce(1).write.mode("append").parquet(folder)
    from dataclasses import replace

    new = [f for f in spark.read.parquet(folder).inputFiles() if f != run.path]
    store.manifest = replace(store.manifest, runs=(replace(run, path=new[0]),))
    assert len([f for f in store.verify() if "checksum" in f]) == 1


def test_reports(store, tmp_path):
    store.write_batch([(f"k{i}", "v") for i in range(10)])
    assert store.stats()["buffer_entries"] == 10 and store.stats()["buffer_bytes"] == 30
    store.flush()
    plan = store.analyze_scan("k2", "k5")
    assert plan.levels == (0,) and plan.cost == "Low" and "cost: Low" in str(plan)
    assert store.analyze_scan("zz", None).runs == 0
    store.scan_cached("a", "z").count()
    store.scan_cached("a", "z").count()
    assert store.stats()["cache_hit_rate"] == 0.5
    with pytest.raises(InvalidConfig):
        Config("x", max_run_size=0)


def test_import_and_cli(spark, tmp_path, capsys):
    from tidelog.cli import main

    (tmp_path / "f.txt").write_text("a:1\nno separator\nb:x:y\na:2\n")
    d = ["--dir", str(tmp_path / "db")]
    assert main([*d, "import", str(tmp_path / "f.txt")], spark) == 0
    assert main([*d, "get", "a"], spark) == 0
    assert main([*d, "get", "zz"], spark) == 1
    assert main([*d, "put", "c", "3"], spark) == 0
    assert main([*d, "del", "a"], spark) == 0
    assert main([*d, "scan", "a", "z"], spark) == 0
    assert main([*d, "compact"], spark) == 0
    assert main([*d, "verify"], spark) == 0
    out = capsys.readouterr().out
    assert "imported 3 entries" in out and "2\n(nil)" in out and "b => x:y\nc => 3" in out and out.endswith("OK\n")


def test_against_a_dict(spark, tmp_path):
    rng, model = random.Random(7), {}
    c = Config(str(tmp_path / "db"), l0_compaction_trigger=2)
    s = Store.open(spark, c)
    for _ in range(25):
        step = rng.choice(["batch", "batch", "delete", "txn", "flush", "compact", "reopen"])
        ks = [f"k{rng.randrange(30):02d}" for _ in range(5)]
        if step == "batch":
            s.write_batch([(k, str(i)) for i, k in enumerate(ks)])
            model |= {k: str(i) for i, k in enumerate(ks)}
        elif step == "delete":
            for k in ks:
                s.delete(k)
                model.pop(k, None)
        elif step == "txn":
            s.begin()
            for k in ks:
                s.tx_put(k, "t")
            if rng.random() < 0.5:
                s.commit()
                model |= dict.fromkeys(ks, "t")
            else:
                s.rollback()
        elif step == "reopen":
            s.close()
            s = Store.open(spark, c)
        else:
            getattr(s, step)()
    assert contents(s) == sorted((k.encode(), v.encode()) for k, v in model.items())
    assert s.verify() == []
    s.close()


def test_neighbours_over_many_ranges(spark):
    kv = spark.range(500).selectExpr("lpad(cast(id as string), 6, '0') as key")
    got = {r.key: (r.prev_key, r.next_key) for r in neighbours(kv, 7).collect()}
    ks = sorted(got)
    assert all(got[k] == (ks[i - 1] if i else None, ks[i + 1] if i + 1 < len(ks) else None) for i, k in enumerate(ks))


def test_stream_appends_once(spark, tmp_path):
    from tidelog.streaming.ingest import append_stream

    src = str(tmp_path / "in")
    spark.sql("select encode('k','utf-8') as key, 1L as seq, false as is_tombstone, encode('v','utf-8') as value").write.parquet(src)
    with Store.open(spark, Config(str(tmp_path / "db"))) as s:
        changes = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
        for _ in range(2):
            q = append_stream(changes, s, str(tmp_path / "cp"))
            q.awaitTermination(60)
        assert contents(s) == [(b"k", b"v")] and s.stats()["writes"] == 1


def test_streams_do_not_meet(spark, tmp_path):
    """Two streams whose batches have the same numbers, and one that starts anew after a crash between commit and checkpoint."""
    from tidelog.streaming.ingest import append_stream

    with Store.open(spark, Config(str(tmp_path / "db"))) as s:
        for k in ("a", "b", "b"):
            src = str(tmp_path / f"in-{k}")
            spark.sql(f"select encode('{k}','utf-8') as key, 1L as seq, false as is_tombstone, encode('v','utf-8') as value").write.mode("overwrite").parquet(src)
            changes = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
            checkpoint = tmp_path / f"cp-{len(s.manifest.streams)}-{s.manifest.version}"
            append_stream(changes, s, str(checkpoint), name=k).awaitTermination(60)
        assert contents(s) == [(b"a", b"v"), (b"b", b"v")] and s.stats()["writes"] == 2
        assert s.manifest.streams == {"a": 0, "b": 0}


@pytest.mark.parametrize("step", ["write_part", "claim"])
def test_writer_dies_at_a_step(spark, tmp_path, step, monkeypatch):
    c = Config(str(tmp_path / "db"))
    with Store.open(spark, c) as s:
        s.put("a", "1")
    dying = Store.open(spark, c)
    dying.put("b", "2")

    def die(*_):
        raise OSError("gone")

    monkeypatch.setattr(dying.manifests.files, step, die)
    with pytest.raises(OSError):
        dying.sync()
    with Store.open(spark, c) as s:
        assert contents(s) == [(b"a", b"1")]
        s.put("c", "3")
    with Store.open(spark, c) as s:
        assert contents(s) == [(b"a", b"1"), (b"c", b"3")]
        s.collect_garbage(keep=1, grace=0)
        assert contents(s) == [(b"a", b"1"), (b"c", b"3")] and not [n for n in s.files.names("manifest") if n.endswith(".part")]


def test_names_are_given_once(spark, tmp_path):
    from tidelog.sources.files import Files

    f = Files(spark, str(tmp_path))
    f.publish_json("x.json", {"a": 1})
    with pytest.raises(ConflictError):
        f.publish_json("x.json", {"a": 2})
    assert f.read_json("x.json") == {"a": 1} and f.names() == ["x.json"]
    # what other file systems use
    f.write_part("y.part", b"{}")
    f.rename_new(f._path(f.full("y.part")), f._path(f.full("y.json")))
    f.write_part("y.part", b"[]")
    with pytest.raises(Exception):  # noqa: B017  Hadoop's own
        f.rename_new(f._path(f.full("y.part")), f._path(f.full("y.json")))
    assert f.read_json("y.json") == {}


def test_frames_are_checked_before_they_count(spark, store):
    bad = spark.sql("select 'k' as key, -5L as seq, false as is_tombstone, 'v' as value")
    with pytest.raises(ValueError):
        store.write_frame(bad)
    assert store.files.names("log") == [] and store.manifest.version == 0
    store.write_batch([("a", "1")])
    store.sync()
    past = Store.open(spark, store.config, version=1)
    with pytest.raises(ConflictError):
        past.write_frame(bad.withColumn("seq", bad.seq + 5))
    assert len(store.files.names("log")) == 1
    assert store.write_frame(bad.where("false")) == 0


def test_refresh_puts_buffered_writes_behind(spark, tmp_path):
    c = Config(str(tmp_path / "db"))
    a, b = Store.open(spark, c), Store.open(spark, c)
    a.write_batch([("k", "a"), ("x", "a")])
    b.put("k", "b")
    a.sync()
    with pytest.raises(ConflictError):
        b.sync()
    b.refresh()
    b.sync()
    assert contents(Store.open(spark, c)) == [(b"k", b"b"), (b"x", b"a")]


def test_threads(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from tidelog.background import BackgroundWorker

    with Store.open(spark, Config(str(tmp_path / "db"))) as s, BackgroundWorker(s) as worker, ThreadPoolExecutor(4) as pool:
        writes = [pool.submit(s.put, f"key-{t}-{i}", f"val-{i}") for i in range(50) for t in "ab"]
        asked = [worker.flush() for _ in range(3)]
        reads = [pool.submit(s.get, "key-a-1") for _ in range(3)]
        for f in (*writes, *asked, *reads):
            f.result()
        assert len(contents(s)) == 100 and s.get("key-b-49") == b"val-49" and s.verify() == []


def test_bounds_of_time(spark, tmp_path):
    import time

    with Store.open(spark, Config(str(tmp_path / "db"), l0_compaction_trigger=100)) as s:
        s.write_batch([(f"key{i}", f"value{i}") for i in range(1000)])
        s.flush()
        began = time.perf_counter()
        assert all(s.get("key500") == b"value500" for _ in range(1000))
        assert time.perf_counter() - began < 5
        for n in range(10):
            s.write_batch([(f"k{n}-{i}", "v") for i in range(50)])
            s.flush()
        began = time.perf_counter()
        assert s.multi_get(spark.range(50).selectExpr("concat('k3-', id) as key")).count() == 50
        assert time.perf_counter() - began < 10
        began = time.perf_counter()
        for i in range(250):
            s.delete(f"key{i}")
        assert time.perf_counter() - began < 2 and s.scan("key", "kez").count() == 750


def test_lookups_meet_checksums(spark, tmp_path):
    from dataclasses import replace

    with Store.open(spark, Config(str(tmp_path / "db"))) as s:
        s.write_batch([("a", "1"), ("b", "2")])
        s.flush()
        run = s.manifest.runs[0]
        held = spark.read.parquet(run.path)
        held.selectExpr("key", "seq", "is_tombstone", "if(key = encode('a', 'utf-8'), encode('9', 'utf-8'), value) as value", "crc").coalesce(1).write.parquet(str(tmp_path / "bad" / "runs" / "L0-x"))
        s.manifest = replace(s.manifest, runs=(replace(run, path=spark.read.parquet(str(tmp_path / "bad" / "runs" / "L0-x")).inputFiles()[0]),))
        assert s.get("b") == b"2"
        with pytest.raises(CorruptionError):
            s.get("a")


def test_compaction_closes_runs_in_time(spark, tmp_path):
    rng = random.Random(3)
    c = Config(str(tmp_path / "db"), max_run_size=500, memtable_size_limit=1 << 30, level_base_size=1 << 30)
    with Store.open(spark, c) as s:
        pairs = {f"k{rng.randrange(400):04d}": "x" * rng.choice((1, 20, 90, 700)) for _ in range(300)}
        s.write_batch(pairs.items())
        s.flush()
        s.compact_level(0)
        held = s.ops().selectExpr("input_file_name() as f", "length(key) + length(value) as n").groupBy("f").agg({"n": "sum", "*": "count"}).collect()
        assert all(r["sum(n)"] <= 500 or r["count(1)"] == 1 for r in held) and len(held) > 3
        assert contents(s) == sorted((k.encode(), v.encode()) for k, v in pairs.items()) and s.verify() == []


def test_recovery_without_manifests(spark, tmp_path):
    c = Config(str(tmp_path / "db"))
    with Store.open(spark, c) as s:
        s.write_batch([("a", "1"), ("b", "1")])
        s.flush()
        s.write_batch([("a", "2")])
        s.flush()
        with pytest.raises(ConflictError):
            Store.recover(spark, c)
        s.files.delete("manifest")
    with Store.recover(spark, c) as s:
        assert contents(s) == [(b"a", b"2"), (b"b", b"1")]
        s.put("a", "3")
        assert s.get("a") == b"3"


def test_caches():
    from tidelog.plans.cache import LruCache

    gone = []
    cache = LruCache(10, gone.append)
    assert not cache.put("large", "x", 11) and len(cache) == 0
    cache.put("a", 1, 4)
    cache.put("b", 2, 4)
    assert cache.get("a") == 1
    cache.put("c", 3, 4)  # b was used longest ago
    assert cache.get("b") is None and cache.get("a") == 1 and gone == [2]
    cache.put("a", 5, 9)
    assert len(cache) == 1 and cache.used == 9
    assert cache.stats()["hits"] == 2 and cache.stats()["misses"] == 1
    cache.clear()
    assert cache.used == 0 and not cache.invalidate("a")


def test_unknown_verb_and_wrong_calls(spark, tmp_path, capsys):
    from tidelog.cli import main

    for args in (["nonsense"], ["put", "a"], []):
        with pytest.raises(SystemExit) as e:
            main(["--dir", str(tmp_path / "db"), *args], spark)
        assert e.value.code == 1
    capsys.readouterr()


def test_lines_of_several_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.txt").write_text("k:b1\nk:b2\nx:1\n")
    (tmp_path / "in" / "a.txt").write_text("k:a\ny:1\n")
    with Store.open(spark, Config(str(tmp_path / "db"))) as s:
        assert s.import_text(str(tmp_path / "in")) == 5
        assert contents(s) == [(b"k", b"b2"), (b"x", b"1"), (b"y", b"1")]
        s.export_text(str(tmp_path / "out"))
        assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["k => b2", "x => 1", "y => 1"]


def test_commits_write_what_changed(spark, tmp_path, monkeypatch):
    from tidelog.sources import manifest

    monkeypatch.setattr(manifest, "FULL_EVERY", 4)
    c = Config(str(tmp_path / "db"), l0_compaction_trigger=100)
    with Store.open(spark, c) as s:
        for i in range(11):
            s.write_batch([(f"k{i}", str(i))])
            s.sync()
            if i % 3 == 2:
                s.flush()
        seen = {v: Store.open(spark, c, version=v).manifest for v in s.manifests.versions()}
        assert seen[s.manifest.version] == s.manifest and len(seen) == 14
        assert all(len(seen[v].log) == v - v // 4 - 3 * (v // 4) for v in seen)
        full = [v for v in seen if s.manifests.files.read_json(manifest.name(v))["full"]]
        assert full == [1, 5, 9, 13]
        s.collect_garbage(keep=3, grace=0)
        assert s.manifests.versions() == [12, 13, 14] and all(s.manifests.load(v) == seen[v] for v in (12, 13, 14))
        assert len(contents(s)) == 11
        s.collect_garbage(keep=1, grace=0)
        s.put("x", "1")
    assert len(contents(Store.open(spark, c))) == 12


def test_small_runs_share_a_task(spark, tmp_path):
    from pyspark.sql import functions as F

    with Store.open(spark, Config(str(tmp_path / "db"), max_run_size=400, memtable_size_limit=1 << 40, l0_compaction_trigger=1000)) as s:
        s.write_frame(spark.range(3000).select(F.lpad(F.col("id").cast("string"), 8, "0").alias("key"), F.col("id").alias("seq"), F.lit(False).alias("is_tombstone"), F.lit("x").alias("value")))
        s.flush()
        s.compact_level(0)
        # a range of keys writes many runs, full ones but for its last
        runs = s.manifest.level(1)
        assert {r.path.rsplit("/part-", 1)[1][:5] for r in runs} <= {"00000", "00001", "00002", "00003"} and len(runs) <= -(-3000 // 44) + 4
        assert max(r.bytes for r in runs) < 8000 and s.verify() == [] and s.scan().count() == 3000
