"""Registered queries that go through the durable store, each with the SQL that must give the same rows.

Each builds a store in a folder of its own under spark.checkpoint.dir and reads it back. The
operations are those of view O, with the sequence number as the value; the SQL states
what must be visible from the tables alone.
"""
from __future__ import annotations

import contextlib
import io
import json
from urllib.error import HTTPError
from urllib.request import urlopen

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog import model
from tidelog.background import BackgroundWorker
from tidelog.model import Config
from tidelog.operators.transactions import Transaction
from tidelog.plans import explain, stats
from tidelog.plans.cache import LruCache, ScanCache
from tidelog.plans.stats import Timer, Timings
from tidelog.queries import LATEST, LIVE_O, META_L, O, lines, view_l, view_o
from tidelog.sources.files import scratch
from tidelog.sources.runs import RUN_FILE_SCHEMA, described
from tidelog.store import Store

#: Few operations, for queries that call the store once for each; events of the first users.
FEW = 200
OPS = f"SELECT key, seq, is_tombstone, CAST(seq AS varchar) AS value FROM ({O}) AS o"
NEWEST = LATEST.format(ops=OPS)
LIVE = f"SELECT key, value FROM ({NEWEST}) AS newest WHERE NOT is_tombstone"
FEW_OPS = f"SELECT * FROM ({OPS}) AS o WHERE seq IN (SELECT event_id FROM events ORDER BY event_id LIMIT {FEW})"
FEW_NEWEST = LATEST.format(ops=FEW_OPS)
FEW_LIVE = f"SELECT key, value FROM ({FEW_NEWEST}) AS newest WHERE NOT is_tombstone"


def ops(spark, sf) -> DataFrame:
    return view_o(spark, sf).withColumn("value", F.col("seq").cast("string"))


def few(spark, sf) -> list:
    """The first operations, in order: FEW rows."""
    return ops(spark, sf).orderBy("seq").limit(FEW).collect()


def opened(spark, **config) -> Store:
    return Store.open(spark, Config(scratch(spark, "kv"), **{"memtable_size_limit": 1 << 40, "l0_compaction_trigger": 1000, **config}))


def apply(store: Store, rows: list) -> None:
    for r in rows:
        store.delete(r.key) if r.is_tombstone else store.put(r.key, r.value)


def text(kv: DataFrame) -> DataFrame:
    return kv.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def quarters(spark, sf, store: Store, then=lambda s: s.flush()) -> Store:
    """The log in four parts by its sequence numbers, ``then`` after each."""
    o = ops(spark, sf)
    n = o.agg(F.max("seq")).first()[0] + 1
    for k in range(4):
        store.write_frame(o.where(F.expr(f"seq * 4 div {n} = {k}")))
        then(store)
    return store


def rows(spark, ddl: str, found: list) -> DataFrame:
    return spark.createDataFrame(found, ddl)


# -- runs, log, recovery ------------------------------------------------------------


def flushed(spark, sf) -> DataFrame:
    return text(quarters(spark, sf, opened(spark)).scan())


def compacted(spark, sf) -> DataFrame:
    store = quarters(spark, sf, opened(spark, l0_compaction_trigger=2, max_run_size=2048))
    store.compact()
    return text(store.scan())


def reopened(spark, sf) -> DataFrame:
    """Half in runs, half in the log only, read by a second handle."""
    store = opened(spark)
    quarters(spark, sf, store, lambda s: s.flush() if s.manifest.version < 3 else None)
    store.close()
    return text(Store.open(spark, store.config).scan())


def auto_flushed(spark, sf) -> DataFrame:
    """The flush that a write sets off: nothing is left in the log, and a run is there."""
    store = opened(spark, memtable_size_limit=1024)
    store.write_frame(ops(spark, sf))
    s = store.stats()
    return rows(spark, "log_files int, flushes int, has_runs boolean, live long", [(s["log_files"], s["flushes"], s["total_runs"] > 0, store.scan().count())])


def reopened_log_counts(spark, sf) -> DataFrame:
    """A log left by one handle counts towards the next one's flush."""
    store = opened(spark)
    apply(store, few(spark, sf))
    store.close()
    with Store.open(spark, store.config.but(memtable_size_limit=store.manifest.log_bytes + 1)) as again:
        before = again.stats()["flushes"]
        again.put("zz", "1")
        return rows(spark, "before int, after int", [(before, again.stats()["flushes"])])


def run_entries(spark, sf) -> DataFrame:
    """What the manifest says of the run of each quarter."""
    store = quarters(spark, sf, opened(spark))
    found: dict[int, list] = {}
    for r in store.manifest.runs:
        found.setdefault(r.sequence, []).append(r)
    return rows(spark, "quarter int, min_key string, max_key string, entries long", [(k, min(r.min_key for r in rs).decode(), max(r.max_key for r in rs).decode(), sum(r.entries for r in rs)) for k, (_, rs) in enumerate(sorted(found.items()))])


def run_sizes(spark, sf) -> DataFrame:
    """Compaction closes runs before they exceed their size, and they don't overlap."""
    store = quarters(spark, sf, opened(spark, max_run_size=400))
    store.compact_level(0)
    store.compact_level(1)
    runs = sorted(store.manifest.level(2), key=lambda r: r.min_key)
    largest = store.ops().groupBy(F.input_file_name()).agg(F.sum(F.length("key") + F.coalesce(F.length("value"), F.lit(0))).alias("b")).agg(F.max("b")).first()[0]
    return rows(spark, "several boolean, within boolean, apart boolean, faults int", [(len(runs) > 1, largest <= 400, all(a.max_key < b.min_key for a, b in zip(runs, runs[1:], strict=False)), len(store.verify()))])


def tombstones_gone(spark, sf) -> DataFrame:
    """Entries and deletes left after a merge at the bottom."""
    store = quarters(spark, sf, opened(spark))
    kept = store.ops().where("is_tombstone").select("key").distinct().count()
    store.compact_level(0)
    return store.ops().agg(F.count("*").alias("entries"), F.count_if("is_tombstone").alias("deletes")).withColumn("some_before", F.lit(kept > 0))


def tombstones_kept(spark, sf) -> DataFrame:
    """Deletes stay in a merge above a level that may still hold their keys."""
    store = opened(spark)
    o = ops(spark, sf)
    store.write_frame(o.where("not is_tombstone"))
    store.flush()
    store.compact_level(0)
    store.compact_level(1)
    store.write_frame(o)
    store.flush()
    store.compact_level(0)
    return store.ops().where("is_tombstone").select(F.col("key").cast("string").alias("key"))


def recovered(spark, sf) -> DataFrame:
    """The runs of a folder without its manifests."""
    store = quarters(spark, sf, opened(spark))
    store.files.delete("manifest")
    return text(Store.recover(spark, store.config).scan())


def crashed(spark, sf) -> DataFrame:
    """Writers that die at each step of a commit leave a store that reads as before and takes the next write."""
    store = opened(spark)
    apply(store, few(spark, sf))
    store.sync()
    found = []
    for step in ("write_part", "claim"):
        dying = Store.open(spark, store.config)

        def die(*_):
            raise OSError("gone")

        if step == "write_part":
            dying.manifests.files.write_part = die
        else:
            dying.manifests.files.claim = die
        dying.put("lost", "1")
        with contextlib.suppress(OSError):
            dying.sync()
        with Store.open(spark, store.config) as after:
            after.put(f"after {step}", "1")
        found.append((step, Store.open(spark, store.config).scan().count()))
    return rows(spark, "step string, live long", found)


def garbage(spark, sf) -> DataFrame:
    """Files go when no kept version names them; young ones stay."""
    store = quarters(spark, sf, opened(spark))
    store.compact_level(0)
    young = len(store.collect_garbage(keep=1))
    old = len(store.collect_garbage(keep=1, grace=0))
    return store.scan().agg(F.count("*").alias("live")).select("live", F.lit(young).alias("young_gone"), F.lit(old >= 8).alias("old_gone"), F.lit(len(store.files.names("log"))).alias("log_left"))


def snapshot(spark, sf) -> DataFrame:
    """The version after the second quarter, read after the fourth."""
    versions = []
    store = quarters(spark, sf, opened(spark), lambda s: versions.append(s.manifest.version))
    return text(Store.open(spark, store.config, version=versions[1]).scan())


def as_of(spark, sf) -> DataFrame:
    """The state as of an operation in the middle of a log that is not flushed yet."""
    store = opened(spark)
    store.write_frame(ops(spark, sf))
    return text(store.snapshot_at(store.manifest.next_seq - 1 - 300))


def levels(spark, sf) -> DataFrame:
    """Statistics by level from the manifest: two quarters at level 1, two at level 0."""
    store = opened(spark)
    quarters(spark, sf, store, lambda s: (s.flush(), s.compact_level(0) if s.counters["flushes"] == 2 else None))
    return stats.level_stats(store.runs_frame()).select("level", "entries", (F.col("runs") > 0).alias("has_runs"))


def prefixed(spark, sf) -> DataFrame:
    return text(quarters(spark, sf, opened(spark)).prefix_scan("0000001"))


def hourly(spark, sf) -> DataFrame:
    """The newest operation of each key and hour, of hours that the stream's watermark has closed."""
    from tidelog.streaming.ingest import latest_per_key, replayed

    e = spark.read.parquet(f"{sf}/events.parquet")
    changes = e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("is_tombstone"), F.col("event_id").cast("string").alias("value"), F.col("ts").cast("timestamp").alias("ts"))
    newest = replayed(changes, "ts", lambda stream: latest_per_key(stream, "ts"), "key string, hour timestamp, seq long, is_tombstone boolean, value string")
    return newest.select("key", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "seq", "is_tombstone")


def streamed(spark, sf) -> DataFrame:
    """Two streams into one store, each started twice: every batch is applied once."""
    from tidelog.streaming.ingest import append_stream

    store, o = opened(spark), ops(spark, sf)
    for k in range(2):
        at = scratch(spark, "stream")
        o.where(F.expr(f"cast(key as bigint) % 2 = {k}")).write.parquet(at)
        for again in range(2):
            # a lost checkpoint starts the batches anew
            append_stream(spark.readStream.schema(o.schema).parquet(at), store, f"{at}-check-{again}", name=f"half {k}").awaitTermination()
    return text(store.scan()).withColumn("writes", F.lit(store.stats()["writes"]).cast("long"))


def imported(spark, sf) -> DataFrame:
    at = scratch(spark, "lines")
    lines(spark, sf).orderBy("seq").select("line").write.text(at)
    store = opened(spark)
    n = store.import_text(at)
    return text(store.scan()).withColumn("imported", F.lit(n).cast("long"))


def exported(spark, sf) -> DataFrame:
    store, at = opened(spark), scratch(spark, "export")
    store.write_frame(ops(spark, sf))
    store.export_text(at)
    return spark.read.text(at).select(F.col("value").alias("line"))


def damaged(spark, sf) -> DataFrame:
    """Faults that verify finds after some values were changed behind their checksums, and what a lookup of one says."""
    from dataclasses import replace

    store = opened(spark)
    store.write_frame(ops(spark, sf))
    store.flush()
    held = spark.read.schema(RUN_FILE_SCHEMA).parquet(*(r.path for r in store.manifest.runs)).withColumn("run", F.md5(F.input_file_name()))
    at = scratch(spark, "damaged") + "/runs/L0-damaged"
    bad = F.col("key").cast("string").cast("long") % 10 == 3
    changed = held.withColumn("value", F.when(bad, F.coalesce(F.concat("value", F.lit(b"!")), F.lit(b"!"))).otherwise(F.col("value")))
    # every run, a file for each
    changed.repartition(len(store.manifest.runs), "run").sortWithinPartitions("run", "key").write.partitionBy("run").parquet(at)
    path = {r.min_key: r.path for r in described(spark, [at], {at: 0}, None)}
    store.manifest = replace(store.manifest, runs=tuple(replace(r, path=path[r.min_key]) for r in store.manifest.runs))
    found = [int(x.split(": ")[1].split()[0]) for x in store.verify() if "checksum" in x]
    try:
        said = str(store.get("00000003"))
    except model.CorruptionError:
        said = "CorruptionError"
    return rows(spark, "bad long, lookup string, sound string", [(sum(found), said, (store.get("00000001") or b"").decode())])


# -- the handle: buffer, transactions, reads, cursor ------------------------------------


def buffered(spark, sf) -> DataFrame:
    store = opened(spark)
    apply(store, few(spark, sf))
    return rows(spark, "entries long, bytes long", [(store.buffered_entries, store.buffered_bytes)])


def drained(spark, sf) -> DataFrame:
    """The buffer's newest entries in key order, with their place."""
    store = opened(spark)
    apply(store, few(spark, sf))
    return rows(spark, "place int, key string, value string", [(i, k.decode(), v and v.decode()) for i, (k, v) in enumerate(store.buffer_items())])


def drained_into_run(spark, sf) -> DataFrame:
    store = opened(spark)
    apply(store, few(spark, sf))
    store.flush()
    left = store.buffered_entries + store.buffered_bytes
    return store.ops().select(F.col("key").cast("string").alias("key"), "is_tombstone").withColumn("left", F.lit(left))


def batched(spark, sf) -> DataFrame:
    """write_batch: puts only, the last of a key wins; one commit for each batch."""
    store, found = opened(spark, sync_writes=True), few(spark, sf)
    for k in range(0, FEW, 50):
        store.write_batch([(r.key, r.value) for r in found[k : k + 50]])
    return text(store.scan()).withColumn("versions", F.lit(store.manifest.version))


def transacted(spark, sf) -> DataFrame:
    """Transactions of 20 operations, every third rolled back; nothing shows before its commit."""
    store, found, early = opened(spark), few(spark, sf), 0
    for t in range(FEW // 20):
        store.begin()
        store.begin()
        part = found[t * 20 : t * 20 + 20]
        before = store.buffered_entries
        for r in part:
            store.tx_delete(r.key) if r.is_tombstone else store.tx_put(r.key, r.value)
        early += store.buffered_entries - before
        store.rollback() if t % 3 == 0 else store.commit()
    return text(store.scan()).withColumns({"early": F.lit(early), "still_open": F.lit(store.has_transaction)})


def interleaved(spark, sf) -> DataFrame:
    """Plain puts apply at once, so a transaction committed later wins over them."""
    store, found = opened(spark), few(spark, sf)
    store.begin()
    for r in found:
        store.tx_put(r.key, f"transaction {r.value}")
    for r in found:
        store.put(r.key, f"plain {r.value}")
    during = text(store.scan()).collect()
    store.commit()
    now = {r.key: r.value for r in text(store.scan()).collect()}
    return rows(spark, "key string, during string, now string", [(r.key, r.value, now[r.key]) for r in during])


def transaction_state(spark, sf) -> DataFrame:
    t, found = Transaction(), []
    found.append(("new", len(t), t.is_empty, t.is_committed))
    for r in few(spark, sf):
        t.delete(r.key) if r.is_tombstone else t.put(r.key, r.value)
    found.append(("filled", len(t), t.is_empty, t.is_committed))
    t.finish()
    found.append(("finished", len(t), t.is_empty, t.is_committed))
    return rows(spark, "state string, operations int, is_empty boolean, is_committed boolean", found)


def got(spark, sf) -> DataFrame:
    """Point lookups over two runs and the log, each key twice: the second time from what was kept."""
    store = opened(spark)
    quarters(spark, sf, store, lambda s: s.flush() if s.manifest.version < 5 else None)
    wanted = [f"{k:08d}" for k in range(12)]
    found = [(k, (store.get(k) or b"").decode() or None) for k in wanted]
    again = [(k, (store.get(k) or b"").decode() or None) for k in wanted]
    s = store.cache_stats()["values"]
    return rows(spark, "key string, value string", found).withColumns({"same": F.lit(found == again), "hits": F.lit(s["hits"]), "misses": F.lit(s["misses"]), "reads": F.lit(store.stats()["reads"])})


def multi_got(spark, sf) -> DataFrame:
    store = quarters(spark, sf, opened(spark))
    return text(store.multi_get(ops(spark, sf).where("cast(key as bigint) % 7 = 0").select("key").distinct()))


def travelled(spark, sf) -> DataFrame:
    """A cursor's moves: what stands at it after each."""
    store = opened(spark)
    apply(store, few(spark, sf))
    c, found = store.iterator(), []

    def note(move: str, do) -> None:
        do()
        found.append((move, c.valid, c.key and c.key.decode(), c.value and c.value.decode()))

    note("first", c.seek_to_first)
    note("next", c.next)
    note("prev", c.prev)
    note("prev at first", c.prev)
    note("seek", lambda: c.seek("000000005"))
    note("seek for prev", lambda: c.seek_for_prev("000000005"))
    note("last", c.seek_to_last)
    note("beyond", c.next)
    return rows(spark, "move string, valid boolean, key string, value string", found)


def pulled(spark, sf) -> DataFrame:
    """Pairs pulled alternately from both ends, until they meet."""
    store = opened(spark)
    apply(store, [r for r in few(spark, sf) if int(r.key) < 8])
    c, found = store.iterator(), []
    while (pair := c.pull() if len(found) % 2 == 0 else c.next_back()) is not None:
        found.append((len(found), pair[0].decode()))
    forward = [k.decode() for k, _ in store.iterator()]
    backward = [k.decode() for k, _ in store.iterator(reverse=True)]
    return rows(spark, "step int, key string", found).withColumn("mirrored", F.lit(forward == backward[::-1] and len(forward) == len(found)))


# -- reports, caches, errors -------------------------------------------------------------


def counted(spark, sf) -> DataFrame:
    """Counters after four flushes and a compaction, kept across handles."""
    store = quarters(spark, sf, opened(spark))
    store.compact_level(0)
    store.put("x", "1")
    store.delete("x")
    store.close()
    s = Store.open(spark, store.config).stats()
    return rows(spark, "writes long, flushes int, compactions int, levels int, log_files int", [(s["writes"], s["flushes"], s["compactions"], s["active_levels"], s["log_files"])])


def planned(spark, sf) -> DataFrame:
    """Explained scans of a store: a range that holds keys, one that doesn't, and a point."""
    store = quarters(spark, sf, opened(spark))
    found = []
    for start, end in ((None, None), ("a", "b"), ("00000004", "00000004\0")):
        p = store.analyze_scan(start, end)
        found.append((str(start), ",".join(map(str, p.levels)), p.estimated_keys if start is None else -1, p.runs > 0, p.uses_buffer, p.uses_bloom, p.cost))
    return rows(spark, "start string, levels string, keys long, reads_runs boolean, buffer boolean, bloom boolean, cost string", found)


def plan_costs(spark, sf) -> DataFrame:
    """Plans over the first n levels of view L, repeated over seven levels: Low, Medium and High."""
    held = view_l(spark, sf).groupBy("level", "run").count().collect()
    found = []
    for n in range(8):
        b = explain.ScanPlanBuilder(b"a", b"b")
        for level in range(n):
            for r in held:
                b.reads(level, 1, r["count"])
        p = b.build()
        shown = f"cost: {p.cost}" in str(p) and f"runs: {p.runs}" in str(p)
        found.append((n, p.runs, p.estimated_keys, p.cost, shown))
    return rows(spark, "n int, runs int, keys long, cost string, shown boolean", found)


def timed(spark, sf) -> DataFrame:
    """Recorded durations, averaged by kind; a timer that counts up and can be reset."""
    t, timer = Timings(), Timer()
    for r in few(spark, sf):
        t.record("put" if r.is_tombstone else "get", int(r.seq) * 7)
    a, b = timer.elapsed_us, timer.elapsed_us
    timer.reset()
    fine = 0 <= timer.elapsed_us <= b + 1_000_000 and a <= b and timer.elapsed_ms <= timer.elapsed_us
    return rows(spark, "puts int, avg_put_us long, gets int, avg_get_us long, avg_flush_ms long, timer boolean", [(t.count["put"], t.avg_put_us, t.count["get"], t.avg_get_us, t.avg_flush_ms, fine)])


def served(spark, sf) -> DataFrame:
    """The metrics over HTTP."""
    with opened(spark, monitoring_enabled=True, monitoring_port=0) as store:
        apply(store, few(spark, sf))
        found = []
        for path in ("/", "/stats", "/cache", "/health", "/nothing"):
            try:
                with urlopen(f"http://127.0.0.1:{store.monitor.port}{path}") as r:
                    status, said = r.status, json.loads(r.read())
            except HTTPError as e:
                status, said = e.code, json.loads(e.read())
            found.append((path, status, said.get("writes"), said.get("status")))
    return rows(spark, "path string, status int, writes long, health string", found)


def least_recently_used(spark, sf) -> DataFrame:
    """Hits of lookups by user, in order of events: a cache for everything, one for a single entry, one for none."""
    found = []
    users = [r.user_id for r in spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id").limit(5000).select("user_id").collect()]
    for name, capacity, size in (("all", 1 << 30, 3), ("one", 3, 3), ("none", 2, 3)):
        dropped: list = []
        cache = LruCache(capacity, dropped.append)
        for u in users:
            if cache.get(u) is None:
                cache.put(u, u + 1, size)
        found.append((name, cache.hits, cache.misses, len(cache), len(dropped)))
        cache.clear()
    return rows(spark, "cache string, hits long, misses long, entries long, dropped long", found)


def scans_kept(spark, sf) -> DataFrame:
    """A kept scan serves until a key of its range is written or a file of it replaced."""
    store = opened(spark)
    store.write_frame(ops(spark, sf))
    found = []

    def ask(step: str, lo: str, hi: str) -> None:
        before = store.cache_stats()["scans"]["hits"]
        n = store.scan_cached(lo, hi).count()
        found.append((step, n, store.cache_stats()["scans"]["hits"] > before))

    ask("new", "00000000", "00000050")
    ask("kept", "00000000", "00000050")
    store.put("00000099", "elsewhere")
    ask("written elsewhere", "00000000", "00000050")
    store.put("000000100", "inside")
    ask("written inside", "00000000", "00000050")
    store.flush()
    ask("flushed", "00000000", "00000050")
    cache = ScanCache(2)
    for k in (b"a", b"b", b"c"):
        cache.put(k, None, spark.range(1), {f"run {k}"})
    found.append(("bounded", len(cache), cache.get(b"a", None) is not None))
    found.append(("by file", cache.invalidate_files({"run b'c'"}), cache.get(b"b", None) is not None))
    return rows(spark, "step string, n long, hit boolean", found)


def backgrounded(spark, sf) -> DataFrame:
    """Flushes and a compaction in threads beside the writer."""
    store = opened(spark)
    with BackgroundWorker(store) as worker:
        quarters(spark, sf, store, lambda s: worker.flush())
        worker.compact()
    return text(store.scan()).withColumns({"tasks": F.lit(worker.done), "compactions": F.lit(store.stats()["compactions"])})


def failed(spark, sf) -> DataFrame:
    """What each misuse raises."""
    store = opened(spark)
    store.put("a", "1")
    store.sync()
    past = Store.open(spark, store.config, version=1)
    other = Store.open(spark, store.config)
    store.put("b", "1")
    store.sync()
    finished = Transaction()
    finished.finish()
    other.put("c", "1")

    @model.guarded
    def broken():
        raise RuntimeError("unforeseen")

    cases = {
        "commit without begin": store.commit, "rollback without begin": store.rollback, "put without begin": lambda: store.tx_put("a", "1"), "committed twice": finished.finish,
        "write to the past": lambda: past.put("a", "1"), "frame to the past": lambda: past.write_frame(ops(spark, sf)), "second writer": other.sync, "no such version": lambda: Store.open(spark, store.config, version=999),
        "bottom level": lambda: store.compact_level(6), "no key": lambda: store.require("zz"), "not buffered": lambda: store.buffer_get("zz"), "bad config": lambda: Config("x", max_run_size=0), "caught": broken,
    }
    found = []
    for name, f in cases.items():
        try:
            f()
            found.append((name, "nothing"))
        except model.StoreError as e:
            found.append((name, type(e).__name__))
    other.refresh()
    other.sync()
    found.append(("after a refresh", str(Store.open(spark, store.config).scan().count())))
    return rows(spark, "misuse string, raised string", found)


def command_line(spark, sf) -> DataFrame:
    """Each verb's exit code and the last line that it prints."""
    from tidelog.cli import main

    at, source = scratch(spark, "cli"), scratch(spark, "cli-lines")
    lines(spark, sf).orderBy("seq").select("line").coalesce(1).write.text(source)
    found = []
    for args in (["import", source], ["put", "a key", "a value"], ["get", "a key"], ["del", "a key"], ["get", "a key"], ["scan", "1", "10"], ["scan", "x", "y"], ["compact"], ["verify"], ["stats"], ["nonsense"]):
        out = io.StringIO()
        with contextlib.redirect_stdout(out), contextlib.redirect_stderr(io.StringIO()):
            try:
                code = main(["--dir", at, *args], spark)
            except SystemExit as e:
                code = int(e.code)
        if args[0] not in ("compact", "stats"):  # these print statistics
            found.append((" ".join(args[:1] if args[0] == "import" else args), code, out.getvalue().strip().split("\n")[-1]))
        elif code or "compactions: " not in out.getvalue():
            found.append((args[0], code, "no statistics"))
    return rows(spark, "call string, exit int, said string", found)


def benched(spark, sf) -> DataFrame:
    from tidelog.cli import bench

    store = opened(spark)
    took = bench(store, 1000)
    return store.scan().agg(F.count("*").alias("live"), F.min(F.col("key").cast("string")).alias("least")).withColumn("timed", F.lit(len(took)))


CLI_IMPORT = "SELECT CAST(user_id AS varchar) AS key, props AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_type <> 'view') AS v WHERE rn = 1"
QUARTER = f"SELECT *, seq * 4 // (SELECT max(event_id) + 1 FROM events) AS quarter FROM ({OPS}) AS o"
ALL = "SELECT count(*) FROM events"
FEW_AT = f"SELECT *, (row_number() OVER (ORDER BY seq) - 1) // 20 AS t FROM ({FEW_OPS}) AS o"
FEW_KEYS = f"SELECT key, value, row_number() OVER (ORDER BY key) AS place, count(*) OVER () AS n FROM ({FEW_LIVE}) AS kv"
USERS = "SELECT user_id AS u, lag(user_id) OVER (ORDER BY event_id) AS before FROM (SELECT * FROM events ORDER BY event_id LIMIT 5000) AS e"


def move_sql(move: str, where: str) -> str:
    return f"SELECT '{move}' AS move, count(*) > 0 AS valid, max(key) AS key, max(value) AS value FROM ({FEW_KEYS}) AS k WHERE {where}"


STORE_QUERIES = {
    "kv_store_flushed": (flushed, LIVE),
    "kv_store_compacted": (compacted, LIVE),
    "kv_store_reopened": (reopened, LIVE),
    "kv_store_auto_flush": (auto_flushed, f"SELECT 0 AS log_files, 1 AS flushes, true AS has_runs, count(*) AS live FROM ({LIVE}) AS kv"),
    "kv_store_reopened_log": (reopened_log_counts, "SELECT 0 AS before, 1 AS after"),
    "kv_store_run_entries": (run_entries, f"SELECT CAST(quarter AS integer) AS quarter, min(key) AS min_key, max(key) AS max_key, count(DISTINCT key) AS entries FROM ({QUARTER}) AS q GROUP BY quarter"),
    "kv_store_run_sizes": (run_sizes, "SELECT true AS several, true AS within, true AS apart, 0 AS faults"),
    "kv_store_tombstones_gone": (tombstones_gone, f"SELECT count(*) AS entries, CAST(0 AS bigint) AS deletes, true AS some_before FROM ({LIVE}) AS kv"),
    "kv_store_tombstones_kept": (tombstones_kept, f"SELECT key FROM ({NEWEST}) AS newest WHERE is_tombstone"),
    "kv_store_recovered": (recovered, LIVE),
    "kv_store_crashed": (crashed, f"SELECT step, (SELECT count(*) FROM ({FEW_LIVE}) AS kv) + n AS live FROM (VALUES ('write_part', 1), ('claim', 2)) AS v(step, n)"),
    "kv_store_garbage": (garbage, f"SELECT count(*) AS live, 0 AS young_gone, true AS old_gone, 0 AS log_left FROM ({LIVE}) AS kv"),
    "kv_store_snapshot": (snapshot, f"SELECT key, value FROM ({LATEST.format(ops=f'SELECT * FROM ({QUARTER}) AS q WHERE quarter < 2')}) AS newest WHERE NOT is_tombstone"),
    "kv_store_as_of": (as_of, f"SELECT key, value FROM ({LATEST.format(ops=f'SELECT * FROM ({OPS}) AS o WHERE seq <= (SELECT max(event_id) - 300 FROM events)')}) AS newest WHERE NOT is_tombstone"),
    "kv_store_levels": (
        levels,
        f"SELECT 1 AS level, count(DISTINCT key) FILTER (NOT is_tombstone) AS entries, true AS has_runs FROM ({LATEST.format(ops=f'SELECT * FROM ({QUARTER}) AS q WHERE quarter < 2')}) AS newest"
        f" UNION ALL SELECT 0, count(DISTINCT key || ' ' || quarter), true FROM ({QUARTER}) AS q WHERE quarter >= 2",
    ),
    "kv_store_prefixed": (prefixed, f"SELECT * FROM ({LIVE}) AS kv WHERE starts_with(key, '0000001')"),
    "kv_stream_hourly": (
        hourly,
        "SELECT key, hour, seq, is_tombstone FROM (SELECT CAST(user_id AS varchar) AS key, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, date_trunc('hour', ts) AS h, event_id AS seq, event_type = 'error' AS is_tombstone,"
        " row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY event_id DESC) AS rn FROM events) AS e WHERE rn = 1 AND h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
    ),
    "kv_store_streamed": (streamed, f"SELECT *, ({ALL}) AS writes FROM ({LIVE}) AS kv"),
    "kv_store_imported": (imported, f"SELECT *, (SELECT count(*) FROM events WHERE event_type <> 'view') AS imported FROM ({CLI_IMPORT}) AS kv"),
    "kv_store_exported": (exported, f"SELECT key || ' => ' || value AS line FROM ({LIVE}) AS kv"),
    "kv_store_damaged": (
        damaged,
        f"SELECT count(*) FILTER (CAST(key AS bigint) % 10 = 3) AS bad, 'CorruptionError' AS lookup, coalesce(max(value) FILTER (key = '00000001' AND NOT is_tombstone), '') AS sound FROM ({NEWEST}) AS newest",
    ),
    "kv_store_buffered": (buffered, f"SELECT count(*) AS entries, CAST(sum(length(key) + CASE WHEN is_tombstone THEN 1 ELSE length(value) END) AS bigint) AS bytes FROM ({FEW_NEWEST}) AS newest"),
    "kv_store_drained": (drained, f"SELECT CAST(row_number() OVER (ORDER BY key) - 1 AS integer) AS place, key, CASE WHEN NOT is_tombstone THEN value END AS value FROM ({FEW_NEWEST}) AS newest"),
    "kv_store_drained_into_run": (drained_into_run, f"SELECT key, is_tombstone, 0 AS left FROM ({FEW_NEWEST}) AS newest"),
    "kv_store_batched": (batched, f"SELECT key, value, {FEW // 50} AS versions FROM ({FEW_NEWEST}) AS newest"),
    "kv_store_transacted": (
        transacted,
        f"SELECT key, value, 0 AS early, false AS still_open FROM ({LATEST.format(ops=f'SELECT * FROM ({FEW_AT}) AS f WHERE t % 3 <> 0')}) AS newest WHERE NOT is_tombstone",
    ),
    "kv_store_interleaved": (interleaved, f"SELECT key, 'plain ' || value AS during, 'transaction ' || value AS now FROM ({FEW_NEWEST}) AS newest"),
    "kv_store_transaction_state": (transaction_state, f"SELECT * FROM (VALUES ('new', 0, true, false), ('filled', {FEW}, false, false), ('finished', {FEW}, false, true)) AS v(state, operations, is_empty, is_committed)"),
    "kv_store_got": (
        got,
        f"SELECT w.key, kv.value, true AS same, 12 AS hits, 12 AS misses, 24 AS reads FROM (SELECT lpad(CAST(range AS varchar), 8, '0') AS key FROM range(12)) AS w LEFT JOIN ({LIVE}) AS kv ON kv.key = w.key",
    ),
    "kv_store_multi_got": (multi_got, f"SELECT * FROM ({LIVE}) AS kv WHERE CAST(key AS bigint) % 7 = 0"),
    "kv_store_travelled": (
        travelled,
        " UNION ALL ".join(
            (
                move_sql("first", "place = 1"), move_sql("next", "place = 2"), move_sql("prev", "place = 1"), move_sql("prev at first", "place = 1"),
                move_sql("seek", f"key = (SELECT min(key) FROM ({FEW_LIVE}) AS x WHERE key >= '000000005')"), move_sql("seek for prev", f"key = (SELECT max(key) FROM ({FEW_LIVE}) AS x WHERE key <= '000000005')"),
                move_sql("last", "place = n"), move_sql("beyond", "place > n"),
            )
        ),
    ),
    "kv_store_pulled": (
        pulled,
        "SELECT CAST(CASE WHEN 2 * place <= n + 1 THEN 2 * (place - 1) ELSE 2 * (n - place) + 1 END AS integer) AS step, key, true AS mirrored FROM"
        f" (SELECT key, row_number() OVER (ORDER BY key) AS place, count(*) OVER () AS n FROM ({FEW_LIVE}) AS kv WHERE CAST(key AS bigint) < 8) AS k",
    ),
    "kv_store_counted": (counted, f"SELECT ({ALL}) + 2 AS writes, 4 AS flushes, 1 AS compactions, 1 AS levels, 1 AS log_files"),
    "kv_store_planned": (
        planned,
        f"SELECT 'None' AS start, '0' AS levels, (SELECT count(DISTINCT key || ' ' || quarter) FROM ({QUARTER}) AS q) AS keys, true AS reads_runs, false AS buffer, false AS bloom, 'Low' AS cost"
        " UNION ALL SELECT 'a', '', -1, false, false, false, 'Low' UNION ALL SELECT '00000004', '0', -1, true, false, true, 'Low'",
    ),
    "kv_store_plan_costs": (
        plan_costs,
        f"SELECT CAST(range AS integer) AS n, CAST(range * (SELECT count(*) FROM ({META_L}) AS m) AS integer) AS runs, CAST(range * (SELECT sum(entries) FROM ({META_L}) AS m) AS bigint) AS keys,"
        " CASE WHEN range <= 2 THEN 'Low' WHEN range <= 4 THEN 'Medium' ELSE 'High' END AS cost, true AS shown FROM range(8)",
    ),
    "kv_store_timed": (
        timed,
        "SELECT CAST(count(*) FILTER (is_tombstone) AS integer) AS puts, CAST(coalesce(sum(seq * 7) FILTER (is_tombstone) // greatest(count(*) FILTER (is_tombstone), 1), 0) AS bigint) AS avg_put_us,"
        " CAST(count(*) FILTER (NOT is_tombstone) AS integer) AS gets, CAST(sum(seq * 7) FILTER (NOT is_tombstone) // count(*) FILTER (NOT is_tombstone) AS bigint) AS avg_get_us, CAST(0 AS bigint) AS avg_flush_ms, true AS timer"
        f" FROM ({FEW_OPS}) AS o",
    ),
    "kv_store_served": (served, f"SELECT path, status, CAST(CASE WHEN path = '/stats' THEN {FEW} END AS bigint) AS writes, CASE WHEN path = '/health' THEN 'ok' END AS health FROM (VALUES ('/', 200), ('/stats', 200), ('/cache', 200), ('/health', 200), ('/nothing', 404)) AS v(path, status)"),
    "kv_store_lru": (
        least_recently_used,
        f"SELECT 'all' AS cache, count(*) - count(DISTINCT u) AS hits, count(DISTINCT u) AS misses, count(DISTINCT u) AS entries, CAST(0 AS bigint) AS dropped FROM ({USERS}) AS a"
        f" UNION ALL SELECT 'one', count(*) FILTER (u = before), count(*) - count(*) FILTER (u = before), 1, count(*) - count(*) FILTER (u = before) - 1 FROM ({USERS}) AS b"
        f" UNION ALL SELECT 'none', 0, count(*), 0, 0 FROM ({USERS}) AS c",
    ),
    "kv_store_scans_kept": (
        scans_kept,
        f"SELECT step, (SELECT count(*) FROM ({LIVE}) AS kv WHERE key >= '00000000' AND key < '00000050') + more AS n, hit FROM (VALUES ('new', 0, false), ('kept', 0, true), ('written elsewhere', 0, true), ('written inside', 1, false), ('flushed', 1, false)) AS v(step, more, hit)"
        " UNION ALL SELECT 'bounded', 2, false UNION ALL SELECT 'by file', 1, true",
    ),
    "kv_store_backgrounded": (backgrounded, f"SELECT *, 5 AS tasks, 1 AS compactions FROM ({LIVE}) AS kv"),
    "kv_store_failed": (
        failed,
        "SELECT * FROM (VALUES ('commit without begin', 'TransactionError'), ('rollback without begin', 'TransactionError'), ('put without begin', 'TransactionError'), ('committed twice', 'TransactionError'),"
        " ('write to the past', 'ConflictError'), ('frame to the past', 'ConflictError'), ('second writer', 'ConflictError'), ('no such version', 'CorruptionError'), ('bottom level', 'CompactionError'),"
        " ('no key', 'KeyNotFound'), ('not buffered', 'KeyNotFound'), ('bad config', 'InvalidConfig'), ('caught', 'CorruptionError'), ('after a refresh', '3')) AS v(misuse, raised)",
    ),
    "kv_store_command_line": (
        command_line,
        "SELECT 'import' AS call, 0 AS exit, 'imported ' || (SELECT count(*) FROM events WHERE event_type <> 'view') || ' entries' AS said"
        " UNION ALL SELECT 'put a key a value', 0, 'OK' UNION ALL SELECT 'get a key', 0, 'a value' UNION ALL SELECT 'del a key', 0, 'OK' UNION ALL SELECT 'get a key', 1, '(nil)'"
        f" UNION ALL SELECT 'scan 1 10', 0, max(key) || ' => ' || arg_max(value, key) FROM ({CLI_IMPORT}) AS kv WHERE key >= '1' AND key < '10'"
        " UNION ALL SELECT 'scan x y', 0, '(empty)' UNION ALL SELECT 'verify', 0, 'OK' UNION ALL SELECT 'nonsense', 1, ''",
    ),
    "kv_store_benched": (benched, "SELECT CAST(500 AS bigint) AS live, 'bench_key_0000000001' AS least, 5 AS timed"),
}
