"""Registered queries over the driver's tables, each with the SQL that must give the same rows.

Views: O is the base log (events), T adds transactions, P is put/delete/re-put over
orders, L deals O into levels and runs, ``lines`` is a text import.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import bloom
from tidelog.functions.checksum import entry_crc, mismatches
from tidelog.functions.text import parse_lines, render
from tidelog.operators import compaction, reads
from tidelog.operators.resolve import as_of, latest, live, merge_runs, superseded, visible
from tidelog.operators.transactions import committed, without_aborted
from tidelog.plans import explain, stats

LO, HI = "00000040", "00000060"
TARGETS = ["0", "00000010", "000000105", "00000149", "9"]


def view_o(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(
        F.lpad(F.col("user_id").cast("string"), 8, "0").alias("key"),
        F.col("event_id").alias("seq"),
        (F.col("event_type") == "error").alias("is_tombstone"),
        F.col("value"),
    )


def view_t(spark, sf) -> DataFrame:
    return view_o(spark, sf).withColumn("txn", F.expr("seq div 50"))


def view_p(spark, sf) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    key = F.concat(F.lit("o"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("key")
    put = o.select(key, F.col("o_orderkey").cast("long").alias("seq"), F.lit(False).alias("is_tombstone"), F.col("o_orderpriority").alias("value"))
    gone = o.where("o_orderstatus = 'F'").select(key, (F.col("o_orderkey") + 1_000_000_000).cast("long").alias("seq"), F.lit(True).alias("is_tombstone"), F.lit(None).cast("string").alias("value"))
    again = o.where("o_custkey % 10 = 0").select(key, (F.col("o_orderkey") + 2_000_000_000).cast("long").alias("seq"), F.lit(False).alias("is_tombstone"), F.lit("reopened").alias("value"))
    return put.unionByName(gone).unionByName(again)


def view_l(spark, sf) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    seqs, users = (e.agg((F.max(c) + 1)).scalar() for c in ("event_id", "user_id"))
    new = F.floor(F.col("seq") * 4 / seqs) == 3
    return view_o(spark, sf).withColumns(
        {
            "level": F.when(new, 0).otherwise(1),
            "run": F.when(new, 100 + F.col("seq") % 3).otherwise(F.floor(F.col("key").cast("long") * 4 / users)).cast("long"),
        }
    )


def manifest_l(spark, sf) -> DataFrame:
    return compaction.run_meta(view_l(spark, sf), "level", "run", bytes=F.sum(F.length("key") + 8).cast("long"))


def lines(spark, sf) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    user = F.col("user_id").cast("string")
    return e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", F.concat(user, F.lit(" "), F.col("value").cast("string"))).otherwise(F.concat(user, F.lit(":"), F.col("props"))).alias("line"))


O = "SELECT lpad(CAST(user_id AS varchar), 8, '0') AS key, event_id AS seq, (event_type = 'error') AS is_tombstone, value FROM events"
LATEST = "SELECT key, seq, is_tombstone, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM ({ops}) AS ops) AS ranked WHERE rn = 1"
LIVE_O = f"SELECT key, value FROM ({LATEST.format(ops=O)}) AS newest WHERE NOT is_tombstone"
T = f"SELECT *, seq // 50 AS txn FROM ({O}) AS o"
P = (
    "SELECT 'o' || lpad(CAST(o_orderkey AS varchar), 10, '0') AS key, CAST(o_orderkey AS bigint) AS seq, false AS is_tombstone, o_orderpriority AS value FROM orders"
    " UNION ALL SELECT 'o' || lpad(CAST(o_orderkey AS varchar), 10, '0'), CAST(o_orderkey + 1000000000 AS bigint), true, NULL FROM orders WHERE o_orderstatus = 'F'"
    " UNION ALL SELECT 'o' || lpad(CAST(o_orderkey AS varchar), 10, '0'), CAST(o_orderkey + 2000000000 AS bigint), false, 'reopened' FROM orders WHERE o_custkey % 10 = 0"
)
L = (
    "SELECT *, CASE WHEN seq * 4 // (SELECT max(event_id) + 1 FROM events) = 3 THEN 0 ELSE 1 END AS level,"
    " CAST(CASE WHEN seq * 4 // (SELECT max(event_id) + 1 FROM events) = 3 THEN 100 + seq % 3 ELSE CAST(key AS bigint) * 4 // (SELECT max(user_id) + 1 FROM events) END AS bigint) AS run"
    f" FROM ({O}) AS o"
)
META_L = f"SELECT level, run, min(key) AS min_key, max(key) AS max_key, count(*) AS entries, max(seq) AS sequence, CAST(sum(length(key) + 8) AS bigint) AS bytes FROM ({L}) AS l GROUP BY level, run"


def live_sql(ops: str, columns: str = "key, value") -> str:
    return f"SELECT {columns} FROM ({LATEST.format(ops=ops)}) AS newest WHERE NOT is_tombstone"


def probe(found: DataFrame, key: str) -> DataFrame:
    """One row whether or not the key is live."""
    return found.agg(F.count("*").alias("n"), F.max("value").alias("value")).select(F.lit(key).alias("key"), (F.col("n") > 0).alias("found"), "value")


def probe_sql(key: str) -> str:
    return f"SELECT '{key}' AS key, count(*) > 0 AS found, max(value) AS value FROM ({LIVE_O}) AS kv WHERE key = '{key}'"


def deleted_key(spark, sf) -> DataFrame:
    gone = latest(view_o(spark, sf)).where("is_tombstone").agg(F.min("key").alias("key"))
    return gone.join(visible(view_o(spark, sf)), "key", "left").select("key", F.col("value").isNotNull().alias("found"))


def even_odd(spark, sf) -> list[DataFrame]:
    o = view_o(spark, sf)
    half = o.agg(F.max("seq")).first()[0] // 2
    older, newer = o.where(F.col("seq") <= half), o.where(F.col("seq") > half)
    return [latest(older, payload=("seq", "is_tombstone", "value")), latest(newer, payload=("seq", "is_tombstone", "value"))]


def bloom_rates(keys: DataFrame, member) -> DataFrame:
    """Members and others against a filter of the members: none of those may be denied, few of these let through."""
    bits, hashes = bloom.sizing(max(1000, keys.count()), 0.01)
    words = bloom.build(keys.where(member), bits, hashes)
    hits = bloom.probe(keys, words, bits, hashes).withColumn("member", member)
    let = F.count_if(~F.col("member") & F.col("may_contain"))
    return hits.agg(
        F.count_if("member").alias("members"), F.count_if(F.col("member") & ~F.col("may_contain")).alias("false_negatives"), F.count_if(~F.col("member")).alias("others"), (let <= F.count_if(~F.col("member")) * 0.05).alias("few_let_through")
    )


def bloom_membership(spark, sf) -> DataFrame:
    return bloom_rates(view_o(spark, sf).select("key").distinct(), F.expr("cast(key as bigint) % 2 = 0"))


def bloom_orders(spark, sf) -> DataFrame:
    return bloom_rates(spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("key")), F.expr("cast(key as bigint) % 2 = 0"))


def bloom_packed(spark, sf) -> DataFrame:
    """Answers of a filter before and after it was packed, and the packed size."""
    keys = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("key"))
    members = keys.where("cast(key as bigint) % 3 = 0")
    bits, hashes = bloom.sizing(max(1000, members.count()), 0.01)
    words = bloom.build(members, bits, hashes)
    raw = bloom.pack(words, bits, hashes)
    before, after = bloom.probe(keys, words, bits, hashes), bloom.probe_words(keys, *bloom.unpack(raw))
    same = before.withColumnRenamed("may_contain", "was").join(after, "key")
    return same.agg(F.count("*").alias("keys"), F.count_if(F.col("was") != F.col("may_contain")).alias("changed"), (F.lit(len(raw)) - 16 - 8 * F.lit(-(-bits // 64))).cast("long").alias("surplus_bytes"))


def bloom_sizes(spark, sf) -> DataFrame:
    sizes = spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").agg(F.count("*").alias("capacity"))
    bits, hashes = bloom.sizing_expr(F.col("capacity"), F.lit(0.01))
    return sizes.select("event_type", "capacity", bits.alias("bits"), hashes.alias("hashes"))


def crc_verify(spark, sf) -> DataFrame:
    """Entries that fail their checksum after every tenth key's value has been changed behind it."""
    kv = visible(view_o(spark, sf)).withColumn("value", F.col("value").cast("string").cast("binary"))
    stored = kv.withColumn("crc", entry_crc())
    damaged = stored.withColumn("value", F.when(F.col("key").cast("long") % 10 == 3, F.concat("value", F.lit(b"!"))).otherwise(F.col("value")))
    return mismatches(damaged).select("key")


def batch_last_wins(spark, sf) -> DataFrame:
    """Batches of 100 operations; within and across them the last one wins."""
    o = view_o(spark, sf).withColumns({"batch": F.expr("seq div 100"), "at": F.expr("seq % 100")})
    return live(latest(o, order=F.struct("batch", "at")))


def txn_commit(spark, sf) -> DataFrame:
    t = view_t(spark, sf)
    return visible(committed(t, t.where("txn % 3 <> 0").select("txn").distinct()))


def txn_rollback(spark, sf) -> DataFrame:
    t = view_t(spark, sf)
    return visible(without_aborted(t, t.where("txn % 3 = 0").select("txn").distinct()))


def run_overlap(spark, sf) -> DataFrame:
    m = manifest_l(spark, sf)
    return compaction.overlapping(m.where("level = 0"), m.where("level = 1"))


def memtable_size(spark, sf) -> DataFrame:
    """Bytes of a buffer that holds the newest operation of each key: a delete counts its key and one."""
    size = F.length("key") + F.when(F.col("is_tombstone"), 1).otherwise(F.length("value"))
    return latest(view_p(spark, sf)).agg(F.count("*").alias("entries"), F.sum(size).cast("long").alias("bytes"))


def compaction_split(spark, sf) -> DataFrame:
    """Runs of at most 4 KiB, greedily filled in key order within ranges of view P: keys alike in their first eight letters."""
    entries = latest(view_p(spark, sf)).where("not is_tombstone").withColumn("part", F.expr("substring(key, 1, 8)"))
    split = compaction.split_greedy(entries, 4096, by="part")
    return split.groupBy("output_range", "output_run").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("entries"), F.sum(F.length("key") + F.length("value")).cast("long").alias("bytes"))


SPLIT_SQL = (
    f"WITH RECURSIVE entries AS MATERIALIZED (SELECT substring(key, 1, 8) AS part, key, length(key) + length(value) AS size, row_number() OVER (PARTITION BY substring(key, 1, 8) ORDER BY key) AS place FROM ({live_sql(P)}) AS kv),"
    " filled AS (SELECT part, key, size, place, size AS held, 0 AS run FROM entries WHERE place = 1"
    " UNION ALL SELECT e.part, e.key, e.size, e.place, CASE WHEN f.held + e.size > 4096 THEN e.size ELSE f.held + e.size END, CASE WHEN f.held + e.size > 4096 THEN f.run + 1 ELSE f.run END"
    " FROM filled AS f JOIN entries AS e ON e.part = f.part AND e.place = f.place + 1)"
    " SELECT part AS output_range, CAST(run AS integer) AS output_run, min(key) AS min_key, max(key) AS max_key, count(*) AS entries, CAST(sum(size) AS bigint) AS bytes FROM filled GROUP BY part, run"
)

QUERIES = {
    "kv_live_full": (lambda s, d: visible(view_o(s, d)), LIVE_O),
    "kv_get_hit": (lambda s, d: probe(reads.get(view_o(s, d), "00000007"), "00000007"), probe_sql("00000007")),
    "kv_get_deleted": (deleted_key, f"SELECT min(key) AS key, false AS found FROM ({LATEST.format(ops=O)}) AS newest WHERE is_tombstone"),
    "kv_get_missing": (lambda s, d: probe(reads.get(view_o(s, d), "zz"), "zz"), probe_sql("zz")),
    "kv_multi_get": (
        lambda s, d: reads.multi_get(view_o(s, d), view_o(s, d).where("cast(key as bigint) % 7 = 0").select("key").distinct()),
        f"{LIVE_O} AND CAST(key AS bigint) % 7 = 0",
    ),
    "kv_scan_range": (lambda s, d: reads.scan(view_o(s, d), LO, HI), f"{LIVE_O} AND key >= '{LO}' AND key < '{HI}'"),
    "kv_scan_inverted": (lambda s, d: reads.scan(view_o(s, d), HI, LO), f"{LIVE_O} AND key >= '{HI}' AND key < '{LO}'"),
    "kv_prefix_scan": (lambda s, d: reads.scan(view_o(s, d), "0000001", "0000002"), f"{LIVE_O} AND starts_with(key, '0000001')"),
    "kv_scan_first_n": (lambda s, d: reads.scan(view_o(s, d), limit=10), f"{LIVE_O} ORDER BY key LIMIT 10"),
    "kv_reverse_first_n": (lambda s, d: reads.scan(view_o(s, d), reverse=True, limit=10), f"{LIVE_O} ORDER BY key DESC LIMIT 10"),
    "kv_seek_many": (
        lambda s, d: reads.seek_many(visible(view_o(s, d)), TARGETS),
        f"SELECT t.target, (SELECT min(key) FROM ({LIVE_O}) AS a WHERE key >= t.target) AS ceiling_key, (SELECT max(key) FROM ({LIVE_O}) AS b WHERE key <= t.target) AS floor_key"
        f" FROM (VALUES {', '.join(f'({t!r})' for t in TARGETS)}) AS t(target)",
    ),
    "kv_seek_ceiling": (lambda s, d: reads.ceiling(view_o(s, d), "000000105"), f"{LIVE_O} AND key >= '000000105' ORDER BY key LIMIT 1"),
    "kv_seek_floor": (lambda s, d: reads.floor(view_o(s, d), "000000105"), f"{LIVE_O} AND key <= '000000105' ORDER BY key DESC LIMIT 1"),
    "kv_seek_first_last": (lambda s, d: reads.first(view_o(s, d)).unionByName(reads.last(view_o(s, d))), f"SELECT key, value FROM ({LIVE_O}) AS kv WHERE key IN (SELECT min(key) FROM ({LIVE_O}) AS a UNION SELECT max(key) FROM ({LIVE_O}) AS b)"),
    "kv_cursor_step": (
        lambda s, d: reads.successor(view_o(s, d), LO).unionByName(reads.predecessor(view_o(s, d), LO)),
        f"SELECT key, value FROM ({LIVE_O}) AS kv WHERE key IN (SELECT min(key) FROM ({LIVE_O}) AS a WHERE key > '{LO}' UNION SELECT max(key) FROM ({LIVE_O}) AS b WHERE key < '{LO}')",
    ),
    "kv_cursor_next_prev": (
        lambda s, d: reads.neighbours(visible(view_o(s, d))),
        f"SELECT key, lag(key) OVER (ORDER BY key) AS prev_key, lead(key) OVER (ORDER BY key) AS next_key FROM ({LIVE_O}) AS kv",
    ),
    "kv_tombstones": (lambda s, d: latest(view_o(s, d)).where("is_tombstone").select("key"), f"SELECT key FROM ({LATEST.format(ops=O)}) AS newest WHERE is_tombstone"),
    "kv_delete_then_put": (lambda s, d: visible(view_p(s, d)), live_sql(P)),
    "kv_overwrite_counts": (lambda s, d: superseded(view_p(s, d)), f"SELECT key, count(*) - 1 AS superseded FROM ({P}) AS p GROUP BY key"),
    "kv_batch_last_wins": (batch_last_wins, LIVE_O),
    "kv_txn_commit": (txn_commit, live_sql(f"SELECT * FROM ({T}) AS t WHERE txn % 3 <> 0")),
    "kv_txn_rollback": (txn_rollback, live_sql(f"SELECT * FROM ({T}) AS t WHERE txn % 3 <> 0")),
    "kv_merge_two_runs": (lambda s, d: merge_runs(even_odd(s, d)).select("key", "seq", "is_tombstone", "value"), LATEST.format(ops=O)),
    "kv_merge_keep_tombstones": (lambda s, d: merge_runs(even_odd(s, d)).where("is_tombstone").select("key", "seq"), f"SELECT key, seq FROM ({LATEST.format(ops=O)}) AS newest WHERE is_tombstone"),
    "kv_merge_drop_tombstones": (lambda s, d: merge_runs(even_odd(s, d), drop_tombstones=True).select("key", "seq", "value"), f"SELECT key, seq, value FROM ({LATEST.format(ops=O)}) AS newest WHERE NOT is_tombstone"),
    "kv_compaction_split": (compaction_split, SPLIT_SQL),
    "kv_run_meta": (lambda s, d: compaction.run_meta(view_l(s, d), "level", "run"), f"SELECT level, run, min_key, max_key, entries, sequence FROM ({META_L}) AS m"),
    "kv_run_overlap": (run_overlap, f"SELECT a.run AS upper_run, b.run AS lower_run FROM ({META_L}) AS a JOIN ({META_L}) AS b ON b.min_key <= a.max_key AND b.max_key >= a.min_key WHERE a.level = 0 AND b.level = 1"),
    "kv_prune_runs": (lambda s, d: compaction.surviving(manifest_l(s, d), LO, HI).select("level", "run"), f"SELECT level, run FROM ({META_L}) AS m WHERE max_key >= '{LO}' AND min_key < '{HI}'"),
    "kv_levels_due": (
        lambda s, d: compaction.levels_to_compact(manifest_l(s, d), trigger=3, base=50_000),
        f"SELECT level, runs, bytes FROM (SELECT level, count(*) AS runs, CAST(sum(bytes) AS bigint) AS bytes FROM ({META_L}) AS m GROUP BY level) AS v WHERE CASE WHEN level = 0 THEN runs >= 3 ELSE bytes > 50000 * 10 ** (level - 1) END",
    ),
    "kv_level_stats": (lambda s, d: stats.level_stats(manifest_l(s, d)), f"SELECT level, count(*) AS runs, CAST(sum(bytes) AS bigint) AS bytes, CAST(sum(entries) AS bigint) AS entries FROM ({META_L}) AS m GROUP BY level"),
    "kv_stats_scalars": (
        lambda s, d: stats.scalars(stats.level_stats(manifest_l(s, d))),
        f"SELECT CAST(sum(runs) AS bigint) AS total_runs, CAST(sum(bytes) AS bigint) AS total_bytes, count(*) AS active_levels, CAST(max(bytes) AS bigint) AS max_level_bytes, CAST(sum(bytes) AS double) / sum(runs) AS avg_run_bytes"
        f" FROM (SELECT level, count(*) AS runs, sum(bytes) AS bytes FROM ({META_L}) AS m GROUP BY level) AS v",
    ),
    "kv_scan_plan": (
        lambda s, d: explain.analyze_frame(manifest_l(s, d), LO, HI),
        f"SELECT CAST(coalesce(sum(entries), 0) AS bigint) AS estimated_keys, count(*) AS runs, count(DISTINCT level) AS levels, CASE WHEN count(DISTINCT level) <= 2 THEN 'Low' WHEN count(DISTINCT level) <= 4 THEN 'Medium' ELSE 'High' END AS cost FROM ({META_L}) AS m WHERE max_key >= '{LO}' AND min_key < '{HI}'",
    ),
    "kv_replay_prefix": (lambda s, d: as_of(view_o(s, d), 500), live_sql(f"SELECT * FROM ({O}) AS o WHERE seq <= 500")),
    "kv_import_text": (
        lambda s, d: visible(parse_lines(lines(s, d))),
        "SELECT key, value FROM (SELECT CAST(user_id AS varchar) AS key, props AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_type <> 'view') AS v WHERE rn = 1",
    ),
    "kv_render_text": (lambda s, d: visible(view_p(s, d)).select(render().alias("line")), f"SELECT key || ' => ' || value AS line FROM ({live_sql(P)}) AS kv"),
    "kv_memtable_size": (memtable_size, f"SELECT count(*) AS entries, CAST(sum(length(key) + CASE WHEN is_tombstone THEN 1 ELSE length(value) END) AS bigint) AS bytes FROM ({LATEST.format(ops=P)}) AS newest"),
    "kv_crc_verify": (crc_verify, f"SELECT key FROM ({LIVE_O}) AS kv WHERE CAST(key AS bigint) % 10 = 3"),
    "kv_bloom_membership": (
        bloom_membership,
        "SELECT count(*) FILTER (u % 2 = 0) AS members, CAST(0 AS bigint) AS false_negatives, count(*) FILTER (u % 2 = 1) AS others, true AS few_let_through FROM (SELECT DISTINCT user_id AS u FROM events) AS d",
    ),
    "kv_bloom_orders": (
        bloom_orders,
        "SELECT count(*) FILTER (u % 2 = 0) AS members, CAST(0 AS bigint) AS false_negatives, count(*) FILTER (u % 2 = 1) AS others, true AS few_let_through FROM (SELECT DISTINCT o_orderkey AS u FROM orders) AS d",
    ),
    "kv_bloom_packed": (bloom_packed, "SELECT count(DISTINCT o_orderkey) AS keys, CAST(0 AS bigint) AS changed, CAST(0 AS bigint) AS surplus_bytes FROM orders"),
    "kv_bloom_sizing": (
        bloom_sizes,
        "SELECT event_type, capacity, bits, greatest(1, CAST(floor(CAST(bits AS double) / capacity * ln(2) + 0.5) AS bigint)) AS hashes FROM"
        " (SELECT event_type, count(*) AS capacity, greatest(64, CAST(floor(-count(*) * ln(0.01) / (ln(2) * ln(2))) AS bigint)) AS bits FROM events GROUP BY event_type) AS s",
    ),
    "kv_perf_summary": (
        lambda s, d: stats.perf_summary(s.read.parquet(f"{d}/events.parquet").withColumn("micros", F.floor(F.col("value")).cast("long")), "event_type", "micros"),
        "SELECT event_type, count(*) AS n, CAST(sum(CAST(floor(value) AS bigint)) AS bigint) // count(*) AS avg_us FROM events GROUP BY event_type",
    ),
}


def queries() -> dict:
    from tidelog.store_queries import STORE_QUERIES

    return {k: f for k, (f, _) in (QUERIES | STORE_QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    from tidelog.store_queries import STORE_QUERIES

    return {k: sql for k, (_, sql) in (QUERIES | STORE_QUERIES).items() if sql}
