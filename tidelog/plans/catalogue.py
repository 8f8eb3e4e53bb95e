"""The registered queries on tables made from the test data, each with its SQL twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.batch import WriteBatch, append_frames, sequenced
from tidelog.functions.scalar import escaped, leading_number, percentile_lower
from tidelog.iterator import Cursor
from tidelog.operators import compaction, cursor, files, visibility
from tidelog.sources.events import bench_rows, events_log
from tidelog.sources.shared import shared_dir
from tidelog.store import Database

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The log as SQL; every statement below starts with it. Mid: half of the sequences.
_LOG = """WITH l AS (SELECT CAST(user_id AS VARCHAR) || '/' || props AS key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS op, value FROM events),
 h AS (SELECT CAST(max(seq) AS BIGINT) AS head, CAST(max(seq) // 2 AS BIGINT) AS mid FROM l),
 newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM l) WHERE r = 1),
 newest_mid AS (SELECT * FROM (SELECT l.*, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM l, h WHERE seq <= mid) WHERE r = 1),
 live AS (SELECT key, seq, value FROM newest WHERE op = 1),
 live_mid AS (SELECT key, seq, value FROM newest_mid WHERE op = 1)
"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_log(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _mid(spark: SparkSession, sf_dir: str) -> int:
    """Half of the head sequence; Parquet statistics answer it."""
    return (spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_id")).first()[0] + 1) // 2


def query(sql: str | None, with_log: bool = True):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = _LOG + sql if with_log else sql
        return f

    return register


# ---- reads


@query("SELECT * FROM live")
def visible_head(spark, d):
    return visibility.visible(_log(spark, d))


@query("SELECT * FROM live_mid")
def visible_at_snapshot(spark, d):
    return visibility.visible(_log(spark, d), _mid(spark, d))


def _probe(spark, d, op: int) -> str:
    """The smallest key whose newest version has ``op``."""
    return visibility.latest(_log(spark, d)).where(F.col("op") == op).agg(F.min("key")).first()[0]


@query("SELECT key, 'found' AS status, value FROM newest WHERE key = (SELECT min(key) FROM newest WHERE op = 1)")
def get_point(spark, d):
    return visibility.get_status(_log(spark, d), [_probe(spark, d, 1)])


@query("SELECT key, 'deleted' AS status, CAST(NULL AS DOUBLE) AS value FROM newest WHERE key = (SELECT min(key) FROM newest WHERE op = 0)")
def get_deleted(spark, d):
    return visibility.get_status(_log(spark, d), [_probe(spark, d, 0)])


@query("SELECT 'no/such key' AS key, 'absent' AS status, CAST(NULL AS DOUBLE) AS value", with_log=False)
def get_absent(spark, d):
    return visibility.get_status(_log(spark, d), ["no/such key"])


@query("SELECT * FROM live WHERE key IN (SELECT key FROM l WHERE seq % 10 = 3)")
def multi_get(spark, d):
    log = _log(spark, d)
    return visibility.multi_get(log, log.where("seq % 10 = 3").select("key"))


@query("""SELECT p.key, p.as_of, v.seq, v.value FROM (SELECT DISTINCT key, seq + 500 AS as_of FROM l WHERE seq % 7 = 0) p
 LEFT JOIN (SELECT * FROM (SELECT p2.key, p2.as_of, l.seq, l.value, l.op, row_number() OVER (PARTITION BY p2.key, p2.as_of ORDER BY l.seq DESC) AS r
   FROM (SELECT DISTINCT key, seq + 500 AS as_of FROM l WHERE seq % 7 = 0) p2 JOIN l ON l.key = p2.key AND l.seq <= p2.as_of) WHERE r = 1 AND op = 1) v
 ON p.key = v.key AND p.as_of = v.as_of""")
def as_of_multi_get(spark, d):
    log = _log(spark, d)
    return visibility.as_of_multi_get(log, log.where("seq % 7 = 0").select("key", (F.col("seq") + 500).alias("as_of")))


@query("SELECT * FROM live ORDER BY key LIMIT 1")
def seek_first(spark, d):
    return cursor.seek_first(_log(spark, d))


@query("SELECT * FROM live ORDER BY key DESC LIMIT 1")
def seek_last(spark, d):
    return cursor.seek_last(_log(spark, d))


@query("SELECT * FROM live WHERE key >= '5' ORDER BY key LIMIT 1")
def seek_ge(spark, d):
    return cursor.seek(_log(spark, d), "5")


@query("SELECT * FROM live WHERE key < '5' ORDER BY key DESC LIMIT 1")
def seek_lt(spark, d):
    return cursor.prev_before(_log(spark, d), "5")


@query("SELECT * FROM live_mid WHERE key > '42' ORDER BY key LIMIT 1")
def next_at_snapshot(spark, d):
    return cursor.next_after(_log(spark, d), "42", _mid(spark, d))


@query("SELECT key, lag(key) OVER (ORDER BY key) AS prev_key, lead(key) OVER (ORDER BY key) AS next_key FROM live")
def next_prev(spark, d):
    return cursor.neighbours(_log(spark, d))


@query("SELECT * FROM live WHERE key >= '2' AND key < '4'")
def scan_range(spark, d):
    return cursor.scan_range(_log(spark, d), "2", "4")


@query("SELECT * FROM live WHERE starts_with(key, '7')")
def scan_prefix(spark, d):
    return cursor.scan_prefix(_log(spark, d), "7")


@query("SELECT * FROM live ORDER BY key DESC LIMIT 20")
def scan_reverse_topn(spark, d):
    return cursor.scan_reverse(_log(spark, d), 20)


@query("SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS version FROM l")
def raw_versions(spark, d):
    return visibility.raw_versions(_log(spark, d)).withColumn("version", F.col("version").cast("bigint"))


@query("SELECT key, count(*) AS versions, CAST(sum(1 - op) AS BIGINT) AS tombstones, min(seq) AS first_seq, max(seq) AS last_seq FROM l GROUP BY key")
def version_history(spark, d):
    return visibility.version_history(_log(spark, d))


@query("""SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change, a.value AS old_value, b.value AS new_value
 FROM live_mid a FULL JOIN live b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR (a.seq <> b.seq AND a.value IS DISTINCT FROM b.value)""")
def snapshot_diff(spark, d):
    head = 2 * _mid(spark, d) + 1
    return visibility.snapshot_diff(_log(spark, d), _mid(spark, d), head)


# ---- batches


def _overlay(spark, d) -> DataFrame:
    """Two batches joined to one, after the head: a put on every key that a tenth of the sequences names, then a delete of every hundredth."""
    log = _log(spark, d)
    keys = log.where("seq % 10 = 0").groupBy("key").agg(F.min("seq").alias("s"))
    puts = keys.select((F.col("s") - 1).alias("ord"), F.lit(1).alias("op"), "key", F.lit(0.5).alias("value"))
    deletes = keys.where("s % 100 = 0").select((F.col("s") - 1).alias("ord"), F.lit(0).alias("op"), "key", F.lit(None).cast("double").alias("value"))
    batch = sequenced(append_frames(puts, deletes), 2 * _mid(spark, d) + 2)
    return log.unionByName(batch)


_OVERLAY = """, keys AS (SELECT key, min(seq) AS s FROM l WHERE seq % 10 = 0 GROUP BY key),
 over AS (SELECT key, seq, op, value FROM l UNION ALL SELECT key, s + 2 * mid + 1, 1, 0.5 FROM keys, h UNION ALL SELECT key, s + 2 * (2 * mid + 1), 0, NULL FROM keys, h WHERE s % 100 = 0)
 SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM over) WHERE r = 1 AND op = 1"""


@query(_OVERLAY)
def batch_apply(spark, d):
    return visibility.visible(_overlay(spark, d))


@query("SELECT key, count(*) AS writes, CAST(max(seq) AS BIGINT) AS seq, max_by(value, seq) AS value FROM l WHERE op = 1 GROUP BY key HAVING count(*) > 1")
def batch_same_key_last_wins(spark, d):
    batch = _log(spark, d).where("op = 1").select((F.col("seq") - 1).alias("ord"), "op", "key", "value")
    puts = sequenced(batch, 1)
    writes = puts.groupBy("key").agg(F.count("*").alias("writes")).where("writes > 1")
    return visibility.visible(puts).join(writes, "key").select("key", "writes", "seq", "value")


# ---- compaction


_MARKED = """, m AS (SELECT l.*, mid, lag(seq) OVER (PARTITION BY key ORDER BY seq DESC) AS p FROM l, h),
 a AS (SELECT * FROM m WHERE NOT (p IS NOT NULL AND p <= mid)) """


@query(_MARKED + "SELECT key, seq, op, value FROM a")
def compact_rule_a(spark, d):
    return compaction.rule_a(_log(spark, d), _mid(spark, d))


@query(_MARKED + "SELECT key, seq, op, value FROM a WHERE NOT (op = 0 AND seq <= mid)")
def compact_rule_ab(spark, d):
    return compaction.compact(_log(spark, d), _mid(spark, d))


def _split(spark, d) -> tuple[DataFrame, DataFrame, int]:
    """Newer versions (the inputs), older ones (deeper files: one for each first character of the key), and a watermark between."""
    log, mid = _log(spark, d), _mid(spark, d)
    return log.where(F.col("seq") > mid // 2), log.where(F.col("seq") <= mid // 2), mid


_PARTIAL = """, ins AS (SELECT l.*, mid FROM l, h WHERE seq > mid // 2), deep AS (SELECT min(key) AS smallest, max(key) AS largest FROM l, h WHERE seq <= mid // 2 GROUP BY substr(key, 1, 2)),
 m AS (SELECT *, lag(seq) OVER (PARTITION BY key ORDER BY seq DESC) AS p FROM ins)
 SELECT key, seq, op, value FROM m WHERE NOT (p IS NOT NULL AND p <= mid)
 AND NOT (op = 0 AND seq <= mid AND NOT EXISTS (SELECT 1 FROM deep WHERE smallest <= m.key AND m.key <= largest))"""


@query(_PARTIAL)
def compact_partial(spark, d):
    inputs, older, mid = _split(spark, d)
    ranges = older.groupBy(F.substring("key", 1, 2)).agg(F.min("key").alias("smallest"), F.max("key").alias("largest"))
    return compaction.compact(inputs, mid, ranges)


@query("SELECT mid AS sequence, key, value FROM live_mid, h UNION ALL SELECT 2 * mid + 1, key, value FROM live, h")
def compact_preserves_visible(spark, d):
    inputs, older, mid = _split(spark, d)
    after = compaction.compact(inputs, mid, deeper_keys=older.select("key").distinct()).unionByName(older)
    at = lambda s: visibility.visible(after, s).select(F.lit(s).cast("bigint").alias("sequence"), "key", "value")
    return at(mid).unionByName(at(2 * mid + 1))


# ---- files


def _runs(spark, d) -> DataFrame:
    """File metadata: each thousand sequences a file of level 0; the older half's customers by range at levels 1 and 2."""
    runs = files.run_stats(_log(spark, d), F.floor(F.col("seq") / 500)).select(F.lit(0).alias("level"), F.col("run").cast("bigint").alias("number"), (F.col("rows") * 4096).alias("size"), "smallest", "largest", "smallest_seq", "largest_seq")
    first = F.substring("key", 1, 1)
    deep = _log(spark, d).groupBy(first.alias("c")).agg(F.count("*").alias("rows"), F.min("key").alias("smallest"), F.max("key").alias("largest"), F.min("seq").alias("smallest_seq"), F.max("seq").alias("largest_seq"))
    levels = [deep.select(F.lit(level).alias("level"), (F.ascii("c") + 1000 * level).cast("bigint").alias("number"), (F.col("rows") * 4096 * factor).alias("size"), "smallest", "largest", "smallest_seq", "largest_seq") for level, factor in ((1, 8), (2, 3))]
    return runs.unionByName(levels[0]).unionByName(levels[1])


_RUNS = """, runs AS (SELECT 0 AS level, CAST(seq // 500 AS BIGINT) AS number, count(*) * 4096 AS size, min(key) AS smallest, max(key) AS largest, min(seq) AS smallest_seq, max(seq) AS largest_seq FROM l GROUP BY seq // 500
 UNION ALL SELECT level, CAST(ascii(substr(key, 1, 1)) + 1000 * level AS BIGINT), count(*) * 4096 * CASE level WHEN 1 THEN 8 ELSE 3 END, min(key), max(key), min(seq), max(seq) FROM l, (VALUES (1), (2)) v(level) GROUP BY level, substr(key, 1, 1)) """


@query("SELECT CAST(seq // 500 AS BIGINT) AS run, count(*) AS rows, min(key) AS smallest, max(key) AS largest, min(seq) AS smallest_seq, max(seq) AS largest_seq FROM l GROUP BY seq // 500")
def flush_run_stats(spark, d):
    return files.run_stats(_log(spark, d), F.floor(F.col("seq") / 500).cast("bigint"))


_SCORES = _RUNS + """, scores AS (SELECT level, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CASE WHEN level = 0 THEN count(*) / 4.0::DOUBLE ELSE sum(size) / (10485760.0::DOUBLE * pow(10, level - 1)) END AS score FROM runs WHERE level < 6 GROUP BY level) """


@query(_SCORES + "SELECT * FROM scores")
def level_scores(spark, d):
    return files.level_scores(_runs(spark, d))


@query(_SCORES + "SELECT * FROM scores ORDER BY score DESC, level LIMIT 1")
def pick_level(spark, d):
    return files.pick_level(_runs(spark, d))


@query(_RUNS + "SELECT level, number, smallest, largest FROM runs WHERE level = 1 AND largest >= '45' ORDER BY largest LIMIT 1")
def find_file(spark, d):
    return files.find_file(_runs(spark, d).where("level = 1"), "45").select("level", "number", "smallest", "largest")


@query(_RUNS + "SELECT level, number FROM runs WHERE largest >= '3' AND smallest <= '55'")
def overlapping_files(spark, d):
    return files.overlapping_files(_runs(spark, d), "3", "55").select("level", "number")


@query(_RUNS + """, shifted AS (SELECT CASE level WHEN 0 THEN 1 ELSE level END AS level, number, smallest, largest, smallest_seq, largest_seq FROM runs WHERE level <> 1),
 n AS (SELECT *, lag(largest) OVER w AS k, lag(largest_seq) OVER w AS q, lag(number) OVER w AS prev_number FROM shifted WINDOW w AS (PARTITION BY level ORDER BY smallest, smallest_seq DESC))
 SELECT level, prev_number, number FROM n WHERE k IS NOT NULL AND NOT (k < smallest OR (k = smallest AND q > smallest_seq))""")
def level_invariant(spark, d):
    shifted = _runs(spark, d).where("level <> 1").withColumn("level", F.when(F.col("level") == 0, 1).otherwise(F.col("level")))
    return files.level_invariant(shifted)


@query(_RUNS + "SELECT CAST(coalesce(sum(size * CASE WHEN largest < '45' THEN 1.0 WHEN smallest >= '45' THEN 0.0 ELSE 0.5 END), 0) AS BIGINT) AS bytes FROM runs")
def approximate_offset(spark, d):
    return files.approximate_offset(_runs(spark, d), "45")


def _actions(spark, d) -> DataFrame:
    """A manifest made of orders: statuses add, remove or leave files."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    action = F.when(F.col("o_orderkey") % 3 == 0, "remove").otherwise("add")
    return orders.select(F.col("o_orderkey").alias("commit"), F.lit(0).alias("ord"), action.alias("action"), (F.col("o_custkey") % 7).cast("int").alias("level"), F.col("o_custkey").alias("number"))


_ACTIONS = """WITH acts AS (SELECT o_orderkey AS commit, CASE WHEN o_orderkey % 3 = 0 THEN 'remove' ELSE 'add' END AS action, CAST(o_custkey % 7 AS INT) AS level, o_custkey AS number FROM orders),
 folded AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY level, number ORDER BY commit DESC) AS r FROM acts) WHERE r = 1 AND action = 'add') """


@query(_ACTIONS + "SELECT commit, level, number FROM folded", with_log=False)
def manifest_fold(spark, d):
    return files.manifest_fold(_actions(spark, d))


@query(_ACTIONS + "SELECT DISTINCT level, number FROM (SELECT level, number FROM folded UNION SELECT level, number FROM (SELECT *, row_number() OVER (PARTITION BY level, number ORDER BY commit DESC) AS r FROM acts WHERE commit <= (SELECT max(commit) // 2 FROM acts)) WHERE r = 1 AND action = 'add')", with_log=False)
def live_files_all_versions(spark, d):
    actions = _actions(spark, d)
    half = actions.agg(F.max("commit")).first()[0] // 2
    old = files.manifest_fold(actions.where(F.col("commit") <= half))
    return files.manifest_fold(actions).select("level", "number").union(old.select("level", "number")).distinct()


@query(_ACTIONS + "SELECT c_custkey AS number FROM customer WHERE c_custkey NOT IN (SELECT number FROM folded)", with_log=False)
def obsolete_files(spark, d):
    listing = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("number"))
    return files.obsolete_files(listing, files.manifest_fold(_actions(spark, d)))


@query("SELECT DISTINCT CAST(s_suppkey % 16 AS BIGINT) AS l0_files, CASE WHEN s_suppkey % 16 >= 12 THEN 'stop' WHEN s_suppkey % 16 >= 8 THEN 'slowdown' ELSE 'none' END AS stall FROM supplier", with_log=False)
def stall_state(spark, d):
    counts = spark.read.parquet(f"{d}/supplier.parquet").select((F.col("s_suppkey") % 16).cast("bigint").alias("l0_files")).distinct()
    return counts.withColumn("stall", files.stall_state(F.col("l0_files")))


@query("SELECT CAST(f AS DOUBLE) AS fraction, value FROM (VALUES (0.5), (0.95), (0.99), (0.0), (1.0)) p(f) JOIN (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM l WHERE value IS NOT NULL) ON i = floor(CAST(f AS DOUBLE) * (n - 1))")
def percentile_nearest_lower(spark, d):
    return percentile_lower(_log(spark, d), "value", [0.5, 0.95, 0.99, 0.0, 1.0])


@query("SELECT DISTINCT key, replace(key, '/', '\\x0a') AS shown, CAST(regexp_extract(key, '^([0-9]+)', 1) AS BIGINT) AS number FROM l")
def escaped_keys(spark, d):
    """Every key, with a line feed for its slash, in printable form, and the number it starts with."""
    rows = _log(spark, d).select("key").distinct()
    return rows.select("key", escaped(F.translate("key", "/", "\n")).alias("shown"), leading_number(F.col("key")).cast("bigint").alias("number"))


@query("SELECT 'k_' || c || '_' || i AS key, repeat('v', 8) AS value FROM range(4) a(c), range(250) b(i)", with_log=False)
def bench_keys(spark, d):
    return bench_rows(spark, 4, 250, 8)


# ---- the table itself


def _table(spark: SparkSession, value: T.DataType | None = None) -> Database:
    """A new table in the shared folder."""
    return Database.open(spark, f"{shared_dir(spark)}/tidelog-tables/{uuid.uuid4().hex}", create_if_missing=True, key_type="string", value_type=value or T.DoubleType())


def _batch(log: DataFrame, first: int) -> DataFrame:
    """Versions as a batch whose first record would take sequence ``first``."""
    return log.select((F.col("seq") - first).alias("ord"), "op", "key", "value")


def _in_halves(spark, d):
    """A table that took the log as two batches, and a snapshot from between."""
    log, mid, db = _log(spark, d), _mid(spark, d), _table(spark)
    db.write_frame(_batch(log.where(F.col("seq") <= mid), 1))
    between = db.snapshot()
    db.write_frame(_batch(log.where(F.col("seq") > mid), mid + 1))
    return db, between, mid


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, o_totalprice AS value FROM orders", with_log=False)
def bulk_load_orders(spark, d):
    """All orders, range-partitioned by key, bulk-loaded into a table and scanned."""
    db = _table(spark)
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_totalprice").alias("value"))
    db.bulk_load(orders.repartitionByRange(8, "key"))
    return db.scan().select("key", "value")


@query("SELECT * FROM live")
def table_scan(spark, d):
    return _in_halves(spark, d)[0].scan()


@query("SELECT * FROM live_mid")
def table_snapshot(spark, d):
    """A snapshot's rows after another handle has overwritten keys, compacted everything and removed what it could."""
    db, between, _ = _in_halves(spark, d)
    other = Database.open(spark, db.path)
    other.compact(full=True)
    other.vacuum()
    db.refresh()
    return db.scan(between)


@query("SELECT key, seq, op, value FROM newest WHERE op = 1")
def table_compacted(spark, d):
    """All versions that a full compaction leaves when no snapshot lives."""
    db, between, _ = _in_halves(spark, d)
    between.release()
    db.compact(full=True)
    db.vacuum()
    return db.log().select("key", "seq", F.col("op").cast("int").alias("op"), "value")


@query(_MARKED + "SELECT key, seq, op, value FROM a WHERE NOT (op = 0 AND seq <= mid)")
def table_compacted_below_snapshot(spark, d):
    """All versions that a full compaction leaves below and above a live snapshot."""
    db, between, _ = _in_halves(spark, d)
    db.compact(full=True)
    between.release()
    return db.log().select("key", "seq", F.col("op").cast("int").alias("op"), "value")


@query("SELECT CAST(1 AS BIGINT) AS live_snapshots, mid AS watermark FROM h UNION ALL SELECT 0, head FROM h")
def gc_watermark(spark, d):
    """What a compaction must keep, with a snapshot of another handle and after its release."""
    db, between, _ = _in_halves(spark, d)
    other = Database.open(spark, db.path)
    rows = [(len(db.snapshots), other.watermark())]
    between.release()
    rows.append((len(db.snapshots), other.watermark()))
    return spark.createDataFrame(rows, "live_snapshots bigint, watermark bigint")


@query("SELECT * FROM live WHERE key IN (SELECT key FROM l WHERE seq % 10 = 3)")
def table_multi_get(spark, d):
    log = _log(spark, d)
    return _in_halves(spark, d)[0].multi_get(log.where("seq % 10 = 3").select("key"))


@query("SELECT key, seq, op, value FROM l, h WHERE seq > mid")
def table_changes(spark, d):
    db, between, mid = _in_halves(spark, d)
    between.release()
    return db.changes(mid).withColumn("op", F.col("op").cast("int"))


_NATIONS = "WITH n AS (SELECT n_name AS key, n_regionkey * 1.0::DOUBLE AS value FROM nation WHERE n_regionkey <> 0) "


def _nations(spark, d) -> Database:
    """A table of nations, written by one batch that also deletes some of them."""
    db, batch = _table(spark), WriteBatch()
    nations = spark.read.parquet(f"{d}/nation.parquet").select("n_name", "n_regionkey").collect()  # 25 rows at every scale
    for n in nations:
        batch.put(n.n_name, float(n.n_regionkey) - 1)
    for n in nations:
        batch.put(n.n_name, float(n.n_regionkey))
    again = WriteBatch()
    for n in nations:
        if n.n_regionkey == 0:
            again.delete(n.n_name)
    db.write(batch.append(again))
    return db


@query(_NATIONS + "SELECT * FROM n", with_log=False)
def table_write_batch(spark, d):
    return _nations(spark, d).scan().select("key", "value")


@query(_NATIONS + """, f AS (SELECT key, value, row_number() OVER (ORDER BY key) AS i, count(*) OVER () AS c FROM n)
 SELECT CAST(i - 1 AS BIGINT) AS step, key, value FROM f UNION ALL SELECT c - 1 + c - i, key, value FROM f WHERE i < c
 UNION ALL SELECT 2 * c - 1, key, value FROM f WHERE i = (SELECT min(i) FROM f WHERE key >= 'NATION_2') UNION ALL SELECT 2 * c, key, value FROM f WHERE i = (SELECT min(i) - 1 FROM f WHERE key >= 'NATION_2')""", with_log=False)
def table_cursor(spark, d):
    """A cursor's way: from the first row to the last, back to the first, then to a key and one back."""
    rows: list[tuple] = []
    with Cursor(_nations(spark, d), page=7) as c:
        at = lambda: rows.append((len(rows), c.key, c.value))
        c.seek_to_first()
        while c.valid:
            at()
            c.next()
        c.seek_to_last()
        c.prev()
        while c.valid:
            at()
            c.prev()
        c.seek("NATION_2")
        at()
        c.prev()
        at()
    return spark.createDataFrame(rows, "step bigint, key string, value double")
