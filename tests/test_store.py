"""The table: lifecycle, writes, snapshots, recovery after failures, maintenance."""

import json

import pytest
from pyspark.sql import functions as F

from tidelog.asyncdb import AsyncDatabase
from tidelog.batch import WriteBatch, append_frames, sequenced, validate
from tidelog.iterator import Cursor
from tidelog.operators import visibility
from tidelog.plans import picking, workloads
from tidelog.schema import Corruption, InvalidArgument, NotFound
from tidelog.snapshot import Snapshot
from tidelog.sources.commits import CommitLog, Folder, State
from tidelog.store import Database, Options
from tidelog.streaming.ingest import ingest


def rows(db, snapshot=None):
    return [(bytes(r.key), bytes(r.value)) for r in db.iterate(snapshot)]


def test_crud_batches_reopen(spark, table):
    with pytest.raises(InvalidArgument, match="does not exist"):
        Database.open(spark, table)
    db = Database.open(spark, table, create_if_missing=True)
    assert db.put(b"key1", b"value1") == 1
    assert db.get(b"key1") == b"value1"
    db.delete(b"key1")
    with pytest.raises(NotFound):
        db.get(b"key1")
    assert db.write(WriteBatch()) == 2
    batch = WriteBatch().put(b"b1", b"1").put(b"b2", b"").delete(b"none").put(b"b1", b"2")
    assert db.write(batch) == 6 and batch.sequence == 3
    assert db.get(b"b1") == b"2" and db.get(b"b2") == b""
    with pytest.raises(InvalidArgument, match="exists"):
        Database.open(spark, table, error_if_exists=True)
    again = Database.open(spark, table)
    assert again.state.last_sequence == 6 and rows(again) == [(b"b1", b"2"), (b"b2", b"")]
    assert again.put(b"z", b"x" * 50_000) == 7 and len(again.get(b"z")) == 50_000
    assert [bytes(r.key) for r in again.seek(b"b2").collect()] == [b"b2"]
    assert [bytes(r.key) for r in again.next_after(b"b1").collect()] == [b"b2"]
    assert [bytes(r.key) for r in again.prev_before(b"b2").collect()] == [b"b1"]
    assert bytes(again.seek_first().first().key) == b"b1" and bytes(again.seek_last().first().key) == b"z"
    assert sorted(bytes(r.key) for r in again.prefix(b"b").collect()) == [b"b1", b"b2"]
    assert sorted(bytes(r.key) for r in again.multi_get([b"b1", b"z", b"q"]).collect()) == [b"b1", b"z"]
    with pytest.raises(InvalidArgument):
        Database.open(spark, table, comparator="numeric")


def test_snapshots(spark, table):
    db = Database.open(spark, table, create_if_missing=True)
    db.write(WriteBatch().put(b"a", b"1").put(b"b", b"2").put(b"c", b"3"))
    seen = db.snapshot()
    db.write(WriteBatch().delete(b"b").put(b"c", b"33").put(b"d", b"4"))
    assert rows(db, seen) == [(b"a", b"1"), (b"b", b"2"), (b"c", b"3")]
    assert rows(db) == [(b"a", b"1"), (b"c", b"33"), (b"d", b"4")]
    assert db.oldest_snapshot() == 3
    assert db.compact(full=True) and rows(db, seen)[1] == (b"b", b"2")
    assert rows(db) == [(b"a", b"1"), (b"c", b"33"), (b"d", b"4")]
    gone = db.vacuum()
    assert rows(db, seen)[1] == (b"b", b"2") and isinstance(gone, list)
    with pytest.raises(InvalidArgument, match="empty"):
        db.get(b"a", Snapshot())
    other = Database.open(spark, table)
    with pytest.raises(InvalidArgument, match="does not belong"):
        other.get(b"a", seen)
    seen.release()
    seen.release()
    with pytest.raises(InvalidArgument, match="empty"):
        db.get(b"a", seen)
    assert db.oldest_snapshot() is None
    db.put(b"x", b"y")
    db.compact(full=True)
    assert db.log().count() == 4 and rows(db)[-1] == (b"x", b"y")


def test_changes(spark, table):
    db = Database.open(spark, table, create_if_missing=True)
    for k in (b"a", b"b", b"c"):
        db.put(k, k)
    seen = db.snapshot()
    db.delete(b"a")
    assert [(r.seq, r.op) for r in db.changes(2).orderBy("seq").collect()] == [(3, 1), (4, 0)]
    assert [r.seq for r in db.changes(1, seen).orderBy("seq").collect()] == [2, 3] and db.changes(4).isEmpty()


def test_uncommitted_files_are_invisible(spark, table):
    db = Database.open(spark, table, create_if_missing=True)
    db.put(b"stable", b"1")
    planted = WriteBatch().put(b"stable", b"no").put(b"ghost", b"no").to_frame(spark)
    planted.select("key", F.col("ord").alias("seq"), "op", "value").write.parquet(f"{table}/data/base=2/orphan")
    again = Database.open(spark, table)
    assert rows(again) == [(b"stable", b"1")]
    assert again.put(b"next", b"2") == 2
    assert rows(again) == [(b"next", b"2"), (b"stable", b"1")]
    assert len(again.vacuum()) >= 1
    assert rows(Database.open(spark, table)) == [(b"next", b"2"), (b"stable", b"1")]


def test_failed_write_leaves_nothing(spark, table, monkeypatch):
    db = Database.open(spark, table, create_if_missing=True)
    db.put(b"key1", b"1")
    monkeypatch.setattr(db.commits, "commit", lambda *_: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        db.put(b"key2", b"2")
    again = Database.open(spark, table)
    assert rows(again) == [(b"key1", b"1")]


def test_two_writers(spark, table):
    a = Database.open(spark, table, create_if_missing=True)
    b = Database.open(spark, table)
    assert a.put(b"k", b"a") == 1
    assert b.put(b"k", b"b") == 2  # lost the first try and took the next sequence
    a.refresh()
    assert a.get(b"k") == b"b" and [r.seq for r in a.log().orderBy("seq").collect()] == [1, 2]


def test_commit_log(spark, table):
    folder = Folder(spark, table)
    log = CommitLog(folder)
    assert folder.create("_commits/x.json", "1") and not folder.create("_commits/x.json", "2") and folder.read("_commits/x.json") == "1"
    state = log.commit(State(), {"last_sequence": 0})
    for i in range(1, 45):
        state = log.commit(state, {"last_sequence": i})
    assert log.load().last_sequence == 44 and log.load(10).last_sequence == 10
    assert log.commit(log.load(3), {"last_sequence": 9}) is None
    with pytest.raises(Corruption):
        State(last_sequence=5).apply(0, {"last_sequence": 4})
    folder.delete("_commits/00000000000000000042.json")
    with pytest.raises(Corruption):
        log.load()
    broken = CommitLog(Folder(spark, table + "2"))
    broken.folder.create(f"_commits/{0:020d}.json", "{")
    with pytest.raises(Corruption):
        broken.load()
    assert json.loads(folder.read(f"_commits/{1:020d}.json")) == {"last_sequence": 1}


def test_bulk_load_prune_and_destroy(spark, table):
    db = Database.open(spark, table, create_if_missing=True, key_type="string")
    data = spark.range(5000).select(F.format_string("k%05d", "id").alias("key"), F.col("id").cast("string").cast("binary").alias("value")).repartitionByRange(4, "key")
    db.bulk_load(data)
    assert db.scan().count() == 5000 and bytes(db.multi_get(["k00077"]).first().value) == b"77"
    assert len(picking.pruned(db.state.files.values(), db.state.last_sequence, b"k00077".hex(), b"k00077".hex())) == 1
    assert db.scan(low="k00010", high="k00020").count() == 10
    db.view("live_rows")
    assert spark.sql("SELECT count(*) AS n FROM live_rows WHERE key < 'k01000'").first().n == 1000
    state = db.state_row().first()
    assert state.files == 4 and state.stall == "none"
    assert db.files().count() == 4
    Database.destroy(spark, table)
    with pytest.raises(InvalidArgument):
        Database.open(spark, table)


def test_leveled_compaction(spark, table):
    db = Database.open(spark, table, create_if_missing=True)
    for i in range(5):
        db.write(WriteBatch().put(b"a", b"%d" % i).put(b"k%d" % i, b"v"))
    assert picking.score(db.state) == (1.25, 0)
    assert db.compact() and not db.compact()
    assert [f.level for f in db.state.files.values()] == [1] and db.get(b"a") == b"4"
    assert db.log().count() == 6  # five k and the newest a
    db.put(b"zz", b"1")
    assert db.compact(level=0) and {f.level for f in db.state.files.values()} == {1}  # a move
    assert db.compactions["moved"] == 1 and db.get(b"zz") == b"1"


def test_batches(spark):
    one, two = WriteBatch().put(b"a", b"1"), WriteBatch().delete(b"a").put(b"b", b"2")
    frame = append_frames(one.to_frame(spark), two.to_frame(spark))
    assert [(r.ord, r.op, bytes(r.key)) for r in frame.orderBy("ord").collect()] == [(0, 1, b"a"), (1, 0, b"a"), (2, 1, b"b")]
    assert [r.seq for r in sequenced(frame, 10).orderBy("seq").collect()] == [10, 11, 12]
    one.append(two)
    assert len(one) == 3 and one.approximate_size() > 12
    seen = []

    class Handler:
        def put(self, k, v):
            seen.append((k, v))

        def delete(self, k):
            seen.append((k,))

    one.iterate(Handler())
    assert seen == [(b"a", b"1"), (b"a",), (b"b", b"2")]
    assert len(one.clear()) == 0
    with pytest.raises(InvalidArgument):
        one.put(b"a", None)
    with pytest.raises(Corruption):
        validate(frame.withColumn("ord", F.lit(0)))
    with pytest.raises(Corruption):
        validate(frame.withColumn("op", F.lit(7)))


def test_async(spark, table):
    db = AsyncDatabase.open_async(spark, table, create_if_missing=True).result()
    done = [db.put_async(b"k%d" % i, b"v%d" % i) for i in range(3)]
    assert [f.result() for f in done] == [1, 2, 3]
    assert db.get_async(b"k1").result() == b"v1" and len(db.multi_get_async([b"k0", b"k2"]).result()) == 2
    assert db.delete_async(b"k1").result() == 4
    with pytest.raises(NotFound):
        db.get_async(b"k1").result()
    assert db.compact_async(full=True).result()
    db.close()


def test_stream_is_taken_in_once(spark, table, tmp_path):
    db = Database.open(spark, table, create_if_missing=True, key_type="string")
    source = f"{tmp_path}/changes"
    schema = "ord bigint, op int, key string, value binary"
    spark.createDataFrame([(0, 1, "a", bytearray(b"1")), (1, 0, "b", None)], schema).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    ingest(db, stream, "s", f"{tmp_path}/cp").awaitTermination()
    assert db.state.last_sequence == 2 and db.state.streams == {"s": 0}
    db.write_frame(spark.createDataFrame([(0, 1, "a", bytearray(b"again"))], schema), stream=("s", 0))
    assert db.state.last_sequence == 2
    spark.createDataFrame([(0, 1, "c", bytearray(b"3"))], schema).coalesce(1).write.mode("append").parquet(source)
    ingest(db, stream, "s", f"{tmp_path}/cp").awaitTermination()
    assert {r.key for r in visibility.visible(db.log()).collect()} == {"a", "c"}


def test_workloads(spark, tmp_path):
    assert workloads.mixed(spark, f"{tmp_path}/m", 2, 50, 8, 50)["found"] > 0
    assert workloads.disk_read(spark, f"{tmp_path}/d", 2, 50)["found"] == 100
    assert workloads.durability_write(spark, f"{tmp_path}/w", 2)["commits"] == 2
    out = workloads.compaction_overlap(spark, f"{tmp_path}/c", 2, 50)
    assert out["same"] and out["compacted"]


# ---- several handles, threads, cursors


def test_snapshots_hold_against_other_handles(spark, table):
    """A snapshot keeps its rows whatever another handle overwrites, compacts and removes, and whatever its own handle takes in."""
    a = Database.open(spark, table, create_if_missing=True)
    a.write(WriteBatch().put(b"k", b"old").put(b"gone", b"1"))
    seen = a.snapshot()
    b = Database.open(spark, table)
    b.write(WriteBatch().put(b"k", b"new").delete(b"gone"))
    assert b.oldest_snapshot() is None and b.watermark() == 2
    assert b.compact(full=True)
    b.vacuum()
    a.put(b"other", b"2")  # takes in b's commits
    assert a.get(b"k", seen) == b"old" and a.get(b"gone", seen) == b"1" and a.get(b"k") == b"new"
    assert {bytes(r.value) for r in a.log().where("key = 'k'").collect()} == {b"old", b"new"}
    seen.release()
    assert b.refresh().last_sequence == b.watermark() == 5
    b.compact(full=True)
    assert len(b.vacuum()) > 0 and [k for k, _ in rows(b)] == [b"k", b"other"]
    again = Database.open(spark, table)
    assert again.log().count() == 2


def test_snapshot_leases_end(spark, table):
    a = Database.open(spark, table, create_if_missing=True, options=Options(snapshot_lease=0.0))
    a.put(b"k", b"1")
    seen = a.snapshot()
    b = Database.open(spark, table)
    b.put(b"k", b"2")
    assert b.watermark() == 2 and a.watermark() == 1  # b no longer knows of it, its own handle does
    b.vacuum()
    assert not [n for n in a.folder.names("_snapshots")] and a.get(b"k", seen) == b"1"
    held = Database.open(spark, table).snapshot()
    del held  # dropped without release
    c = Database.open(spark, table)
    d = c.snapshot()
    c.close()
    with pytest.raises(InvalidArgument):
        c.get(b"k", d)


def test_bulk_load_keeps_every_row_of_any_input(spark, table):
    """Range partitions are cut anew each time a frame is computed; what the commit says must be of the rows that were written."""
    db = Database.open(spark, table, create_if_missing=True, key_type="string")
    data = spark.range(3000).select(F.format_string("k%05d", "id").alias("key"), F.col("id").cast("string").cast("binary").alias("value"))
    last = 0
    for k in range(20):
        last_before, last = last, db.bulk_load(data.repartitionByRange(3 + k % 3, F.rand(), "key"))
        written = db.changes(last_before)
        found = written.agg(F.count("*"), F.count_distinct("seq"), F.max("seq")).first()
        assert (found[0], found[1]) == (3000, 3000) and found[2] <= last
    assert db.scan().count() == 3000
    random_ = data.where(F.rand() < 0.5).select(F.monotonically_increasing_id().alias("ord"), F.lit(1).alias("op"), "key", "value").coalesce(1)
    before = db.state.last_sequence
    after = db.write_frame(random_)
    assert db.changes(before).agg(F.max("seq")).first()[0] == after


def test_bad_batches_leave_nothing(spark, table):
    db = Database.open(spark, table, create_if_missing=True, key_type="string")
    schema = "ord bigint, op int, key string, value binary"
    for bad in ([(0, 7, "a", None)], [(0, 1, "a", None), (0, 1, "b", None)], [(-1, 1, "a", None)], [(0, 1, None, None)]):
        with pytest.raises(Corruption):
            db.write_frame(spark.createDataFrame(bad, schema))
    assert db.write_frame(spark.createDataFrame([], schema)) == 0
    assert db.state.last_sequence == 0 and not db.state.files and not [f for f, _ in db.folder.files("data")]


def test_threads_share_a_handle(spark, table):
    from concurrent.futures import ThreadPoolExecutor

    db = Database.open(spark, table, create_if_missing=True)
    with ThreadPoolExecutor(4) as pool:
        done = [pool.submit(db.put, b"k%d" % i, b"v") for i in range(8)]
        compacted = pool.submit(db.compact, None, True)
        sequences = sorted(f.result() for f in done)
        compacted.result()
    assert sequences == list(range(1, 9)) and len(rows(db)) == 8 and db.state.commit == db.commits.head()


def test_cursor(spark, table):
    db = Database.open(spark, table, create_if_missing=True)
    for part in (range(0, 20, 2), range(1, 20, 2)):
        batch = WriteBatch()
        for i in part:
            batch.put(b"k%02d" % i, b"%d" % i)
        db.write(batch)
    db.write(WriteBatch().delete(b"k05").delete(b"k19").delete(b"k00"))
    keys = [b"k%02d" % i for i in range(20) if i not in (0, 5, 19)]
    for page in (1, 4, 256):
        with Cursor(db, page=page) as c:
            assert not c.valid
            c.seek_to_first()
            got = []
            while c.valid:
                got.append(c.key)
                c.next()
            assert got == keys
            c.seek_to_last()
            assert (c.key, c.value) == (b"k18", b"18")
            c.prev()
            c.prev()
            assert c.key == b"k16"
            c.next()
            assert c.key == b"k17"
            c.seek(b"k05")
            assert c.key == b"k06" and c.sequence == 4
            c.prev()
            assert c.key == b"k04"
            db.put(b"k04", b"later")  # another state
            c.next()
            c.prev()
            assert c.value == b"4"
            db.put(b"k04", b"4")
            c.seek(b"z")
            assert not c.valid
            with pytest.raises(InvalidArgument):
                c.next()
    empty = Cursor(Database.open(spark, table + "2", create_if_missing=True))
    empty.seek_to_first()
    assert not empty.valid


def test_options(spark, table):
    db = Database.open(spark, table, create_if_missing=True, options=Options(auto_compaction=True, paranoid_checks=True, filter_policy=False))
    for i in range(5):
        db.put(b"k%d" % i, b"v")
    assert len(db.state.at_level(0)) < 4 and db.compactions["done"] + db.compactions["moved"] > 0 and len(rows(db)) == 5
    assert len(db.scan(verify_checksums=True).collect()) == 5 and len(db.multi_get([b"k1"], verify_checksums=True).collect()) == 1


def test_unknown_edits_are_corruption(spark, table):
    db = Database.open(spark, table, create_if_missing=True)
    db.folder.create(f"_commits/{1:020d}.json", json.dumps({"last_sequence": 0, "added_columns": ["x"]}))
    with pytest.raises(Corruption, match="added_columns"):
        Database.open(spark, table)


def test_compactions_can_be_cancelled(spark, table, monkeypatch):
    import threading
    import time

    from tidelog.operators import compaction
    from tidelog.schema import StoreIOError

    db = Database.open(spark, table, create_if_missing=True)
    for i in range(2):
        db.put(b"k%d" % i, b"v")
    plain = compaction.compact

    def slow(*args, **kwargs):
        wait = F.udf(lambda k: time.sleep(20) or k, "binary")
        return plain(*args, **kwargs).withColumn("key", wait("key"))

    monkeypatch.setattr(compaction, "compact", slow)
    errors = []

    def work():
        try:
            db.compact(full=True)
        except StoreIOError as e:
            errors.append(e)

    t = threading.Thread(target=work)
    began = time.time()
    t.start()
    while t.is_alive() and time.time() - began < 15:
        time.sleep(1)
        db.cancel_compactions()
    t.join(30)
    assert errors and time.time() - began < 18
    monkeypatch.undo()
    assert len(rows(db)) == 2 and db.compact(full=True) and len(rows(db)) == 2


def test_read_pipeline(spark, tmp_path):
    assert workloads.sst_read_pipeline(spark, f"{tmp_path}/p", 2, 50)["found"] == 100


def test_metrics_and_files_cut_by_the_level_beyond(spark, table):
    db = Database.open(spark, table, create_if_missing=True, key_type="string", options=Options(max_file_size=1))
    data = spark.range(200).select(F.format_string("k%05d", "id").alias("key"), F.lit(b"v").alias("value"))
    db.bulk_load(data.coalesce(1))
    assert db.compact(full=True) and len(db.state.at_level(1)) > 1
    db.scan(low="k00001", high="k00002").count()
    got = {r.name: r.value for r in db.metrics_rows().collect()}
    assert got["commits"] == 1 and got["rows_written"] == 200 and got["files_pruned"] > 0 and got["bytes_compacted"] > 0
