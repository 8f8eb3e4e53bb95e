"""Truth tables and random logs against a model of a few lines."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import compaction, cursor, visibility

SCHEMA = "key string, seq bigint, op int, value string"

CASES = [
    ([("foo", 100, 1, "v1"), ("foo", 200, 1, "v2"), ("foo", 300, 1, "v3")], "foo", {300: "v3", 250: "v2", 200: "v2", 150: "v1", 100: "v1", 99: None}),
    ([("foo", 100, 1, "bar"), ("foo", 200, 0, None)], "foo", {200: None, 150: "bar", 100: "bar"}),
    ([("foo", 100, 0, None)], "foo", {100: None}),
    ([("foo", 100, 1, "v1"), ("foo", 200, 0, None), ("foo", 300, 1, "v2")], "foo", {300: "v2", 200: None, 100: "v1"}),
    ([("foo", 1, 1, "")], "foo", {1: ""}),
]


@pytest.mark.parametrize("rows,key,expected", CASES)
def test_versions(spark, rows, key, expected):
    log = spark.createDataFrame(rows, SCHEMA)
    for s, value in expected.items():
        row = visibility.get(log, key, s).first()
        assert (row.value if row else None) == value
        assert {r.key: r.value for r in visibility.visible(log, s).collect()} == ({} if value is None else {key: value})


def test_binary_keys_and_order(spark):
    rows = [(bytearray(b"key\0with\0nulls"), 100, 1, bytearray(b"val\0ue\0")), (bytearray(b""), 1, 1, bytearray(b"e")), (bytearray(b"a"), 2, 1, bytearray(b"")), (bytearray(b"a\0"), 3, 1, bytearray(b"x")), (bytearray(b"\xff"), 4, 1, bytearray(b"y"))]
    log = spark.createDataFrame(rows, "key binary, seq bigint, op int, value binary")
    assert bytes(visibility.get(log, bytearray(b"key\0with\0nulls")).first().value) == b"val\0ue\0"
    assert [bytes(r.key) for r in visibility.visible(log).orderBy("key").collect()] == [b"", b"a", b"a\0", b"key\0with\0nulls", b"\xff"]
    assert bytes(cursor.seek_last(log).first().key) == b"\xff"


def model(rows, s):
    state = {}
    for k, q, op, v in sorted(rows, key=lambda r: r[1]):
        if q <= s:
            if op:
                state[k] = v
            else:
                state.pop(k, None)
    return state


def random_log(rng, n):
    return [(f"k{rng.randrange(8)}", q + 1, rng.randrange(3) > 0 and 1 or 0, f"v{q}") for q in range(n)]


def test_random_logs_and_compaction(spark):
    """200 logs in one frame each for reads and for compaction at every sequence at or above the watermark."""
    rng = random.Random(7)
    logs = [random_log(rng, rng.randrange(1, 14)) for _ in range(200)]
    watermarks = [rng.randrange(0, 14) for _ in logs]
    rows = [(f"{i}/{k}", q, op, v) for i, log in enumerate(logs) for k, q, op, v in log]
    log = spark.createDataFrame(rows, SCHEMA).cache()
    for s in (1, 4, 9, 20):
        expected = {f"{i}/{k}": v for i, own in enumerate(logs) for k, v in model(own, s).items()}
        assert {r.key: r.value for r in visibility.visible(log, s).collect()} == expected
    for w in (0, 3, 7, 13):
        kept = compaction.compact(log, w).cache()
        assert kept.count() <= log.count()
        for s in {w, w + 2, 20}:
            before = {(r.key, r.value) for r in visibility.visible(log, s).collect()}
            assert {(r.key, r.value) for r in visibility.visible(kept, s).collect()} == before
        inputs, older = log.where("seq > 5"), log.where("seq <= 5")
        for partial in (compaction.compact(inputs, w, older.groupBy().agg(F.min("key").alias("smallest"), F.max("key").alias("largest"))), compaction.compact(inputs, w, deeper_keys=older.select("key"))):
            s = max(w, 6)
            assert {(r.key, r.value) for r in visibility.visible(partial.unionByName(older), s).collect()} == {(r.key, r.value) for r in visibility.visible(log, s).collect()}
    assert watermarks


@pytest.mark.parametrize("rows,w,kept", [
    ([("k", 2, 1, "new"), ("k", 1, 1, "old")], 1, {2, 1}),
    ([("k", 3, 1, "newest"), ("k", 2, 0, None), ("k", 1, 1, "base")], 3, {3}),
    ([("k", 4, 0, None), ("k", 3, 1, "o"), ("z", 1, 1, "z")], 2, {4, 3, 1}),
    ([("k", 4, 0, None), ("k", 3, 1, "o")], 4, set()),
])
def test_rules(spark, rows, w, kept):
    assert {r.seq for r in compaction.compact(spark.createDataFrame(rows, SCHEMA), w).collect()} == kept


def test_tombstone_stays_above_deeper_data(spark):
    log = spark.createDataFrame([("d", 2, 0, None)], SCHEMA)
    deeper = spark.createDataFrame([("a", "f")], "smallest string, largest string")
    assert compaction.compact(log, 5, deeper).count() == 1
    assert compaction.compact(log, 5, deeper_keys=spark.createDataFrame([("e",)], "key string")).count() == 0


def test_neighbours(spark):
    rng = random.Random(3)
    keys = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(0, 6))) for _ in range(80)})
    log = spark.createDataFrame([(k, i + 1, 1, "v") for i, k in enumerate(keys)], SCHEMA)
    got = {r.key: (r.prev_key, r.next_key) for r in cursor.neighbours(log, prefix_bytes=2).collect()}
    assert got == {k: (keys[i - 1] if i else None, keys[i + 1] if i + 1 < len(keys) else None) for i, k in enumerate(keys)}


def test_neighbours_by_a_sample_of_keys(spark):
    """All keys share a long prefix, so bytes don't spread them."""
    keys = [f"common/prefix/{i:05d}" for i in range(700)]
    log = spark.createDataFrame([(k, i + 1, 1, "v") for i, k in enumerate(keys)] + [("common/prefix/00007", 900, 0, None)], SCHEMA)
    live = [k for k in keys if not k.endswith("00007")]
    for slices in (1, 6, 5000):
        got = {r.key: (r.prev_key, r.next_key) for r in cursor.neighbours(log, slices=slices).collect()}
        assert got == {k: (live[i - 1] if i else None, live[i + 1] if i + 1 < len(live) else None) for i, k in enumerate(live)}
    cuts = cursor.key_cuts(log.select("key"), 6)
    sizes = [sum(a <= k < b for k in keys) for a, b in zip(["", *cuts], [*cuts, "~"])]
    assert len(cuts) == 5 and max(sizes) < 3 * 700 / 6
    assert cursor.neighbours(log.limit(0)).count() == 0


def test_positions_beyond_many_dead_keys(spark, monkeypatch):
    monkeypatch.setattr(cursor, "NEAR", 4)
    rows = [(f"k{i:03d}", i + 1, 1, "v") for i in range(100)] + [(f"k{i:03d}", i + 200, 0, None) for i in range(100) if i not in (50, 60)]
    log = spark.createDataFrame(rows, SCHEMA)
    one = lambda df: df.first().key
    assert (one(cursor.seek_first(log)), one(cursor.seek_last(log)), one(cursor.next_after(log, "k050")), one(cursor.prev_before(log, "k060"))) == ("k050", "k060", "k060", "k050")
    assert cursor.next_after(log, "k060").count() == 0 and cursor.seek(log, "zz").count() == 0
    assert one(cursor.seek_first(log, 100)) == "k000"


def test_as_of_and_diff_of_a_hot_key(spark):
    """One key with most of the versions; answers as by the model."""
    rng = random.Random(17)
    rows = [(f"k{rng.choice([0, 0, 0, 0, 1, 2])}", q + 1, int(rng.random() < 0.7), f"v{q}") for q in range(400)]
    log = spark.createDataFrame(rows, SCHEMA)
    probes = [(f"k{i % 4}", s) for i, s in enumerate(range(0, 420, 3))]
    got = {(r.key, r.as_of): r.value for r in visibility.as_of_multi_get(log, spark.createDataFrame(probes + probes[:3], "key string, as_of bigint")).collect()}
    assert got == {(k, s): model(rows, s).get(k) for k, s in probes}
    for a, b in ((0, 400), (100, 300), (399, 400)):
        before, after = model(rows, a), model(rows, b)
        diff = {r.key: (r.old_value, r.new_value) for r in visibility.snapshot_diff(log, a, b).collect()}
        assert diff == {k: (before.get(k), after.get(k)) for k in before.keys() | after.keys() if before.get(k) != after.get(k)}
