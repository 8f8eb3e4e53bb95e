import pytest
from pyspark.sql import functions as F

from tidelog.functions.scalar import escaped, leading_number, percentile_lower, prefix_end
from tidelog.operators import files
from tidelog.plans import picking
from tidelog.sources.commits import DataFile, State

RANGES = [(1, 1, 10, "100", "200", 1, 1), (1, 2, 10, "300", "400", 1, 1), (1, 3, 10, "500", "600", 1, 1)]
SCHEMA = "level int, number bigint, size bigint, smallest string, largest string, smallest_seq bigint, largest_seq bigint"


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(RANGES, SCHEMA)


def test_find_and_overlap(frame):
    for keys, number in ((("050", "100", "150", "200"), 1), (("250", "299", "300", "350", "400"), 2), (("450", "499", "500", "550", "600"), 3), (("650", "999"), None)):
        for key in keys:
            row = files.find_file(frame, key).first()
            assert (row.number if row else None) == number
    for low, high, expected in ((None, "250", True), ("350", None, True), (None, None, True), ("050", "099", False), ("650", "999", False), ("150", "550", True), ("200", "300", True)):
        assert (not files.overlapping_files(frame, low, high).isEmpty()) == expected


def test_invariant(spark, frame):
    assert files.level_invariant(frame).isEmpty()
    for bad in ([(1, 1, 1, "100", "300", 100, 100), (1, 2, 1, "300", "400", 100, 100)], [(2, 1, 1, "a", "f", 1, 1), (2, 2, 1, "c", "g", 1, 1)]):
        assert files.level_invariant(spark.createDataFrame(bad, SCHEMA)).count() == 1
    assert files.level_invariant(spark.createDataFrame([(1, 1, 1, "100", "300", 9, 9), (1, 2, 1, "300", "400", 5, 5)], SCHEMA)).isEmpty()


def test_scores(spark):
    l0 = spark.createDataFrame([(0, i, 65536, "a", "b", 1, 1) for i in range(5)], SCHEMA)
    assert files.pick_level(l0).first().asDict() == {"level": 0, "files": 5, "bytes": 5 * 65536, "score": 1.25}
    l1 = spark.createDataFrame([(1, 1, 15 << 20, "a", "b", 1, 1)], SCHEMA)
    assert (files.pick_level(l1).first().level, files.pick_level(l1).first().score) == (1, 1.5)


def test_boundary_inputs(spark):
    own = spark.createDataFrame([(1, 1, 1, "100", "100", 3, 2), (1, 2, 1, "100", "200", 1, 3), (1, 3, 1, "300", "300", 1, 1)], SCHEMA)
    chosen = own.where("number = 1")
    assert {r.number for r in files.boundary_inputs(own, chosen).collect()} == {1, 2}


def test_manifest_fold(spark):
    acts = [(0, 0, "add", 0, 10), (0, 1, "add", 0, 20), (0, 2, "add", 1, 100), (0, 3, "add", 1, 200), (1, 0, "remove", 0, 20), (1, 1, "remove", 1, 100), (1, 2, "add", 0, 30), (1, 3, "add", 1, 150), (1, 4, "remove", 1, 200), (1, 5, "add", 1, 200)]
    live = files.manifest_fold(spark.createDataFrame(acts, "commit bigint, ord int, action string, level int, number bigint"))
    assert {(r.level, r.number) for r in live.collect()} == {(0, 10), (0, 30), (1, 150), (1, 200)}


def made(level, number, low, high, size=10):
    return DataFile(f"f{number}", level, number, size, 1, 0, low.encode().hex(), high.encode().hex(), 1, 1)


def test_picking_closes_over_overlaps():
    own = [made(0, 4, "a", "c"), made(0, 3, "b", "e"), made(0, 2, "d", "f"), made(0, 1, "x", "y"), made(1, 10, "a", "d")]
    plan = picking.pick(State(files={f.path: f for f in own}))
    assert {f.number for f in plan.inputs} == {4, 3, 2, 10} and not plan.trivial and plan.target == 1
    heavy = [made(1, 1, "a", "z", 12 << 20), made(3, 2, "a", "m", 11 << 20), made(3, 3, "n", "z", 11 << 20)]
    assert picking.pick(State(files={f.path: f for f in heavy})).trivial is False
    assert picking.pick(State(files={"f1": heavy[0]})).trivial is True
    assert picking.pick(State()) is None


def test_scalars(spark):
    assert prefix_end(b"ab") == b"ac" and prefix_end(b"a\xff") == b"b" and prefix_end(b"\xff") is None
    one = spark.createDataFrame([(bytearray(b"a\0\xffz"), "123abc")], "k binary, t string").select(escaped(F.col("k")).alias("e"), leading_number(F.col("t")).alias("n")).first()
    assert one.e == "a\\x00\\xffz" and one.n == 123
    none = spark.createDataFrame([("x1",), (str(2**64),)], "t string").select(leading_number(F.col("t")).alias("n")).collect()
    assert [r.n for r in none] == [None, None]
    values = spark.createDataFrame([(float(v),) for v in (5, 1, 4, 2, 3, 3)], "v double")
    got = {r.fraction: r.value for r in percentile_lower(values, "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    assert got == {0.0: 1.0, 0.5: 3.0, 0.95: 4.0, 1.0: 5.0}
    assert percentile_lower(values.limit(0), "v", [0.5]).isEmpty()


def test_flush_level():
    state = State(files={f.path: f for f in [made(1, 1, "m", "p"), made(2, 2, "a", "b"), made(3, 3, "x", "z", 30 << 20)]})
    flat = lambda low, high: picking.flush_level(state, low.encode().hex(), high.encode().hex())
    assert [flat("n", "o"), flat("a", "c"), flat("f", "g"), flat("x", "y")] == [0, 1, 2, 1]
