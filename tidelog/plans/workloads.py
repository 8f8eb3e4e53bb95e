"""The benchmark workloads as batch jobs on a table: mixed, cold reads, durable writes, and reads during a compaction."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.asyncdb import AsyncDatabase
from tidelog.batch import WriteBatch
from tidelog.sources.events import bench_rows
from tidelog.store import Database


def _timed(f) -> tuple[float, object]:
    began = time.perf_counter()
    out = f()
    return time.perf_counter() - began, out


def reads_of(rows: DataFrame, read_percent: int) -> DataFrame:
    """The share of keys that a client reads rather than writes, chosen by hash."""
    return rows.where(F.pmod(F.xxhash64("key"), F.lit(100)) < read_percent)


def mixed(spark: SparkSession, path: str, clients: int = 8, operations: int = 1000, value_bytes: int = 100, read_percent: int = 50) -> dict:
    """Prefill, then upsert one part of the keys and look up the other."""
    rows = bench_rows(spark, clients, operations, value_bytes)
    with Database.open(spark, path, create_if_missing=True, key_type="string") as db:
        fill, _ = _timed(lambda: db.bulk_load(rows))
        writes = rows.exceptAll(reads_of(rows, read_percent))
        write, _ = _timed(lambda: db.bulk_load(writes))
        read, found = _timed(lambda: db.multi_get(reads_of(rows, read_percent)).count())
    return {"prefill_s": fill, "write_s": write, "read_s": read, "found": found}


def disk_read(spark: SparkSession, path: str, clients: int = 8, operations: int = 1000, value_bytes: int = 100) -> dict:
    """Prefill, reopen, look up every key. Served asynchronously by several readers it is the pipelined table read."""
    rows = bench_rows(spark, clients, operations, value_bytes)
    with Database.open(spark, path, create_if_missing=True, key_type="string") as db:
        db.bulk_load(rows)
    with Database.open(spark, path) as db:
        read, found = _timed(lambda: db.multi_get(rows).count())
    return {"read_s": read, "found": found}


def sst_read_pipeline(spark: SparkSession, path: str, clients: int = 8, operations: int = 1000, value_bytes: int = 100, readers: int = 4) -> dict:
    """Prefill, reopen, and look up every key with several lookups under way at once, one for each client's keys."""
    rows = bench_rows(spark, clients, operations, value_bytes)
    with Database.open(spark, path, create_if_missing=True, key_type="string") as db:
        db.bulk_load(rows)
    pipeline = AsyncDatabase(Database.open(spark, path), readers)
    try:
        own = [rows.where(F.startswith("key", F.lit(f"k_{c}_"))).select("key") for c in range(clients)]
        read, found = _timed(lambda: sum(len(f.result()) for f in [pipeline.multi_get_async(keys) for keys in own]))
    finally:
        pipeline.close()
    return {"read_s": read, "found": found}


def durability_write(spark: SparkSession, path: str, commits: int = 5) -> dict:
    """Small commits one after another; each is durable when it returns."""
    times = []
    with Database.open(spark, path, create_if_missing=True) as db:
        for i in range(commits):
            times.append(_timed(lambda i=i: db.write(WriteBatch().put(b"d_%d" % i, b"v")))[0])
    return {"commits": commits, "mean_s": sum(times) / len(times), "max_s": max(times)}


def compaction_overlap(spark: SparkSession, path: str, clients: int = 4, operations: int = 1000, readers: int = 2) -> dict:
    """Readers of a snapshot while the table takes ``cw_`` keys and is compacted; they must see the same rows throughout."""
    rows = bench_rows(spark, clients, operations, 100)
    with Database.open(spark, path, create_if_missing=True, key_type="string") as db:
        db.bulk_load(rows)
        with db.snapshot() as seen, ThreadPoolExecutor(readers) as pool:
            expected = db.scan(seen).count()
            files = list(db.state.files.values())
            counts = [pool.submit(lambda: db.log(seen, files=files).count()) for _ in range(readers)]
            db.bulk_load(rows.withColumn("key", F.concat(F.lit("cw_"), "key")))
            compacted = db.compact(full=True)
            same = all(c.result() == expected for c in counts) and db.scan(seen).count() == expected
    return {"rows": expected, "compacted": compacted, "same": same}
