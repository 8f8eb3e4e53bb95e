"""What a reader sees of a log at a sequence: per key the newest version not above it, unless that is a tombstone.

The tombstone filter stands after the choice of the newest version, never before it. Filters on ``key`` that callers put on the result reach
the scan, since ``key`` partitions the window; ``row_number() = 1`` is planned as a group limit before and after the shuffle, so a key with
many versions sends one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.schema import DELETE, PUT


def upto(log: DataFrame, sequence: int | Column | None) -> DataFrame:
    return log if sequence is None else log.where(F.col("seq") <= sequence)


def latest(log: DataFrame, sequence: int | None = None) -> DataFrame:
    """The newest version of each key at ``sequence``, tombstones included."""
    newest = Window.partitionBy("key").orderBy(F.col("seq").desc(), F.col("op").desc())
    return upto(log, sequence).withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def visible(log: DataFrame, sequence: int | None = None) -> DataFrame:
    """Live keys at ``sequence``: ``key, seq, value``."""
    return latest(log, sequence).where(F.col("op") == PUT).drop("op")


def get(log: DataFrame, key, sequence: int | None = None) -> DataFrame:
    """At most one row, ``key, seq, value``: a top-1 over the versions of one key."""
    rows = upto(log, sequence).where(F.col("key") == F.lit(key)).orderBy(F.col("seq").desc(), F.col("op").desc()).limit(1)
    return rows.where(F.col("op") == PUT).drop("op")


def get_status(log: DataFrame, keys: Sequence, sequence: int | None = None) -> DataFrame:
    """One row for each key asked for: ``key, status, value`` with status ``found``, ``deleted`` or ``absent``."""
    spark = log.sparkSession
    probes = spark.createDataFrame([(k,) for k in keys], f"key {log.schema['key'].dataType.simpleString()}")
    found = latest(log.where(F.col("key").isin(list(keys))), sequence)
    status = F.when(F.col("op").isNull(), "absent").when(F.col("op") == DELETE, "deleted").otherwise("found")
    return probes.join(found, "key", "left").select("key", status.alias("status"), F.when(F.col("op") == PUT, F.col("value")).alias("value"))


def multi_get(log: DataFrame, keys: DataFrame, sequence: int | None = None) -> DataFrame:
    """Live versions of the keys in ``keys.key`` (repeats don't matter). Spark sizes the semi join: a small side is broadcast at run time."""
    return visible(log.join(keys.select("key"), "key", "left_semi"), sequence)


def as_of_multi_get(log: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe ``(key, as_of)``: the live version at its own sequence, ``key, as_of, seq, value`` (null where there is none).

    Probes and versions are put in one order, in which each probe takes the last version before it; so the rows are those of both, never
    their product, and a task holds one version of a key at a time.
    """
    kinds = {f.name: f.dataType for f in log.schema.fields}
    marks = probes.select("key", "as_of").distinct().select(F.col("key").cast(kinds["key"]).alias("key"), F.col("as_of").cast("bigint").alias("_at"), F.lit(True).alias("_probe"), F.lit(None).cast("tinyint").alias("_op"), F.lit(None).cast("struct<seq:bigint,op:tinyint>").alias("_v"), F.lit(None).cast(kinds["value"]).alias("_value"))
    version = F.struct(F.col("seq").cast("bigint").alias("seq"), F.col("op").cast("tinyint").alias("op"))
    versions = log.join(marks.select("key"), "key", "left_semi").select("key", F.col("seq").cast("bigint").alias("_at"), F.lit(False).alias("_probe"), F.col("op").cast("tinyint").alias("_op"), version.alias("_v"), F.col("value").alias("_value"))
    before = Window.partitionBy("key").orderBy("_at", "_probe", "_op").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.last(F.when(~F.col("_probe"), F.struct("_v", "_value")), ignorenulls=True).over(before)
    answered = versions.unionByName(marks).withColumn("_seen", seen).where("_probe")
    live = F.col("_seen._v.op") == PUT
    return answered.select("key", F.col("_at").alias("as_of"), F.when(live, F.col("_seen._v.seq")).alias("seq"), F.when(live, F.col("_seen._value")).alias("value"))


def raw_versions(log: DataFrame) -> DataFrame:
    """All versions with their rank in their key, the newest first; tombstones included."""
    return log.withColumn("version", F.row_number().over(Window.partitionBy("key").orderBy(F.col("seq").desc(), F.col("op").desc())))


def version_history(log: DataFrame) -> DataFrame:
    """Per key: numbers of versions and tombstones, first and last sequence."""
    return log.groupBy("key").agg(F.count("*").alias("versions"), F.sum(F.when(F.col("op") == DELETE, 1).otherwise(0)).alias("tombstones"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def snapshot_diff(log: DataFrame, before: int, after: int) -> DataFrame:
    """Keys whose visible value differs between two sequences: ``key, change, old_value, new_value``.

    One aggregation: the newest version of each key at either sequence, side by side. Tasks combine their versions before the shuffle, so a key with
    many of them sends one row per task.
    """
    newest = lambda s: F.max_by(F.struct("seq", "op", "value"), F.when(F.col("seq") <= s, F.struct("seq", "op")))
    sides = upto(log, max(before, after)).groupBy("key").agg(newest(before).alias("old"), newest(after).alias("new"))
    sides = sides.select("key", *[F.when(F.col(c)["op"] == PUT, F.col(c)).alias(c) for c in ("old", "new")])
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    differs = (F.col("old").isNull() != F.col("new").isNull()) | (F.col("old.seq") != F.col("new.seq")) & ~F.col("old.value").eqNullSafe(F.col("new.value"))
    return sides.where(differs).select("key", change.alias("change"), F.col("old.value").alias("old_value"), F.col("new.value").alias("new_value"))
