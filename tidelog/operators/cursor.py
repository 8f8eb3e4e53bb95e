"""Cursor movements as queries over the visible rows of a log (``key, seq, value``).

Every movement filters on the raw key first, so it reaches the scan. A single position is found among the versions nearest to it: a top-k of the raw
keys, without a shuffle, bounds the range whose visible rows are looked at; where all keys in it are dead the next, larger range follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.visibility import upto, visible
from tidelog.schema import sort_key


#: Versions that the first try of a position looks at; each further one looks at 16 times as many.
NEAR = 256


def _nearest(log: DataFrame, sequence: int | None, order: str, reverse: bool = False) -> DataFrame:
    """The first (or last) visible row."""
    by, rest, near = sort_key(order), upto(log, sequence), NEAR
    along = by.desc() if reverse else by
    while True:
        head = rest.select(by.alias("_by")).orderBy(F.col("_by").desc() if reverse else F.col("_by")).limit(near)
        n, edge = head.agg(F.count("*"), F.min("_by") if reverse else F.max("_by")).first()
        if n < near:
            return visible(rest).orderBy(along).limit(1)
        inside = by >= F.lit(edge) if reverse else by <= F.lit(edge)
        found = visible(rest.where(inside)).orderBy(along).limit(1)
        if not found.isEmpty():
            return found
        rest, near = rest.where(~inside), 16 * near


def seek_first(log: DataFrame, sequence: int | None = None, order: str = "bytewise") -> DataFrame:
    return _nearest(log, sequence, order)


def seek_last(log: DataFrame, sequence: int | None = None, order: str = "bytewise") -> DataFrame:
    return _nearest(log, sequence, order, True)


def seek(log: DataFrame, target, sequence: int | None = None, order: str = "bytewise") -> DataFrame:
    """The first live key at or after ``target``."""
    return _nearest(log.where(sort_key(order) >= sort_key(order, F.lit(target))), sequence, order)


def next_after(log: DataFrame, key, sequence: int | None = None, order: str = "bytewise") -> DataFrame:
    """The first live key after ``key``."""
    return _nearest(log.where(sort_key(order) > sort_key(order, F.lit(key))), sequence, order)


def prev_before(log: DataFrame, key, sequence: int | None = None, order: str = "bytewise") -> DataFrame:
    """The last live key before ``key``."""
    return _nearest(log.where(sort_key(order) < sort_key(order, F.lit(key))), sequence, order, True)


def scan_range(log: DataFrame, low=None, high=None, sequence: int | None = None) -> DataFrame:
    """Live keys in ``[low, high)``; an absent bound is open."""
    if low is not None:
        log = log.where(F.col("key") >= F.lit(low))
    if high is not None:
        log = log.where(F.col("key") < F.lit(high))
    return visible(log, sequence)


def scan_prefix(log: DataFrame, prefix, sequence: int | None = None) -> DataFrame:
    return visible(log.where(F.startswith(F.col("key"), F.lit(prefix))), sequence)


def scan_reverse(log: DataFrame, limit: int, before=None, sequence: int | None = None, order: str = "bytewise") -> DataFrame:
    """The last ``limit`` live keys (below ``before``), downwards."""
    if before is not None:
        log = log.where(sort_key(order) < sort_key(order, F.lit(before)))
    return visible(log, sequence).orderBy(sort_key(order).desc()).limit(limit)


#: Keys of a sample for each slice that ``neighbours`` cuts the keys into.
SAMPLE = 50


def key_cuts(keys: DataFrame, slices: int) -> list:
    """Keys that cut the distinct ``key`` of a frame into about ``slices`` equal parts; from a sample by the keys' hash, ``SAMPLE`` keys for each part."""
    every = max(1, (keys.agg(F.approx_count_distinct("key")).first()[0] or 0) // (SAMPLE * slices))
    sample = sorted(r.key for r in keys.select("key").where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).distinct().collect())
    return [sample[i * len(sample) // slices] for i in range(1, slices)] if len(sample) >= slices else []


def neighbours(log: DataFrame, sequence: int | None = None, prefix_bytes: int | None = None, slices: int | None = None) -> DataFrame:
    """Every live key with its predecessor and successor: ``key, prev_key, next_key`` (null at the ends).

    A window over all keys would be one task. Keys are cut into ``slices`` ranges (by default four for each shuffle partition) of about equal
    numbers of keys, whatever the keys look like, or by their first ``prefix_bytes`` bytes; both keep the order. What lies
    across a border is looked up in the table of the ranges' first and last keys, of one row for each.
    """
    rows = visible(log, sequence).select("key")
    if prefix_bytes is None:
        slices = slices or 4 * int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        cuts = key_cuts(log.select("key"), slices)
        marks = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast(f"array<{log.schema['key'].dataType.simpleString()}>")
        rows = rows.withColumn("_slice", F.size(F.filter(marks, lambda c: c <= F.col("key"))))
    else:
        rows = rows.withColumn("_slice", F.substring(F.col("key").cast("binary"), 1, prefix_bytes))
    within = Window.partitionBy("_slice").orderBy("key")
    rows = rows.withColumn("_prev", F.lag("key").over(within)).withColumn("_next", F.lead("key").over(within))
    along = Window.orderBy("_slice")
    borders = rows.groupBy("_slice").agg(F.min("key").alias("_low"), F.max("key").alias("_high"))
    borders = borders.select("_slice", F.lag("_high").over(along).alias("_before"), F.lead("_low").over(along).alias("_after"))
    return rows.join(borders, "_slice").select("key", F.coalesce("_prev", "_before").alias("prev_key"), F.coalesce("_next", "_after").alias("next_key"))
