"""Atomic batches of puts and deletes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.schema import DELETE, MAX_SEQUENCE, PUT, Corruption, InvalidArgument


class Handler(Protocol):
    def put(self, key, value) -> None: ...

    def delete(self, key) -> None: ...


class WriteBatch:
    """Ordered operations that take effect together; a later one on the same key wins."""

    #: Bytes of an encoded batch without records.
    HEADER = 12

    def __init__(self):
        self._rows: list[tuple] = []
        self.sequence = 0

    def put(self, key, value) -> WriteBatch:
        if value is None:
            raise InvalidArgument("a put needs a value; an empty one is legal")
        self._rows.append((PUT, key, value))
        return self

    def delete(self, key) -> WriteBatch:
        self._rows.append((DELETE, key, None))
        return self

    def append(self, other: WriteBatch) -> WriteBatch:
        self._rows.extend(list(other._rows))
        return self

    def clear(self) -> WriteBatch:
        self._rows.clear()
        self.sequence = 0
        return self

    def __len__(self) -> int:
        return len(self._rows)

    def __iter__(self) -> Iterator[tuple]:
        return iter(self._rows)

    def iterate(self, handler: Handler) -> None:
        """Replays the operations in order."""
        for op, key, value in self._rows:
            if op == PUT:
                handler.put(key, value)
            elif op == DELETE:
                handler.delete(key)
            else:
                raise Corruption(f"unknown operation in batch: {op}")

    def approximate_size(self) -> int:
        """About the bytes of the batch: header, and for each record one byte and its strings with their lengths."""
        size = lambda x: 0 if x is None else (lambda n: n + max(1, (n.bit_length() + 6) // 7))(len(x if isinstance(x, (bytes, bytearray)) else str(x).encode()))
        return self.HEADER + sum(1 + size(k) + size(v) for _, k, v in self._rows)

    def to_frame(self, spark: SparkSession, key: T.DataType | None = None, value: T.DataType | None = None) -> DataFrame:
        """``ord, op, key, value`` with ``ord`` from 0."""
        schema = T.StructType([T.StructField("ord", T.LongType(), False), T.StructField("op", T.ByteType(), False), T.StructField("key", key or T.BinaryType(), False), T.StructField("value", value or T.BinaryType(), True)])
        return spark.createDataFrame([(i, op, k, v) for i, (op, k, v) in enumerate(self._rows)], schema)


def append_frames(first: DataFrame, second: DataFrame) -> DataFrame:
    """The records of ``second`` after those of ``first`` (both ``ord, op, key, value``)."""
    offset = first.agg((F.coalesce(F.max("ord"), F.lit(-1)) + 1).alias("_offset"))  # one row
    moved = second.crossJoin(F.broadcast(offset)).withColumn("ord", F.col("ord") + F.col("_offset")).drop("_offset")
    return first.unionByName(moved)


def sequenced(batch: DataFrame, base: int) -> DataFrame:
    """Log rows of a batch whose first record takes sequence ``base``."""
    if not 0 < base <= MAX_SEQUENCE:
        raise InvalidArgument(f"sequence out of range: {base}")
    return batch.select("key", (F.col("ord") + base).cast("bigint").alias("seq"), F.col("op").cast("tinyint").alias("op"), "value")


def validate(batch: DataFrame) -> None:
    """Raises Corruption unless ``ord`` is distinct and not negative, every operation is known and every key is there."""
    bad = batch.agg(F.count("*").alias("n"), F.count_distinct("ord").alias("ords"), F.min("ord").alias("least"), F.sum(F.when(F.col("op").isin(PUT, DELETE), 0).otherwise(1)).alias("ops"), F.sum(F.col("key").isNull().cast("int")).alias("keys")).first()
    if bad.n and (bad.ords != bad.n or bad.least < 0):
        raise Corruption("batch has wrong record numbers")
    if bad.ops:
        raise Corruption("batch has an unknown operation")
    if bad["keys"]:
        raise Corruption("batch has a record without key")
