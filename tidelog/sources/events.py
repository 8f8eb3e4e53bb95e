"""Change logs made from ordinary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_log(events: DataFrame) -> DataFrame:
    """The log of an ``events`` table: key user_id/props, sequence event_id + 1, errors as tombstones."""
    return events.select(
        F.concat_ws("/", F.col("user_id").cast("string"), "props").alias("key"), (F.col("event_id") + 1).alias("seq"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("op"), "value",
    )


def bench_rows(spark: SparkSession, clients: int, operations: int, value_bytes: int) -> DataFrame:
    """Keys ``k_<client>_<i>`` with values of ``value_bytes`` letters v."""
    rows = spark.range(clients * operations)
    client, i = F.floor(F.col("id") / operations).cast("bigint"), F.col("id") % operations
    return rows.select(F.format_string("k_%d_%d", client, i).alias("key"), F.repeat(F.lit("v"), value_bytes).alias("value"))
