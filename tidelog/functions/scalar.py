"""Scalar and ordered-statistic helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_end(prefix: bytes) -> bytes | None:
    """The smallest key above all keys with ``prefix``; nothing when there is none (only 0xff bytes)."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def escaped(key: Column) -> Column:
    """Printable form of bytes: ASCII 20 to 7E as they are, other bytes as ``\\x`` and two lower-case hex digits."""
    pairs = F.regexp_extract_all(F.hex(key.cast("binary")), F.lit("(..)"), 1)
    shown = lambda h: F.when((h >= "20") & (h <= "7E"), F.decode(F.unhex(h), "UTF-8")).otherwise(F.concat(F.lit("\\x"), F.lower(h)))
    return F.array_join(F.transform(pairs, shown), "")


def leading_number(text: Column) -> Column:
    """The decimal number that a text starts with, or null (also when it needs more than 64 bits unsigned)."""
    digits = F.regexp_extract(text, r"^(\d+)", 1)
    number = F.when(F.length(digits) <= 38, digits.cast("decimal(38,0)"))
    return F.when((digits != "") & (number <= F.lit(str(2**64 - 1)).cast("decimal(38,0)")), number)


def percentile_lower(df: DataFrame, column: str, fractions: list[float], slices: int = 200) -> DataFrame:
    """``fraction, value``: the element at floor(p * (n - 1)) of the sorted non-null values, exact and never interpolated.

    Approximate quantiles cut the values into about equal slices; slices are counted exactly, and only those that hold a wanted rank are sorted,
    each as a window partition of its own. No rows for an empty column.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value"))
    cuts = values.agg(F.percentile_approx("value", [i / slices for i in range(1, slices)], 10_000)).first()[0] or []
    marks = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    sliced = values.withColumn("_slice", F.size(F.filter(marks, lambda c: c <= F.col("value"))))
    up = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over at most ``slices`` rows
    counts = sliced.groupBy("_slice").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_upto", F.sum("_n").over(up)).withColumn("_total", F.sum("_n").over(Window.partitionBy(F.lit(0))))
    wanted = counts.select("*", F.explode(F.array(*[F.lit(float(p)) for p in fractions])).alias("fraction")).withColumn("_rank", F.floor(F.col("fraction") * (F.col("_total") - 1)))
    wanted = wanted.where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n"))).select("_slice", "fraction", (F.col("_rank") - F.col("_upto") + F.col("_n") + 1).alias("_row"))
    inside = sliced.join(wanted.select("_slice").distinct(), "_slice", "left_semi").withColumn("_row", F.row_number().over(Window.partitionBy("_slice").orderBy("value")))
    return inside.join(wanted, ["_slice", "_row"]).select("fraction", "value")
