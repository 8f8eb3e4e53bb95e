"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources.shared import shared_dir

#: One block of documents is processed by one Python call; a block holds about so many bytes of input.
BLOCK_BYTES = 8 << 20


#: Rows and bytes of one Arrow batch at most; rows can be long, and a task holds a batch several times over.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Makes the session's Arrow batches smaller, if they are larger than the bounds above."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = "".join(c for c in spark.conf.get(name) if c.isdigit() or c == "-")
        if not 0 < int(now or 0) <= most:
            spark.conf.set(name, str(most))


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """``id`` (bigint) and ``body`` (UTF-8 bytes, null for null) only, so that other columns, whatever their names, stay out.

    The columns in ``carry``, but for the text itself, come along as one struct, ``carried``; the second result is its type.
    The session's Arrow batches are made small.
    """
    small_batches(df.sparkSession)
    columns = [F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("body")]
    if not carry:
        return df.select(*columns), ""
    out = df.select(*columns, F.struct(*([c for c in carry if c != text_col] or [id_col])).alias("carried"))
    return out, out.schema["carried"].dataType.simpleString()


def carried(df: DataFrame, carry: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """Makes ``carried`` of ``body`` and the struct that came along: the fields of ``carry`` in their order."""
    if not carry:
        return df
    fields = [F.col("body").cast("string").alias(c) if c == text_col else F.col("carried")[c].alias(c) for c in carry]
    return df.withColumn("carried", F.struct(*fields)).drop("body")


def input_bytes(df: DataFrame) -> int:
    """About the bytes of ``df``: the optimiser's estimate for a plain scan of files, else counted in a pass over the rows.

    Estimates of joins multiply, and rows from elsewhere have none.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    if plan.collectLeaves().size() == 1 and size < 1 << 60:
        return max(1, size)
    text = [F.coalesce(F.length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    return max(1, df.agg(F.sum(sum(text, F.lit(64)).cast("bigint"))).first()[0] or 1)


def parts(df: DataFrame, bytes_each: int = BLOCK_BYTES, factor: float = 1.0) -> int:
    """How many partitions hold ``df`` (times ``factor``) at about ``bytes_each``; at least the session's shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(1_000_000, max(least, math.ceil(input_bytes(df) * factor / bytes_each)))


def dealt(df: DataFrame, bytes_each: int, *columns: str, ranges: bool = False) -> DataFrame:
    """Repartitioned by ``columns``: to as many partitions as hold ``df`` at ``bytes_each``; where that is fewer than the session's, Spark may join small ones.
    By ``ranges`` rows with one value of the first column may fall into several partitions."""
    n = parts(df, bytes_each)
    by = df.repartitionByRange if ranges else df.repartition
    return by(n, *columns) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else by(*columns)


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidelog-{spark.sparkContext.applicationId}"


#: Spark's switch that removes a query's shuffle files as soon as it has ended.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Queries that are planned and run within leave no shuffle files behind; their results must be written or collected."""
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(_RELEASE) if before is None else spark.conf.set(_RELEASE, before)


#: For steps in a local (mounted) folder: no checksum files beside those of Parquet's own pages. Hadoop sets each such file's permissions by starting
#: processes of the size of an executor, three for a file with its checksums, one without.
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: lineage is cut and the rows outlive lost executors.

    Results are lazy and may read these files later, so they stay until ``cleanup`` or until the folder is removed with the application's other files.
    The step's shuffle files go when it has been written.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with released(spark):
        df.write.options(**(_PLAIN if path.startswith("file:") else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of a bitmap of ids at most; beyond that it lets more rows through, which an exact join has to sort out anyway.
ID_BITS = 1 << 30
_PAGE = 1 << 15


def id_bits(ids: DataFrame) -> tuple[object, int]:
    """A broadcast bitmap of the hashes of the distinct ``id`` in ``ids``, and its number of bits: about 16 for an id, ``ID_BITS`` at most."""
    spark = ids.sparkSession
    with released(spark):
        bits = min(ID_BITS, max(_PAGE, 1 << (16 * ids.count()).bit_length()))
        at = ids.select(id_hash(F.col("id"), bits).alias("at"))
        pages = at.groupBy(F.shiftright("at", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(_PAGE - 1)).alias("bits")).collect()
    whole = np.zeros(bits // 8, np.uint8)
    for r in pages:
        whole[r.page * _PAGE // 8 : (r.page + 1) * _PAGE // 8] = np.frombuffer(r.bits, np.uint8)
    return spark.sparkContext.broadcast(whole.tobytes()), bits


def id_hash(column, bits: int):
    """The place of an id in a bitmap of ``bits`` bits."""
    return F.xxhash64(column).bitwiseAND(bits - 1)


def held(bitmap: bytes, at: np.ndarray) -> np.ndarray:
    """Whether the places ``at`` are set."""
    raw = np.frombuffer(bitmap, np.uint8)
    return (raw[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def cleanup(spark: SparkSession) -> None:
    """Removes what this application's operators have stored; to be called when their results have been written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser (multiply and xor-shift), to spread hash values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
