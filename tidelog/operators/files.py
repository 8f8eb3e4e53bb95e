"""Queries over file metadata: ``level, number, size, smallest, largest`` and (where it matters) ``smallest_seq, largest_seq``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the level policy.
LEVELS = 7
L0_TRIGGER, L0_SLOWDOWN, L0_STOP = 4, 8, 12
L1_BYTES, LEVEL_FACTOR = 10 * 1024 * 1024, 10
GRANDPARENT_FACTOR, EXPAND_FACTOR = 10, 25


def find_file(files: DataFrame, key) -> DataFrame:
    """The first file of a sorted level whose largest key is at or after ``key``."""
    return files.where(F.col("largest") >= F.lit(key)).orderBy("largest").limit(1)


def overlapping_files(files: DataFrame, low=None, high=None) -> DataFrame:
    """Files whose range meets ``[low, high]``; an absent bound is open."""
    if low is not None:
        files = files.where(F.col("largest") >= F.lit(low))
    if high is not None:
        files = files.where(F.col("smallest") <= F.lit(high))
    return files


def level_invariant(files: DataFrame) -> DataFrame:
    """Neighbours of levels 1 and deeper that overlap, in key order with newer sequences first: no rows when the levels are sorted and disjoint."""
    along = Window.partitionBy("level").orderBy("smallest", F.col("smallest_seq").desc())
    before = files.where("level > 0").withColumn("_key", F.lag("largest").over(along)).withColumn("_seq", F.lag("largest_seq").over(along)).withColumn("prev_number", F.lag("number").over(along))
    sorted_ = (F.col("_key") < F.col("smallest")) | (F.col("_key") == F.col("smallest")) & (F.col("_seq") > F.col("smallest_seq"))
    return before.where(F.col("_key").isNotNull() & ~sorted_).select("level", "prev_number", "number")


def level_scores(files: DataFrame) -> DataFrame:
    """``level, files, bytes, score`` of the levels that have files and aren't the last: files over 4 at level 0, else bytes over the level's limit."""
    limit = F.lit(float(L1_BYTES)) * F.pow(F.lit(float(LEVEL_FACTOR)), F.col("level") - 1)
    per = files.where(F.col("level") < LEVELS - 1).groupBy("level").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return per.withColumn("score", F.when(F.col("level") == 0, F.col("files") / F.lit(float(L0_TRIGGER))).otherwise(F.col("bytes") / limit))


def pick_level(files: DataFrame) -> DataFrame:
    """The level with the highest score (the upper one on ties)."""
    return level_scores(files).orderBy(F.col("score").desc(), "level").limit(1)


def stall_state(l0_files: Column) -> Column:
    return F.when(l0_files >= L0_STOP, "stop").when(l0_files >= L0_SLOWDOWN, "slowdown").otherwise("none")


def manifest_fold(actions: DataFrame) -> DataFrame:
    """Live files from ``commit, ord, action, level, number, ...``: the last action of each file decides, and within a commit an add after a remove revives."""
    last = Window.partitionBy("level", "number").orderBy(F.col("commit").desc(), F.col("ord").desc())
    return actions.withColumn("_rank", F.row_number().over(last)).where("_rank = 1 AND action = 'add'").drop("_rank", "action", "ord")


def obsolete_files(listing: DataFrame, live: DataFrame) -> DataFrame:
    """Files found in storage (``number``) that no retained version names."""
    return listing.join(live.select("number").distinct(), "number", "left_anti")


def boundary_inputs(level_files: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen files plus those of the level that share a user key at a border with them, however long the chain.

    Files that share border keys form runs of a sorted level, so a running count of breaks numbers the runs; no iteration.
    """
    along = Window.partitionBy("level").orderBy("smallest", F.col("smallest_seq").desc(), "number")
    start = F.coalesce((F.lag("largest").over(along) != F.col("smallest")).cast("int"), F.lit(1))
    runs = level_files.withColumn("_start", start).withColumn("_run", F.sum("_start").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    wanted = runs.join(chosen.select("level", "number"), ["level", "number"], "left_semi").select("level", "_run").distinct()
    return runs.join(wanted, ["level", "_run"], "left_semi").drop("_start", "_run")


def approximate_offset(files: DataFrame, key) -> DataFrame:
    """One row ``bytes``: about how many bytes of files lie before ``key`` (files that hold it count half)."""
    share = F.when(F.col("largest") < F.lit(key), 1.0).when(F.col("smallest") >= F.lit(key), 0.0).otherwise(0.5)
    return files.agg(F.coalesce(F.sum(F.col("size") * share), F.lit(0.0)).cast("bigint").alias("bytes"))


def run_stats(log: DataFrame, run: Column) -> DataFrame:
    """Per run: rows, smallest and largest key, first and last sequence: what a flush records of a file."""
    return log.groupBy(run.alias("run")).agg(F.count("*").alias("rows"), F.min("key").alias("smallest"), F.max("key").alias("largest"), F.min("seq").alias("smallest_seq"), F.max("seq").alias("largest_seq"))
