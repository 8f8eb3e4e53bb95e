"""Garbage collection of a log as set operations, and the policies that decide what to compact.

For inputs I, watermark W and the key ranges D of deeper files: a version goes when the next newer version of its key among the inputs is not above
W (rule A); else a tombstone goes when it is not above W and no deeper file may hold its key (rule B). For every read sequence
at or above W the visible rows stay the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.visibility import latest
from tidelog.schema import DELETE, InvalidArgument

#: Deeper key ranges up to which the range join is worth broadcasting; beyond it keys are looked up by an equality join.
RANGE_LIMIT = 10_000


def rule_a(inputs: DataFrame, watermark: int) -> DataFrame:
    """The next newer version of a dropped one is not above W, so of a key's versions up to W the newest stays alone, and all above W stay.

    The latter aren't shuffled; of the former each task sends one for a key, so a key with very many versions loads no task.
    """
    columns = inputs.columns
    return inputs.where(F.col("seq") > watermark).unionByName(latest(inputs, watermark).select(*columns))


def compact(inputs: DataFrame, watermark: int, deeper: DataFrame | None = None, deeper_keys: DataFrame | None = None, n_deeper: int | None = None) -> DataFrame:
    """Both rules. ``deeper``: ranges ``smallest, largest`` of deeper files (none: a full compaction); ``deeper_keys``: their
    keys, used instead where ``n_deeper`` ranges are too many to compare with each tombstone. Ranges keep more tombstones than keys do;
    what readers see is the same.
    """
    above, below = inputs.where(F.col("seq") > watermark), latest(inputs, watermark).select(*inputs.columns)
    rest, dead = above.unionByName(below.where(F.col("op") != DELETE)), below.where(F.col("op") == DELETE)
    if deeper is None and deeper_keys is None:
        return rest
    if deeper is not None and n_deeper is None:
        n_deeper = deeper.count()
    if deeper is not None and n_deeper > RANGE_LIMIT and deeper_keys is None:
        raise InvalidArgument(f"{n_deeper} deeper ranges are too many to compare with each tombstone; name their keys")
    if deeper is not None and n_deeper <= RANGE_LIMIT:
        ranges = deeper.select(F.col("smallest").alias("_low"), F.col("largest").alias("_high"))
        kept = dead.join(ranges, (F.col("key") >= F.col("_low")) & (F.col("key") <= F.col("_high")), "left_semi")
    else:
        kept = dead.join(deeper_keys.select("key"), "key", "left_semi")
    return rest.unionByName(kept)


def preserves_visible(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts of visible rows lost and gained (both expected to be 0): one row ``lost, gained``."""
    cols = ["key", "value"]
    lost, gained = before.select(*cols).exceptAll(after.select(*cols)), after.select(*cols).exceptAll(before.select(*cols))
    counts = lost.agg(F.count("*").alias("lost")).crossJoin(gained.agg(F.count("*").alias("gained")))  # one row each
    return counts


def gc_watermark(snapshots: list[int], head: int) -> int:
    """The oldest live snapshot, else the head (0 for an empty log); versions above it must be kept as they are."""
    return min(snapshots) if snapshots else max(0, head)
