"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import stored

#: Edges that one task takes into a union-find forest.
TASK_EDGES = 400_000


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x] = top
            x = y
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    f = Forest()
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            f.join(x, y)
    nodes = list(f.up)
    for k in range(0, len(nodes), 100_000):
        part = nodes[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([f.root(x) for x in part], pa.int64())], ["a", "b"])


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Large-star (``both``) or small-star: hangs neighbours on the smallest one."""
    turned = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if both:
        turned = turned.unionByName(turned.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = turned.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = turned.join(least, "u")
    out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")) if both else joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for every node of ``edges(a, b)`` that isn't itself the smallest.

    Rounds: tasks of at most about ``TASK_EDGES`` edges each make a forest of their share; what is left beyond one
    task is contracted by alternating stars until nothing changes. Loops, repeated and null edges do no harm.
    """
    edges = stored(edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).where("a <> b"), "edges")
    while True:
        n = edges.count()
        tasks = max(1, math.ceil(n / TASK_EDGES))
        shares = edges.coalesce(1) if tasks == 1 else edges.repartition(tasks, "a")
        forest = shares.mapInArrow(_forest, "a bigint, b bigint")
        if tasks == 1:
            return stored(forest.select(F.col("a").alias("node"), F.col("b").alias("component")), "components")
        now = stored(_star(_star(forest, True), False), "stars")
        mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark(now) == mark(edges):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        edges = now
