"""Embedding near-duplicates by an epsilon grid order join.

Vectors of one label, scaled to length one, lie within epsilon = sqrt(2 - 2 cos) of each other when they link. They are
projected on the leading principal axes of all vectors (a projection never lengthens a distance), put into cells of
side epsilon, and sorted by cell. The sorted sequence is cut into blocks of a fixed size, sooner where the cell changes. The join recurses over pairs
of sequence intervals, each level a join of the surviving pairs with the 32 parts of either interval, and drops a pair as soon as the
bounding boxes of the two are more than epsilon apart; what is left are pairs of blocks. In a pair the recursion goes on over runs of ``RUN`` vectors, and what still
isn't provably distant is compared exactly in double precision. Equal vectors are one class with a count. A pair of blocks reports link counts and
a spanning forest of its links, never the links themselves.

Blocks can be skipped where the leading axes tell vectors apart, as in clustered data. Of vectors that fill all directions alike no
eight axes prove a distance, and all blocks of a label are compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import small_batches, stored
from tidelog.llm.components import components

AXES = 8
#: Vectors of a block, and of a run within it.
BLOCK, RUN = 512, 64
#: Bits of a block's number that one level of the recursion resolves.
FAN = 5


def _unit(i: int | None, label: str | None, v: list[float] | None) -> np.ndarray | None:
    """The vector scaled to length one, or nothing where it can't link."""
    if i is None or label is None or not v or None in v:
        return None
    x = np.asarray(v, np.float64)
    top = float(np.abs(x).max())
    if not np.isfinite(x).all() or top == 0:
        return None
    x = x / top
    return x / math.sqrt(float(x @ x))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors that can link: scaled to length one, with a digest of the raw values."""
    for b in batches:
        ids, labels, digests, units = [], [], [], []
        for i, label, v in zip(*(c.to_pylist() for c in b.columns)):
            if (unit := _unit(i, label, v)) is None:
                continue
            ids.append(i)
            labels.append(f"{len(v)}/{label}")
            digests.append(hashlib.blake2b(np.asarray(v, np.float64).tobytes(), digest_size=16).digest())
            units.append(unit.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(digests, pa.binary()), pa.array(units, pa.binary())], ["id", "label", "digest", "unit"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each length of vectors: number, sum and sum of outer products."""
    sums: dict[int, list] = {}
    for b in batches:
        by: dict[int, list[bytes]] = {}
        for u in b.column("unit").to_pylist():
            by.setdefault(len(u) // 8, []).append(u)
        for d, us in by.items():
            x = np.frombuffer(b"".join(us), np.float64).reshape(-1, d)
            old = sums.get(d, [0, 0.0, 0.0])
            sums[d] = [old[0] + len(x), old[1] + x.sum(0), old[2] + x.T @ x]
    yield _moment_rows(sums)


def _moment_rows(sums: dict[int, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1].tobytes() for v in sums.values()], pa.binary()), pa.array([v[2].tobytes() for v in sums.values()], pa.binary())], ["d", "n", "sums", "outer"])


def _moment_sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for b in batches:
        for d, n, s, o in zip(*(c.to_pylist() for c in b.columns)):
            old = sums.get(d, [0, 0.0, 0.0])
            sums[d] = [old[0] + n, old[1] + np.frombuffer(s), old[2] + np.frombuffer(o).reshape(d, d)]
    yield _moment_rows(sums)


def _axes(units: DataFrame, k: int) -> dict[int, np.ndarray]:
    """The leading principal axes for each length of vectors; what comes to the driver is of fixed size for a length."""
    schema = "d int, n bigint, sums binary, outer binary"
    rows = units.select("unit").mapInArrow(_moments, schema).repartition(8).mapInArrow(_moment_sum, schema).collect()
    out: dict[int, list] = {}
    for r in rows:
        old = out.get(r.d, [0, 0.0, 0.0])
        out[r.d] = [old[0] + r.n, old[1] + np.frombuffer(r.sums), old[2] + np.frombuffer(r.outer).reshape(r.d, r.d)]
    axes = {}
    for d, (n, s, o) in out.items():
        mean = s / n
        values, vectors = np.linalg.eigh(o / n - np.outer(mean, mean))
        axes[d] = np.ascontiguousarray(vectors[:, np.argsort(-values)[:k]])
    return axes


def _placed(axes, eps: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [[] for _ in range(k)]
            for u in b.column("unit").to_pylist():
                x = np.frombuffer(u, np.float64)
                p = x @ axes.value[len(x)]
                for j in range(k):
                    cells[j].append(int(math.floor(p[j] / eps)) if j < len(p) else 0)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.int32()) for c in cells)], [*b.schema.names, *(f"c{j}" for j in range(k))])

    return run


def _blocks(axes, size: int, k: int):
    """Blocks of sorted vectors: of one label and at most ``size``, sooner where the cell changes on one of the first four axes and a quarter of that is reached. ``part`` and
    ``place`` number them in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[tuple] = []
        made = 0

        def block() -> pa.RecordBatch:
            nonlocal made
            raw = b"".join([h[3] for h in held])
            x = np.frombuffer(raw, np.float64).reshape(len(held), -1)
            low, high = (np.zeros(k) for _ in range(2))
            p = x @ axes.value[x.shape[1]]
            low[: p.shape[1]], high[: p.shape[1]] = p.min(0), p.max(0)
            made += 1
            ids, copies = np.array([h[0] for h in held], np.int64), np.array([h[2] for h in held], np.int64)
            fields = [(part, pa.int64()), (made - 1, pa.int64()), (held[0][1], pa.string()), (ids.tobytes(), pa.binary()), (copies.tobytes(), pa.binary()), (raw, pa.binary()), *((float(v), pa.float64()) for v in [*low, *high])]
            names = ["part", "place", "label", "ids", "copies", "units", *(f"{e}{j}" for e in ("low", "high") for j in range(k))]
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in fields], names)

        for b in batches:
            cells = list(zip(*(b.column(f"c{j}").to_pylist() for j in range(k))))
            for cell, row in zip(cells, zip(*(b.column(c).to_pylist() for c in ("id", "label", "copies", "unit")))):
                if held and (held[0][1] != row[1] or len(held) >= size or 4 * len(held) >= size and held[-1][4][:4] != cell[:4]):
                    yield block()
                    held.clear()
                held.append((*row, cell))
        if held:
            yield block()

    return run


def block_pairs(boxes: DataFrame, eps: float, axes: int) -> DataFrame:
    """``x, y``: the pairs of blocks (each with itself too) of one label that may hold a link, from ``label, number, low0.., high0..``; the recursion over sequence
    intervals. Every level is a join on the interval, so pairs stay on the executors, and an interval meets at most 32 times 32 parts at once."""
    top = boxes.agg(F.max("number")).first()[0] or 0
    levels = max(1, -(-int(top).bit_length() // FAN))
    ends = [F.min(f"low{j}").alias(f"low{j}") for j in range(axes)] + [F.max(f"high{j}").alias(f"high{j}") for j in range(axes)]

    def nodes(level: int, side: str) -> DataFrame:
        one = boxes.groupBy("label", F.shiftright("number", FAN * level).alias("node")).agg(*ends) if level else boxes.withColumnRenamed("number", "node")
        return one.select(F.col("label").alias(f"label_{side}"), F.col("node").alias(side), F.shiftright("node", FAN).alias(f"up_{side}"), *[F.col(f"{e}{j}").alias(f"{e}{j}_{side}") for e in ("low", "high") for j in range(axes)])

    zero = F.lit(0.0)
    gaps = [F.greatest(zero, F.col(f"low{j}_x") - F.col(f"high{j}_y"), F.col(f"low{j}_y") - F.col(f"high{j}_x")) for j in range(axes)]
    near = sum((g * g for g in gaps), zero) <= eps * eps * (1 + 1e-9)
    pairs = None
    for level in reversed(range(levels)):
        x, y = nodes(level, "x"), nodes(level, "y")
        if pairs is None:
            both = x.join(y, (F.col("label_x") == F.col("label_y")) & (F.col("up_x") == F.col("up_y")))  # the top intervals: one parent for all
        else:
            above = pairs.select(F.col("label").alias("label_x"), F.col("label").alias("label_y"), F.col("x").alias("up_x"), F.col("y").alias("up_y"))
            both = above.join(x, ["label_x", "up_x"]).join(y, ["label_y", "up_y"])
        pairs = both.where((F.col("x") <= F.col("y")) & near).select(F.col("label_x").alias("label"), "x", "y")
        pairs = stored(pairs, "intervals")
    return pairs.select("x", "y")


def near_intervals(low: np.ndarray, high: np.ndarray, first: tuple[int, int], second: tuple[int, int], eps: float) -> list[tuple[int, int]]:
    """Pairs of boxes, one of each of two sequence intervals (or both of the same one, each pair once), that aren't more than ``eps`` apart."""
    out: list[tuple[int, int]] = []
    hulls: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def hull(a: int, b: int):
        if (a, b) not in hulls:
            hulls[a, b] = low[a:b].min(0), high[a:b].max(0)
        return hulls[a, b]

    def halves(v: tuple[int, int]) -> list[tuple[int, int]]:
        middle = (v[0] + v[1]) // 2
        return [v] if v[1] - v[0] == 1 else [(v[0], middle), (middle, v[1])]

    stack = [(first, second)]
    while stack:
        x, y = stack.pop()
        (lx, hx), (ly, hy) = hull(*x), hull(*y)
        gap = np.maximum(0, np.maximum(lx - hy, ly - hx))
        if float(gap @ gap) > eps * eps * (1 + 1e-9):
            continue
        if x[1] - x[0] == 1 and y[1] - y[0] == 1:
            out.append((x[0], y[0]))
            continue
        for p in halves(x):
            stack += [(p, q) for q in halves(y) if x != y or p <= q]
    return out


def schedule(boxes: list[tuple[int, str, list[float], list[float]]], eps: float) -> list[tuple[int, int]]:
    """Pairs of boxes (each with itself too) of one label, from a sorted list, that may hold a link."""
    out: list[tuple[int, int]] = []
    at = 0
    while at < len(boxes):
        end = at
        while end < len(boxes) and boxes[end][1] == boxes[at][1]:
            end += 1
        own = boxes[at:end]
        pairs = near_intervals(np.array([b[2] for b in own]), np.array([b[3] for b in own]), (0, len(own)), (0, len(own)), eps)
        out += [(own[i][0], own[j][0]) for i, j in pairs]
        at = end
    return out


def local_roots(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the bipartite graph of a boolean matrix: the smallest row number that each row and each column reaches (or a large one)."""
    n, m = links.shape
    none = n
    row, col = np.arange(n), np.full(m, none)
    while True:
        new_col = np.where(links, row[:, None], none).min(0)
        new_row = np.minimum(row, np.where(links, new_col[None, :], none).min(1))
        if (new_row == row).all() and (new_col == col).all():
            return row, col
        row, col = new_row, new_col


def _possible(x: np.ndarray, y: np.ndarray, own: bool, axes: np.ndarray, eps: float) -> np.ndarray | None:
    """Of two blocks' vectors: which pairs of runs aren't provably distant, as a matrix; nothing where all have to be compared."""
    if len(x) <= RUN and len(y) <= RUN:
        return None
    p = np.concatenate([x, y]) @ axes
    starts = np.concatenate([np.arange(0, len(x), RUN), len(x) + np.arange(0, len(y), RUN)])
    low, high = np.minimum.reduceat(p, starts, axis=0), np.maximum.reduceat(p, starts, axis=0)
    n = -(-len(x) // RUN)
    pairs = near_intervals(low, high, (0, n), (0, n) if own else (n, len(starts)), eps)
    near = np.zeros((n, len(starts) - n), bool)
    for i, j in pairs:
        near[i, j if own else j - n] = True
        if own:
            near[j, i] = True
    return None if near.mean() > 0.5 else near


def _compared(cosine: float, axes, eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                a, ca = np.frombuffer(one["ids_x"], np.int64), np.frombuffer(one["copies_x"], np.int64)
                b, cb = np.frombuffer(one["ids_y"], np.int64), np.frombuffer(one["copies_y"], np.int64)
                x, y = np.frombuffer(one["units_x"], np.float64).reshape(len(a), -1), np.frombuffer(one["units_y"], np.float64).reshape(len(b), -1)
                own = one["x"] == one["y"]
                near = _possible(x, y, own, axes.value[x.shape[1]], eps)
                if near is None:
                    links = x @ y.T >= cosine
                else:
                    links = np.zeros((len(a), len(b)), bool)
                    for i in np.flatnonzero(near.any(1)):
                        columns = np.flatnonzero(np.repeat(near[i], RUN)[: len(b)])
                        links[i * RUN : (i + 1) * RUN, columns] = x[i * RUN : (i + 1) * RUN] @ y[columns].T >= cosine
                if own:
                    np.fill_diagonal(links, False)
                if not links.any():
                    continue
                row, col = local_roots(links | np.eye(len(links), dtype=bool) if own else links)
                at = np.flatnonzero(links.any(1))
                nodes, roots, counts = [a[at]], [a[row[at]]], [links[at].astype(np.int64) @ cb]
                if not own:
                    to = np.flatnonzero(links.any(0))
                    nodes, roots, counts = [*nodes, b[to]], [*roots, a[col[to]]], [*counts, links[:, to].T.astype(np.int64) @ ca]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (nodes, roots, counts)], ["a", "b", "n"])

    return run


def blocked(classes: DataFrame, eps: float, axes: int, block: int):
    """Blocks of the sorted sequence of ``id, label, copies, unit``, with their ``number`` and bounding boxes, and the axes (broadcast, of fixed size)."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(_axes(classes, axes))
    cells, corners = [f"c{j}" for j in range(axes)], [f"{e}{j}" for e in ("low", "high") for j in range(axes)]
    placed = classes.select("id", "label", "copies", "unit").mapInArrow(_placed(shared, eps, axes), "id bigint, label string, copies bigint, unit binary, " + ", ".join(f"{c} int" for c in cells))
    tasks = max(1, classes.count() // (8 * block))
    sorted_ = placed.repartitionByRange(tasks, "label", *cells, "id").sortWithinPartitions("label", *cells, "id")
    blocks = stored(sorted_.mapInArrow(_blocks(shared, block, axes), "part bigint, place bigint, label string, ids binary, copies binary, units binary, " + ", ".join(f"{c} double" for c in corners)), "blocks")
    wide = 1 << int(blocks.agg(F.max("place")).first()[0] or 0).bit_length()
    return blocks.withColumn("number", F.col("part") * wide + F.col("place")), shared


def embedding_components(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, axes: int = AXES, block: int = BLOCK) -> DataFrame:
    """Per row: id, ``n_links`` (other rows with a cosine of ``cosine`` or more and the same label), ``component_id``, ``kept``.

    Rows whose vector is null, empty, zero or holds null or non-finite values, and rows with a null label, link with
    nothing; vectors of different length never link. Equal vectors link with each other. Repeated rows (equal ids) count
    as vectors of their own among the links and are one node of the graph. Extra columns are left out.
    """
    if not 0 < cosine <= 1:
        raise ValueError("the cosine must be above 0 and at most 1")
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    units = stored(rows.mapInArrow(_clean, "id bigint, label string, digest binary, unit binary"), "units")
    classes = stored(units.groupBy("label", "digest").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("unit").alias("unit")), "vectors")
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    blocks, shared = blocked(classes, eps, axes, block)
    pairs = block_pairs(blocks.drop("ids", "copies", "units", "part", "place"), eps, axes)
    data = blocks.select("number", "ids", "copies", "units")
    both = pairs.join(data.toDF("x", "ids_x", "copies_x", "units_x"), "x").join(data.toDF("y", "ids_y", "copies_y", "units_y"), "y")
    found = stored(both.mapInArrow(_compared(cosine, shared, eps), "a bigint, b bigint, n bigint"), "found")
    known = components(found.select("a", "b"))
    links = found.groupBy("a").agg(F.sum("n").alias("n"))
    per_class = classes.select("label", "digest", F.col("id").alias("lowest"), "copies").join(links, F.col("lowest") == F.col("a"), "left").join(known, F.col("lowest") == F.col("node"), "left")
    per_class = per_class.select("label", "digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "lowest").alias("component_id"))
    linked = units.select("id", "label", "digest").join(per_class, ["label", "digest"]).select("id", "n_links", "component_id")
    # A left join back would meet repeated ids twice; unlinkable rows are told by the same test instead.
    rest = rows.mapInArrow(_unclean, "id bigint").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(rest)
    return out.withColumn("kept", F.col("id") == F.col("component_id")).withColumnRenamed("id", id_col)


def _unclean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [i for i, label, v in zip(*(c.to_pylist() for c in b.columns)) if _unit(i, label, v) is None]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["id"])
