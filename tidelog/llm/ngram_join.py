"""N-gram Jaccard join: prefix filters under several global token orders, intersected before verification.

Documents with equal shingle sets (by 96-bit digests) form one class, named by its smallest id; only classes are compared. All token orders put rare shingles
first (by counts over all documents, in a table of fixed size) and break ties each by another hash. Two sets that
reach the threshold share a shingle of their prefixes under every order. Classes that share one under the first order
meet in groups; a pair goes on only if its prefixes under all other orders, fetched for the sets in question, share a shingle too, at places that leave
enough shingles behind them, and if small sketches of the sets don't rule it out; it is then verified on the whole sets. A large group isn't paired with itself: first its
members are held against leaders of the group and their neighbours; then only pairs of different components, so that a large group of near copies costs what its
links cost. All pairs of different components that the filters leave are verified, so no link is lost.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import dealt, held, id_bits, id_hash, mix64, parts, released, stored, texts
from tidelog.llm.components import components
from tidelog.llm.wordhash import grams, hashed

ORDERS = 3
#: Bytes of a set's digest: 10 billion sets share one with a chance of less than one in a billion.
CLASS_BYTES = 12
#: Neighbours in a group that are held against each other at once; the others follow where components still differ.
NEAR = 16
#: Counters of shingles; one byte of each (a level) is sent to every executor, whatever the size of the corpus.
COUNTERS = 1 << 24
#: Levels of a counter that a doubling takes, and the sets of one shingle that a task gathers; more are dealt out by a salt.
STEPS, HOT = 6, 1 << 16
_SEGMENT = 1 << 18
#: Sets of one token that a task compares with as many others, where their components differ.
CROSS_SETS = 512
#: Bytes of groups, as stored, that a task pairs.
GROUP_BYTES = 4 << 20
#: Bits of a set's sketch, which rules out most pairs below the threshold before whole sets are fetched.
SKETCH = 4096
_SEEDS = [0x9E6C63D0676A9A99, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD]


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its ``n``-word shingles); a shorter row's whole sequence is one; A-Z lower-cased."""
    for w in hashed(column, lower=True):
        all_ = grams(w.hashes, n, 0x2545F4914F6CDD1D)
        for k, (at, size) in enumerate(zip(w.base.tolist(), w.count.tolist())):
            if size >= n:
                yield w.first + k, np.unique(all_[at : at + size - n + 1])
            else:
                yield w.first + k, grams(w.hashes[at : at + size], size, 0x9FB21C651E98DF25) if size else np.zeros(0, np.uint64)


def class_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=CLASS_BYTES).digest()


def _names(column: pa.Array) -> np.ndarray:
    """A column of class names, digests or integers, as rows of integers."""
    if not pa.types.is_binary(column.type):
        return np.asarray(column)[:, None]
    column = column.cast(pa.large_binary())
    _, at, raw = column.buffers()
    first = int(np.frombuffer(at, np.int64)[column.offset])
    return np.frombuffer(raw, np.uint8)[first : first + CLASS_BYTES * len(column)].view(np.uint32).reshape(len(column), -1)


def _name_column(names: np.ndarray) -> pa.Array:
    """The reverse of ``_names``."""
    if names.shape[1] == 1:
        return pa.array(names[:, 0])
    bounds = np.arange(len(names) + 1, dtype=np.int32) * CLASS_BYTES
    return pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(np.ascontiguousarray(names).tobytes())])


def prefix_size(n: int, percent: int) -> int:
    return n + (-percent * n) // 100 + 1  # n - ceil(n * percent / 100) + 1


def prefix(s: np.ndarray, levels: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The first shingles of a set under one order, sorted by it; enough that sets over the threshold share one."""
    p = prefix_size(len(s), percent)
    level = levels[(s % np.uint64(COUNTERS)).astype(np.int64)].astype(np.uint64)
    key = level << np.uint64(56) | mix64(s ^ np.uint64(_SEEDS[order])) >> np.uint64(8)
    first = np.argpartition(key, p - 1)[:p] if p < len(s) else np.arange(len(s))
    return s[first[np.argsort(key[first])]]


def reach(n: int, m: int, percent: int) -> int:
    """Shingles that sets of ``n`` and ``m`` must share to be linked."""
    return -(-percent * (n + m) // (100 + percent))


def _profile(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            ids, cls, size = batch.column(0).to_pylist(), [None] * batch.num_rows, [0] * batch.num_rows
            for row, s in shingle_sets(batch.column(1), n):
                size[row] = len(s)
                if len(s):
                    cls[row] = class_of(s)
                    np.add.at(counts, (s % np.uint64(COUNTERS)).astype(np.int64), np.uint32(1))
            m = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cls, pa.binary()), pa.array(size, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], ["id", "cls", "n", "segment", "counts"])
        if counts.any():
            rows = [zlib.compress(np.minimum(counts[k : k + _SEGMENT], 65_535).astype(np.uint16).tobytes(), 1) for k in range(0, COUNTERS, _SEGMENT)]
            m = len(rows)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.array(range(m), pa.int32()), pa.array(rows, pa.binary())], ["id", "cls", "n", "segment", "counts"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the tasks' counters and gives for every counter a level 0 to 255 that rises with its logarithm."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            one = np.frombuffer(zlib.decompress(raw), np.uint16)
            if k not in sums:
                sums[k] = np.zeros(_SEGMENT, np.uint64)
            sums[k] += one
    levels = [np.minimum(255, np.log2(v + 1.0) * STEPS).astype(np.uint8).tobytes() for v in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["segment", "levels"])


def occurrences(level: np.ndarray) -> np.ndarray:
    """About the sets that a counter of this level has counted."""
    return (2.0 ** (level / STEPS)).astype(np.int64) - 1


def _levels(profile: DataFrame) -> bytes:
    total = bytearray(COUNTERS)
    rows = profile.where(F.col("segment").isNotNull()).select("segment", "counts").repartition(16, "segment").mapInArrow(_added, "segment int, levels binary")
    for r in rows.collect():  # COUNTERS bytes in all
        total[r.segment * _SEGMENT : (r.segment + 1) * _SEGMENT] = r.levels
    return bytes(total)


def _prefixes(n: int, percent: int, shared):
    """Rows of the first order's prefixes: token, its place in the prefix, set size, class, and a salt: 0, or for shingles of more than ``HOT`` sets
    the number (from 1 on) of the share of them that the class belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen = np.frombuffer(shared.value, np.uint8), set()
        for batch in batches:
            tokens, places, sizes, cls, salts, many = [], [], [], [], [], 0
            for _, s in shingle_sets(batch.column(1), n):
                if len(s) and (c := class_of(s)) not in seen:  # a class once per task, as far as the memory of it reaches
                    if len(seen) >= 300_000:
                        seen.clear()
                    seen.add(c)
                    t = prefix(s, levels, 0, percent)
                    tokens.append(t)
                    places.append(np.arange(len(t)))
                    sizes.append(np.full(len(t), len(s)))
                    name = np.frombuffer(c, np.uint32)
                    cls.append(np.broadcast_to(name, (len(t), CLASS_BYTES // 4)))
                    shares = occurrences(levels[(t % np.uint64(COUNTERS)).astype(np.int64)]) // HOT
                    salts.append(np.where(shares > 0, int(name[0]) % (shares + 1) + 1, 0))
                    many += len(t)
                if many >= 200_000:
                    yield rows(tokens, places, sizes, cls, salts)
                    tokens, places, sizes, cls, salts, many = [], [], [], [], [], 0
            if tokens:
                yield rows(tokens, places, sizes, cls, salts)

    def rows(tokens, places, sizes, cls, salts):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(sizes).astype(np.int32)), _name_column(np.concatenate(cls)), pa.array(np.concatenate(salts).astype(np.int32))], ["token", "pos", "n", "cls", "salt"])

    return run


def _crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by token (and salt), place, size and class: those of tokens with several classes, and all salted ones, each row once."""
    waiting = None  # the first row of the token at the end of the last batch, while it has one class only
    last = None  # the last row seen
    for b in batches:
        if not b.num_rows:
            continue
        t, i, n, c = *(np.asarray(x) for x in b.columns[:3]), _names(b.column(3))
        hot = np.asarray(b.column(4)) > 0 if b.num_columns > 4 else np.zeros(len(t), bool)
        before = last
        if waiting is not None:
            t, i, n, c, hot = (np.concatenate([w, x]) for w, x in zip(waiting, (t, i, n, c, hot)))
            before = None
        new_token = np.ones(len(t), bool)
        new_token[1:] = t[1:] != t[:-1]
        fresh = new_token.copy()
        fresh[1:] |= (c[1:] != c[:-1]).any(1)
        going_on = before is not None and t[0] == before[0]  # a token already known to be crowded
        if going_on and (c[0] == before[1]).all():
            fresh[0] = False
        group = np.cumsum(new_token) - 1
        count = np.bincount(group, fresh)
        if going_on:
            count[0] += 2
        last, waiting = (t[-1], c[-1].copy()), None
        keep = fresh & ((count[group] > 1) | hot)
        if count[-1] == 1 and not hot[-1]:
            k = np.flatnonzero(group == group[-1])[:1]
            waiting = (t[k], i[k], n[k], c[k], hot[k])
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(t[keep]), pa.array(i[keep]), pa.array(n[keep]), _name_column(c[keep])], ["token", "pos", "n", "cls"])


def _stars(percent: int):
    """From crowded rows sorted by token and place: each with the group's first set in reach (it has the fewest rarer
    shingles, so of near copies it is the one closest to their common original) and with its ``NEAR`` predecessors.

    Pairs have no token. A task's first and last token may go on in other tasks; their first sets (``a``) are given with token, place and size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, before, leads, first = None, [], [], None
        for b in batches:
            left, right = [], []
            for t, i, n, c in zip(*(x.to_pylist() for x in b.columns)):
                if t != token:
                    if first is None and token is not None:
                        first = (token, leads)
                    token, before, leads = t, [], []
                led = False
                for m, j, other in leads:
                    if min(n - i, m - j) >= reach(n, m, percent):
                        left.append(other)
                        right.append(c)
                        led = True
                        break
                if not led and len(leads) < NEAR:
                    leads.append((n, i, c))
                for m, j, other in before:
                    if min(n - i, m - j) >= reach(n, m, percent):
                        left.append(other)
                        right.append(c)
                before = [*before[1 - NEAR :], (n, i, c)]
            pairs = _pairs(left, right)
            none = [pa.nulls(pairs.num_rows, k) for k in (pa.int64(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*pairs.columns, *none], ["a", "b", "token", "pos", "n"])
        rows = [(c, None, t, i, n) for t, own in (first or (None, []), (token, leads)) for n, i, c in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["a", "b", "token", "pos", "n"])

    return run


def _chiefs(percent: int):
    """From the first sets that tasks found, sorted by token and place: those of the whole token, as one task would have found them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, leads = None, []
        for b in batches:
            out = []
            for t, i, n, c in zip(*(x.to_pylist() for x in b.columns)):
                if t != token:
                    token, leads = t, []
                if len(leads) < NEAR and not any(c == other or min(n - i, m - j) >= reach(n, m, percent) for m, j, other in leads):
                    leads.append((n, i, c))
                    out.append((t, i, n, c))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], b.schema.field(k).type) for k in range(4)], b.schema.names)

    return run


def _crosses(percent: int):
    """From crowded rows sorted by token, block pair (``low``, ``high``) and size, with their component: all pairs in reach whose components differ, and
    which are of different blocks where ``low`` and ``high`` differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sets, smallest = None, {}, 0
        for b in batches:
            left, right = [], []
            for t, low, high, own, i, n, c, comp in zip(*(b.column(x).to_pylist() for x in ("token", "low", "high", "own", "pos", "n", "id", "component"))):
                if (t, low, high) != group:
                    group, sets, smallest = (t, low, high), {}, n
                elif 100 * smallest < percent * n:  # sets too small for all that follow go
                    sets = {k: kept for k, near in sets.items() if (kept := [x for x in near if 100 * x[0] >= percent * n])}
                    smallest = n
                for (its, block), near in sets.items():
                    if its != comp and (low == high or block != own):
                        for m, j, other in near:
                            if min(n - i, m - j) >= reach(n, m, percent):
                                left.append(other)
                                right.append(c)
                sets.setdefault((comp, own), []).append((n, i, c))
                if len(left) >= 100_000:
                    yield _pairs(left, right)
                    left, right = [], []
            yield _pairs(left, right)

    return run


def _pairs(left: list[int], right: list[int]) -> pa.RecordBatch:
    a, b = np.array(left, np.int64), np.array(right, np.int64)
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])


def sketch(s: np.ndarray) -> bytes:
    """A bitmap of a set's members by their hash."""
    bits = np.zeros(SKETCH, np.uint8)
    bits[(mix64(s) % np.uint64(SKETCH)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _members(n: int, percent: int, orders: int, shared, wanted):
    """Id, set size, the prefixes under all orders but the first (four bytes of each shingle's hash, by place), sketch and whole set of the
    documents whose place (of their id) is set in a bitmap; few others among them do no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            batch = batch.filter(pa.array(held(wanted.value, np.asarray(batch.column(2)))))
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                ids, rows = part.column(0).to_pylist(), []
                for row, s in shingle_sets(part.column(1), n):
                    if len(s):
                        heads = [(mix64(prefix(s, levels, r, percent)) >> np.uint64(32)).astype(np.uint32).tobytes() for r in range(1, orders)]
                        rows.append((ids[row], len(s), b"".join(heads), sketch(s), s.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["id", "n", "heads", "sketch", "members"])

    return run


def _sharing(sides: list[tuple[np.ndarray, list[np.ndarray]]], reached: np.ndarray, orders: int) -> np.ndarray:
    """Which pairs share a shingle in reach in their prefixes under every order but the first; ``sides`` hold set sizes and prefixes. Shingles
    are told by four bytes, so few pairs too many pass, none too few."""
    keep = np.ones(len(reached), bool)
    for r in range(orders - 1):
        keys, left = [], []
        for size, heads in sides:
            many = np.array([len(h) // (orders - 1) for h in heads], np.int64)
            tokens = np.concatenate([h[r * k : (r + 1) * k] for h, k in zip(heads, many)])
            of = np.repeat(np.arange(len(heads)), many)
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(many) - many, many)
            key = of.astype(np.uint64) << np.uint64(32) | tokens
            order = np.argsort(key, kind="stable")
            keys.append(key[order])
            left.append((size[of] - place)[order])  # within equal keys the first place leaves the most
        both, i, j = np.intersect1d(*keys, return_indices=True)
        pair = (both >> np.uint64(32)).astype(np.int64)
        passed = np.zeros(len(reached), bool)
        passed[pair[np.minimum(left[0][i], left[1][j]) >= reached[pair]]] = True
        keep &= passed
    return keep


def _possible(percent: int, orders: int):
    """Pairs that neither the other orders nor the sketches rule out: every bit that one sketch has alone is at least one member that the other set lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda c, kind: [np.frombuffer(v, kind) for v in batch.column(c).to_pylist()]  # noqa: E731, B023
            n, m = (np.asarray(batch.column(c)).astype(np.int64) for c in ("n_x", "n_y"))
            keep = _sharing([(n, column("heads_x", np.uint32)), (m, column("heads_y", np.uint32))], -(-percent * (n + m) // (100 + percent)), orders)
            x, y = (np.array(column(c, np.uint64)) for c in ("sketch_x", "sketch_y"))
            alone = lambda p, q: np.bitwise_count(p & ~q).sum(1).astype(np.int64)
            most = np.minimum(n - alone(x, y), m - alone(y, x))
            yield batch.select(["a", "b"]).filter(pa.array(keep & ((100 + percent) * most >= percent * (n + m))))

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 90, orders: int = ORDERS) -> DataFrame:
    """Per row: id, ``n_shingles`` and ``component_id``, the smallest id reachable by links of Jaccard ``percent``/100 or more.

    Null and empty texts, and texts of blanks only, have no shingles and link with nothing; shorter texts than a
    shingle are one. Rows with equal id are one document of the graph. Rows without id keep a null component. Extra columns are left out.
    """
    bodies, _ = texts(docs, id_col, text_col)
    profile = stored(bodies.mapInArrow(_profile(shingle), "id bigint, cls binary, n bigint, segment int, counts binary"), "profile")
    with released(docs.sparkSession):
        shared = docs.sparkSession.sparkContext.broadcast(_levels(profile))
    rows = profile.where(F.col("segment").isNull()).select("id", "cls", "n")
    named = rows.where("cls is not null and id is not null")
    classes = stored(named.groupBy("cls").agg(F.min("id").alias("lowest")), "classes")

    count = parts(bodies)
    heads = bodies.mapInArrow(_prefixes(shingle, percent, shared), "token bigint, pos int, n int, cls binary, salt int")
    heads = heads.repartition(count, "token", "salt").sortWithinPartitions("token", "salt", "pos", "n", "cls")
    crowded = heads.mapInArrow(_crowded, "token bigint, pos int, n int, cls binary")
    groups = stored(crowded.join(classes, "cls").select("token", "pos", "n", F.col("lowest").alias("id")), "groups")
    placed = lambda bits: bodies.where(F.col("id").isNotNull()).select("id", "body", id_hash(F.col("id"), bits).alias("at"))
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def links(pairs: DataFrame) -> DataFrame:
        """Pairs that pass the other orders' filters, the sketches and the threshold."""
        bitmap, bits = id_bits(ends(pairs))
        members = stored(placed(bits).mapInArrow(_members(shingle, percent, orders, shared, bitmap), "id bigint, n bigint, heads binary, sketch binary, members binary"), "members")
        side = lambda i, s: members.select(F.col("id").alias(i), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "heads", "sketch")])
        pairs = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").mapInArrow(_possible(percent, orders), "a bigint, b bigint")
        pairs = stored(pairs.distinct(), "possible")
        sets = members.select("id", "members")
        both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
        return stored(both.mapInArrow(_verified(percent), "a bigint, b bigint").distinct(), "links")

    # Rows that repeat an id are one document, whatever their texts.
    twice = named.groupBy("id").agg(F.count_distinct("cls").alias("texts")).where("texts > 1").select("id")
    linked = named.join(twice, "id").join(classes, "cls").select(F.col("id").alias("a"), F.col("lowest").alias("b")).where("a <> b")

    # Ranges of token and place, so that a token of very many sets is dealt to several tasks; its sets are then held against the first ones of all.
    order, star = ("token", "pos", "n", "id"), "a bigint, b bigint, token bigint, pos int, n int"
    found = stored(dealt(groups.select(*order), GROUP_BYTES, *order, ranges=True).sortWithinPartitions(*order).mapInArrow(_stars(percent), star), "found")
    leaders = found.where("token is not null").select("token", "pos", "n", F.col("a").alias("id")).repartition("token").sortWithinPartitions(*order)
    chiefs = stored(leaders.mapInArrow(_chiefs(percent), "token bigint, pos int, n int, id bigint").toDF("token", "pos_a", "n_a", "a"), "chiefs")  # few: its size is known before the join
    led = groups.join(chiefs, "token").where((100 + percent) * F.least(F.col("n") - F.col("pos"), F.col("n_a") - F.col("pos_a")) >= percent * (F.col("n") + F.col("n_a")))
    led = led.groupBy("token", "id").agg(F.min(F.struct("pos_a", "n_a", "a")).alias("first")).select(F.least("first.a", "id").alias("a"), F.greatest("first.a", "id").alias("b"))
    stars = stored(found.where("token is null").select("a", "b").unionByName(led).where("a <> b").distinct(), "stars")
    linked = stored(linked.unionByName(links(stars)), "linked")
    known = components(linked)
    marked = groups.join(known.withColumnRenamed("node", "id"), "id", "left").select("token", "pos", "n", "id", F.coalesce("component", "id").alias("component"))
    # Only tokens of several components are left; those of very many sets are compared block by block, each pair of blocks in one task.
    mixed = marked.groupBy("token").agg(F.count("*").alias("sets"), F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
    mixed = mixed.select("token", F.ceil(F.col("sets") / CROSS_SETS).alias("blocks"))
    blocked = marked.join(mixed, "token").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    blocked = blocked.select("token", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "pos", "n", "id", "component")
    crosses = stored(blocked, "mixed")
    crosses = dealt(crosses, GROUP_BYTES, "token", "low", "high").sortWithinPartitions("token", "low", "high", "n", "id").mapInArrow(_crosses(percent), "a bigint, b bigint").distinct()
    crosses = stored(crosses.join(stars, ["a", "b"], "left_anti"), "crosses")
    if not crosses.isEmpty():
        known = components(linked.unionByName(links(crosses)))
    of_class = classes.join(known, classes.lowest == known.node, "left").select("cls", F.coalesce("component", "lowest").alias("component"))
    out = rows.join(of_class, "cls", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("component_id", F.when(F.col("id").isNotNull(), F.col("component_id"))).withColumnRenamed("id", id_col)
