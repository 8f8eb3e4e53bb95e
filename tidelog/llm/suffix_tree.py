"""A language model as a probabilistic suffix tree over words, learned and applied by blocks of documents.

A node is a context of up to ``depth`` words with a distribution of the next token. The root is the add-one unigram
distribution. A longer context is kept when its next-token counts diverge from its parent's distribution (that of the context without its first word): when predicting
each of its own occurrences from the others (leave one out, smoothed with the parent) gains more than ``MARGIN`` nats in all; contexts are
grown below kept ones only, an order at a time. A token is scored from the longest kept context before it; every node smooths its
counts with its parent's probability, so each is a distribution.

Documents are packed into blocks. Every block sends the distinct n-grams of its texts with its counts, cut by hash, to counting tasks,
which add up all blocks' counts, test the contexts and answer every block for the n-grams it asked for. No table of the corpus
is ever held in one place; only words that make up a 65,536th of all tokens (at most so many) are broadcast. Contexts that would
overfill a counting task are spread over several by the next token; each adds up its share of the test, and the sums of these few
(each holds more than a task's share of all tokens) decide for all.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import input_bytes, mix64, released, stored, texts
from tidelog.llm.wordhash import hashed

BLOCK = 6 << 20
#: Pseudo-counts of the parent's distribution, and nats that a context must gain.
WEIGHT = (0.0, 4.0, 2.0, 1.0, 1.0, 1.0)
MARGIN = 4.0
#: Share of all tokens from which a word is broadcast.
SHARE = 1 << 16
_END = np.uint64(0x3C79AC492BA7B653)
_PAIR = np.uint64(0x63D83595A9B1F3C7)


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def _unpack(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), kind)


def _blocks(fold: int, held: int):
    """Documents to blocks: ids, learning flags, and the compressed texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = TaskContext.get().partitionId() << 32
        ids: list = []
        bodies: list[bytes] = []
        size = 0

        def block() -> pa.RecordBatch:
            lengths = np.array([len(b) for b in bodies], np.int64)
            known = np.array([i is not None for i in ids])
            learn = np.array([i is not None and zlib.crc32(str(i).encode()) % fold != held for i in ids])
            raw = zstandard.compress(b"".join(bodies), 3)
            fields = [[name], [np.array([i or 0 for i in ids], np.int64).tobytes()], [known.tobytes()], [learn.tobytes()], [lengths.tobytes()], [raw]]
            return pa.RecordBatch.from_arrays([pa.array(fields[0], pa.int64()), *(pa.array(f, pa.binary()) for f in fields[1:])], ["block", "ids", "known", "learn", "lengths", "bodies"])

        for b in batches:
            for i, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                body = body or b""
                if ids and size + len(body) > BLOCK:
                    yield block()
                    name, ids, bodies, size = name + 1, [], [], 0
                ids.append(i)
                bodies.append(body)
                size += len(body) + 16
        if ids:
            yield block()

    return run


class Block:
    """The token sequence of one block: words by hash, one end after each document."""

    def __init__(self, row: dict):
        self.name = row["block"]
        self.ids, self.known, self.learn = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool), np.frombuffer(row["learn"], bool)
        lengths = np.frombuffer(row["lengths"], np.int64)
        raw = zstandard.decompress(row["bodies"]) if lengths.sum() else b""
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])
        parts = list(hashed(column, lower=True))
        counts = np.concatenate([w.count for w in parts])
        words = np.concatenate([w.hashes for w in parts])
        self.size = counts + 1
        self.first = np.cumsum(self.size) - self.size
        self.doc = np.repeat(np.arange(len(counts)), self.size)
        self.token = np.full(int(self.size.sum()), _END)
        end = np.zeros(len(self.token), bool)
        end[self.first + counts] = True
        self.token[~end] = words
        self.weight = self.learn[self.doc].astype(np.float64)
        self.place = np.arange(len(self.token)) - self.first[self.doc]

        self.keys, self.back = np.unique(self.token, return_inverse=True)
        self._shares: np.ndarray | None = None

    def counts(self) -> np.ndarray:
        """Of each distinct token in the learning texts."""
        return np.bincount(self.back, self.weight, len(self.keys))

    def shares(self, top: Top) -> np.ndarray:
        """Of each distinct token."""
        if self._shares is None:
            self._shares = top.share(self.keys)
        return self._shares


class Grams:
    """The n-grams of one order in a block, sorted by context and next token."""

    def __init__(self, block: Block, order: int, top: Top, bits: int, allowed: np.ndarray | None = None, counts: np.ndarray | None = None, parent: np.ndarray | None = None):
        """For orders above 1, ``counts``: for each token the count of it and the ``order`` - 1 words before it, where that is answered; ``parent``, where contexts are to be
        tested: each token's probability below the shorter context (below the root it is its share)."""
        at = np.flatnonzero(block.place >= order if allowed is None else allowed & (block.place >= order))
        self.at = at
        shares = block.shares(top)
        before = block.back[at - 1]
        if order == 1:
            share = np.where(shares[before] > 1 / SHARE, shares[before], 0.0)
        else:
            share = counts[at - 1] / top.total
        spread = np.ceil(share * (4 << bits)).astype(np.uint64)  # a frequent context's tokens go to so many tasks
        self.hot = spread > 4
        hot = np.flatnonzero(self.hot)
        # Context hashes and each token's number among them; frequent ones get a hash for each share of their tokens.
        if order == 1:
            plain, which = block.keys, before
        else:
            context = block.token[at - order]
            for k in range(order - 1, 0, -1):
                context = mix64(context ^ _PAIR) + block.token[at - k]
            plain, which = np.unique(context, return_inverse=True)
        plain_hot = plain[which[hot]]
        apart, which_hot = np.unique(mix64(plain_hot + block.token[at[hot]] % spread[hot] + np.uint64(1)), return_inverse=True)
        which = which.copy()
        which[hot] = len(plain) + which_hot
        both = np.concatenate([plain, apart])
        used = np.flatnonzero(np.bincount(which, minlength=len(both)))
        used = used[np.argsort(both[used])]
        number = np.zeros(len(both), np.int64)
        number[used] = np.arange(len(used))
        self.contexts, which = both[used], number[which]
        self.hot_context = used >= len(plain)
        whole = np.zeros(len(apart), np.uint64)
        whole[which_hot] = plain_hot
        self.whole = whole[used[self.hot_context] - len(plain)]  # the contexts that frequent ones' shares belong to
        token = block.token[at]
        key = which.astype(np.uint64) << np.uint64(32) | mix64(token ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)
        keys, first, self.back = np.unique(key, return_index=True, return_inverse=True)
        self.of = (keys >> np.uint64(32)).astype(np.int64)  # each item's context
        self.item = keys.astype(np.uint32)
        self.count = np.bincount(self.back, block.weight[at], len(keys)).astype(np.uint32)
        self.level = np.minimum(255, np.round(-8 * np.log2(shares[block.back[at[first]]] if parent is None else parent[at[first]]))).astype(np.uint8)
        self.edges = np.searchsorted(self.contexts, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.array([0])

    def requests(self, name: int, bits: int) -> Iterator[tuple]:
        item_edges = np.searchsorted(self.of, np.append(self.edges, len(self.contexts)))
        edges = np.append(self.edges, len(self.contexts))
        per = np.bincount(self.of, minlength=len(self.contexts)).astype(np.uint32)
        short = self.contexts << np.uint64(bits) >> np.uint64(24)
        five = short.view(np.uint8).reshape(-1, 8)[:, :5]
        hot_edges = np.concatenate([[0], np.cumsum(self.hot_context)])[edges]
        for p in range(len(edges) - 1):
            a, b = edges[p], edges[p + 1]
            if a < b:
                i, j = item_edges[p], item_edges[p + 1]
                yield p, name, five[a:b].tobytes(), _pack(per[a:b]), np.packbits(self.hot_context[a:b]).tobytes(), self.whole[hot_edges[p] : hot_edges[p + 1]].tobytes(), self.item[i:j].tobytes(), _pack(self.count[i:j]), _pack(self.level[i:j])


_REQUEST = "part int, block bigint, contexts binary, sizes binary, hot binary, whole binary, items binary, counts binary, levels binary"


def _request_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 7]
    names = ["part", "block", "contexts", "sizes", "hot", "whole", "items", "counts", "levels"]
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


class Top:
    """Frequent words and their counts; the others count as a ``SHARE``-th."""

    def __init__(self, keys: bytes, counts: bytes, total: int, bits: int):
        self.keys, self.total, self.drop = np.frombuffer(keys, np.uint64), max(1, total), np.uint64(24 - bits)
        self.counts = np.frombuffer(counts, np.int64)

    def share(self, token: np.ndarray) -> np.ndarray:
        short = token >> self.drop
        if not len(self.keys):
            return np.full(len(token), 1 / SHARE)
        at = np.minimum(np.searchsorted(self.keys, short), len(self.keys) - 1)
        return np.where(self.keys[at] == short, self.counts[at] / self.total, 1 / SHARE)


def _five(raw: bytes) -> np.ndarray:
    n = len(raw) // 5
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(n, 5)
    return wide.view(np.uint64).ravel()


def _ask_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                keys, counts = b.keys, b.counts()
                edges = np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(keys)) if bits else [0, len(keys)]
                five = (keys << np.uint64(bits) >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5]
                rows = [(p, b.name, five[i:j].tobytes(), _pack(counts[i:j].astype(np.uint32))) for p, (i, j) in enumerate(zip(edges[:-1], edges[1:])) if i < j]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["part", "block", "words", "counts"])

    return run


_ANSWER = "block bigint, kind int, part int, answer binary"


def _answers(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["block", "kind", "part", "answer"])


def _count_words(bits: int):
    """Adds up the counts of one part's words. Kind 1: the counts, for each block; kind 0: totals and candidates for frequent words."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        asked = [_five(r) for r in table.column("words").to_pylist()]
        counts = [_unpack(r, np.uint32) for r in table.column("counts").to_pylist()]
        keys, back = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(back, np.concatenate(counts), len(keys)).astype(np.int64)
        out, at = [], 0
        for name, a in zip(table.column("block").to_pylist(), asked):
            out.append((name, 1, part, _pack(total[back[at : at + len(a)]].astype(np.uint32))))
            at += len(a)
        often = total * SHARE >= total.sum()  # of this part; at most SHARE of them, the final test follows
        full = np.uint64(part) << np.uint64(40) | keys[often]
        head = np.array([total.sum(), (total > 0).sum(), often.sum()], np.int64)
        out.append((-1, 0, part, head.tobytes() + full.tobytes() + total[often].tobytes()))
        return _answers(out)

    return run


def _diverges(sums: np.ndarray, n: np.ndarray, mu: float) -> np.ndarray:
    """The test of contexts with ``n`` next tokens: ``sums`` are of c * log((c - 1) / prior + mu) over their items."""
    return (sums - n * np.log((n - 1 + mu).clip(min=mu)) > MARGIN) & (n >= 2)


def _frequent_kept(grams: DataFrame, kind: int) -> np.ndarray:
    """Sorted hashes of the frequent contexts that pass the test; fewer than there are counting tasks."""

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                whole, n, sums = np.frombuffer(raw, np.int64).reshape(3, -1)
                yield pa.RecordBatch.from_arrays([pa.array(whole), pa.array(n.view(np.float64)), pa.array(sums.view(np.float64))], ["whole", "n", "sums"])

    rows = grams.where("kind = 0").select("answer").mapInArrow(shares, "whole bigint, n double, sums double")
    each = rows.groupBy("whole").agg(F.sum("n").alias("n"), F.sum("sums").alias("sums")).collect()
    whole, n, sums = np.array([r.whole for r in each], np.int64).view(np.uint64), np.array([r.n for r in each], np.float64), np.array([r.sums for r in each], np.float64)
    return np.sort(whole[_diverges(sums, n, WEIGHT[kind - 1])])


def _count_grams(kind: int):
    """Adds up one part's n-grams, tests the contexts, and answers each block. Kind 0: what this part adds to the test of frequent contexts."""
    mu = WEIGHT[kind - 1]

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        contexts = [_five(r) for r in table.column("contexts").to_pylist()]
        sizes = [_unpack(r, np.uint32) for r in table.column("sizes").to_pylist()]
        hot = np.concatenate([np.unpackbits(np.frombuffer(h, np.uint8), count=len(c)) for h, c in zip(table.column("hot").to_pylist(), contexts)]).astype(bool)
        items = np.concatenate([np.frombuffer(r, np.uint32) for r in table.column("items").to_pylist()])
        counts = np.concatenate([_unpack(r, np.uint32) for r in table.column("counts").to_pylist()])
        levels = np.concatenate([_unpack(r, np.uint8) for r in table.column("levels").to_pylist()])
        known, which = np.unique(np.concatenate(contexts), return_inverse=True)
        of = np.repeat(which, np.concatenate(sizes)).astype(np.uint64)
        keys, first, back = np.unique(of << np.uint64(32) | items, return_index=True, return_inverse=True)
        c = np.bincount(back, counts, len(keys))
        owner = (keys >> np.uint64(32)).astype(np.int64)
        n = np.bincount(owner, c, len(known))
        prior = 2.0 ** (-levels[first].astype(np.float64) / 8)
        seen = np.maximum(c, 1)
        sums = np.bincount(owner, c * np.log((seen - 1) / prior + mu), len(known))
        keep = _diverges(sums, n, mu)
        keep[which[hot]] = True  # blocks get their counts; the sums over all parts decide
        out, at, item_at = [], 0, 0
        if hot.any():
            apart, first_hot = np.unique(which[hot], return_index=True)
            whole = np.concatenate([np.frombuffer(r, np.uint64) for r in table.column("whole").to_pylist()])[first_hot]
            out.append((-1, 0, part, whole.tobytes() + n[apart].astype(np.float64).tobytes() + sums[apart].tobytes()))
        for name, own, size in zip(table.column("block").to_pylist(), contexts, sizes):
            w = which[at : at + len(own)]
            kept = keep[w]
            many = int(size.sum())
            mask = np.repeat(kept, size)
            got = c[back[item_at : item_at + many][mask]].astype(np.uint32)
            raw = np.packbits(kept).tobytes() + n[w[kept]].astype(np.uint32).tobytes() + got.tobytes()
            out.append((name, kind, part, zstandard.compress(raw, 1)))
            at += len(own)
            item_at += many
        return _answers(out)

    return run


def _read(grams: Grams, answers: dict[int, bytes], frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From a block's answers: kept flag and total of each context, count of each item. ``frequent``: the frequent contexts that are kept."""
    kept, total, count = np.zeros(len(grams.contexts), bool), np.zeros(len(grams.contexts)), np.zeros(len(grams.of))
    edges = np.append(grams.edges, len(grams.contexts))
    item_edges = np.searchsorted(grams.of, edges)
    for p, raw in answers.items():
        a, b, i, j = edges[p], edges[p + 1], item_edges[p], item_edges[p + 1]
        raw = zstandard.decompress(raw)
        bits = -(-(b - a) // 8)
        own = np.unpackbits(np.frombuffer(raw[:bits], np.uint8), count=b - a).astype(bool)
        numbers = np.frombuffer(raw[bits:], np.uint32)
        kept[a:b] = own
        total[a:b][own] = numbers[: own.sum()]
        mask = own[grams.of[i:j] - a]
        count[i:j][mask] = numbers[own.sum() :]
    kept[grams.hot_context] = np.isin(grams.whole, frequent)
    return kept, total, count


def _by_kind(table: pa.Table) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = defaultdict(dict)
    for kind, part, raw in zip(*(table.column(c).to_pylist() for c in ("kind", "part", "answer"))):
        out[kind][part] = raw
    return out


class Descent:
    """A block's way down the orders that have been answered: for each token the probability below its longest kept context so far."""

    def __init__(self, block: Block, top: Top, bits: int, counts: np.ndarray, root: np.ndarray):
        """``counts`` of each token, and its probability at the root."""
        self.block, self.top, self.bits = block, top, bits
        self.counts, self.p = counts, root.copy()
        self.allowed: np.ndarray | None = None  # tokens whose next longer context may be kept
        self.order = 0

    def grams(self, parent: np.ndarray | None = None) -> Grams:
        """Of the next order."""
        return Grams(self.block, self.order + 1, self.top, self.bits, self.allowed, self.counts, parent)

    def step(self, answers: dict[int, bytes], frequent: np.ndarray) -> None:
        grams, weight = self.grams(), WEIGHT[self.order + 1]
        kept, sums, got = _read(grams, answers, frequent)
        of, got = grams.of[grams.back], got[grams.back]
        # A spread context's own total is the count of its words, which the order before has answered.
        total = np.where(grams.hot, self.counts[grams.at - 1], sums[of])
        known = kept[of] & (total >= got)
        at = grams.at[known]
        self.p[at] = (got[known] + weight * self.p[at]) / (total[known] + weight)
        self.counts, answered = np.zeros(len(self.p)), np.zeros(len(self.p), bool)
        self.counts[grams.at], answered[grams.at] = got, kept[of]
        self.allowed = np.zeros(len(self.p), bool)
        self.allowed[at] = True
        # A context that occurs less than twice can't be kept: its words, ending with the token before, have been counted.
        rare = answered & (self.counts < 2)
        self.allowed[1:] &= ~rare[:-1]
        self.order += 1


def suffix_tree_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 7, held: int = 2, depth: int = 2) -> DataFrame:
    """Per row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` (both log10 probabilities of the text).

    Contexts have up to ``depth`` words. Learns from rows whose crc32 of the id, as text, is not ``held`` modulo ``fold``. Null and empty texts are one end token; a very
    long text is a block of its own and scored whole. Rows without id are scored, never learned from, and have a null ``held_out``. Repeated rows count each. An empty table gives no rows; with nothing to
    learn from every token has the probability of an unknown one. Extra columns are left out. Words are told apart by 64 bits, of which counting tasks see 40 and more
    of a context and 32 of the token after it, so one token in some billions may take another's count.
    """
    if not 1 <= depth < len(WEIGHT):
        raise ValueError(f"contexts have 1 to {len(WEIGHT) - 1} words")
    spark = docs.sparkSession
    bodies, _ = texts(docs, id_col, text_col)
    bits = max(0, min(20, math.ceil(math.log2(max(1, input_bytes(bodies) / (3 << 20))))))
    blocks = stored(bodies.mapInArrow(_blocks(fold, held), "block bigint, ids binary, known binary, learn binary, lengths binary, bodies binary"), "text-blocks")

    asked = blocks.mapInArrow(_ask_words(bits), "part int, block bigint, words binary, counts binary")
    words = stored(asked.groupBy("part").applyInArrow(_count_words(bits), _ANSWER), "words")
    with released(spark):
        total, distinct, keys, counts = _frequent(words)
    numbers = spark.sparkContext.broadcast((keys.tobytes(), counts.tobytes(), total, bits))
    often: list = []  # for each order the frequent contexts that are kept, broadcast

    def down(descent: Descent, answers: dict[int, dict[int, bytes]]) -> Descent:
        for frequent in often:
            descent.step(answers[descent.order + 2], np.frombuffer(frequent.value, np.uint64))
        return descent

    def requests(row: dict, answers: dict[int, dict[int, bytes]]) -> list[tuple]:
        top, b = Top(*numbers.value), Block(row)
        shares = b.shares(top)[b.back]
        descent = down(Descent(b, top, bits, np.rint(shares * top.total), shares), answers)
        return list(descent.grams(descent.p).requests(b.name, bits))

    def ask_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _request_table(requests(row, {})).to_batches()

    def ask_next(left: pa.Table, right: pa.Table) -> pa.Table:
        return _request_table([r for row in left.to_pylist() for r in requests(row, _by_kind(right))])

    tables: list[DataFrame] = []
    for order in range(1, depth + 1):
        kind = order + 1
        if order == 1:
            asked = blocks.mapInArrow(ask_first, _REQUEST)
        else:
            answers = functools.reduce(DataFrame.unionByName, tables)
            asked = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask_next, _REQUEST)
        counted = stored(asked.groupBy("part").applyInArrow(_count_grams(kind), _ANSWER), f"order-{order}")
        with released(spark):
            often = [*often, spark.sparkContext.broadcast(_frequent_kept(counted, kind).tobytes())]
        tables.append(counted.where(F.col("kind") == kind))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        top, out = Top(*numbers.value), []
        answers = _by_kind(right)
        for row in left.to_pylist():
            b = Block(row)
            count = np.concatenate([_unpack(answers[1][p], np.uint32) for p in sorted(answers[1])]).astype(np.float64)[b.back]
            base = (count + 1) / (total + distinct + 1)
            p = down(Descent(b, top, bits, count, base), answers).p
            docs_ = len(b.ids)
            out.append(pa.table([
                pa.array(b.ids, pa.int64(), mask=~b.known), pa.array(~b.learn, pa.bool_(), mask=~b.known), pa.array(b.size, pa.int64()), pa.array(np.bincount(b.doc, count > 0, docs_).astype(np.int64)),
                pa.array(np.full(docs_, total), pa.int64()), pa.array(np.bincount(b.doc, np.log10(base), docs_)), pa.array(np.bincount(b.doc, np.log10(p), docs_)),
            ], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(out)

    answers = functools.reduce(DataFrame.unionByName, [words.where("kind = 1"), *tables])
    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def _frequent(words: DataFrame) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Tokens and distinct tokens of the learning texts, and the words with a ``SHARE``-th of all tokens, with counts."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, v, keys, counts = [], [], [], []
            for raw in b.column(0).to_pylist():
                total, distinct, often = np.frombuffer(raw[:24], np.int64)
                n.append(int(total))
                v.append(int(distinct))
                keys.append(np.frombuffer(raw[24 : 24 + 8 * often], np.int64).tolist())
                counts.append(np.frombuffer(raw[24 + 8 * often :], np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(v, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))], ["n", "v", "keys", "counts"])

    rows = words.where("kind = 0").select("answer").mapInArrow(heads, "n bigint, v bigint, keys array<bigint>, counts array<bigint>")
    total, distinct = (int(x or 0) for x in rows.agg(F.sum("n"), F.sum("v")).first())
    top = rows.select(F.explode(F.arrays_zip("keys", "counts")).alias("w")).where(F.col("w.counts") * SHARE >= total).where(F.col("w.counts") > 0).select("w.keys", "w.counts").collect()
    top.sort(key=lambda r: np.uint64(r.keys & (2**64 - 1)))
    return total, distinct, np.array([r.keys & (2**64 - 1) for r in top], np.uint64), np.array([r.counts for r in top], np.int64)
