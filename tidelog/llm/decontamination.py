"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's windows of ``window`` words (a shorter item is one pattern). Patterns of one length m form
a table: every block of two neighbouring words in a pattern gives the distance by which the search may move when it
meets that block (a block in no pattern: m - 1), the last block of each pattern has distance 0 and leads, by a hash of
the pattern's last words, to a bucket of patterns, which are then compared directly. So most words of a clean document
are never looked at. Words are compared as bytes, so a hit is a true occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import carried, stored, texts

WINDOW = 13
#: The benchmark's text that is held at once, on the driver and by each worker; a larger one is searched block by block.
BLOCK_LIMIT = 16 << 20
#: Lower-cases A-Z and makes every ASCII character but letters and digits a blank; other bytes stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def fold_words(body: bytes | None) -> list[bytes]:
    return body.translate(_FOLD).split() if body else []


class WuManber:
    """Search for word sequences of any lengths; each has a set of item numbers."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[int]]):
        self.tables = []
        for m in sorted({len(p) for p in patterns}):
            block, shift, buckets = min(2, m), {}, {}
            for p, items in patterns.items():
                if len(p) != m:
                    continue
                for end in range(block, m + 1):
                    key = p[end - block : end]
                    shift[key] = min(shift.get(key, m - block + 1), m - end)
                buckets.setdefault(hash(p[-min(4, m) :]), []).append((p, frozenset(items)))
            self.tables.append((m, block, shift, buckets))

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, int, frozenset[int]]]:
        """(start, length, items) of every occurrence."""
        n = len(words)
        for m, block, shift, buckets in self.tables:
            far, tail = m - block + 1, min(4, m)
            move = shift.get
            end = m
            if block == 2:
                while end <= n:
                    step = move((words[end - 2], words[end - 1]), far)
                    if step:
                        end += step
                        continue
                    yield from self._compare(words, end, m, tail, buckets)
                    end += 1
            else:
                for end in range(1, n + 1):
                    if (words[end - 1],) in shift:
                        yield from self._compare(words, end, m, tail, buckets)

    @staticmethod
    def _compare(words, end, m, tail, buckets):
        bucket = buckets.get(hash(tuple(words[end - tail : end])))
        if bucket:
            here = tuple(words[end - m : end])
            for pattern, items in bucket:
                if pattern == here:
                    yield end - m, m, items


def windows(items: list[tuple[int, bytes | None]], window: int) -> dict[tuple[bytes, ...], set[int]]:
    """Patterns and the numbers of the items (by place in ``items``) they stem from."""
    out: dict[tuple[bytes, ...], set[int]] = {}
    for k, (_, body) in enumerate(items):
        words = fold_words(body)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            out.setdefault(tuple(words[i : i + window]), set()).add(k)
    return out


def _spans(docs: DataFrame, kind: str, items: list[tuple[int, bytes | None]], window: int, whole: bool) -> DataFrame:
    """Per document: words, covered word ranges and items, of documents with hits; with ``whole`` the finished rows of all documents, in the same Python call."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    along = whole and bool(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        search = WuManber(windows(known, window))
        for batch in batches:
            ids, n_words, starts, ends, found = [], [], [], [], []
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = fold_words(body)
                spans: list[list[int]] = []
                hit: set[int] = set()
                for at, size, its in sorted(search.occurrences(words), key=lambda x: x[:2]):
                    hit |= its
                    if spans and at <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], at + size)
                    else:
                        spans.append([at, at + size])
                if whole or spans:
                    ids.append(i)
                    n_words.append(len(words))
                    starts.append([s for s, _ in spans])
                    ends.append([e for _, e in spans])
                    found.append([known[k][0] for k in sorted(hit)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int64())), *(batch.columns[1:] if along else ())], ["id", "n_words", "starts", "ends", "items", *(batch.schema.names[1:] if along else ())])

    if whole:
        return docs.mapInArrow(lambda batches: _finish(run(batches)), _FINISHED + (f", body binary, carried {kind}" if kind else ""))
    return docs.mapInArrow(run, "id bigint, n_words bigint, starts array<int>, ends array<int>, items array<bigint>")


_FINISHED = "id bigint, n_words bigint, n_hit bigint, n_items bigint, items array<bigint>, starts array<int>, ends array<int>, items_sha256 string, contaminated boolean"


def _digest(ids: list[int]) -> tuple[int, str]:
    names = sorted({str(i) for i in ids})
    return len(names), hashlib.sha256(",".join(names).encode()).hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_limit: int = BLOCK_LIMIT, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: id, ``n_words``, ``n_hit``, ``n_items``, ``items`` (array), ``starts`` and ``ends`` (covered word ranges), ``items_sha256``, ``contaminated``.

    Null and empty texts have no words and no hits; null or empty items occur nowhere; repeated items each count;
    an empty benchmark leaves all documents clean. Extra columns are left out, but for
    those in ``carry``, which come back as the fields of ``carried``. ``contaminated``: at least one word in
    twenty is covered. The benchmark is held in memory up to ``block_limit`` bytes; a larger one is written by blocks of that
    size to the shared folder, as the documents are with a key for each row, and searched block by block, the hits of a row are united. No shuffle for one block.
    """
    (bodies, kind), (items, _) = texts(docs, id_col, text_col, carry), texts(benchmark, item_col, item_text)
    size = items.agg(F.coalesce(F.sum(F.length("body") + 64), F.lit(0))).first()[0]
    if size <= block_limit:
        out = _spans(bodies, kind, [(r.id, bytes(r.body) if r.body is not None else None) for r in items.collect()], window, True)
    else:
        blocks = -(-2 * size // block_limit)
        kept = stored(items.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), "benchmark")
        keyed = stored(bodies.withColumn("row", F.monotonically_increasing_id()), "documents")  # ids may be null or repeat
        hits = None
        for b in range(blocks):
            rows = [(r.id, bytes(r.body) if r.body is not None else None) for r in kept.where(F.col("block") == b).collect()]
            one = _spans(keyed.select(F.col("row").alias("id"), "body"), kind, rows, window, False)
            hits = one if hits is None else hits.unionByName(one)
        hits = hits.groupBy(F.col("id").alias("row")).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")])
        rows = keyed.mapInArrow(_counted, "id bigint, n_words bigint, row bigint" + (f", body binary, carried {kind}" if kind else ""))
        spans = rows.join(hits, "row", "left").select("id", "n_words", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("starts", "array<int>"), ("ends", "array<int>"), ("items", "array<bigint>"))], *rows.columns[3:])
        out = spans.mapInArrow(_finish, _FINISHED + (f", body binary, carried {kind}" if kind else ""))
    return carried(out, carry, text_col).withColumnRenamed("id", id_col)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = [len(fold_words(x)) for x in b.column(1).to_pylist()]
        along = ["body", "carried"] if b.num_columns > 3 else []
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *(b.column(c) for c in ["row", *along])], ["id", "n_words", "row", *along])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for r in b.select(["id", "n_words", "starts", "ends", "items"]).to_pylist():
            spans: list[list[int]] = []
            for s, e in sorted(zip(r["starts"], r["ends"])):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e)
                else:
                    spans.append([s, e])
            n_hit = sum(e - s for s, e in spans)
            n_items, digest = _digest(r["items"])
            rows.append((r["id"], r["n_words"], n_hit, n_items, r["items"], [s for s, _ in spans], [e for _, e in spans], digest, n_hit > 0 and 20 * n_hit >= r["n_words"]))
        kinds = [("id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items_sha256", pa.string()), ("contaminated", pa.bool_())]
        yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)), *b.columns[5:]], [*(n for n, _ in kinds), *b.schema.names[5:]])
