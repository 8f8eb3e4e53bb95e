"""Substring dedup by compaction of the corpus' De Bruijn graph.

Edges are windows of ``window`` consecutive words, nodes their starts and ends of one word less. Edges are dealt out by
their minimizer (the smallest hash among the window's ``ANCHOR``-grams), which equal windows share; consecutive windows
with one minimizer travel as one path piece with its coordinates (document, word). Where the pieces of one minimizer meet,
each edge gets its source: the first place in the document with the smallest id. Neighbouring edges of a document whose
sources are neighbours too form a nonbranching repeated path; pieces of a path that fell to different minimizers are
glued by their coordinates after a shuffle by document. Each glued path is then verified: a strong digest of
its words in the document is compared, through joins, with that of the words at its source coordinates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import parts, stored, texts
from tidelog.llm.wordhash import grams, hashed

WINDOW = 13
ANCHOR = 5
#: Bytes of an edge's hash that travel, besides the eight of its minimizer.
EDGE_BYTES = 5


def _pieces(window: int):
    anchor = min(ANCHOR, window)
    reach = window - anchor + 1
    size = pa.int32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for w in hashed(batch.column(1)):
                n = len(w.hashes)
                if n < window:
                    continue
                left = np.repeat(w.base + w.count, w.count)[: n - window + 1] - np.arange(n - window + 1)
                at = np.flatnonzero(left >= window)  # windows inside one document
                if not len(at):
                    continue
                small = grams(w.hashes, anchor, 0x8EBC6AF09C88C6E3)
                edge = grams(w.hashes, window, 0x589965CC75374CC3)[at]
                best = small[at]
                for k in range(1, reach):
                    np.minimum(best, small[at + k], out=best)
                new = np.ones(len(at), bool)  # also where a word repeats over and over, its windows are one piece
                new[1:] = (best[1:] != best[:-1]) | (at[1:] != at[:-1] + 1)
                first = np.flatnonzero(new)
                row = w.row[at[first]]
                raw = edge.view(np.uint8).reshape(-1, 8)[:, :EDGE_BYTES].tobytes()
                bounds = np.append(first, len(at)).astype(np.int32) * EDGE_BYTES
                payload = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array(best[first].view(np.int64)), pa.array(ids[w.first + row]), pa.array((at[first] - w.base[row]).astype(np.int32), size), payload], ["key", "id", "at", "edges"])

    return run


def _sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pieces sorted by minimizer, then document and place: repeated path pieces with the coordinates of their source.

    Of the last minimizer the first places of its edges are carried to the next batch; else nothing is kept.
    """
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    last_key, carry = None, none
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.asarray(batch.column(0))
        payload = batch.column(3).cast(pa.large_binary())
        _, offs, raw = payload.buffers()
        offs = np.frombuffer(offs, np.int64)[payload.offset : payload.offset + len(payload) + 1]
        length = np.diff(offs) // EDGE_BYTES
        total = int(length.sum())
        wide = np.zeros((total, 8), np.uint8)
        wide[:, :EDGE_BYTES] = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]].reshape(total, EDGE_BYTES)
        edge = wide.view(np.uint64).ravel()
        row = np.repeat(np.arange(len(key)), length)
        doc = np.asarray(batch.column(1))[row]
        begin = np.cumsum(length) - length
        at = np.asarray(batch.column(2)).astype(np.int64)[row] + np.arange(total) - begin[row]
        change = np.concatenate([[False], key[1:] != key[:-1]])
        number = np.cumsum(change).astype(np.uint64)[row]
        extra = len(carry[0]) if last_key == key[0] else 0
        if extra:
            edge, doc, at = (np.concatenate([c, x]) for c, x in zip(carry, (edge, doc, at)))
            number = np.concatenate([np.zeros(extra, np.uint64), number])
            row = np.concatenate([np.full(extra, -1), row])
        _, first, back = np.unique(number << np.uint64(8 * EDGE_BYTES) | edge, return_index=True, return_inverse=True)
        source = first[back]
        end = number[first] == number[-1]
        carry, last_key = (edge[first[end]], doc[first[end]], at[first[end]]), key[-1]
        hit = np.flatnonzero(doc[source] < doc)
        hit = hit[hit >= extra]
        if not len(hit):
            continue
        sdoc, sat = doc[source[hit]], at[source[hit]]
        r, a = row[hit], at[hit]
        new = np.ones(len(hit), bool)
        new[1:] = (r[1:] != r[:-1]) | (a[1:] != a[:-1] + 1) | (sdoc[1:] != sdoc[:-1]) | (sat[1:] != sat[:-1] + 1)
        f = np.flatnonzero(new)
        n = np.diff(np.append(f, len(hit)))
        for k in range(0, len(f), 100_000):
            g = f[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(doc[hit[g]]), pa.array(a[g].astype(np.int32)), pa.array(n[k : k + 100_000].astype(np.int32)), pa.array(sdoc[g]), pa.array(sat[g].astype(np.int32))], ["id", "at", "n", "source", "source_at"])


def _glue(window: int):
    """Pieces of one document (a list each) to paths: the longest runs of neighbours with neighbouring sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                current = None
                for p in sorted(((p["at"], p["n"], p["source"], p["source_at"]) for p in pieces)):
                    if current and current[0] + current[1] == p[0] and current[2] == p[2] and current[3] + current[1] == p[3]:
                        current[1] += p[1]
                        continue
                    if current:
                        for o, v in zip(out, (i, *current)):
                            o.append(v)
                    current = list(p)
                if current:
                    for o, v in zip(out, (i, *current)):
                        o.append(v)
            words = [n + window - 1 for n in out[2]]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(words, pa.int32()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int32())], ["id", "at", "words", "source", "source_at"])

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, ats, sizes, found = [], [], [], []
        for i, body, spans in zip(*(c.to_pylist() for c in batch.columns)):
            words = (body or b"").split()
            for s in spans:
                ids.append(i)
                ats.append(s["at"])
                sizes.append(s["words"])
                found.append(hashlib.blake2b(b" ".join(words[s["at"] : s["at"] + s["words"]]), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ats, pa.int32()), pa.array(sizes, pa.int32()), pa.array(found, pa.binary())], ["id", "at", "words", "digest"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes the covered words; gives counts, the digest of what is kept, the kept text and the covered ranges."""
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [], [], [])
        for i, body, spans in zip(*(c.to_pylist() for c in batch.columns[:3])):
            words = (body or b"").split()
            ranges: list[list[int]] = []
            for s, n in sorted((s["at"], s["words"]) for s in spans or ()):
                if ranges and s <= ranges[-1][1]:
                    ranges[-1][1] = max(ranges[-1][1], s + n)
                else:
                    ranges.append([s, s + n])
            kept, at = [], 0
            for s, e in ranges:
                kept += words[at:s]
                at = e
            text = b" ".join(kept + words[at:])
            removed = sum(e - s for s, e in ranges)
            for o, v in zip(out, (i, len(words), removed, hashlib.sha256(text).hexdigest(), text if removed else body, [s for s, _ in ranges], [e for _, e in ranges])):
                o.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        names = ["id", "n_words", "n_removed", "kept_sha256", "kept", "starts", "ends"]
        yield pa.RecordBatch.from_arrays([*(pa.array(o, k) for o, k in zip(out, kinds)), *batch.columns[3:]], [*names, *batch.schema.names[3:]])


def repeated_paths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Maximal repeated paths before verification: id, ``at``, ``words``, and the ``source`` document and place they repeat."""
    bodies = texts(docs, id_col, text_col)[0].where(F.col("id").isNotNull())
    n = parts(bodies, factor=3)
    pieces = bodies.mapInArrow(_pieces(window), "key bigint, id bigint, at int, edges binary")
    dealt = pieces.repartition(n, "key").sortWithinPartitions("key", "id", "at")
    found = dealt.mapInArrow(_sources, "id bigint, at int, n int, source bigint, source_at int")
    lists = found.groupBy("id").agg(F.collect_list(F.struct("at", "n", "source", "source_at")).alias("pieces"))
    return lists.mapInArrow(_glue(window), "id bigint, at int, words int, source bigint, source_at int")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, ``n_words``, ``n_removed``, ``kept_sha256``, ``kept`` (text), ``starts`` and ``ends`` (removed word ranges).

    A word goes when a window of ``window`` words that covers it also starts in a document with a smaller id; all windows
    are judged on the input. ``kept`` joins the kept words by a blank; a text that loses nothing stays as it is. Null and
    empty texts have no words (the hash of nothing; ``kept`` null or empty). Rows with equal id count as one document
    for the order: none of them takes words from another (rows that repeat an id are expected to repeat its text). Rows without id lose nothing. Extra columns are left
    out, but for those in ``carry``, which come back as the fields of ``carried``.
    A path whose digest differs from its source's (a hash collision) is not removed.
    """
    bodies, _ = texts(docs, id_col, text_col)
    paths = stored(repeated_paths(docs, id_col, text_col, window), "paths")
    places = paths.select("id", "at", "words").unionByName(paths.select(F.col("source").alias("id"), F.col("source_at").alias("at"), "words")).distinct()
    wanted = places.groupBy("id").agg(F.collect_list(F.struct("at", "words")).alias("spans"))
    digests = bodies.join(wanted, "id").select("id", "body", "spans").mapInArrow(_digests, "id bigint, at int, words int, digest binary")
    digests = stored(digests, "digests")
    own = digests.withColumnRenamed("digest", "own").groupBy("id", "at", "words").agg(F.min("own").alias("own"))
    there = digests.select(F.col("id").alias("source"), F.col("at").alias("source_at"), "words", "digest")
    same = paths.join(own, ["id", "at", "words"]).join(there, ["source", "source_at", "words"]).where(F.col("own") == F.col("digest"))
    gone = stored(same.select("id", "at", "words").distinct().groupBy("id").agg(F.collect_list(F.struct("at", "words")).alias("spans")), "gone")
    whole, kind = texts(docs, id_col, text_col, carry)
    out = whole.join(gone, "id", "left").select("id", "body", "spans", *whole.columns[2:])
    out = out.mapInArrow(_cut, "id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept binary, starts array<int>, ends array<int>" + (f", carried {kind}" if carry else ""))
    return out.withColumn("kept", F.col("kept").cast("string")).withColumnRenamed("id", id_col)
