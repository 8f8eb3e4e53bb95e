"""Toxicity scores by a logistic model whose training is counterfactually regularised.

Each labelled text is paired with counterfactuals: for every identity term in it, the token sequence with that term's occurrences swapped
within their group (``woman`` for ``man``; one term at a time, so that a text which names both isn't its own counterfactual). Training minimises
log loss + ``pull`` x the squared difference of the two texts' logits + an L2 term, so that a mention of a group as such can't carry
weight. Features are presence bits: a word and the starts of a word, hashed. Those of identity terms always take part; others are screened by their association with the label.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import carried, released, stored, texts

#: Groups of identity terms; a term's counterfactual is the next one of its group.
IDENTITY = (
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("girls", "boys"), ("female", "male"), ("mother", "father"), ("she", "he"), ("her", "his"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "arab"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("old", "young"), ("deaf", "blind", "disabled"), ("immigrant", "native"), ("immigrants", "natives"),
    ("frau", "mann"), ("frauen", "männer"), ("christen", "muslime", "juden"), ("femme", "homme"), ("femmes", "hommes"), ("chrétien", "musulman", "juif"),
    ("mujer", "hombre"), ("mujeres", "hombres"), ("cristiano", "musulmán", "judío"),
)
SWAP = {a.encode(): g[(i + 1) % len(g)].encode() for g in IDENTITY for i, a in enumerate(g)}
DIM = 1 << 17
#: Labelled rows that a model is fitted on at most: those with the smallest hash of the id.
FIT_ROWS = 12_000
#: Features that a model has at most, besides those of identity terms: the most strongly associated ones.
FEATURES = 4096
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _slot(feature: bytes) -> int:
    """A hash of a feature that is the same in every process."""
    import xxhash

    return xxhash.xxh32_intdigest(feature) % DIM


def word_slots(word: bytes) -> tuple[int, ...]:
    """Slots of a word: the word itself, and its first four and five characters when it is longer."""
    chars = word.decode("utf-8", "replace")
    starts = [chars[:n].encode() for n in (4, 5) if len(chars) > n]
    return tuple({_slot(b"=" + word), *(_slot(b"^" + s) for s in starts)})


def tokens_of(body: bytes | None) -> list[bytes]:
    return body.translate(_FOLD).split() if body else []


def words_of(body: bytes | None) -> set[bytes]:
    return set(tokens_of(body))


def counterfactuals(tokens: list[bytes]) -> list[list[bytes]]:
    """For each identity term in a token sequence: the sequence with the next term of its group in its places."""
    return [[SWAP[term] if t == term else t for t in tokens] for term in sorted({t for t in tokens if t in SWAP})]


@dataclass
class ToxicityModel:
    weights: np.ndarray  # float32, one for each slot
    bias: float

    def logit(self, words: set[bytes]) -> float:
        slots = {s for w in words for s in word_slots(w)}
        return self.bias + float(self.weights[list(slots)].sum()) if slots else self.bias


def _slots_of(words: set[bytes]) -> np.ndarray:
    return np.fromiter({s for w in words for s in word_slots(w)}, dtype=np.int32)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one task's texts: number, toxic ones, and both for each slot, as one row."""
    seen, toxic, n, bad = np.zeros(DIM, np.int32), np.zeros(DIM, np.int32), 0, 0
    for b in batches:
        for body, y in zip(b.column("body").to_pylist(), b.column("y").to_pylist()):
            slots = _slots_of(words_of(body))
            seen[slots] += 1
            n += 1
            if y:
                toxic[slots] += 1
                bad += 1
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([bad], pa.int64()), pa.array([zlib.compress(seen.tobytes(), 1)], pa.binary()), pa.array([zlib.compress(toxic.tobytes(), 1)], pa.binary())], ["n", "bad", "seen", "toxic"])


def _screened(seen: np.ndarray, toxic: np.ndarray, n: int, bad: int, screen: float) -> np.ndarray:
    """The slots that take part: those of identity terms that occur, and the strongest of those whose rows' labels differ from the base rate by ``screen``
    standard errors, over 5 rows at least."""
    identity = sorted({s for w in SWAP for s in word_slots(w) if seen[s]})
    rate = bad / n
    far = np.abs(toxic - seen * rate) / np.sqrt(np.maximum(seen, 1) * rate * (1 - rate))
    strong = np.flatnonzero((seen >= 5) & (far >= screen))
    strong = strong[np.argsort(-far[strong], kind="stable")][:FEATURES]
    return np.unique(np.concatenate([strong, np.array(identity, int)])).astype(np.int64)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_id: str = "doc_id", id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS, pull: float = 1.0, l2: float = 1e-4, epochs: int = 200, rate: float = 0.3, screen: float = 4.0) -> ToxicityModel:
    """Fits on at most ``rows`` labels, chosen by a hash of their id. Features are counted and screened on the executors, so the driver holds
    at most ``rows`` rows of at most ``FEATURES`` features, however long the texts.

    Labels without value or text are left out, an id counts once (as toxic, if any of its labels says so); null texts count as empty. Without rows, or with one class only, the bias is
    the smoothed log odds and all weights are zero.
    """
    chosen = labels.select(F.col(label_id).cast("bigint").alias("label_id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("label_id").agg(F.max("y").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("label_id"), "label_id").limit(rows)
    chosen = stored(texts(docs, id_col, text_col)[0].join(F.broadcast(chosen), F.col("id") == F.col("label_id")).select("body", (F.col("y") > 0).cast("int").alias("y")), "labelled")
    seen, toxic, n, bad = np.zeros(DIM), np.zeros(DIM), 0, 0
    with released(docs.sparkSession):
        for r in chosen.coalesce(8).mapInArrow(_counted, "n bigint, bad bigint, seen binary, toxic binary").collect():
            seen += np.frombuffer(zlib.decompress(r.seen), np.int32)
            toxic += np.frombuffer(zlib.decompress(r.toxic), np.int32)
            n, bad = n + r.n, bad + r.bad
    odds = float(np.log((bad + 0.5) / (n - bad + 0.5)))
    weights = np.zeros(DIM, np.float32)
    if not 0 < bad < n:
        return ToxicityModel(weights, odds)
    slots = _screened(seen, toxic, n, bad, screen)
    k = len(slots)
    column = np.full(DIM, -1, np.int32)
    column[slots] = np.arange(k)
    raw = column.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(raw, np.int32)

        def columns(tokens: list[bytes]) -> bytes:
            own = known[_slots_of(set(tokens))]
            return own[own >= 0].tobytes()

        for b in batches:
            sequences = [tokens_of(body) for body in b.column("body").to_pylist()]
            others = [[columns(o) for o in counterfactuals(t)] for t in sequences]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([columns(t) for t in sequences], pa.binary()), pa.array(others, pa.list_(pa.binary()))], ["y", "plain", "others"])

    got = chosen.mapInArrow(run, "y int, plain binary, others array<binary>").toArrow()
    y = np.array(got.column("y").to_pylist(), dtype=np.float64)

    def matrix(rows_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Column numbers of all rows, one after another, and the row of each."""
        cols = [np.frombuffer(r, np.int32) for r in rows_]
        return np.concatenate(cols).astype(np.int64) if cols else np.zeros(0, np.int64), np.repeat(np.arange(len(cols)), [len(c) for c in cols])

    cols, at = matrix(got.column("plain").to_pylist())
    pairs = [(i, o) for i, own in enumerate(got.column("others").to_pylist()) for o in own]
    twins = np.array([i for i, _ in pairs], np.int64)  # the text of each counterfactual
    tcols, tat = matrix([o for _, o in pairs])
    del got
    w, b = np.zeros(k), odds
    sums_w, sums_b = np.full(k, 1e-8), 1e-8
    for _ in range(epochs):  # full-batch AdaGrad
        z = b + np.bincount(at, w[cols], n)
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        g = (p - y) / n
        gb = g.sum()
        gw = np.bincount(cols, g[at], k) + l2 * w
        if len(twins) and pull:
            gap = 2 * pull * (z[twins] - b - np.bincount(tat, w[tcols], len(twins))) / n
            gw += np.bincount(cols, np.bincount(twins, gap, n)[at], k) - np.bincount(tcols, gap[tat], k)
        sums_w += gw * gw
        sums_b += gb * gb
        w -= rate * gw / np.sqrt(sums_w)
        b -= rate * gb / np.sqrt(sums_b)
    weights[slots] = w
    return ToxicityModel(weights, float(b))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, ``score`` (0 to 1) and ``predicted``. Null and empty texts get the bias alone; whole texts are read, however long, in time linear in them.

    A narrow map. The model is broadcast; its size is fixed by ``DIM``. Each distinct word's slots are looked up
    once per worker, in a bounded memo. Repeated rows are scored each; extra columns are left out, but for
    those in ``carry``, which come back as the fields of ``carried``.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.tobytes(), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, bias = shared.value
        weights = np.frombuffer(raw, np.float32)
        live = weights != 0
        memo: dict[bytes, tuple[int, ...]] = {}
        for b in batches:
            scores = []
            along = b.columns[1:] if b.num_columns > 2 else []
            for body in b.column("body").to_pylist():
                slots: set[int] = set()
                for w in words_of(body):
                    s = memo.get(w)
                    if s is None:
                        if len(memo) >= 100_000:
                            memo.clear()
                        s = memo[w] = tuple([x for x in word_slots(w) if live[x]])
                    if s:
                        slots.update(s)
                z = bias + float(weights[list(slots)].astype(np.float64).sum()) if slots else bias
                scores.append(1 / (1 + float(np.exp(-max(-500.0, min(500.0, z))))))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), *along], ["id", "score", "predicted", *(["body", "carried"] if along else [])])

    rows, kind = texts(docs, id_col, text_col, carry)
    out = rows.mapInArrow(run, "id bigint, score double, predicted int" + (f", body binary, carried {kind}" if carry else ""))
    return carried(out, carry, text_col).withColumnRenamed("id", id_col)


def remainder(id_col: str, m: int):
    """crc32 of the id as text, modulo m."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % m


def train_and_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold: int = 5) -> DataFrame:
    """Fits on the labelled rows outside the held-out fold (remainder 0) and scores every row; adds ``held_out``."""
    own = labels.select("doc_id", label_col).where(remainder("doc_id", fold) != 0)
    model = fit_toxicity(docs, own, "doc_id", id_col, text_col, label_col)
    return score_toxicity(docs, model, id_col, text_col).withColumn("held_out", remainder(id_col, fold) == 0)
