"""SentencePiece merge-type (BPE) encoding and decoding, exactly, by backtracking.

For one word all vocabulary pieces that occur in it are found in one Aho-Corasick pass; the longest piece at each
position is tried first. Two neighbours are compatible when merging their joined text again, pair by pair in score
order, gives back the same two pieces; a sequence whose neighbours are all compatible is the merge result. When no
piece fits, the position is marked in a bitfield as failed, the last piece is taken back and a shorter one is tried.

No piece holds a word mark after another character, so merges never cross a word's start: texts are cut there, and
each distinct word is encoded once per worker (a bounded memo). Characters outside the vocabulary fall back to bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.common import texts

MARK = "▁"
MEMO = 400_000
_TAIL = re.compile(rb"[!-/:-@\[-`{-~\n]+$")


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


class _Memo(dict):
    """A dictionary that computes what it lacks and starts anew when full, so its memory is bounded."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= MEMO:
            self.clear()
        value = self[key] = self.make(key)
        return value


class PieceCodec:
    """Encodes and decodes with one model file (merge type, identity normaliser, byte fallback)."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            message = dict(_fields(f.read()))
        trainer, normal = dict(_fields(message[2])), dict(_fields(message[3]))
        if trainer.get(3) != 2 or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or not trainer.get(35):
            raise ValueError("only merge-type models with identity normalisation and byte fallback are supported")
        if not normal.get(3, 1):
            raise ValueError("models without a blank before the text are not supported")
        size = model.get_piece_size()
        if any(model.is_unused(i) for i in range(size)):
            raise ValueError("models with unused pieces are not supported")
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) for i in range(size)]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i] and not model.is_byte(i)}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        if any(MARK in p.lstrip(MARK) for p in self.ids) or any(p[:2] == MARK * 2 and p.strip(MARK) for p in self.ids):
            raise ValueError("pieces that cross a word's start are not supported")
        self.chars = {c for p in self.ids for c in p}
        self.raw = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if special[i] else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        known = set(self.ids) | self.chars  # a character of some piece takes part in merges even if it is no piece itself
        self.automaton = ahocorasick.Automaton()
        for p in known:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in known), "") for p in known}
        self.known = re.compile("[" + re.escape("".join(sorted(self.chars))) + "]+|.", re.DOTALL)
        self.fits: dict[tuple[str, str], bool] = {}
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.memo = _Memo(self._both)
        self.tails = _Memo(self._tail)

    def merged(self, text: str) -> list[str]:
        """Merging by the definition: again and again the best-scored neighbours, the leftmost on ties."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= MEMO:
                self.fits.clear()
            known = self.fits[key] = self.merged(left + right) == [left, right]
        return known

    def split(self, text: str) -> list[str]:
        """The pieces of a run of vocabulary characters, by backtracking."""
        n = len(text)
        longest = [""] * (n + 1)
        for end, piece in self.automaton.iter(text):  # ends rise, so the last one noted at a start is the longest
            longest[end + 1 - len(piece)] = piece
        failed = 0  # bit i: nothing fits from position i on
        out: list[str] = []
        at, piece, last = 0, longest[0], ""
        known, shorter = self.fits.get, self.shorter
        while at < n:
            while piece:
                if not last or ((fit := known((last, piece))) or fit is None and self.compatible(last, piece)):
                    if not failed or not failed >> (at + len(piece)) & 1:
                        break
                piece = shorter[piece]
            if piece:
                out.append(piece)
                at += len(piece)
                last = piece
                piece = longest[at]
            else:
                failed |= 1 << at
                if not out:
                    return self.merged(text)  # not reached where each piece merges to itself; the definition then decides
                piece = out.pop()
                at -= len(piece)
                last = out[-1] if out else ""
        return out

    def word(self, text: str) -> list[int]:
        """Ids of one normalised word."""
        ids: list[int] = []
        for run in self.known.findall(text):
            if run[0] in self.chars:
                for piece in self.split(run):
                    one = self.ids.get(piece)
                    ids += [one] if one is not None else [self.byte_ids[b] for b in piece.encode()]
            else:
                ids += [self.byte_ids[b] for b in run.encode()]
        return ids

    def _both(self, key: bytes) -> tuple[bytes, bytes]:
        """Ids as text, and what they decode to, of a word; ``key`` is the word without its first blank."""
        if (cut := _TAIL.search(key)) and (at := cut.start()) and key[at - 1] != 32:
            last = at - 1
            while key[last] & 0xC0 == 0x80:  # to the first byte of the head's last character
                last -= 1
            if key[last : at + 1].decode() not in self.joined:  # no piece holds these two characters side by side
                head, tail = self.memo[key[:at]], self.tails[key[at:]]
                return head[0] + b"," + tail[0], head[1] + tail[1]
        return self._ids(self.word(MARK + key.decode().replace(" ", MARK)))

    def _tail(self, key: bytes) -> tuple[bytes, bytes]:
        return self._ids(self.word(key.decode()))

    def _ids(self, ids: list[int]) -> tuple[bytes, bytes]:
        return ",".join(map(str, ids)).encode(), b"".join([self.raw[i] for i in ids])

    @staticmethod
    def words(body: bytes) -> list[bytes]:
        """The text with a blank before it, cut where words start; each word without its first blank, but with any others before it."""
        if not body:
            return []
        if b"\xe2\x96\x81" in body:
            body = body.replace(b"\xe2\x96\x81", b" ")
        if b"  " in body or body[-1:] == b" " or body[:1] == b" ":
            return [w[1:] for w in re.findall(rb" *[^ ]+| +", b" " + body)]
        return body.split(b" ")

    def both(self, body: bytes) -> tuple[bytes, bytes]:
        """The ids as decimal numbers joined by commas, and the UTF-8 text that these ids decode to."""
        each = list(map(self.memo.__getitem__, self.words(body)))
        return b",".join([x for x, _ in each]), b"".join([x for _, x in each])[1:]

    def forget(self) -> None:
        """Empties the memos."""
        self.memo.clear()
        self.tails.clear()
        self.fits.clear()

    def encode(self, text: str) -> list[int]:
        csv = self.both(text.encode())[0]
        return [int(x) for x in csv.split(b",")] if csv else []

    def decode(self, ids: list[int]) -> str:
        """The text of any ids; bytes that form no character become U+FFFD."""
        raw = b"".join([self.raw[i] for i in ids])
        return raw.removeprefix(b" ").decode("utf-8", "replace")


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec per worker process and model file."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, digests_only: bool = False) -> DataFrame:
    """Per row: the id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, unless ``digests_only``, ``ids`` (array) and ``decoded``.

    ``model``: a model file's path on every executor; by default the public 32k model, found by each worker itself.
    Null and empty texts give no ids and the hash of nothing. Repeated rows are encoded each; extra columns are left out.
    A narrow map: no shuffle, memory bounded by one batch of rows and the memo.
    """
    extra = "" if digests_only else ", ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model or model_path())
        try:
            yield from encoded(c, batches)
        finally:  # workers outlive tasks
            c.forget()

    def encoded(c: PieceCodec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 250):
                part = batch.slice(start, 250)
                counts, id_hash, back_hash, ids, decoded = [], [], [], [], []
                for body in part.column(1).to_pylist():
                    csv, back = c.both(body or b"")
                    counts.append(csv.count(b",") + 1 if csv else 0)
                    id_hash.append(hashlib.sha256(csv).hexdigest())
                    back_hash.append(hashlib.sha256(back).hexdigest())
                    if not digests_only:
                        ids.append([int(x) for x in csv.split(b",")] if csv else [])
                        decoded.append(back.decode())
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(id_hash, pa.string()), pa.array(back_hash, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if not digests_only:
                    columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    out = texts(df, id_col, text_col)[0].mapInArrow(run, "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + extra)
    return out.withColumnRenamed("id", id_col)
