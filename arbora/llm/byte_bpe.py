"""Exact byte-level BPE of a public vocabulary by backtracking over longest token matches."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The vocabulary as ranks; a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that cuts a text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a worker keeps; then it starts anew.
KEPT_PIECES = 300_000
#: Rows of one output batch.
BATCH_ROWS = 1024

_PIECES = regex.compile(PATTERN)
# a blank that is followed by neither white space nor the end begins a piece, whatever stands before it
_CHUNKS = regex.compile(r"(?= \S)", flags=regex.V1)
_DOUBLE = regex.compile(r" \s")


@dataclass
class Tables:
    """What a vocabulary gives: the tokens' bytes in one buffer with offsets, and the two tokens that each is merged from.

    Its size is that of the vocabulary file, whatever the corpus.
    """

    buffer: bytes
    offsets: np.ndarray
    left: np.ndarray
    right: np.ndarray


def read_tables(path: str = VOCABULARY) -> Tables:
    with open(path, "rb") as file:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, file))
    tokens = [token for _, token in ranked]
    ids = {token: k for k, token in enumerate(tokens)}
    left, right = np.arange(len(tokens), dtype=np.int32), np.arange(len(tokens), dtype=np.int32)
    for k, token in enumerate(tokens):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ids.get(parts[i] + parts[i + 1], len(tokens)))
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            left[k], right[k] = ids[parts[0]], ids[parts[1]]
    return Tables(b"".join(tokens), np.cumsum([0, *map(len, tokens)]).astype(np.int64), left, right)


class Encoder:
    """Encodes pieces of text by backtracking: take the longest token, and a shorter one or a step back
    where two neighbours could not have come out of the merges side by side."""

    def __init__(self, tables: Tables) -> None:
        bounds = tables.offsets.tolist()
        self.tokens = [tables.buffer[a:b] for a, b in zip(bounds, bounds[1:])]
        self.left, self.right = tables.left.tolist(), tables.right.tolist()
        self.pairs = {(a, b): k for k, (a, b) in enumerate(zip(self.left, self.right)) if a != k}
        self.ids = {token: k for k, token in enumerate(self.tokens)}
        self.automaton = ahocorasick.Automaton()
        for k, token in enumerate(self.tokens):
            self.automaton.add_word(token.decode("latin-1"), (k, len(token)))
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.first, self.later = _Kept(self, ""), _Kept(self, " ")

    def fit(self, a: int, b: int) -> bool:
        """Whether a and b can stand side by side: undo their merges, latest first, and see that no earlier merge crosses the gap."""
        key = (a, b)
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > 1_000_000:
                self.compatible.clear()
            known = self.compatible[key] = self._fit(a, b)
        return known

    def _fit(self, a: int, b: int) -> bool:
        undone = len(self.tokens)  # merges from this rank on had not yet happened
        while True:
            if self.pairs.get((a, b), undone) < undone:
                return False
            whole_a, whole_b = self.left[a] == a, self.left[b] == b
            if whole_a and whole_b:
                return True
            # of equal ranks the left one was merged first, so the right one is undone first
            if whole_b or (not whole_a and a > b):
                undone, a = a, self.right[a]
            else:
                undone, b = b + 1, self.left[b]

    def encode_bytes(self, piece: bytes) -> list[int]:
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        starts: list[list[int]] = [[] for _ in piece]
        for end, (k, length) in self.automaton.iter(piece.decode("latin-1")):
            starts[end - length + 1].append(k)  # shorter ones come first
        out: list[int] = []
        tried = [len(s) for s in starts]  # candidates left at each place
        dead = bytearray(len(piece) + 1)
        at = 0
        while at < len(piece):
            while tried[at]:
                tried[at] -= 1
                k = starts[at][tried[at]]
                end = at + len(self.tokens[k])
                if not dead[end] and (not out or self.fit(out[-1], k)):
                    out.append(k)
                    at = end
                    break
            else:
                # no way on from here after this token: another one before it
                dead[at] = 1
                at -= len(self.tokens[out.pop()])
                continue
            if at < len(piece):
                tried[at] = len(starts[at])
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text, as 32-bit integers in machine order."""
        if _DOUBLE.search(text):
            return b"".join(map(self.first.__getitem__, _CHUNKS.split(text)))
        head, *rest = text.split(" ")
        return b"".join((self.first[head], *map(self.later.__getitem__, rest)))


class _Kept(dict):
    """Ids of the chunks seen so far; a chunk begins at the text's start or at a blank, and holds one piece or more."""

    def __init__(self, encoder: Encoder, before: str) -> None:
        self.encoder, self.before = encoder, before

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= KEPT_PIECES:
            self.clear()
        ids = [k for piece in _PIECES.findall(self.before + chunk) for k in self.encoder.encode_bytes(piece.encode("utf-8", "replace"))]
        found = self[chunk] = np.array(ids, np.int32).tobytes()
        return found


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(shared) -> Encoder:
    """This worker's encoder for the broadcast tables."""
    if shared.id not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[shared.id] = Encoder(shared.value)
    return _ENCODERS[shared.id]


class SharedTables:
    """The vocabulary's tables, read once on the driver and broadcast (a few MB, fixed by the file)."""

    def __init__(self, spark: SparkSession, path: str = VOCABULARY) -> None:
        self.broadcast = spark.sparkContext.broadcast(read_tables(path))
        self.id = path

    @property
    def value(self) -> Tables:
        return self.broadcast.value

    def __getstate__(self) -> dict:
        return {"broadcast": self.broadcast, "id": self.id}


def encode_documents(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): every text whole, as ordinary text; empty and null texts give an empty list.

    Repeated rows and null doc_ids come out as they went in; an empty table gives no rows.
    """
    shared = SharedTables(documents.sparkSession, vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        for batch in batches:
            for part in (batch.slice(k, BATCH_ROWS) for k in range(0, batch.num_rows, BATCH_ROWS)):
                ids = [encoder.encode(t) if t else b"" for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(encode, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): each id's bytes are cut from one buffer by its offsets. A null list gives null, an empty one the empty text."""
    shared = SharedTables(encoded.sparkSession, vocabulary)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        buffer, offsets = np.frombuffer(tables.buffer, np.uint8), tables.offsets
        for batch in batches:
            texts = []
            for ids in batch.column(1):
                if not ids.is_valid:
                    texts.append(None)
                    continue
                k = ids.values.to_numpy()
                length = offsets[k + 1] - offsets[k]
                ends = np.cumsum(length)
                at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[k] - ends + length, length)
                texts.append(buffer[at].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id bigint, text string")


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens); empty and null texts have none."""
    shared = SharedTables(documents.sparkSession, vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        for batch in batches:
            n = [len(encoder.encode(t)) // 4 if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32())], ["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(count, "doc_id bigint, n_tokens int")


def token_lengths(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", F.size("ids").alias("n_tokens"))
