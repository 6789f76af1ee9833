"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

Each byte is shown as the character 256 + byte, so that every piece of the vocabulary is plain text; its
score is its negative rank and normalisation is off, so sentencepiece merges what the ranks merge first.
Texts are cut by the pattern, each pre-token is encoded by itself, and ids map back to bytes by a table.

Null texts count as empty and have no ids. The rank file is a parameter; it is read on the driver and its
bytes (under 1 MB) go to the tasks. Vocabularies whose bytes are not all there are refused.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import pieces, texts

#: Pre-tokens whose ids a task remembers; then it starts anew.
MEMORY = 100_000


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """A protocol buffer field: varint, 32-bit float or bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def read_ranks(content: bytes) -> list[bytes]:
    """The pieces of a rank file in order of rank; ranks must be 0, 1, 2, ..."""
    rows = sorted((int(rank), base64.b64decode(piece)) for piece, rank in map(bytes.split, content.splitlines()) if rank)
    if [r for r, _ in rows] != list(range(len(rows))):
        raise ValueError("ranks are not consecutive")
    return [piece for _, piece in rows]


def shown(piece: bytes) -> str:
    return "".join(chr(256 + b) for b in piece)


def model_proto(vocabulary: list[bytes]) -> bytes:
    """The serialised sentencepiece model: a piece's id is its rank; the unknown piece comes last."""
    normal, unknown, bpe = 1, 2, 2
    body = b"".join(_field(1, _field(1, shown(p).encode()) + _field(2, -float(rank)) + _field(3, normal)) for rank, p in enumerate(vocabulary))
    body += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    body += _field(2, _field(3, bpe) + _field(4, len(vocabulary) + 1) + _field(40, len(vocabulary)))
    return body + _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))


class Codec:
    """Encodes and decodes with one vocabulary; made once in each task."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex
        import sentencepiece

        self.vocabulary = read_ranks(ranks)
        self.whole = {p: i for i, p in enumerate(self.vocabulary)}
        if any(bytes([b]) not in self.whole for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.cut = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.vocabulary))
        self.table = {b: chr(256 + b) for b in range(256)}
        self.known: dict[str, bytes] = {}

    def learn(self, pretokens: Iterable[str]) -> None:
        rest, raw = [], []
        for t in pretokens:
            b = t.encode("utf-8", "surrogatepass")
            if (rank := self.whole.get(b)) is not None:  # a whole piece needs no merges
                self.known[t] = rank.to_bytes(4, "little")
            else:
                rest.append(t)
                raw.append(b.decode("latin-1"))
        if rest:  # one call for all: each call starts threads of its own
            ids = self.model.encode("\n".join(raw).translate(self.table).split(self.table[10]) if not any("\n" in x for x in raw) else [x.translate(self.table) for x in raw], num_threads=1)
            for t, x in zip(rest, ids, strict=True):
                self.known[t] = array("I", x).tobytes()

    def encode(self, many: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        found = [self.cut(t) for t in many]
        missing = set().union(*found).difference(self.known)
        if len(self.known) + len(missing) > MEMORY:
            self.known.clear()
            missing = set().union(*found)
        self.learn(missing)
        return [b"".join(map(self.known.__getitem__, x)) for x in found]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and ids array<int> of each row's text."""
    ranks = _ranks(ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks, pattern)
        for b in pieces(batches, text):
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in codec.encode(texts(b, text))]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keep), pa.array(ids, pa.list_(pa.int32()))], [*keep, "ids"])

    source = docs.select(*keep, text)
    return source.mapInArrow(run, ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keep) + ", ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and decoded binary; null ids give null."""
    ranks = _ranks(ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = read_ranks(ranks)
        for b in batches:
            out = [None if x is None else b"".join(map(vocabulary.__getitem__, x)) for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keep), pa.array(out, pa.binary())], [*keep, "decoded"])

    source = encoded.select(*keep, ids)
    return source.mapInArrow(run, ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keep) + ", decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encode, then decode the ids, in one pass over the texts."""
    ranks = _ranks(ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks, pattern)
        for b in pieces(batches):
            ids = codec.encode(texts(b))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(b.schema.get_field_index("doc_id")),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
