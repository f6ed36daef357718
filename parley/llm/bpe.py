"""Byte-level BPE by a sentencepiece model made from the vocabulary alone.

The model file is written directly (protocol buffers): every token's bytes become
a piece of one character per byte, its score is its negative rank, nothing is
normalised, and ids equal ranks. Merging the best-scored neighbours is then
merging the lowest rank, so each pre-token encodes as the byte-level merges do.
Pre-tokens are cut by the pattern, encoded once per task and remembered; decoding
goes from ids to pieces and from characters back to bytes.

* Missing texts count as empty; empty texts have no ids. Repeated rows alike.
* A pre-token may be as long as the text: merging uses a queue, not rescans.
"""
from __future__ import annotations

import base64
import hashlib
import struct
import sys
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import slices, text_of

#: Characters that stand for the bytes 0 .. 255: a range without white space, marks of the library or combining characters.
FIRST_CHAR = 0x4E00
REMEMBERED = 1 << 20  # pre-tokens a task remembers before it starts anew
RESULT = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


TO_PIECE = {b: FIRST_CHAR + b for b in range(256)}


def as_piece(token: bytes) -> str:
    return token.decode("latin-1").translate(TO_PIECE)


def as_bytes(piece: str) -> bytes:
    return bytes(ord(c) - FIRST_CHAR for c in piece)


def field(number: int, value: int | float | bytes) -> bytes:
    """One protocol buffer field: whole number, 32-bit float, or bytes with their length."""
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def model_file(ranks: dict[bytes, int]) -> bytes:
    """The serialised model. The unknown piece, which no text reaches, comes after the last rank."""
    order = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = [field(1, as_piece(t).encode()) + field(2, float(-r)) + field(3, 1) for r, t in enumerate(order)]
    pieces.append(field(1, b"<unk>") + field(2, 0.0) + field(3, 2))
    trainer = field(3, 2) + field(4, len(pieces)) + field(40, len(order))  # type BPE, vocabulary size, unknown id
    trainer += b"".join(field(n, (1 << 64) - 1) for n in (41, 42, 43))  # no begin, end or padding pieces
    normalizer = field(1, b"identity") + b"".join(field(n, 0) for n in (3, 4, 5))  # no dummy prefix, stripping or escapes
    return b"".join(field(1, p) for p in pieces) + field(2, trainer) + field(3, normalizer)


class Codec:
    """Encodes and decodes whole texts with one model."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        n = self.model.get_piece_size() - 1
        self.bytes_of = [as_bytes(self.model.id_to_piece(i)) for i in range(n)]

    def ids(self, text: str) -> array:
        known, parts = self.known, self.cut(text)
        new = [p for p in set(parts) if p not in known]
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(set(parts))
            for part, ids in zip(new, self.model.encode([as_piece(p.encode()) for p in new], out_type=int, num_threads=1)):
                known[part] = array("I", ids).tobytes()
        out = array("I")
        out.frombytes(b"".join(map(known.__getitem__, parts)))
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def model_of(vocab_path: str | None = None, pattern: str | None = None) -> tuple[bytes, str]:
    import public_tokenizers

    return (model_file(read_ranks(vocab_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))),
            pattern or public_tokenizers.PATTERN)


def encoded(docs: DataFrame, vocab_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ``ids`` (array of int) of every row."""
    model, cut = model_of(vocab_path, pattern)

    def work(batches):
        codec = Codec(model, cut)
        for b in slices(batches):
            ids = [codec.ids(t) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("_text")).mapInArrow(work, f"doc_id {kind}, ids array<int>")


def digested(docs: DataFrame, vocab_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of the ids (little-endian, 32 bits) and of the bytes they decode to."""
    model, cut = model_of(vocab_path, pattern)

    def work(batches):
        codec = Codec(model, cut)
        for b in slices(batches):
            n, of_ids, of_bytes = [], [], []
            for text in b.column("_text").to_pylist():
                ids = codec.ids(text)
                n.append(len(ids))
                of_ids.append(hashlib.sha256(little_endian(ids)).hexdigest())
                of_bytes.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("_text")).mapInArrow(work, f"doc_id {kind}, {RESULT}")


def little_endian(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def query(spark, sf_dir):
    return digested(spark.read.parquet(f"{sf_dir}/documents.parquet"))
