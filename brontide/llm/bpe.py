"""Byte-level BPE as a serialised sentencepiece model.

A tiktoken-style rank file is turned into a sentencepiece BPE model without
training: each byte is mapped to one visible character, every vocabulary entry
becomes a piece scored by its negative rank, and the normaliser is the identity,
so sentencepiece's highest-score-first merging is rank-order merging.  The
``ModelProto`` is written directly in protobuf wire format.  A pre-token (one
match of the pattern) is byte-mapped and encoded by the processor unless it is a
vocabulary entry itself, as tiktoken does; ids decode by the inverse map.

A rank-ordered merge needs each intermediate piece in the vocabulary, which
byte-level BPE vocabularies have by construction.

Work per distinct segment (see ``ByteBPE.segments``), not per occurrence: a bounded memo in each worker
keeps the ids.  Everything happens in one ``mapInArrow`` pass, without shuffle.

Defined cases: a null text encodes as an empty one (no ids, empty bytes); a very long text, and a very long pre-token, is encoded
whole; repeated rows, and those of a null doc_id, give an answer each; merges of equal rank don't exist; other columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brontide.llm.shared import table

#: Segments kept in a worker's memo before it starts anew.
MEMO = 300_000
#: Texts cut and encoded together.
TEXTS = 64
#: Byte b is shown as code point FIRST_CHAR + b (letters and syllables that no normaliser touches).
FIRST_CHAR = 0xAC00
TO_CHARS = {i: chr(FIRST_CHAR + i) for i in range(256)}


def byte_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(TO_CHARS)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value) -> bytes:
    """One protobuf field: int as varint, float as fixed32, bytes and str length-delimited."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A ModelProto whose piece id is the rank + 1; id 0 is the unknown piece that the format demands."""
    pieces = [_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if rank != len(pieces) - 1:
            raise ValueError("ranks must run from 0 without gaps")
        pieces.append(_field(1, _field(1, byte_chars(token)) + _field(2, float(-rank)) + _field(3, 1)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normalizer = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBPE:
    """Encoder and decoder over one rank file."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.tokens = [t for t, _ in sorted(self.ranks.items(), key=lambda x: x[1])]
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.ranks))
        self.find = regex.compile(pattern).findall
        self.blank_run = regex.compile(r"\s\s").search
        self.memo: dict[str, bytes] = {}

    def _learn(self, segments: list[str]) -> None:
        """Put the ids of these segments, as little-endian unsigned 32-bit bytes, into the memo."""
        parts = [[p.encode() for p in self.find(s)] for s in segments]
        unknown = [p for p in dict.fromkeys(p for ps in parts for p in ps) if p not in self.ranks]
        got = self.processor.encode([byte_chars(p) for p in unknown], num_threads=1) if unknown else []
        known = {p: np.array(ids, "<u4") - 1 for p, ids in zip(unknown, got, strict=True)}
        for s, ps in zip(segments, parts, strict=True):
            self.memo[s] = b"".join([known[p].tobytes() if p in known else self.ranks[p].to_bytes(4, "little") for p in ps])

    def segments(self, text: str) -> list[str]:
        """Pieces whose pre-tokens are those of the whole text.

        A pre-token that holds a space and a non-space starts with that space, so
        a text without two blanks in a row can be cut before each space; any other
        text is cut into its pre-tokens.
        """
        if self.blank_run(text):
            return self.find(text)
        first, *rest = text.split(" ")
        return [first] * bool(first) + [" " + s for s in rest]

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut = [self.segments(t) for t in texts]
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        new = {s: None for segments in cut for s in segments if s not in memo}
        if new:
            self._learn(list(new))
        return [b"".join([memo[s] for s in segments]) for segments in cut]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes([text])[0], "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def encoder(path: str | None = None, pattern: str | None = None) -> ByteBPE:
    """One per worker. By default the public multi-language vocabulary and its pattern."""
    import public_tokenizers

    return ByteBPE(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), ids_sha256, decoded_sha256 of each row's text."""

    def run(batches):
        bpe = encoder(path, pattern)
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for first in range(0, batch.num_rows, TEXTS):
                texts = [t or "" for t in batch.column(1).slice(first, TEXTS).to_pylist()]
                for data in bpe.encode_bytes(texts):
                    back = bpe.decode(np.frombuffer(data, "<u4").tolist())
                    for column, value in zip(rows, (len(data) // 4, data if keep_ids else None, hashlib.sha256(data).hexdigest(), hashlib.sha256(back).hexdigest()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.string())], names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")
