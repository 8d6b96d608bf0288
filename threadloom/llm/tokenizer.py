"""Token ids of a byte-level BPE vocabulary by a sentencepiece model made from it.

The model is serialised straight from the vocabulary file: each token's bytes are
mapped to printable characters, its score is its negative rank (so that the lowest
rank merges first, the leftmost first among equals), the normaliser is the identity.
Texts are cut into pre-tokens by the vocabulary's pattern; each distinct pre-token of a
worker is encoded once. Nothing is trained and no vocabulary is kept in this repository.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from threadloom.llm.spread import spread

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Pre-tokens remembered per worker; beyond it the memory starts afresh.
REMEMBERED = 200_000
#: A run of this many characters without a pre-token boundary is encoded without being remembered.
LONG = 64

#: Fixed value: the pre-token pattern that the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable, else the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 0x100
    for b in range(256):
        out.append(chr(b if b in printable else free))
        free += b not in printable
    return out


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the next id is the unknown piece."""
    normal, unknown, bpe, none = 1, 2, 2, -1
    to = byte_characters()
    pieces = [b""] * len(ranks)
    for token, rank in ranks.items():
        text = "".join(to[b] for b in token).encode()
        pieces[rank] = _field(1, text) + _field(2, float(-rank)) + _field(3, normal)
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(ranks)) + b"".join(_field(k, none) for k in (41, 42, 43))
    normalizer = _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


def read_ranks(folder: str = FOLDER, vocabulary: str = VOCABULARY) -> dict[bytes, int]:
    with open(os.path.join(folder, vocabulary + ".tiktoken"), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Encoder:
    """Encodes and decodes whole texts. Null and empty texts have no ids."""

    def __init__(self, folder: str = FOLDER, vocabulary: str = VOCABULARY):
        import regex
        import sentencepiece

        ranks = read_ranks(folder, vocabulary)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.cut = regex.compile(PATTERN).findall
        self.to = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        self.known: dict[str, list[int]] = {}

    def _encode(self, pre_tokens: list[str]) -> list[list[int]]:
        # bytes as characters of latin-1, then mapped to printable ones
        return self.model.encode([x.encode().decode("latin-1").translate(self.to) for x in pre_tokens], num_threads=1) if pre_tokens else []

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        parts, known = self.cut(text), self.known
        try:
            return [i for x in parts for i in known[x]]
        except KeyError:
            pass
        new = [x for x in dict.fromkeys(parts) if x not in known]
        if new:
            if len(known) > REMEMBERED:
                known.clear()
                new = list(dict.fromkeys(parts))
            ids = self._encode(new)
            once = {}
            for x, y in zip(new, ids, strict=True):
                (known if len(x) <= LONG else once)[x] = y
            if once:
                return [i for x in parts for i in (known[x] if len(x) <= LONG else once[x])]
        return [i for x in parts for i in known[x]]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode()


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Encoder:
    """The encoder of this process, made once."""
    key = (folder, vocabulary)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(key, ids)``: one row per input row; ids of null and of empty text are an empty list.

    Only the two columns are read, texts are never cut, and there is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(folder, vocabulary)
        for batch in batches:
            ids = pa.array([own.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["key", "ids"])

    source = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return spread(source).mapInArrow(run, f"key {dict(docs.dtypes)[key]}, ids array<int>").withColumnRenamed("key", key)


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(key, same, n_tokens)``; ``same`` is a hash of the text, null where it is null."""
    import pyspark.sql.functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(folder, vocabulary)
        for batch in batches:
            n = pa.array([len(own.encode(t)) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["key", "same", "n_tokens"])

    source = docs.select(docs[key].alias("key"), F.when(docs[text].isNotNull(), F.xxhash64(docs[text])).alias("same"), docs[text].alias("text"))
    return spread(source).mapInArrow(run, f"key {dict(docs.dtypes)[key]}, same bigint, n_tokens bigint").withColumnRenamed("key", key)
