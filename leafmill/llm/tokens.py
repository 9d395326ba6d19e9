"""Encoding with a public byte-level BPE vocabulary, run by a sentencepiece model serialised from that vocabulary.

The rank file says which byte strings are tokens, the lowest rank merging first. The same tokenizer as a sentencepiece BPE
model: each byte becomes one printable character, each token a piece whose score is its negative rank, the normaliser is
the identity, and a piece's id is its rank. Nothing is trained. Texts are split into pre-tokens by the vocabulary's public
pattern; distinct pre-tokens are encoded once for each worker and kept in a memo of bounded size.

Defined cases: null and empty texts have the empty list; white space is text; strings that look like special tokens are
ordinary text, for the model has none. ``decode`` inverts the mapping exactly.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fixed value: the vocabulary's public pre-token pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens a worker remembers; beyond it the memo starts again.
MEMO = 200_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def read_ranks(path: str = VOCABULARY) -> list[bytes]:
    """The tokens' bytes by rank."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"ranks of {path} have gaps")
    return [t for _, t in pairs]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _integer(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value & (1 << 64) - 1)


def serialise_model(ranks: list[bytes]) -> bytes:
    """The vocabulary as a sentencepiece model file: pieces with ids equal to ranks, the unknown piece after them."""
    characters = byte_characters()
    missing = {bytes([b]) for b in range(256)} - set(ranks)
    if missing:
        raise ValueError(f"the vocabulary lacks {len(missing)} single bytes, so some texts have no tokens")
    out = bytearray()
    for rank, token in enumerate(ranks):
        piece = "".join(characters[b] for b in token).encode()
        out += _message(1, _message(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)))
    out += _message(1, _message(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _integer(3, 2))
    trainer = _integer(3, 2) + _integer(4, len(ranks) + 1) + _integer(40, len(ranks)) + b"".join(_integer(f, -1) for f in (41, 42, 43))
    normalizer = _message(1, b"identity") + _integer(3, 0) + _integer(4, 0) + _integer(5, 0)
    return bytes(out + _message(2, trainer) + _message(3, normalizer))


class Encoder:
    """Encodes whole texts; one for each worker."""

    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(PATTERN).findall
        self.letters = {b: c for b, c in enumerate(byte_characters())}
        self.bytes = {c: b for b, c in self.letters.items()}
        self.memo: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        parts, memo = self.split(text), self.memo
        new = [p for p in set(parts) if p not in memo]
        if new:
            if len(memo) + len(new) > MEMO:
                memo.clear()
                new = list(set(parts))
            mapped = [p.encode().decode("latin-1").translate(self.letters) for p in new]
            memo.update(zip(new, self.pieces.encode(mapped, num_threads=1)))
        out: list[int] = []
        for p in parts:
            out += memo[p]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; bytes that are no text alone (a list cut inside a character) become U+FFFD."""
        return bytes(self.bytes[c] for i in ids for c in self.pieces.id_to_piece(int(i))).decode("utf-8", "replace")


def encoder_udf(spark: SparkSession, vocabulary: str = VOCABULARY):
    """A column function text -> ids. The model (about 1 MB, fixed by the vocabulary) is sent to the executors once."""
    model = spark.sparkContext.broadcast(serialise_model(read_ranks(vocabulary)))

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(model.value)
        for batch in batches:
            ids, offsets = array("i"), array("i", [0])
            for text in batch.to_pylist():
                ids.extend(encoder.encode(text))
                offsets.append(len(ids))
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))

    return encode


def with_ids(df: DataFrame, text: str | Column = "text", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with the token ids of ``text``; no shuffle, other columns don't leave the JVM."""
    return df.withColumn(ids, encoder_udf(df.sparkSession, vocabulary)(F.col(text) if isinstance(text, str) else text))
