"""Byte-level BPE through a sentencepiece model written straight from a rank vocabulary.

Each token's bytes are mapped to characters one to one and become a piece scored
by its negative rank; with identity normalisation and no white-space escape
sentencepiece then merges in rank order, as byte-pair encoding does. Pre-tokens
are encoded one by one; decoding maps ids to pieces and pieces back to bytes.
"""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
import struct
from collections.abc import Iterable, Iterator, Sequence

import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from .common import mapped, table

#: Pre-tokens that a generation of a worker's memo holds; the last two are kept. Longer ones aren't remembered.
MEMO, MEMO_CHARS = 200_000, 64
#: Characters of texts whose pre-tokens are encoded together.
TOGETHER = 1_000_000
#: First of the 256 characters that stand for bytes: letters without any meaning to sentencepiece.
BASE = 0x4E00


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def to_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(_UP)


def to_bytes(chars: str) -> bytes:
    return bytes(ord(c) - BASE for c in chars)


_UP = {b: BASE + b for b in range(256)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: bytes by length, int as varint, float as 32 bits."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece ModelProto: pieces in rank order after <unk>, BPE, identity normaliser."""
    # fixed values of the public sentencepiece_model.proto: ModelProto pieces = 1, trainer_spec = 2, normalizer_spec = 3;
    # SentencePiece piece = 1, score = 2, type = 3 (UNKNOWN = 2); TrainerSpec model_type = 3 (BPE = 2), vocab_size = 4,
    # unk_id = 40, bos_id = 41, eos_id = 42, pad_id = 43; NormalizerSpec name = 1, add_dummy_prefix = 3,
    # remove_extra_whitespaces = 4, escape_whitespaces = 5
    out = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        out.append(_field(1, _field(1, to_chars(token).encode()) + _field(2, float(-rank))))
    none = 2**64 - 1  # -1: no such id
    out.append(_field(2, _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, 0) + _field(41, none) + _field(42, none) + _field(43, none)))
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class ByteBpe:
    """Encoder and decoder of one vocabulary; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        by_rank = sorted(ranks.items(), key=lambda x: x[1])
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(ranks))
        self.rank_of = [-1] + [r for _, r in by_rank]  # piece number -> rank
        self.ranks = ranks
        self.bytes_of = {r: to_bytes(to_chars(b)) for b, r in by_rank}
        # by piece number: the decimal rank, and the bytes
        self.shown = ["-1"] + [str(r) for _, r in by_rank]
        self.back = [b""] + [self.bytes_of[r] for _, r in by_rank]
        self.pattern = regex.compile(pattern)
        # two generations: what the former holds is taken over when it is met again
        self.memo: dict[str, tuple[str, bytes]] = {}
        self.former: dict[str, tuple[str, bytes]] = {}

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token: its own id if it is a token, else the merges' result."""
        data = piece.encode("utf-8", "surrogatepass")
        own = self.ranks.get(data)
        if own is not None:
            return [own]
        return [self.rank_of[i] for i in self.model.encode(to_chars(data))]

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pattern.findall(text) for i in self.encode_piece(p)]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def _learn(self, pieces: set[str]) -> dict[str, tuple[str, bytes]]:
        """piece -> (decimal ids joined by commas, decoded bytes) of pieces: of the memo, or encoded together and, unless long, remembered."""
        memo, former, found, todo = self.memo, self.former, {}, []
        shown, back, ranks = self.shown, self.back, self.ranks
        for p in pieces.difference(memo):
            known = former.get(p)
            if known is not None:
                memo[p] = known
                continue
            data = p.encode("utf-8", "surrogatepass")
            own = ranks.get(data)
            if own is not None:
                memo[p] = str(own), self.bytes_of[own]
            else:
                todo.append((p, to_chars(data)))
        if todo:
            for (p, _), merged in zip(todo, self.model.encode([c for _, c in todo], num_threads=1)):
                # piece numbers to decimal ranks, and by the inverse mapping to bytes
                entry = ",".join([shown[i] for i in merged]), b"".join([back[i] for i in merged])
                (memo if len(p) <= MEMO_CHARS else found)[p] = entry
        return found

    def digests(self, texts: Sequence[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text: number of ids, sha256 of the decimal ids joined by commas, sha256 of the decoded bytes."""
        at = 0
        while at < len(texts):
            lists, size = [], 0
            while at < len(texts) and size < TOGETHER:  # bounded memory; a longer text is worked on alone
                lists.append(self.pattern.findall(texts[at]))
                size += len(texts[at])
                at += 1
            passing = self._learn(set().union(*lists))
            memo = self.memo
            get = memo.__getitem__ if not passing else lambda p: passing[p] if p in passing else memo[p]
            for pieces in lists:
                found = [get(p) for p in pieces]
                ids = ",".join([x[0] for x in found])
                back = b"".join([x[1] for x in found])
                yield ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest()
            if len(self.memo) > MEMO:
                self.former, self.memo = self.memo, {}


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> ByteBpe:
    """A worker's codec for a vocabulary file, made once."""
    return ByteBpe(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) for each row of docs; a null or empty text has no ids. Long texts are encoded whole, repeated rows each; an empty table gives an empty result."""

    def make():
        bpe = codec(path)
        return lambda texts: ([bpe.encode(t or "") for t in texts],)

    return mapped(docs, ["doc_id"], ["text"], make, {"ids": ("array<int>", pa.list_(pa.int32()))})


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of (doc_id, ids); bytes that aren't UTF-8 become U+FFFD, null ids an empty text. Repeated rows are decoded each; an empty table gives an empty result."""

    def make():
        bpe = codec(path)
        return lambda ids: ([bpe.decode(i or ()).decode("utf-8", "replace") for i in ids],)

    return mapped(encoded, ["doc_id"], ["ids"], make, {"text": ("string", pa.string())})


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null texts are as empty ones: no ids, digests of nothing. Whole texts of any
    length; repeated rows are answered each.
    """

    def make():
        gc.set_threshold(200_000, 20, 100)  # the memo's many small objects hold no cycles
        bpe = codec(path)
        return lambda texts: tuple(zip(*bpe.digests([t or "" for t in texts]))) or ((), (), ())

    added = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    return mapped(docs, ["doc_id"], ["text"], make, added)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """round_trip() of the whole table `documents`; nulls, empty and long texts, repeated rows and an empty table as there."""
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
