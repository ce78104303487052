"""Byte-level BPE through a serialised sentencepiece model (operator 2).

The model file is written straight from a rank vocabulary: byte b becomes the character U+0100+b, every token the
string of its bytes' characters with score -rank, the normaliser is the identity.  Sentencepiece then merges the
adjacent pair with the highest score (lowest rank), leftmost first, which is the byte-pair merge of the vocabulary.
Pre-tokens (matches of the split pattern) are encoded one by one; a pre-token that is itself a token is that token.
Decoding maps ids back to pieces and characters back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

CACHE = 400_000  # entries of a generation of a worker's caches
_ODD_SPACE = re.compile(r"\s | \s|\A | \Z").search  # a space that has white space or a text's border beside it
SCHEMA = "n_tokens long, ids binary, decoded binary"
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> list[bytes]:
    """Token bytes in order of rank, of a file of `base64 rank` lines."""
    with open(path, "rb") as f:
        rows = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    if [r for r, _ in rows] != list(range(len(rows))):
        raise ValueError(f"ranks of {path} are not 0..n-1")
    return [token for _, token in rows]


def to_chars(parts: list[bytes]) -> list[str]:
    """Each byte string as characters: printable ASCII as it is, any other byte b as U+0100+b."""
    joined = np.frombuffer(b"\xff".join(parts), np.uint8)  # no UTF-8 text and no token but the lone byte holds 0xFF
    return _CHAR_OF[joined].tobytes().decode("utf-16-le").split(_END) if parts else []


_CHAR_OF = np.arange(256, dtype="<u2")
_CHAR_OF[[*range(0x20), *range(0x7F, 0x100)]] += 0x100
_END = chr(_CHAR_OF[0xFF])


def _field(number: int, payload: bytes | int | float) -> bytes:
    """One protobuf field: bytes, a varint, or a 32-bit float."""
    if isinstance(payload, bytes):
        return _varint(number << 3 | 2) + _varint(len(payload)) + payload
    if isinstance(payload, float):
        return _varint(number << 3 | 5) + struct.pack("<f", payload)
    return _varint(number << 3) + _varint(payload)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def model_proto(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto whose piece ids are the ranks; the unknown piece comes after them."""
    unknown = len(tokens)
    chars = to_chars([t.replace(b"\xff", b"") or b"?" for t in tokens])
    for rank, t in enumerate(tokens):  # tokens with the byte 0xFF, that the joined form uses as separator
        if b"\xff" in t:
            chars[rank] = "".join(chr(_CHAR_OF[b]) for b in t)
    pieces = [_field(1, _field(1, c.encode()) + _field(2, float(-rank))) for rank, c in enumerate(chars)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    absent = (1 << 64) - 1  # -1: the model has no such piece
    trainer = _field(3, 2) + _field(40, unknown) + _field(41, absent) + _field(42, absent) + _field(43, absent)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Memory:
    """A bounded cache of two generations: what is used stays in the recent one."""

    def __init__(self):
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def missing(self, keys: set[str]) -> list[str]:
        """The keys without a value; the others are in `recent` afterwards."""
        if len(self.recent) + len(keys) > CACHE:
            self.recent, self.older = {}, self.recent
        new = []
        for k in keys.difference(self.recent):
            if (v := self.older.get(k)) is None:
                new.append(k)
            else:
                self.recent[k] = v
        return new


class Codec:
    """Encoder and decoder of one vocabulary and split pattern."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.tokens = tokens
        self.whole = {t: i for i, t in enumerate(tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(tokens))
        self.split = regex.compile(pattern).findall
        self.pieces = [self.model.id_to_piece(i) for i in range(len(tokens))]
        self.bytes_of = [bytes(ord(c) & 0xFF for c in p) for p in self.pieces]
        self.words = Memory()  # pre-token -> ids
        self.after_space = Memory()  # part -> ids of a space and the part

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        A match of the pattern never reaches over a lone space between two other characters, except that it may begin
        with it; so texts are first cut there, and the ids of cut parts are remembered."""
        cut = [[t] if _ODD_SPACE(t) else t.split(" ") for t in texts]
        parts = set().union(*(c[1:] for c in cut))
        new = self.after_space.missing(parts)
        ids = self._encode_parts([c[0] for c in cut] + [" " + p for p in new])
        known = self.after_space.recent
        known.update(zip(new, ids[len(cut):]))
        return [b"".join([head, *map(known.__getitem__, c[1:])]) for c, head in zip(cut, ids)]

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of short texts; all their new pre-tokens go to the model at once."""
        split = list(map(self.split, parts))
        new = self.words.missing(set().union(*split))
        raw = [w.encode() for w in new]
        known = self.words.recent
        for w, r, ids in zip(new, raw, self.model.encode(to_chars(raw), num_threads=1)):
            if len(ids) > 1 and r in self.whole:
                ids = [self.whole[r]]
            known[w] = array("I", ids).tobytes()
        return [b"".join(map(known.__getitem__, s)) for s in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """The codec of a vocabulary file, one per worker process."""
    return Codec(read_ranks(path), pattern)


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file on the machine that calls (each executor has the package)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _codec(vocab: str, pattern: str) -> Codec:
    return codec(vocab if os.path.sep in vocab else vocabulary(vocab), pattern)


def encode_decode(df: DataFrame, key: list[str], vocab: str, pattern: str, text: str = "text", digests: bool = False) -> DataFrame:
    """`key` columns of each row with its tokens.

    `vocab` is a path that every executor has, or the name of a file of the public tokenizer package.  Columns: the
    ids (little-endian unsigned 32-bit) and the decoded bytes, or with `digests` their SHA-256.  Null text is empty;
    repeated rows repeat; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _codec(vocab, pattern)
        for rows, t in K.pieces(batches, "__text"):
            n, ids, back = [], [], []
            for got in c.encode([t.text(i).decode() for i in range(t.n)]):
                plain = c.decode(got)
                n.append(len(got) // 4)
                ids.append(hashlib.sha256(got).hexdigest() if digests else got)
                back.append(hashlib.sha256(plain).hexdigest() if digests else plain)
            kind = pa.string() if digests else pa.binary()
            yield pa.RecordBatch.from_arrays([*(rows.column(f"__k{i}") for i in range(len(key))), pa.array(n, pa.int64()),
                                              pa.array(ids, kind), pa.array(back, kind)],
                                             names=[*key, *(x.split()[0] for x in (DIGESTS if digests else SCHEMA).split(", "))])

    src = df.select(*(df[k].alias(f"__k{i}") for i, k in enumerate(key)), F.col(text).alias("__text"))
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)
    return src.mapInArrow(run, f"{fields}, {DIGESTS if digests else SCHEMA}")
