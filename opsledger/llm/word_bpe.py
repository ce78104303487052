"""Word-level BPE with a lexicon transducer (operator 12).

Encoding follows a tokenizer file of this kind: NFC, white space to blanks, lower case; pieces of letters, single digits
or other signs; bytes as characters, the last one of a piece with the mark of a word's end; then the pair of the lowest
merge rank is joined, leftmost first, until none is left.

The corpus's frequent words (each at least one in `1/SHARE` word occurrences, so at most 1/SHARE words, by counts over
all documents) are merged once and compiled into a minimal acyclic transducer with the ids as output.  Its file lies in
the shared folder, Spark ships it to each executor, and the workers memory-map it.  Words that it does not hold are
merged exactly, many at a time.  What the lexicon holds never changes a result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .byte_bpe import Memory, vocabulary
from .common import scratch_dir, written
from .lexicon import Transducer, compile_lexicon, find, hash_slots

SHARE = 1 / (1 << 18)  # of all word occurrences, that a word of the lexicon has at least
LONGEST = 64  # bytes of a word that is merged in blocks or kept in the lexicon; longer ones use a heap
FLUSH = 400_000  # words that a counting task holds before it hands its counts on
# White space of the tokenizer files, which does not count the four separators U+001C to U+001F.
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(f"[{_SPACES}]+").split
_SEPARATOR = re.compile("[\x1c-\x1f]").search
_NONE = 1 << 62
_END = b"\xff" * 4
SCHEMA = "n_tokens long, ids binary, decoded binary"
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_chars() -> list[str]:
    """The character that byte-level tokenizers write for each byte: printable ones as they are, the rest from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordBpe:
    """The parts of a tokenizer file: normalisation, split, merges and pieces."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for piece, i in [*vocab.items(), *self.special.items()]:
            self.pieces[i] = piece
        self.decimal = [str(i) for i in range(len(self.pieces))]
        chars = byte_chars()
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + end] for c in chars], np.int64)
        pairs = [(vocab[a] << 32 | vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(map(_pair, model["merges"]))]
        pairs.sort()
        self.key = np.array([p[0] for p in pairs], np.int64)
        self.slot = hash_slots(self.key)
        self.rank = np.array([p[1] for p in pairs], np.int64)
        self.joined = np.array([p[2] for p in pairs], np.int64)
        self.rule = {k: (r, j) for k, r, j in pairs}
        whole = Tokenizer.from_file(path)
        self.normalize, self.pre_tokenize = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + r"|\n").findall
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.mark = os.path.commonprefix(list(self.special))

    def words(self, chunks: list[str]) -> tuple[list[str], list[str], dict[str, list[str | int]]]:
        """The normalised words of runs of text without white space.

        Most runs are split by one call: they come first, and their words with a line end after each run but the last.
        The others, with letters that have parts or special tokens, come with their words, special tokens as ids."""
        odd: dict[str, list[str | int]] = {}
        plain = [c for c in chunks if c.isascii() or max(c) < "ɐ"]  # letters that never compose, with plain case rules
        if len(plain) < len(chunks):
            odd = {c: [] for c in set(chunks).difference(plain)}
        joined = "\n".join(plain)
        if self.mark in joined or _SEPARATOR(joined):
            odd |= {c: [] for c in plain if self.mark in c or _SEPARATOR(c)}
            plain = [c for c in plain if c not in odd]
            joined = "\n".join(plain)
        for c, out in odd.items():
            for part in self.at_special(c):
                if part in self.special:
                    out.append(self.special[part])
                elif part:
                    out += [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in self.pre_tokenize(self.normalize(part))]
        return plain, self.split(joined.lower()), odd

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word by its merges, as little-endian unsigned 32-bit integers."""
        out: list = [None] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONGEST]
        if len(short) < len(words):
            for i, w in enumerate(words):
                if len(w) > LONGEST:
                    out[i] = self._merge_long(w).astype("<u4").tobytes()
        for lo in range(0, len(short), 50_000):
            part = short[lo:lo + 50_000]
            for i, ids in zip(part, cut_ids(*self._merge_block([words[i] for i in part]))):
                out[i] = ids
        return out

    def _symbols(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sym = self.inner[raw]
        sym[ends] = self.last[raw[ends]]
        return sym

    def _merge_block(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """One merge of every word in each round: its lowest rank, leftmost."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym = self._symbols(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - 1)
        own = np.repeat(np.arange(len(words)), size)
        done_sym, done_own = [], []
        while len(sym):
            value = np.full(len(sym), _NONE, np.int64)
            inside = np.flatnonzero(own[:-1] == own[1:])
            rule = find(self.key, self.slot, sym[inside] << 32 | sym[inside + 1])
            hit = rule >= 0
            value[inside[hit]] = self.rank[rule[hit]] << 32 | inside[hit]
            start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            best = np.minimum.reduceat(value, start)
            go = best < _NONE
            length = np.diff(np.append(start, len(sym)))
            stay = np.repeat(go, length)
            done_sym.append(sym[~stay])
            done_own.append(own[~stay])
            at = best[go] & 0xFFFFFFFF
            sym[at] = self.joined[find(self.key, self.slot, sym[at] << 32 | sym[at + 1])]
            stay[at + 1] = False
            sym, own = sym[stay], own[stay]
        sym, own = np.concatenate(done_sym or [sym]), np.concatenate(done_own or [own])
        order = np.argsort(own, kind="stable")
        count = np.bincount(own, minlength=len(words))
        return sym[order], count

    def _merge_long(self, word: bytes) -> np.ndarray:
        """A heap of the pairs by rank and place, for words of any length."""
        raw = np.frombuffer(word, np.uint8)
        sym = self._symbols(raw, np.array([len(raw) - 1])).tolist()
        left, right = [*range(-1, len(sym) - 1)], [*range(1, len(sym)), -1]
        rule = self.rule.get
        heap = [(r[0], i, sym[i], sym[i + 1]) for i in range(len(sym) - 1) if (r := rule(sym[i] << 32 | sym[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if sym[i] == a else -1
            if j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = rule(a << 32 | b)[1], -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := rule(sym[x] << 32 | sym[y])):
                    heapq.heappush(heap, (r[0], x, sym[x], sym[y]))
        return np.array([s for s in sym if s >= 0], np.int64)

    def decode(self, ids: bytes) -> str:
        """Pieces joined by blanks: the tokenizer file names no decoder."""
        return " ".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def cut_ids(ids: np.ndarray, count: np.ndarray) -> list[bytes]:
    """The ids of each word, which follow one another, as bytes of their own."""
    raw, end = ids.astype("<u4").tobytes(), np.cumsum(count) * 4
    return [raw[a:b] for a, b in zip((end - 4 * count).tolist(), end.tolist())]


def _pair(merge) -> tuple[str, str]:
    return tuple(merge.split(" ")) if isinstance(merge, str) else tuple(merge)


def chunks(text: str) -> list[str]:
    """Runs between white space; NFC, lower case and the split never reach over white space."""
    return [c for c in _CUT(text) if c] if _SEPARATOR(text) else text.split()


class Codec:
    """A worker's encoder: the mapped lexicon before the merges."""

    def __init__(self, bpe: WordBpe, lexicon: Transducer):
        self.bpe, self.lexicon, self.known = bpe, lexicon, Memory()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = list(map(chunks, texts))
        plain, words, odd = self.bpe.words(self.known.missing(set().union(*split)))
        distinct = set(words).union(*odd.values())
        ids = self.word_ids([w for w in distinct if isinstance(w, str) and w != "\n"])
        ids["\n"] = _END  # no id has four such bytes, so that the joined ids can be cut there
        table = self.known.recent
        if plain:
            table.update(zip(plain, b"".join(map(ids.__getitem__, words)).split(_END)))
        for c, p in odd.items():
            table[c] = b"".join([ids[w] if isinstance(w, str) else w.to_bytes(4, "little") for w in p])
        return [b"".join(map(table.__getitem__, s)) for s in split]

    def word_ids(self, words: list[str]) -> dict[str, bytes]:
        """From the lexicon, and by merges for words that it does not hold."""
        raw = list(map(str.encode, words))
        short = [i for i, w in enumerate(raw) if len(w) <= LONGEST]
        known, flat, count = self.lexicon.lookup([raw[i] for i in short])
        out = {words[short[i]]: ids for i, ids in zip(np.flatnonzero(known).tolist(), cut_ids(flat, count))}
        rest = [i for i, w in enumerate(words) if w not in out]
        out.update(zip([words[i] for i in rest], self.bpe.merge([raw[i] for i in rest])))
        return out


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


@lru_cache(maxsize=4)
def _codec(path: str, lexicon: str) -> Codec:
    return Codec(word_bpe(path), Transducer(lexicon))


def _path(vocab: str) -> str:
    return vocab if os.path.sep in vocab else vocabulary(vocab)


def word_counts(df: DataFrame, vocab: str, text: str = "text") -> DataFrame:
    """(word binary, n long) over all rows of `df`, special tokens not counted; tasks count before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen = word_bpe(_path(vocab)), Counter()

        def out() -> pa.RecordBatch:
            total: Counter = Counter()
            plain, words, odd = bpe.words(list(seen))
            run = iter(plain)
            n = seen[next(run)] if plain else 0
            for w in words:
                if w == "\n":
                    n = seen[next(run)]
                else:
                    total[w] += n
            for c, p in odd.items():
                for w in p:
                    if isinstance(w, str):
                        total[w] += seen[c]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(map(str.encode, total), pa.binary()), pa.array(list(total.values()), pa.int64())],
                                              names=["word", "n"])

        for _, t in K.pieces(batches, text):
            for k in range(t.n):
                seen.update(chunks(t.text(k).decode()))
            if len(seen) > FLUSH:
                yield out()
        yield out()

    return df.select(F.col(text).alias(text)).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_lexicon(df: DataFrame, vocab: str, text: str = "text", share: float = SHARE) -> str:
    """Name of the shipped lexicon file of the words that make up `share` of `df`'s word occurrences or more.

    At most 1/share words of at most LONGEST bytes reach the driver, however large the corpus."""
    spark = df.sparkSession
    counts = written(word_counts(df, vocab, text), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.where((F.col("n") >= F.lit(share * total)) & (F.length("word") <= LONGEST)).select("word")
    words = sorted(bytes(r.word) for r in often.toLocalIterator())
    ids = word_bpe(_path(vocab)).merge(words)
    return ship(spark, compile_lexicon((w, tuple(np.frombuffer(i, "<u4").tolist())) for w, i in zip(words, ids)))


def ship(spark, data: bytes) -> str:
    """`data` as a file in the shared folder, handed to every executor by Spark; its name there."""
    name = f"llm-lexicon-{uuid.uuid4().hex}.bin"
    path = f"{scratch_dir(spark)}/{name}"
    path = path if "://" in path or path.startswith("file:") else f"file://{path}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(data)
    out.close()
    spark.sparkContext.addFile(path)
    return name


def encode_decode(df: DataFrame, key: list[str], vocab: str, text: str = "text", digests: bool = False,
                  share: float = SHARE) -> DataFrame:
    """`key` columns of each row with its tokens.

    `vocab` is a tokenizer file that every executor has, or the name of one of the public tokenizer package.  Columns:
    ids (little-endian unsigned 32-bit) and the decoded text (UTF-8), or with `digests` the SHA-256 of the decimal ids
    joined by blanks and of the decoded text.  Null text is empty: no tokens; repeated rows repeat; an empty table gives
    an empty result; other columns are ignored, whatever their names."""
    name = frequent_lexicon(df.select(F.col(text).alias("__text")), vocab, "__text", share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(_path(vocab), SparkFiles.get(name))
        decimal = codec.bpe.decimal.__getitem__
        for rows, t in K.pieces(batches, "__text"):
            n, ids, back = [], [], []
            for got in codec.encode([t.text(i).decode() for i in range(t.n)]):
                plain = codec.bpe.decode(got).encode()
                n.append(len(got) // 4)
                if digests:
                    ids.append(hashlib.sha256(" ".join(map(decimal, np.frombuffer(got, "<u4").tolist())).encode()).hexdigest())
                    back.append(hashlib.sha256(plain).hexdigest())
                else:
                    ids.append(got)
                    back.append(plain)
            kind = pa.string() if digests else pa.binary()
            yield pa.RecordBatch.from_arrays([*(rows.column(f"__k{i}") for i in range(len(key))), pa.array(n, pa.int64()),
                                              pa.array(ids, kind), pa.array(back, kind)],
                                             names=[*key, *(x.split()[0] for x in (DIGESTS if digests else SCHEMA).split(", "))])

    src = df.select(*(df[k].alias(f"__k{i}") for i, k in enumerate(key)), F.col(text).alias("__text"))
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)
    return src.mapInArrow(run, f"{fields}, {DIGESTS if digests else SCHEMA}")
