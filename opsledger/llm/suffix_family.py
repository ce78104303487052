"""Suffix-array deduplication with a logarithmic index family (operator 8).

A byte is removed when a string of LENGTH bytes over it also starts in a document with a smaller id.  Indexing every
suffix would move fifty times the corpus, so the suffix arrays are sparse.  Each LENGTH-byte window names one anchor:
its HEAD-byte substring with the smallest fingerprint, leftmost first.  Equal windows name equal anchors at the same
place, so only suffixes at anchors (about one in sixteen) are indexed, ordered by the fingerprint of their head.

The index is cut into shards by fingerprint.  Inside a shard, batches arrive one by one: the batch's sorted array is
merge-scanned against every level of the family for common entries, is added as a level, and levels of about equal size
merge geometrically, so a shard of n entries has O(log n) levels.  Two families do the work:

1. heads: which anchors occur in more than one document (all anchors, 5 bytes of fingerprint each);
2. windows: of these anchors only, the smallest document of every LENGTH-byte window around them.

Between the passes the documents are read again and joined with what was found about them.  Within a piece (2 MB of
text) equal entries are one, and all its documents but the smallest are settled on the spot; so a passage that a third
of all documents share sends one entry for each piece, not one for each document.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import released, written

LENGTH = 50
HEAD = 20
BATCH = 1 << 16  # entries of a batch that gets its array and joins the family
SHARD_BYTES = 8 << 20  # corpus bytes for each shard of the index
LEAST_SHARDS = 128
BLOCK = 1 << 17  # bytes of texts whose runs are found together, in a core's cache
ASK = 1 << 20  # windows that are looked up together
_KEY_BITS = 40
_ROW = "shard int, kind int, payload binary"
_ENTRIES, _SETTLED = 0, 1


class Family:
    """Levels of sorted distinct keys, each with the smallest and largest document seen with it."""

    def __init__(self):
        self.levels: list[list[np.ndarray]] = []
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, key: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.waiting.append((key, low, high))
        self.n_waiting += len(key)
        if self.n_waiting >= BATCH:
            self.close_batch()

    def close_batch(self) -> None:
        """Sort the waiting entries, merge-scan them against each level, and make them a level."""
        if not self.n_waiting:
            return
        level = self._sorted(*(np.concatenate(x) for x in zip(*self.waiting)), None)
        self.waiting, self.n_waiting = [], 0
        for old in self.levels:
            at = np.searchsorted(old[0], level[0])
            at[at == len(old[0])] = 0
            new = np.flatnonzero(old[0][at] == level[0])
            at = at[new]
            low = np.minimum(old[1][at], level[1][new])
            high = np.maximum(old[2][at], level[2][new])
            old[1][at], old[2][at], level[1][new], level[2][new] = low, high, low, high
        while self.levels and len(self.levels[-1][0]) <= 2 * len(level[0]):
            old = self.levels.pop()
            level = self._sorted(*(np.concatenate([a, b]) for a, b in zip(old, level)), "stable")  # it merges sorted runs
        self.levels.append(level)

    @staticmethod
    def _sorted(key: np.ndarray, low: np.ndarray, high: np.ndarray, kind: str | None) -> list[np.ndarray]:
        by = np.argsort(key, kind=kind)
        key = key[by]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return [key[first], np.minimum.reduceat(low[by], first), np.maximum.reduceat(high[by], first)]

    def bounds(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest document of each key over all levels (every key has been added)."""
        self.close_batch()
        by = np.argsort(key)  # sorted keys walk through a level, others jump about in it
        key = key[by]
        least, most = np.full(len(key), np.iinfo(np.int64).max), np.full(len(key), np.iinfo(np.int64).min)
        for k, lo, hi in self.levels:
            at = np.searchsorted(k, key)
            at[at == len(k)] = 0
            here = np.flatnonzero(k[at] == key)
            at = at[here]
            least[here] = np.minimum(least[here], lo[at])
            most[here] = np.maximum(most[here], hi[at])
        low, high = np.empty_like(least), np.empty_like(most)
        low[by], high[by] = least, most
        return low, high


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one binary value."""
    head = b"".join(struct.pack("<cQ", a.dtype.char.encode(), a.nbytes) for a in arrays)
    return struct.pack("<B", len(arrays)) + head + b"".join(a.tobytes() for a in arrays)


def unpack(data: bytes) -> list[np.ndarray]:
    n, at, out = data[0], 1, []
    heads = [struct.unpack_from("<cQ", data, 1 + 9 * i) for i in range(n)]
    at = 1 + 9 * n
    for kind, size in heads:
        out.append(np.frombuffer(data, np.dtype(kind.decode()), size // np.dtype(kind.decode()).itemsize, at))
        at += size
    return out


class Runs:
    """Runs of consecutive windows that name the same anchor: first and last window start, anchor, head fingerprint, text."""

    def __init__(self, t: K.Texts):
        self.value = K.BYTE_VALUE[t.buf]
        none = np.zeros(0, np.int64)
        parts = [(none, none, none, np.zeros(0, K.U))]
        for lo, part in K.parts(t, BLOCK):
            first, last, anchor, head = self._of(part, self.value[t.off[lo]:t.off[lo] + len(part.buf)])
            parts.append((first + t.off[lo], last + t.off[lo], anchor + t.off[lo], head))
        self.first, self.last, self.anchor, self.head = (np.concatenate(x) for x in zip(*parts))
        self.doc = t.owner(self.first)

    @staticmethod
    def _of(t: K.Texts, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = len(t.buf)
        fit = np.maximum(np.diff(t.off) - LENGTH + 1, 0)
        if not fit.sum():
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, K.U)
        head = K.window_hash(value, HEAD)
        bits = K.U(max(24, int(n).bit_length()))
        best = head >> bits << bits | np.arange(len(head), dtype=K.U)
        span, width = 1, LENGTH - HEAD + 1
        while span * 2 <= width:
            best = np.minimum(best[:-span], best[span:])
            span *= 2
        if width > span:
            best = np.minimum(best[:span - width], best[width - span:])
        start = np.repeat(t.off[:-1] - (np.cumsum(fit) - fit), fit) + np.arange(int(fit.sum()))
        anchor = (best[start] & ((K.U(1) << bits) - K.U(1))).astype(np.int64)
        fresh = np.ones(len(start), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
        at = np.flatnonzero(fresh)
        first, last, anchor = start[at], start[np.append(at[1:], len(start)) - 1], anchor[at]
        return first, last, anchor, K.mix(head[anchor] + K.U(1))  # anchors have small fingerprints; shards need even ones


def _joined(parts: list[tuple[np.ndarray, ...]], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Consecutive parts put together until they have at least `most` items."""
    some, n = [], 0
    for part in parts:
        some.append(part)
        n += len(part[0])
        if n >= most:
            yield tuple(np.concatenate(x) for x in zip(*some))
            some, n = [], 0
    if some:
        yield tuple(np.concatenate(x) for x in zip(*some))


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    by = np.argsort(shard, kind="stable")
    cut = np.flatnonzero(np.r_[True, shard[by][1:] != shard[by][:-1]]) if len(by) else []
    for i, lo in enumerate(cut):
        hi = cut[i + 1] if i + 1 < len(cut) else len(by)
        yield int(shard[by[lo]]), by[lo:hi]


def _small(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers as a base and the narrowest unsigned offsets."""
    base = a.min(initial=np.iinfo(np.int64).max) if len(a) else np.int64(0)
    off = (a - base).astype(K.U)
    top = int(off.max(initial=0))
    return np.array([base], np.int64), off.astype(np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else K.U)


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    shard, kind, payload = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())],
                                      names=["shard", "kind", "payload"])


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return (h >> K.U(64 - (shards.bit_length() - 1))).astype(np.int64)


def _key(h: np.ndarray, shards: int) -> np.ndarray:
    """The bits of a head fingerprint that stand for it inside its shard, with the shard above them."""
    bits = shards.bit_length() - 1
    return h >> K.U(max(0, 64 - bits - _KEY_BITS))


def _named(rows: pa.RecordBatch, t: K.Texts) -> np.ndarray:
    return np.asarray(rows.column("__id").to_numpy(zero_copy_only=False), np.int64)


def _head_rows(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """First pass: for each piece and shard its distinct heads, each with one document; heads that a piece holds in two
    documents are settled there."""
    for rows, t in K.pieces(batches, "__text"):
        ids, r = _named(rows, t), Runs(t)
        if not len(r.first):
            continue
        key, doc = _key(r.head, shards), ids[r.doc]
        by = np.lexsort((doc, key))
        key, doc, shard = key[by], doc[by], _shard(r.head, shards)[by]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        low, high = doc[first], doc[np.append(first[1:], len(key)) - 1]
        shared = np.repeat(low != high, np.diff(np.append(first, len(key))))
        out = [(int(k), _ENTRIES, pack((key[first][x] & K.U(0xFFFFFFFF)).astype(np.uint32), (key[first][x] >> K.U(32) & K.U(0xFF)).astype(np.uint8),
                                       (low != high)[x].view(np.uint8), *_small(low[x])))
               for k, x in _by_shard(shard[first])]
        if shared.any():
            out.append((int(ids[0]) % shards, _SETTLED, pack(key[shared], doc[shared])))
        yield _rows(out)


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for batch in batches:
        for shard, kind, payload in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "payload"))):
            yield shard, kind, unpack(payload)


def _shared_heads(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Second half of the first pass: (id, key) of every anchor whose head occurs in more than one document."""
    now, family, held = -1, Family(), []

    def answer() -> Iterator[pa.RecordBatch]:
        if held:
            key, multi, doc = (np.concatenate(x) for x in zip(*held))
            low, high = family.bounds(key)
            tell = (low != high) & ~multi
            yield pa.RecordBatch.from_arrays([pa.array(doc[tell]), pa.array(K.signed(key[tell]))], names=["id", "key"])

    for shard, kind, part in _sharded(batches):
        if kind == _SETTLED:
            yield pa.RecordBatch.from_arrays([pa.array(part[1]), pa.array(K.signed(part[0]))], names=["id", "key"])
            continue
        if shard != now:
            yield from answer()
            now, family, held = shard, Family(), []
        low32, high8, multi, base, off = part
        key = low32.astype(K.U) | high8.astype(K.U) << K.U(32) | K.U(shard) << K.U(_KEY_BITS)
        doc = off.astype(np.int64) + base
        # a head of several documents counts as seen in two different ones
        family.add(key, doc, doc + multi)
        held.append((key, multi.astype(bool), doc))
    yield from answer()


def _context_rows(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Second pass: the context (all windows) of each run with a shared head, once for each piece; repeats inside the
    piece are settled for all documents but the smallest."""
    for rows, t in K.pieces(batches, "__text", K.PIECE):
        ids, r = _named(rows, t), Runs(t)
        if not len(r.first):
            continue
        keys = rows.column("keys")
        counts = np.asarray(keys.value_lengths())
        flat = np.array(keys.flatten()).view(K.U)
        own = K.mix(np.repeat(np.arange(t.n), counts).astype(K.U) + K.U(1))
        known = np.sort(K.mix(flat ^ own))
        mine = K.mix(_key(r.head, shards) ^ K.mix(r.doc.astype(K.U) + K.U(1)))
        hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine) if len(known) else []
        if not len(hit):
            continue
        first, last, anchor, head, doc = r.first[hit], r.last[hit], r.anchor[hit], r.head[hit], ids[r.doc[hit]]
        local = first - t.off[r.doc[hit]]
        # equal contexts have equal heads at equal places and equal outer windows
        window = K.window_hash(r.value, LENGTH)
        context = K.mix(head ^ K.mix(window[first] + K.U(3)) ^ K.mix(window[last] ^ K.mix((last - first).astype(K.U) << K.U(8) | (anchor - first).astype(K.U))))
        by = np.lexsort((doc, context))
        lead = np.r_[True, context[by][1:] != context[by][:-1]]
        smallest = np.repeat(doc[by][lead], np.diff(np.append(np.flatnonzero(lead), len(by))))
        later = by[doc[by] > smallest]
        send = by[doc[by] == smallest]
        size = (last - first)[send]
        out = []
        for k, x in _by_shard(_shard(head[send], shards)):
            run = send[x]
            length = size[x] + LENGTH
            gone = np.cumsum(length) - length
            at = np.arange(int(length.sum())) - np.repeat(gone, length) + np.repeat(first[run], length)
            out.append((k, _ENTRIES, pack(size[x].astype(np.uint8), *_small(doc[run]), *_small(local[run]), t.buf[at])))
        if len(later):
            out.append((int(ids[0]) % shards, _SETTLED, pack(doc[later], local[later], local[later] + (last - first)[later] + LENGTH)))
        yield _rows(out)


def _covers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Second half of the second pass: (id, a, b), byte spans of windows that a smaller document has too."""
    now, family, held = -1, Family(), []
    spans = lambda i, a, b: pa.RecordBatch.from_arrays([pa.array(i), pa.array(a), pa.array(b)], names=["id", "a", "b"])

    def answer() -> Iterator[pa.RecordBatch]:
        for windows, doc, at in _joined(held, ASK):
            low, _ = family.bounds(windows)
            dup = low < doc
            edge = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1) | (dup[1:] != dup[:-1])])
            end = np.append(edge[1:], len(doc)) - 1
            edge, end = edge[dup[edge]], end[dup[edge]]
            yield spans(doc[edge], at[edge], at[end] + LENGTH)

    for shard, kind, part in _sharded(batches):
        if kind == _SETTLED:
            yield spans(*part)
            continue
        if shard != now:
            yield from answer()
            now, family, held = shard, Family(), []
        size, base, off, from_, local, buf = part
        n = size.astype(np.int64) + 1
        length = n - 1 + LENGTH
        start = np.cumsum(length) - length
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        windows = K.window_hash(K.BYTE_VALUE[buf], LENGTH)[inner + np.repeat(start, n)]
        doc = np.repeat(off.astype(np.int64) + base, n)
        family.add(windows, doc, doc)
        held.append((windows, doc, inner + np.repeat(local.astype(np.int64) + from_, n)))
    yield from answer()


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, a, b): byte spans that together cover what is removed from each document (they may overlap)."""
    src = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text"))
    total = src.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    shards = LEAST_SHARDS
    while shards * SHARD_BYTES < total:
        shards *= 2
    dealt = lambda df: df.repartition(shards, "shard").sortWithinPartitions("shard")
    heads = dealt(src.mapInArrow(lambda b: _head_rows(b, shards), _ROW)).mapInArrow(lambda b: _shared_heads(b, shards), "id long, key long")
    flags = written(heads.groupBy("id").agg(F.collect_set("key").alias("keys")), "heads")  # bounded by the text's anchors
    again = src.join(flags, src["__id"] == flags["id"]).select("__id", "__text", "keys")
    # written, so that the texts' shuffle is released before the contexts' one; both held 1.4 times the input
    contexts = written(again.mapInArrow(lambda b: _context_rows(b, shards), _ROW), "contexts")
    released(flags)
    covers = written(dealt(contexts).mapInArrow(_covers, "id long, a long, b long"), "covers")
    released(contexts)
    return covers


def _with_spans(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    found = repeated_spans(docs, doc_id, text)
    covers = found.groupBy("id").agg(F.collect_set(F.struct("a", "b")).alias("spans"))  # bounded by the text
    covers = written(covers.select("id", F.transform("spans", lambda s: s["a"]).alias("__a"), F.transform("spans", lambda s: s["b"]).alias("__b")), "spans")
    released(found)
    return docs.join(covers, docs[doc_id].cast("long") == covers["id"], "left").drop("id")


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, K.Texts, np.ndarray]]:
    """Pieces with the mask of removed bytes."""
    for rows, t in K.pieces(batches, "__text"):
        a, b = rows.column("__a").fill_null([]), rows.column("__b").fill_null([])
        shift = np.repeat(t.off[:-1], np.asarray(a.value_lengths()))
        lo, hi = np.array(a.flatten(), np.int64) + shift, np.array(b.flatten(), np.int64) + shift
        hi = np.minimum(hi, np.repeat(t.off[1:], np.asarray(a.value_lengths())))
        yield rows, t, K.covered(len(t.buf), lo, hi)


def removal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digests: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and what is left: its SHA-256, or the bytes.

    Null and empty texts have no bytes; a row with a null id loses nothing and is matched with nothing; rows that
    repeat an id never match each other; an empty table gives no rows; other columns are ignored."""
    last = "kept_sha256 string" if digests else "kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, t, gone in _masks(batches):
            n = K.per_text(t, gone)
            begin = gone.copy()
            begin[1:] &= ~gone[:-1]
            border = t.off[:-1][np.diff(t.off) > 0]
            begin[border] = gone[border]
            left = [t.buf[a:b][~gone[a:b]].tobytes() for a, b in zip(t.off[:-1], t.off[1:])]
            rest = pa.array([hashlib.sha256(x).hexdigest() for x in left] if digests else left, pa.string() if digests else pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("__id"), pa.array(np.diff(t.off)), pa.array(n), pa.array(K.per_text(t, begin)), rest],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", last.split()[0]])

    src = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text"))
    return _with_spans(src, "__id", "__text").select("__id", "__text", "__a", "__b").mapInArrow(
        run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}")
