"""NumPy kernels over the UTF-8 bytes of an Arrow text column.

Everything here is block-wise: a batch is cut into pieces of a few MB (a longer single text is a piece of
its own), and each kernel does a fixed number of vectorised passes over a piece.  Fingerprints are 64 bits:
a polynomial over randomised byte values (mod 2**64), finished by a bijective mixer, the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
PIECE = 2 << 20
_MULT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (overwrites its argument)."""
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """`n` fixed pseudo-random 64-bit numbers."""
    return mix((np.arange(n, dtype=U) + U(1)) * U(_MULT) + U(salt * 0xA0761D6478BD642F & _MASK))


BYTE_VALUE = seeds(256, 1) | U(1)
FOLDED_VALUE = BYTE_VALUE.copy()
FOLDED_VALUE[65:91] = BYTE_VALUE[97:123]  # A-Z count as a-z
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int, base: int = _MULT) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64."""
    out = np.full(max(n, 1), U(base | 1), U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Texts:
    """The bytes of a column: `buf` (uint8), text k is buf[off[k]:off[k+1]]; nulls are empty."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off, self.n = buf, off, len(off) - 1

    @classmethod
    def of(cls, col: pa.Array) -> "Texts":
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        col = col.cast(pa.large_binary())
        if col.null_count:
            col = col.fill_null(b"")
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
        data = col.buffers()[2]
        buf = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and len(off) else np.zeros(0, np.uint8)
        return cls(buf, off - off[0] if len(off) else np.zeros(1, np.int64))

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The text that each byte position belongs to."""
        return np.searchsorted(self.off, at, "right") - 1

    def text(self, k: int) -> bytes:
        return self.buf[self.off[k]:self.off[k + 1]].tobytes()


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of the batches whose `column` holds at most `limit` bytes (or one text), with its bytes."""
    for batch in batches:
        all_texts = Texts.of(batch.column(column))
        lo = 0
        while lo < all_texts.n:
            hi = max(lo + 1, int(np.searchsorted(all_texts.off, all_texts.off[lo] + limit, "right")) - 1)
            off = all_texts.off[lo:hi + 1]
            yield batch.slice(lo, hi - lo), Texts(all_texts.buf[off[0]:off[-1]], off - off[0])
            lo = hi


def parts(t: Texts, limit: int) -> Iterator[tuple[int, Texts]]:
    """Slices of the texts of at most `limit` bytes (or one text), each with the number of its first text."""
    lo = 0
    while lo < t.n:
        hi = max(lo + 1, int(np.searchsorted(t.off, t.off[lo] + limit, "right")) - 1)
        yield lo, Texts(t.buf[t.off[lo]:t.off[hi]], t.off[lo:hi + 1] - t.off[lo])
        lo = hi


def spans(t: Texts, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes outside the `separator` table, cut at text borders."""
    if not len(t.buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separator[t.buf]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    border = t.off[:-1][np.diff(t.off) > 0]
    begin[border] = inside[border]
    start = np.flatnonzero(begin)
    close = inside.copy()
    close[:-1] &= ~inside[1:]
    last = t.off[1:][np.diff(t.off) > 0] - 1
    close[last] = inside[last]
    return start, np.flatnonzero(close) + 1


def span_hash(t: Texts, start: np.ndarray, end: np.ndarray, value: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """64-bit fingerprints of byte spans that are in order and do not overlap."""
    if not len(start):
        return np.zeros(0, U)
    size = end - start
    gone = np.cumsum(size) - size
    total = int(size.sum())
    inner = np.arange(total) - np.repeat(gone, size)
    val = value[t.buf[inner + np.repeat(start, size)]] * powers(int(size.max()) if total else 1)[inner]
    out = np.zeros(len(start), U)
    full = np.flatnonzero(size)
    if len(full):
        out[full] = np.add.reduceat(val, gone[full])
    return mix(out + size.astype(U) * U(0x2545F4914F6CDD1D))


class Words:
    """Words (runs of non-white-space bytes) of a piece: byte spans, the text of each, and fingerprints."""

    def __init__(self, t: Texts, value: np.ndarray = BYTE_VALUE):
        self.start, self.end = spans(t, SPACE)
        self.doc = t.owner(self.start)
        self.hash = span_hash(t, self.start, self.end, value)
        self.count = np.bincount(self.doc, minlength=t.n)
        self.first = np.cumsum(self.count) - self.count


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Fingerprint of each k consecutive items of `h` (len(h)-k+1 values), by doubling: no prefix arrays."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    mult = lambda e: U(pow(_MULT | 1, e, 1 << 64))
    out, have, part, size = None, 0, h, 1
    while True:
        if k & size:
            out = part if out is None else out[:len(out) - size] * mult(size) + part[have:have + len(out) - size]
            have += size
        if size * 2 > k:
            return mix(out[:n].copy())
        part = part[:-size] * mult(size) + part[size:]
        size *= 2


def windows_in(doc: np.ndarray, k: int) -> np.ndarray:
    """Positions where k consecutive items belong to the same text."""
    if len(doc) < k:
        return np.zeros(0, np.int64)
    return np.flatnonzero(doc[:len(doc) - k + 1] == doc[k - 1:])


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mask of the positions inside at least one of the spans."""
    step = np.bincount(start, minlength=n + 1)[:n + 1] - np.bincount(end, minlength=n + 1)[:n + 1]
    return np.cumsum(step)[:n] > 0


def per_text(t: Texts, flag: np.ndarray) -> np.ndarray:
    """Number of set flags (one per byte) in each text."""
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return total[t.off[1:]] - total[t.off[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
