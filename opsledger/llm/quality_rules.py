"""Quality rules with suffix-array repetition (operator 4).

A piece of the corpus becomes one suffix array over words, in which a word of one text never equals a word of
another, so that its longest-common-prefix (LCP) intervals are the repeated word strings of each text.  An
interval is kept when it is maximal (it can't be extended to the left in all its occurrences, nor to the right by
construction) and at least `min_words` long; the union of the occurrences of the kept intervals is the repeated part
of the text.  A text is rejected when too much of it is repeated or when its longest repeat is too long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel as K

SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, repeat_fraction double, longest_repeat_words long, n_repeats long")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_GRAM = 8


@dataclass(frozen=True)
class Limits:
    """Production parameters of the rules."""

    min_words: int = 8  # shortest repeat that counts
    max_fraction: float = 0.30  # of the text's word characters inside repeats
    max_longest: int = 100  # words in the longest repeat
    base_words: int = 20
    base_repeat_percent: int = 30


def suffix_array(symbol: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Suffix order of `symbol`, suffix i ending at last[i] (exclusive); by prefix doubling.

    Only suffixes whose prefix still ties with another one are sorted again."""
    n = len(symbol)
    order = np.argsort(symbol, kind="stable")
    rank, tied = _ranks(order, symbol[order], np.zeros(n, np.int64))
    k = 1
    while len(tied):
        nxt = np.where(tied + k < last[tied], rank[np.minimum(tied + k, n - 1)] + 1, 0)
        base = rank[tied]
        by = np.lexsort((nxt, base))
        slot = np.sort(base, kind="stable")
        first = np.r_[True, slot[1:] != slot[:-1]]
        place = slot + np.arange(len(slot)) - np.maximum.accumulate(np.where(first, np.arange(len(slot)), 0))
        moved, key = tied[by], nxt[by]
        order[place] = moved
        fresh = np.r_[True, (slot[1:] != slot[:-1]) | (key[1:] != key[:-1])]
        new = np.maximum.accumulate(np.where(fresh, place, 0))
        rank[moved] = new
        alone = fresh & np.r_[fresh[1:], True]
        tied = moved[~alone]
        k *= 2
    return order


def _ranks(order: np.ndarray, key: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each suffix = place of the first suffix with its key; and the suffixes that share theirs."""
    n = len(order)
    if not n:
        return rank, order
    fresh = np.r_[True, key[1:] != key[:-1]]
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return rank, order[~(fresh & np.r_[fresh[1:], True])]


def lcp_neighbours(h: np.ndarray, last: np.ndarray, order: np.ndarray) -> np.ndarray:
    """lcp[i]: words that the suffixes order[i-1] and order[i] have in common (lcp[0] = 0).

    Compared by polynomial prefix fingerprints, in falling powers of two."""
    n = len(h)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    p = K.powers(n + 1)
    inv = K.powers(n + 1, pow(int(p[1]), -1, 1 << 64)) if n else p
    total = np.concatenate([np.zeros(1, K.U), np.cumsum(h * p[:n], dtype=K.U)])
    at = np.flatnonzero(h[order[1:]] == h[order[:-1]]) + 1
    a, b = order[at - 1], order[at]
    room = np.minimum(last[a] - a, last[b] - b)
    got = np.zeros(len(at), np.int64)
    step = 1 << int(room.max(initial=1)).bit_length()
    while step:
        fits = np.flatnonzero(got + step <= room)
        x, y = a[fits] + got[fits], b[fits] + got[fits]
        same = (total[x + step] - total[x]) * inv[x] == (total[y + step] - total[y]) * inv[y]
        got[fits[same]] += step
        step >>= 1
    lcp[at] = got
    return lcp


def lcp_intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All LCP intervals (first place, last place, length) of length >= `least`: one stack pass over the places
    where lcp >= least, which are few."""
    lo, hi, size = [], [], []
    hot = np.flatnonzero(lcp >= least)
    if not len(hot):
        return (np.zeros(0, np.int64),) * 3
    stack: list[tuple[int, int]] = []  # (first place, length), lengths rising
    prev = -2

    def close(at: int, down_to: int) -> int:
        first = at
        while stack and stack[-1][1] > down_to:
            first, length = stack.pop()
            lo.append(first)
            hi.append(at)
            size.append(length)
        return first

    for i, v in zip(hot.tolist(), lcp[hot].tolist()):
        if i != prev + 1:
            close(prev, 0)
        first = i - 1
        if stack and stack[-1][1] > v:
            first = close(i - 1, v)
        if not stack or stack[-1][1] < v:
            stack.append((first, v))
        prev = i
    close(prev, 0)
    return np.array(lo), np.array(hi), np.array(size)


def repeats(words: K.Words, n_texts: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: mask (per word) of the union of maximal repeats, longest repeat, number of maximal repeats."""
    n = len(words.hash)
    longest, count = np.zeros(n_texts, np.int64), np.zeros(n_texts, np.int64)
    mask = np.zeros(n, bool)
    if not n:
        return mask, longest, count
    own = K.mix(words.hash ^ K.mix(words.doc.astype(K.U) + K.U(7)))  # equal words of different texts differ
    last = (words.first + words.count)[words.doc]
    # A repeat of `least` words starts with a repeated window; texts without one have nothing to sort.
    at = K.windows_in(words.doc, least)
    grams = K.window_hash(own, least)[at] if len(at) else np.zeros(0, K.U)
    by = np.argsort(grams, kind="stable")
    twin = np.flatnonzero(grams[by][1:] == grams[by][:-1])
    some = np.zeros(n_texts, bool)
    some[words.doc[at[by[twin]]]] = True
    pick = np.flatnonzero(some[words.doc])
    if not len(pick):
        return mask, longest, count
    new_doc = words.doc[pick]
    gap = np.cumsum(np.where(some, words.count, 0)) - np.where(some, words.count, 0)
    end = (gap + words.count)[new_doc]
    sym = own[pick]
    order = suffix_array(sym, end)
    lcp = lcp_neighbours(sym, end, order)
    lo, hi, size = lcp_intervals(lcp, least)
    # left-maximal: the words before the occurrences are not all the same (the start of a text differs from all)
    before = np.where(np.r_[True, new_doc[1:] != new_doc[:-1]], K.mix(np.arange(len(sym), dtype=K.U)), np.r_[sym[:1], sym[:-1]])
    left = before[order]
    change = np.concatenate([[0], np.cumsum(np.r_[False, left[1:] != left[:-1]])])  # change[i+1]: changes up to place i
    maximal = change[hi + 1] != change[lo + 1]
    lo, hi, size = lo[maximal], hi[maximal], size[maximal]
    # Every repeated string lies inside a maximal one, so the union of the maximal intervals' spans is that of each
    # suffix's longest repeated prefix: the deepest interval around its place.
    best = np.maximum(lcp, np.append(lcp[1:], 0))
    hit = np.flatnonzero(best >= least)
    mask[pick] = K.covered(len(sym), order[hit], order[hit] + best[hit])
    np.maximum.at(longest, new_doc[order[hit]], best[hit])
    np.add.at(count, new_doc[order[lo]], 1)
    return mask, longest, count


def measure(t: K.Texts, limits: Limits) -> dict[str, np.ndarray]:
    """All columns of SCHEMA for the texts of a piece."""
    w = K.Words(t)
    points = np.concatenate([[0], np.cumsum((t.buf & 0xC0) != 0x80, dtype=np.int64)])
    chars = points[w.end] - points[w.start]
    word_chars = np.bincount(w.doc, chars, t.n).astype(np.int64)
    ls, le = K.spans(t, _NEWLINE)
    line_doc, line = t.owner(ls), K.span_hash(t, ls, le)
    has_word = np.searchsorted(w.start, le, "left") > np.searchsorted(w.start, ls, "left")
    line_doc, line = line_doc[has_word], line[has_word]
    by = np.lexsort((line, line_doc))
    again = (line_doc[by][1:] == line_doc[by][:-1]) & (line[by][1:] == line[by][:-1])
    dup = np.bincount(line_doc[by][1:][again], minlength=t.n)
    mask, longest, count = repeats(w, t.n, limits.min_words)
    if limits.min_words == _GRAM:
        gram_mask = mask
    else:
        gram_mask = repeats(w, t.n, _GRAM)[0]
    n_repeat = np.bincount(w.doc[gram_mask], minlength=t.n)
    in_repeat = np.bincount(w.doc[mask], chars[mask], t.n)
    fraction = in_repeat / np.maximum(word_chars, 1)
    failed = (w.count < limits.base_words) | (100 * n_repeat > limits.base_repeat_percent * w.count)
    good = (fraction <= limits.max_fraction) & (longest <= limits.max_longest)
    return {"n_words": w.count.astype(np.int64), "word_chars": word_chars, "n_symbols": K.per_text(t, _SYMBOL[t.buf]),
            "n_dup_lines": dup.astype(np.int64), "n_repeat_words": n_repeat.astype(np.int64), "base_failed": failed,
            "kept": ~failed & good, "repeat_fraction": fraction, "longest_repeat_words": longest, "n_repeats": count}


def quality_columns(df: DataFrame, key: list[str], text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """`key` columns of every row of `df` with the measures of its text.

    Null and empty texts have no words and fail the base rule; equal rows give equal results; an empty table gives an
    empty result; other columns are ignored, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, t in K.pieces(batches, "__text"):
            got = measure(t, limits)
            yield pa.RecordBatch.from_arrays([*(rows.column(f"__k{i}") for i in range(len(key))), *map(pa.array, got.values())],
                                             names=[*key, *got])

    src = df.select(*(df[k].alias(f"__k{i}") for i, k in enumerate(key)), df[text].alias("__text"))
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)
    return src.mapInArrow(run, f"{fields}, {SCHEMA}")


def good_rows(df: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows of `df`, with all their columns, whose text the rules keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, t in K.pieces(batches, text):
            yield rows.filter(pa.array(measure(t, limits)["kept"]))

    return df.mapInArrow(run, df.schema)
