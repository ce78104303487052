"""Benchmark decontamination by template canonicalisation (operator 3).

Numbers, names and units become typed placeholders (slots); every window of `width` template tokens of a document is
looked up among the benchmark's windows by a hash join; windows of few plain words must be equal word for word.  Hits on
one alignment (document position minus item position) map the item's slot values to document values; of each value the
answer that most windows give counts, and a window goes unless most of its slots agree with that (half are enough if one
is unchanged): then a question whose numbers or names were replaced throughout is a leak, and so is a copy with an edited
number, while boilerplate with unrelated values is not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import written

# Unit words and number words that become placeholders.
UNITS = """kg g mg t lb lbs oz km m cm mm mi ft yd l ml h hr hrs min s sec ms percent dollar dollars euro euros cent cents
pound pounds gram grams kilogram kilograms ton tons meter meters metre metres kilometer kilometers kilometre kilometres
centimeter centimeters mile miles foot feet inch inches yard yards liter liters litre litres second seconds minute minutes
hour hours day days week weeks month months year years degree degrees""".split()
NUMBER_WORDS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen
seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion""".split()

NUMBER, NAME, UNIT = 1, 2, 3
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:\n")] = True


@dataclass(frozen=True)
class Rules:
    """Production parameters."""

    width: int = 8  # template tokens in a window; a shorter item is one window of its own length
    least_item: int = 4  # items with fewer template tokens are no evidence and are not searched
    least_literal: float = 0.5  # windows with a smaller share of plain words match only word for word
    least_cover: float = 0.5  # share of an item's tokens inside consistent hits
    filter_entries: int = 1 << 20  # up to this many distinct benchmark windows (8 MB) scans drop non-hits at once


def _word_hashes(words: list[str]) -> np.ndarray:
    t = K.Texts.of(pa.array(words))
    return np.sort(K.span_hash(t, t.off[:-1], t.off[1:], K.FOLDED_VALUE))


_UNIT_HASH, _NUMBER_HASH = _word_hashes(UNITS), _word_hashes(NUMBER_WORDS)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


class Template:
    """Template tokens of a piece: text of each, slot type (0: plain word), value fingerprint, template symbol."""

    def __init__(self, t: K.Texts):
        b = t.buf
        n = len(b)
        folded = K.Texts(b, t.off)
        if n > 1:  # capitals written in two bytes (0xC3 0x80-0x9E) fold to the small letters 0x20 higher
            capital = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)) + 1
            folded.buf = b.copy()
            folded.buf[capital] += 0x20
        digit, alpha = _DIGIT[b], _ALPHA[b]
        if n > 2:  # punctuation written in two or three bytes; separators inside numbers
            gap = (b[:-1] == 0xC2) & (b[1:] >= 0xA0) & (b[1:] < 0xC0)
            for k in range(2):
                alpha[k:n - 1 + k][gap] = False
            gap = ((b[:-2] == 0xE2) & ((b[1:-1] == 0x80) | (b[1:-1] == 0x81))) | ((b[:-2] == 0xE3) & (b[1:-1] == 0x80))
            for k in range(3):
                alpha[k:n - 2 + k][gap] = False
            digit[1:-1] |= ((b[1:-1] == 44) | (b[1:-1] == 46)) & _DIGIT[b[:-2]] & _DIGIT[b[2:]]
        kind = digit.view(np.uint8) + 2 * alpha.view(np.uint8)
        edge = np.ones(n, bool)
        edge[1:] = kind[1:] != kind[:-1]
        edge[t.off[:-1][np.diff(t.off) > 0]] = True
        cut = np.flatnonzero(edge)
        stop = np.append(cut[1:], n)
        keep = kind[cut] > 0
        self.start, self.end = cut[keep], stop[keep]
        self.doc = t.owner(self.start)
        self.value = K.span_hash(folded, self.start, self.end, K.FOLDED_VALUE)
        m = len(self.start)
        number = digit[self.start] | _among(self.value, _NUMBER_HASH)
        same = np.zeros(m, bool)
        same[1:] = self.doc[1:] == self.doc[:-1]
        unit = _among(self.value, _UNIT_HASH)
        unit[1:] &= number[:-1] & same[1:]
        unit[:1] = False
        # a name: a capital followed by a small letter, not at the start of a sentence
        stops = np.concatenate([[0], np.cumsum(_STOP[b])])
        inner = same.copy()
        inner[1:] &= stops[self.start[1:]] == stops[self.end[:-1]]
        c0, long_ = b[self.start] if m else b[:0], self.end - self.start >= 2
        second = np.minimum(self.start + 1, max(n - 1, 0))
        c1 = b[second] if n else b[:0]
        wide = c0 == 0xC3
        upper = ((c0 >= 65) & (c0 < 91)) | (wide & (c1 >= 0x80) & (c1 < 0x9F))
        after = b[np.minimum(self.start + np.where(wide, 2, 1), max(n - 1, 0))] if n else b[:0]
        small = long_ & (((after >= 97) & (after < 123)) | (after >= 0x80)) & (self.end - self.start > np.where(wide, 2, 1))
        name = inner & upper & small & ~number & ~unit
        self.slot = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, 0))).astype(np.int8)
        self.symbol = np.where(self.slot > 0, self.slot.astype(K.U), self.value)
        self.count = np.bincount(self.doc, minlength=t.n)
        self.first = np.cumsum(self.count) - self.count

    def windows(self, width: int, least_literal: float) -> tuple[np.ndarray, np.ndarray]:
        """Token positions and fingerprints of the windows of `width` tokens: of the template, or of the values themselves
        where too few tokens are plain words."""
        at = K.windows_in(self.doc, width)
        if not len(at):
            return at, np.zeros(0, K.U)
        plain = np.concatenate([[0], np.cumsum(self.slot == 0)])
        poor = plain[at + width] - plain[at] < least_literal * width
        grams = K.window_hash(self.symbol, width)[at]
        if poor.any():
            grams[poor] = K.mix(K.window_hash(self.value, width)[at[poor]] + K.U(1))
        return at, grams


def _rows(template: Template, ids: pa.Array, at: np.ndarray, grams: np.ndarray, width: int, n_tokens: bool) -> pa.RecordBatch:
    """One row per window: id, width, fingerprint, position, and the slots inside (offset, value)."""
    slots = np.concatenate([[0], np.cumsum(template.slot > 0)])
    where = np.flatnonzero(template.slot > 0)
    lo, hi = slots[at], slots[at + width]
    n = hi - lo
    pick = where[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    off = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
    doc = template.doc[at]
    cols = {"id": ids.take(pa.array(doc)), "width": pa.array(np.full(len(at), width, np.int32)), "gram": pa.array(K.signed(grams)),
            "pos": pa.array((at - template.first[doc]).astype(np.int64)),
            "slot_at": pa.ListArray.from_arrays(off, pa.array((pick - np.repeat(at, n)).astype(np.int32))),
            "slot_value": pa.ListArray.from_arrays(off, pa.array(K.signed(template.value[pick])))}
    if n_tokens:
        cols["n_tokens"] = pa.array(template.count[doc].astype(np.int64))
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


_WINDOW = "id long, width int, gram long, pos long, slot_at array<int>, slot_value array<long>"


def item_windows(items: DataFrame, item_id: str, text: str, rules: Rules) -> DataFrame:
    """Template windows of all benchmark items (with the items' token counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, t in K.pieces(batches, "__text"):
            tp = Template(t)
            for width in np.unique(np.clip(tp.count, 0, rules.width)).tolist():
                if width < rules.least_item:
                    continue
                at, grams = tp.windows(width, rules.least_literal)
                own = np.minimum(tp.count[tp.doc[at]], rules.width) == width
                yield _rows(tp, rows.column("__id"), at[own], grams[own], width, True)

    src = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("__id"), F.col(text).alias("__text"))
    return src.mapInArrow(run, f"{_WINDOW}, n_tokens long")


def document_windows(docs: DataFrame, doc_id: str, text: str, rules: Rules, widths: list[int], known: np.ndarray | None) -> DataFrame:
    """Template windows of all documents; with `known` (sorted fingerprints) only those that are among them."""
    cast = None if known is None else docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, t in K.pieces(batches, "__text"):
            tp = Template(t)
            for width in widths:
                at, grams = tp.windows(width, rules.least_literal)
                if cast is not None:
                    hit = _among(grams, cast.value)
                    at, grams = at[hit], grams[hit]
                if len(at):
                    yield _rows(tp, rows.column("__id"), at, grams, width, False)

    src = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text"))
    return src.mapInArrow(run, _WINDOW)


def _chosen(slots: Column) -> Column:
    """Of an alignment's slots (a value of the item, the document's value) the document's value that counts for each: that
    of most windows, then the item's own, then the largest."""
    pairs = F.transform(slots, lambda s: F.struct(s["a"].alias("a"), s["v"].alias("v")))
    answers = F.array_distinct(pairs)
    asked = F.array_distinct(F.transform(slots, lambda s: s["a"]))
    votes = F.transform(answers, lambda x: F.struct(x["a"].alias("a"), F.size(F.filter(pairs, lambda p: p == x)).alias("n"),
                                                    (x["a"] == x["v"]).alias("same"), x["v"].alias("v")))
    best = F.transform(asked, lambda a: F.array_max(F.filter(votes, lambda x: x["a"] == a)))
    voted = F.map_from_entries(F.transform(best, lambda x: F.struct(x["a"], x["v"])))
    return F.when(F.size(asked) == F.size(answers), F.map_from_entries(answers)).otherwise(voted)


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
          rules: Rules = Rules()) -> DataFrame:
    """One row per leaked (document, item): cover (share of the item's template tokens found), n_windows, n_slots,
    n_changed (slots with another value than in the item), kind ('verbatim' or 'reparameterised').

    Null texts and ids match nothing; items with fewer than `least_item` template tokens are not searched; repeated
    rows count once; empty tables give no rows; other columns are ignored."""
    bench = written(item_windows(items, item_id, text, rules).distinct(), "bench")
    size = bench.agg(F.count_distinct("gram").alias("n"), F.collect_set("width").alias("w")).first()
    known = None
    if size["n"] <= rules.filter_entries:  # a checked size; beyond it the join alone decides
        known = np.sort(np.array([r[0] for r in bench.select("gram").distinct().collect()], np.int64).view(K.U))
    hits = document_windows(docs, doc_id, text, rules, sorted(size["w"] or []), known)
    b = bench.select(F.col("id").alias("item_id"), "width", "gram", F.col("pos").alias("at"), F.col("slot_value").alias("asked"), "n_tokens",
                     F.col("slot_at").alias("asked_at"))
    d = hits.select(F.col("id").alias("doc_id"), "width", "gram", "pos", "slot_value", "slot_at")
    # equal template windows have their slots at equal offsets; keep pairs of (item's value, document's value)
    pairs = F.arrays_zip(F.transform("asked_at", lambda x: x + F.col("at")).alias("i"), F.col("asked").alias("a"), F.col("slot_value").alias("v"))
    joined = d.join(b, ["gram", "width"]).where(F.col("slot_at") == F.col("asked_at")).select(
        "doc_id", "item_id", "n_tokens", (F.col("pos") - F.col("at")).alias("shift"), "at", "width", pairs.alias("slots"))
    # an alignment holds at most one hit for each item position, so its sets are bounded by the item's length
    aligned = joined.groupBy("doc_id", "item_id", "n_tokens", "shift").agg(
        F.collect_set(F.struct("at", "slots")).alias("hits"), F.max("width").alias("width"))
    aligned = aligned.withColumn("chosen", _chosen(F.flatten(F.col("hits.slots"))))
    other = lambda s: F.element_at("chosen", s["a"]) != s["v"]
    unchanged = lambda h: F.exists(h["slots"], lambda s: s["a"] == s["v"]).cast("int")
    agrees = lambda h: 2 * F.size(F.filter(h["slots"], other)) < F.size(h["slots"]) + unchanged(h)
    aligned = aligned.withColumn("hits", F.filter("hits", lambda h: (F.size(h["slots"]) == 0) | agrees(h))).where(F.size("hits") > 0)
    aligned = aligned.withColumn("slots", F.array_distinct(F.flatten(F.col("hits.slots"))))
    tokens = F.array_distinct(F.flatten(F.transform("hits.at", lambda p: F.sequence(p, p + F.col("width") - 1))))
    tokens = F.array_except(tokens, F.transform(F.filter("slots", other), lambda s: s["i"]))
    # alignments of the same item in one document: at most one per window of the item that counts
    per_shift = aligned.select("doc_id", "item_id", "n_tokens", tokens.alias("tokens"), F.size("hits").alias("hits"), F.size("slots").alias("n_slots"),
                               F.size(F.filter("slots", lambda s: s["a"] != s["v"])).alias("n_changed"))
    found = per_shift.select("doc_id", "item_id", "n_tokens", "hits", "n_slots", "n_changed", F.explode("tokens").alias("token"))
    per_token = found.groupBy("doc_id", "item_id", "n_tokens", "token").agg(
        F.max(F.struct("hits", "n_slots", -F.col("n_changed"))).alias("best"))
    out = per_token.groupBy("doc_id", "item_id").agg(
        (F.count("token") / F.first("n_tokens")).alias("cover"), F.max("best").alias("best"))
    return out.where(F.col("cover") >= rules.least_cover).select(
        "doc_id", "item_id", "cover", F.col("best.hits").cast("long").alias("n_windows"), F.col("best.n_slots").cast("long").alias("n_slots"),
        (-F.col("best.col3")).cast("long").alias("n_changed"),
        F.when(F.col("best.col3") == 0, "verbatim").otherwise("reparameterised").alias("kind"))


def without_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of `docs` (all columns) whose document leaks no item; rows with a null id stay."""
    bad = written(leaks(docs, items, doc_id, "item_id", text, rules).select(F.col("doc_id").alias("__leak")).distinct(), "leak")
    return docs.join(bad, docs[doc_id].cast("long") == bad["__leak"], "left_anti")
