"""Multilingual mixture inference (operator 5).

A document is a bag of words, each drawn from one language with unknown proportions.  A word's likelihood under a
language is the product of the language's smoothed frequencies of the word's letter trigrams.  Expectation-maximisation
estimates the proportions; the language set is the one that backward elimination reaches by penalised likelihood
(half the logarithm of the number of words for each language beyond the first).

The frequencies are counted over every training document: trigrams fall into 2**16 hashed cells, so the model has a
fixed size for each language whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K

CELLS = 1 << 16
MAX_LANGUAGES = 256  # bound of the model: MAX_LANGUAGES * CELLS counts; more languages are refused
SMOOTHING = 0.5
ROUNDS = 12  # EM rounds for each language set
UNKNOWN = "und"
SCHEMA = "lang_pred string, score double, languages array<string>, proportions array<double>"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True
_FOLD = np.full(256, 32, np.uint32)
_FOLD[_LETTER] = np.flatnonzero(_LETTER)
_FOLD[65:91] += 32


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_p: np.ndarray  # (languages, CELLS) float32


def trigrams(t: K.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (letter runs), and the cell of the trigram around each byte of the piece."""
    start, end = K.spans(t, ~_LETTER)
    cur = _FOLD[t.buf]
    before, after = np.full(len(cur), 32, np.uint32), np.full(len(cur), 32, np.uint32)
    before[1:], after[:-1] = cur[:-1], cur[1:]
    filled = np.diff(t.off) > 0
    before[t.off[:-1][filled]] = 32
    after[t.off[1:][filled] - 1] = 32
    code = before << 16 | cur << 8 | after
    return start, end, ((code * np.uint32(0x9E3779B1)) >> 16).astype(np.int32)


def count_cells(training: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, cell, n) over all rows of `training`; one array of counts per language and task, then summed by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for rows, t in K.pieces(batches, "__text"):
            names = rows.column("__lang").to_pylist()
            start, end, cell = trigrams(t)
            owner = t.owner(np.arange(len(t.buf)))
            inside = K.covered(len(t.buf), start, end)
            local = {x: i for i, x in enumerate(dict.fromkeys(names))}
            code = np.array([local[x] for x in names], np.int64)
            got = np.bincount(code[owner[inside]] * CELLS + cell[inside], minlength=len(local) * CELLS).reshape(-1, CELLS)
            for x, i in local.items():
                total[x] = total[x] + got[i] if x in total else got[i]
        for x, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())],
                                             names=["lang", "cell", "n"])

    src = training.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("__text"), F.col(lang).alias("__lang"))
    return src.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def learn(training: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The model of the languages named in `training` (rows with a null text or language teach nothing).

    Only the counts, bounded by MAX_LANGUAGES * CELLS, reach the driver."""
    rows = (count_cells(training, text, lang).groupBy("lang").agg(F.array_agg("cell").alias("cells"), F.array_agg("n").alias("ns"))
            .orderBy("lang").limit(MAX_LANGUAGES + 1).collect())
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    n = np.full((len(rows), CELLS), SMOOTHING)
    for i, r in enumerate(rows):
        n[i, r["cells"]] += r["ns"]
    return Model([r["lang"] for r in rows], np.log(n / n.sum(1, keepdims=True)).astype(np.float32))


def _em(ratio: np.ndarray, first: np.ndarray, doc: np.ndarray, size: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM over the words of each document; returns proportions and log-likelihood (relative to the words' best)."""
    for _ in range(ROUNDS):
        part = ratio * share[doc]
        part /= np.maximum(part.sum(1, keepdims=True), 1e-30)
        share = np.add.reduceat(part, first, 0) / size[:, None]
    return share, np.add.reduceat(np.log(np.maximum((ratio * share[doc]).sum(1), 1e-30)), first)


def mixtures(t: K.Texts, log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages; 0 for languages left out) and a flag for texts with words."""
    k = len(log_p)
    share = np.zeros((t.n, k))
    start, end, cell = trigrams(t)
    if not len(start) or not k:
        return share, np.zeros(t.n, bool)
    doc = t.owner(start)
    size = np.bincount(doc, minlength=t.n)
    some = np.flatnonzero(size)
    # a letter run's log-likelihood for each language
    inside = K.covered(len(t.buf), start, end)
    length = end - start
    begin = np.cumsum(length) - length
    ll = np.add.reduceat(log_p[:, cell[inside]], begin, 1).T
    ratio = np.exp(np.maximum(ll - ll.max(1, keepdims=True), -60))
    n = size[some]
    first = np.cumsum(n) - n
    local = np.repeat(np.arange(len(some)), n)
    single = np.add.reduceat(ll - ll.max(1, keepdims=True), first, 0)
    best = single.argmax(1)
    got = np.zeros((len(some), k))
    got[np.arange(len(some)), best] = 1
    # With log-likelihood concave in the proportions, a best language from which no direction rises is the optimum.
    at_best = np.take_along_axis(ratio, best[local][:, None], 1)
    rise = np.add.reduceat(ratio / np.maximum(at_best, 1e-26), first, 0) - n[:, None]
    todo = np.flatnonzero((rise > 1e-6 * n[:, None]).any(1)) if k > 1 else np.zeros(0, np.int64)
    price = np.log(n) / 2
    while len(todo):  # one group: the documents that may mix languages
        words = np.concatenate([np.arange(first[i], first[i] + n[i]) for i in todo])
        m = n[todo]
        f, d, r = np.cumsum(m) - m, np.repeat(np.arange(len(todo)), m), ratio[words]
        alive = np.ones((len(todo), k), bool)
        pi, like = _em(r, f, d, m, alive / alive.sum(1, keepdims=True))
        open_ = np.ones(len(todo), bool)
        # no set beats the best single language if even the full set gains less than one language's price
        alone = like - single[todo].max(1) < price[todo]
        open_[alone] = False
        pi[alone] = got[todo[alone]]
        while open_.any():
            weak = np.where(alive, pi, np.inf).argmin(1)
            less = alive.copy()
            less[np.arange(len(todo)), weak] = False
            open_ &= less.any(1)
            act = np.flatnonzero(open_)
            if not len(act):
                break
            keep = np.concatenate([np.arange(f[i], f[i] + m[i]) for i in act])
            mm = m[act]
            warm = np.where(less[act], pi[act] + 1e-3, 0)
            p2, l2 = _em(r[keep], np.cumsum(mm) - mm, np.repeat(np.arange(len(act)), mm), mm, warm / warm.sum(1, keepdims=True))
            better = l2 >= like[act] - price[todo[act]]
            won = act[better]
            pi[won], like[won], alive[won] = p2[better], l2[better], less[won]
            open_[act[~better]] = False
        got[todo] = pi
        break
    share[some] = got
    return share, size > 0


def predict(df: DataFrame, key: list[str], model: Model, text: str = "text") -> DataFrame:
    """`key` columns of each row with its main language, that language's proportion, and the whole language set.

    A null text, a text without a letter, or a model without languages gives `und` with score 0.  Equal texts give
    equal results; ties go to the language first by name; other columns are ignored."""
    cast = df.sparkSession.sparkContext.broadcast(model)  # bounded: MAX_LANGUAGES * CELLS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = cast.value
        for rows, t in K.pieces(batches, "__text"):
            share, known = mixtures(t, m.log_p)
            ascii_letter = K.per_text(t, _LETTER[t.buf] & (t.buf < 128)) > 0
            pred, score, sets, parts = [], [], [], []
            for i in range(t.n):
                if not known[i] or not (ascii_letter[i] or any(map(str.isalpha, t.text(i).decode()))):
                    pred.append(UNKNOWN), score.append(0.0), sets.append([]), parts.append([])
                    continue
                by = sorted(np.flatnonzero(share[i] > 0), key=lambda j: -share[i, j])
                pred.append(m.languages[by[0]])
                score.append(float(min(1.0, share[i, by[0]])))
                sets.append([m.languages[j] for j in by])
                parts.append([float(share[i, j]) for j in by])
            yield pa.RecordBatch.from_arrays([*(rows.column(f"__k{i}") for i in range(len(key))), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(sets, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64()))],
                                             names=[*key, "lang_pred", "score", "languages", "proportions"])

    src = df.select(*(df[k].alias(f"__k{i}") for i, k in enumerate(key)), F.col(text).alias("__text"))
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)
    return src.mapInArrow(run, f"{fields}, {SCHEMA}")


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3
