"""MinHash near-duplicates by a chosen-path set similarity join (operator 9).

Documents are sets of word 5-shingles.  Documents with equal sets form a class, and the join runs over one document of
each class.  A tree starts with all of them; a node branches along a few minwise positions chosen by its own hash, and
a document goes to the child named by its minimum there.  At similarity s a position keeps a pair together with
probability s, and a node has on average 1/s branches per position, so a similar pair stays together somewhere while
dissimilar ones part.  Small nodes are compared exhaustively (by all pairs, or by blocks of sketches); a larger one is
compared with its first document and branches again unless that makes it one component.  Independent trees repeat this
up to the target recall.  Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import marked, marks, released, written
from .links import POSITIONS, binary, distinct_shingles, group_pairs, likely, matrix, minima, resolve

GRAM = 5
PERCENT = 75
TREES = 12  # a pair at the threshold is missed by all roots with probability about 0.25**16
STEP = 3  # positions chosen together on a branch below the root


def word_shingles(t: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each text: its 5-word windows, or its whole word sequence if that is shorter."""
    w = K.Words(t, K.FOLDED_VALUE)
    at = K.windows_in(w.doc, GRAM)
    own, h = [w.doc[at]], [K.window_hash(w.hash, GRAM)[at] if len(at) else np.zeros(0, K.U)]
    for k in range(1, GRAM):
        short = np.flatnonzero(w.count == k)
        if len(short):
            own.append(short)
            h.append(K.window_hash(w.hash, k)[w.first[short]])
    return np.concatenate(own), np.concatenate(h)


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, sig, sketch): set size, 128-bit set fingerprint, minwise values and their low bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, t in K.pieces(batches, "__text"):
            owner, h = distinct_shingles(*word_shingles(t))
            n = np.bincount(owner, minlength=t.n)
            at, sig = minima(owner, h)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
            s = np.zeros((2, t.n), K.U)
            for k in range(2):
                if len(first):
                    s[k, at] = np.add.reduceat(K.mix(h ^ K.U(0x5851F42D4C957F2D * (k + 1) & 0xFFFFFFFFFFFFFFFF)), first)
            yield pa.RecordBatch.from_arrays(
                [rows.column("__id"), pa.array(n.astype(np.int64)), pa.array(K.signed(s[0])), pa.array(K.signed(s[1])),
                 binary(sig, t.n, at), binary(sig.astype(np.uint8), t.n, at)],
                names=["doc_id", "n_shingles", "s1", "s2", "sig", "sketch"])

    src = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text"))
    return src.mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, sig binary, sketch binary")


def _emit(ids: pa.Array, nodes: list[np.ndarray], rows: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(K.signed(np.concatenate(nodes))), ids.take(pa.array(np.concatenate(rows)))], names=["key", "id"])


def roots(reps: DataFrame, trees: int) -> DataFrame:
    """(key, id): the first nodes of all trees; two of three roots have one branch, the third has two."""
    plan = [(t, p) for t in range(trees) for p in ((5 * t) % POSITIONS, (5 * t + 2) % POSITIONS)[:2 if t % 3 == 0 else 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = matrix(batch.column("sig"), np.uint32, POSITIONS)
            every = np.arange(len(sig))
            if len(sig):
                yield _emit(batch.column("id"), [K.mix(sig[:, p].astype(K.U) | K.U((t * POSITIONS + p + 1) << 32)) for t, p in plan],
                            [every] * len(plan))

    return reps.select("id", "sig").mapInArrow(run, "key long, id long")


def branches(members: DataFrame) -> DataFrame:
    """(key, id): children of `members(key, id, sig)`: 2 or 3 branches (by the node's hash, (4/3)**3 on average), each
    along STEP positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = matrix(batch.column("sig"), np.uint32, POSITIONS)
            node = np.array(batch.column("key")).view(K.U)
            if not len(sig):
                continue
            every, nodes, rows = np.arange(len(sig)), [], []
            third = K.mix(node ^ K.U(0x1234567)) % K.U(100) < K.U(37)
            for branch in range(3):
                own = every if branch < 2 else every[third]
                child = K.mix(node[own] + K.U((branch + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
                pick = child.copy()
                for _ in range(STEP):
                    pick = K.mix(pick + K.U(1))
                    child = K.mix(child ^ sig[own, (pick % K.U(POSITIONS)).astype(np.int64)].astype(K.U))
                nodes.append(child)
                rows.append(own)
            yield _emit(batch.column("id"), nodes, rows)

    return members.select("key", "id", "sig").mapInArrow(run, "key long, id long")


def texts_of(docs: DataFrame, doc_id: str, text: str, ids: DataFrame) -> DataFrame:
    """(id, text): the documents with one of the `ids(id)`; others are left out before the shuffle, as far as a bitmap tells."""
    wanted = marks(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = marked(wanted.value, np.asarray(batch.column("id").fill_null(0)).view(K.U))
            yield batch.filter(pa.array(some))

    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return source.mapInArrow(run, "id long, text string").join(ids, "id", "left_semi")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, trees: int = TREES) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (it is the document's own id).

    Null and empty texts have the empty set and are linked with nothing; equal sets are linked; a row with a null id
    is kept, with a null component; rows that repeat an id are taken by their own text; an empty table gives no rows;
    other columns are ignored."""
    sigs = written(signatures(docs, doc_id, text), "sigs")
    named = sigs.where("n_shingles > 0 and doc_id is not null")
    classes = written(named.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("id"), F.count("doc_id").alias("copies")), "classes")
    reps = written(named.join(classes.select("s1", "s2", F.col("id").alias("doc_id")), ["doc_id", "s1", "s2"], "left_semi")
                   .dropDuplicates(["doc_id", "s1"]).select(F.col("doc_id").alias("id"), "sig", "sketch"), "reps")
    nodes = written(roots(reps, trees), "nodes")
    pairs, large = group_pairs(nodes, "nodes")
    released(nodes)
    pairs = written(likely(pairs.distinct(), reps), "likely")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).union(large.select("id")).distinct()
    ids = written(ids, "ids")
    texts = written(texts_of(docs, doc_id, text, ids), "texts")
    linked = resolve(pairs, large, lambda members: branches(members.join(reps.select("id", "sig"), "id")), texts, word_shingles, percent, "links")
    released(reps, pairs, ids, texts)
    rooted = classes.join(linked, "id", "left").select("s1", "s2", "id", "copies", "root")
    alone = F.col("root").isNull()
    # a root is the smallest of its classes' ids, and a class id is the smallest of its documents'
    where = written(rooted.where(~alone | (F.col("copies") > 1)).select("s1", "s2", F.coalesce("root", "id").alias("component")), "where")
    out = sigs.select("doc_id", "n_shingles", "s1", "s2").join(where, ["s1", "s2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` (all columns) that are the first of their group of near duplicates."""
    gone = written(near_duplicates(docs, doc_id, text).where("not kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(gone, docs[doc_id].cast("long") == gone["__gone"], "left_anti")
