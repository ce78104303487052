"""Candidate pairs, exact Jaccard verification and components, shared by the similarity operators.

Ids are longs.  A group (a bucket of bands, a node of a tree) of at most `SMALL` members gives all its pairs; a larger
one gives the pairs with its smallest member, and what these leave open is settled in `resolve`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import connected_components, released, written

SMALL = 16
BLOCK, AGAINST = 4096, 2048  # rows of a block of a group, and of those that they are compared with
BLOCK_BYTES, AGAINST_BYTES = 4 << 20, 2 << 20  # the same in bytes of text (a longer single text is one row)
PROOF_BYTES = 1 << 17  # bytes of one side of the pairs that are proved together
EXHAUSTIVE = 4096  # members up to which a group that is not one component is compared exhaustively, in blocks
ROUNDS = 6  # splits of a larger one
POSITIONS = 64  # minwise values of a set
SKETCH = 0.5  # sets whose sketches agree on less than this share (4.6 deviations below 0.75) are not compared in full
FINE, FINE_SKETCH = 256, 0.65  # the same for sets that are compared in blocks (3.7 deviations below 0.75)
_A = (K.seeds(FINE, 11) >> K.U(32)).astype(np.uint32) | np.uint32(1)
_B = (K.seeds(FINE, 12) >> K.U(32)).astype(np.uint32)
Shingler = Callable[[K.Texts], tuple[np.ndarray, np.ndarray]]  # -> owner of each shingle (rising), fingerprint


def distinct_shingles(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (owner, fingerprint) pairs, ordered by owner; owners are below 2**24."""
    by = np.argsort(owner.astype(K.U) << K.U(40) | h >> K.U(24))
    owner, h = owner[by], h[by]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[first], h[first]


def common_counts(oa: np.ndarray, ha: np.ndarray, ob: np.ndarray, hb: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of n owners: the distinct fingerprints on side a, on side b, and on both (any order, repeats allowed).

    One sort of owner, fingerprint and side in 64 bits."""
    bits = K.U(max(1, int(n - 1).bit_length()))
    line = lambda o, h, side: o.astype(K.U) << (K.U(64) - bits) | h >> (bits + K.U(1)) << K.U(1) | K.U(side)
    key = np.sort(np.concatenate([line(oa, ha, 0), line(ob, hb, 1)]))
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    owner = (key >> (K.U(64) - bits)).astype(np.int64)
    of_b = (key & K.U(1)).astype(bool)
    both = owner[1:][key[1:] >> K.U(1) == key[:-1] >> K.U(1)]
    count = lambda o: np.bincount(o, minlength=n)
    return count(owner[~of_b]), count(owner[of_b]), count(both)


def minima(owner: np.ndarray, h: np.ndarray, positions: int = POSITIONS) -> tuple[np.ndarray, np.ndarray]:
    """Owners that have shingles, and their minwise values (uint32)."""
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    sig = np.empty((len(first), positions), np.uint32)
    if len(first):
        low = (h >> K.U(32)).astype(np.uint32)
        for p in range(positions):
            sig[:, p] = np.minimum.reduceat(low * _A[p] + _B[p], first)
    return owner[first], sig


def binary(a: np.ndarray, n: int, at: np.ndarray) -> pa.Array:
    """Rows of `a` as binary values at places `at` of n; the other places are empty."""
    size = np.zeros(n, np.int64)
    size[at] = a.shape[1] * a.itemsize
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(a))])


def matrix(col: pa.Array, dtype: type, width: int) -> np.ndarray:
    t = K.Texts.of(col)
    return np.ascontiguousarray(t.buf).view(dtype).reshape(-1, width)


def likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose sketches agree on at least SKETCH of the positions (`sketches(id, sketch)`: low bytes of the minima)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = matrix(batch.column("x"), np.uint8, POSITIONS) == matrix(batch.column("y"), np.uint8, POSITIONS)
            keep = pa.array(np.flatnonzero(same.mean(1) >= SKETCH))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])

    of = lambda side, name: sketches.select(F.col("id").alias(side), F.col("sketch").alias(name))
    return pairs.join(of("b", "y"), "b").join(of("a", "x"), "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def pairs_of_small(members: DataFrame, key: str, member: str) -> DataFrame:
    """All pairs a < b within each group; the caller keeps only groups of about SMALL members at most."""
    lists = members.groupBy(key).agg(F.sort_array(F.collect_set(member)).alias("m"))
    first = lists.select(F.posexplode("m").alias("i", "a"), "m")
    return first.select("a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b"))


def verified(pairs: DataFrame, texts: DataFrame, shingles: Shingler, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts' full shingle sets have 100 * intersection >= percent * union.

    `texts(id, text)` holds every id of `pairs`; both sides are written tables, so a hot id is split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, left in K.pieces(batches, "text_a", PROOF_BYTES):
            na, nb, both = common_counts(*shingles(left), *shingles(K.Texts.of(rows.column("text_b"))), rows.num_rows)
            ok = (100 * both >= percent * (na + nb - both)) & (both > 0)
            keep = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([rows.column("a").take(keep), rows.column("b").take(keep)], names=["a", "b"])

    of = lambda side: texts.select(F.col("id").alias(side), F.col("text").alias(f"text_{side}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def group_pairs(members: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b) of `members(key, id)` (all of a small group, those with the least id of a large one), and
    the members of the large groups."""
    sizes = written(members.groupBy("key").agg(F.count("id").alias("n"), F.min("id").alias("least")).where("n > 1"), tag)
    placed = written(members.join(sizes, "key"), tag)
    released(sizes)
    large = placed.where(F.col("n") > SMALL)
    star = large.where("least <> id").select(F.col("least").alias("a"), F.col("id").alias("b"))
    return pairs_of_small(placed.where(F.col("n") <= SMALL), "key", "id").union(star), large.select("key", "id")


def compare_block(block: pa.Table, shingles: Shingler, percent: int) -> pa.Table:
    """Links between the block's odd members and its others (a row may be both if a column `other` says so): for each
    odd one, one link to each other component.

    Sketches rule out what is far from a link; the rest is compared on the full shingle sets."""
    odd, ids, root = (block.column(c).to_numpy() for c in ("odd", "id", "root"))
    other = block.column("other").to_numpy() if "other" in block.column_names else ~odd
    owner, h = distinct_shingles(*shingles(K.Texts.of(block.column("text"))))
    n = np.bincount(owner, minlength=len(ids))
    first = np.cumsum(n) - n
    code = np.unique(h, return_inverse=True)[1]
    at, sig = minima(owner, h, FINE)
    sketch = np.zeros((len(ids), FINE), np.uint8)
    sketch[at] = sig
    y = np.flatnonzero(other & (n > 0))
    others, a, b = sketch[y], [], []
    mark = np.zeros(int(code.max(initial=0)) + 1, bool)
    for i in np.flatnonzero(odd & (n > 0)):
        near = y[((others == sketch[i]).sum(1, dtype=np.int16) >= FINE_SKETCH * FINE) & (root[y] != root[i])]
        if not len(near):
            continue
        mine = code[first[i]:first[i] + n[i]]
        mark[mine] = True
        size = n[near]
        gone = np.cumsum(size) - size
        both = np.add.reduceat(mark[code[np.arange(int(size.sum())) + np.repeat(first[near] - gone, size)]].astype(np.int64), gone)
        mark[mine] = False
        hit = near[100 * both >= percent * (n[i] + size - both)]
        hit = hit[np.unique(root[hit], return_index=True)[1]]
        a.append(np.minimum(ids[i], ids[hit]))
        b.append(np.maximum(ids[i], ids[hit]))
    none = [np.zeros(0, np.int64)]
    return pa.table({"a": np.concatenate(a or none), "b": np.concatenate(b or none)})


def block_links(members: DataFrame, texts: DataFrame, shingles: Shingler, percent: int, tag: str) -> DataFrame:
    """Links (a, b) between components of `members(key, id, root, least)` (written): the members outside a group's first
    component against all its members, in blocks of about BLOCK by AGAINST rows, and of BLOCK_BYTES by AGAINST_BYTES of
    text at most.  A text is sent once to each block that it meets, so once in a group of one block."""
    odd = F.col("root") != F.col("least")
    sizes = members.join(texts.select("id", F.octet_length("text").cast("long").alias("size")), "id").groupBy("key").agg(
        F.count("id").alias("n"), F.sum("size").alias("bytes"), F.count_if(odd).alias("n_odd"), F.sum(F.when(odd, F.col("size"))).alias("odd_bytes"))
    slots = lambda n, rows, size, most: F.greatest(F.ceil(F.col(n) / rows), F.ceil(F.col(size) / most), F.lit(1)).cast("int")
    grid = written(sizes.where("n_odd > 0").select("key", slots("n", BLOCK, "bytes", BLOCK_BYTES).alias("rows"),
                                                   slots("n_odd", AGAINST, "odd_bytes", AGAINST_BYTES).alias("cols")), tag)
    m = members.join(grid, "key").join(texts.select("id", "text"), "id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    shape = ["key", "i", "j", "odd", "other", "id", "root", "text"]
    others = (m.withColumns({"i": place("rows"), "odd": odd, "other": F.lit(True)}).withColumn("j", every("cols"))
              .withColumn("odd", F.col("odd") & (F.col("j") == place("cols"))).select(shape))
    against = (m.where(odd & (F.col("rows") > 1)).withColumns({"j": place("cols"), "odd": F.lit(True), "other": F.lit(False)})
               .withColumn("i", every("rows")).where(F.col("i") != place("rows")).select(shape))
    return others.union(against).groupBy("key", "i", "j").applyInArrow(lambda block: compare_block(block, shingles, percent), "a long, b long")


def resolve(pairs: DataFrame, groups: DataFrame, split: Callable[[DataFrame], DataFrame], texts: DataFrame, shingles: Shingler,
            percent: int, tag: str) -> DataFrame:
    """Components (id, root) of the links among the candidate `pairs(a, b)` (a < b, written) and inside the large
    `groups(key, id)`, whose pairs with their least member are among `pairs`.

    Links inside a component need no further proof.  So each id is verified against its smallest partner first, and
    later only pairs that still lie in different components.  A large group in one component is done.  Any other is
    compared exhaustively if it has at most EXHAUSTIVE members (those outside its first component against all, in blocks),
    else split into smaller groups (`split` gives the members' child groups) and looked at again; what is still larger
    after ROUNDS splits is compared in blocks as well."""
    def proof(rest: DataFrame) -> DataFrame:
        rest = written(rest, tag)
        proved = written(verified(rest, texts, shingles, percent), tag)
        released(rest)
        return proved

    links = proof(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    roots = connected_components(links, tag)

    def joined(rest: DataFrame) -> None:
        of = lambda side: roots.select(F.col("id").alias(side), F.col("root").alias(f"root_{side}"))
        both = rest.join(of("a"), "a", "left").join(of("b"), "b", "left")
        found(proof(both.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b").distinct()))

    def found(more: DataFrame) -> None:
        nonlocal links, roots
        if not more.isEmpty():
            links = links.union(more)
            roots = connected_components(links, tag)

    def mixed(members: DataFrame) -> DataFrame:
        rooted = written(members.join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")), tag)
        several = written(rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("id").alias("n"))
                          .where("least <> most").select("key", "least", "n"), tag)
        both = written(rooted.join(several, "key"), tag)
        released(rooted, several)
        return both

    joined(pairs)
    left = mixed(groups)
    for turn in range(ROUNDS + 1):
        if left.isEmpty():
            break
        now = left if turn == ROUNDS else left.where(F.col("n") <= EXHAUSTIVE)
        found(written(block_links(now.select("key", "id", "root", "least"), texts, shingles, percent, tag).distinct(), tag))
        more = left.where(F.col("n") > EXHAUSTIVE).select("key", "id")
        if turn == ROUNDS or more.isEmpty():
            break
        rest, large = group_pairs(written(split(more), tag), tag)
        joined(rest)
        left = mixed(large)
    return roots
