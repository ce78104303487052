"""Embedding whitening on distributed block matrices (operator 11).

Entries are scaled to whole numbers, so that sums and deviations are exact.  The fit list holds each distinct vector
once; it is cut into row blocks, centred, and multiplied as a Spark MLlib BlockMatrix by its own transpose, which gives
the scatter matrix (dimension x dimension, all that reaches the driver).  Its eigenvectors, scaled, are a second
BlockMatrix; the product projects every row block.  Rows meet their vector's projection again by an equi-join.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BLOCK = 1024  # rows of a block
ZERO = 1e-12  # eigenvalues up to this share of the largest one count as zero


def finite(vector: Column) -> Column:
    """Whether a vector has entries, all of them finite."""
    whole = F.forall(vector, lambda e: e.isNotNull() & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & whole, F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda e: F.floor(e.cast("double") * F.lit(float(scale))).cast("long"))


def row_blocks(x: DataFrame, dim: int) -> DataFrame:
    """`x(x array<long>)` as (pid, seq, rows, x binary): blocks of at most BLOCK rows, 64-bit entries row after row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seq, held = TaskContext.get().partitionId(), 0, np.zeros((0, dim), np.int64)
        for batch in batches:
            new = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            held = np.concatenate([held, new])
            while len(held) >= BLOCK:
                yield block(pid, seq, held[:BLOCK])
                held, seq = held[BLOCK:], seq + 1
        if len(held):
            yield block(pid, seq, held)

    def block(pid: int, seq: int, a: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int64()), "seq": pa.array([seq], pa.int64()),
                                           "rows": pa.array([len(a)], pa.int64()),
                                           "x": pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())})

    return x.mapInArrow(cut, "pid long, seq long, rows long, x binary")


def numbered(blocks: DataFrame) -> DataFrame:
    """The blocks with one running number, without gaps.  One count for each task of the table reaches the driver."""
    spark = blocks.sparkSession
    before, offsets = 0, []
    for r in blocks.groupBy("pid").count().orderBy("pid").collect():
        offsets.append((r.pid, before))
        before += r["count"]
    first = spark.createDataFrame(offsets, "pid long, before long")
    return blocks.join(first, "pid").select((F.col("before") + F.col("seq")).alias("block"), "rows", "x")


def column_sums(blocks: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of every dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for batch in batches:
            for raw in batch.column("x").to_pylist():
                a = np.frombuffer(raw, np.int64).reshape(-1, dim)
                n += len(a)
                part = a.sum(0) if np.abs(a.astype(float)).max(initial=0) < 2.0 ** 50 else a.astype(object).sum(0)
                total = [t + int(v) for t, v in zip(total, part)]
        yield pa.RecordBatch.from_pydict({"dim": pa.array(range(-1, dim), pa.int32()),
                                          "s": pa.array([Decimal(v) for v in [n, *total]], pa.decimal128(38, 0))})

    rows = blocks.select("x").mapInArrow(add, "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").alias("s")).collect()
    sums = {r.dim: int(r.s) for r in rows}
    return sums.get(-1, 0), [sums.get(k, 0) for k in range(dim)]


def centred(raw: bytes, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n of a block, the numerator exact where it fits 64 bits."""
    a = np.frombuffer(raw, np.int64).reshape(-1, len(sums))
    if (np.abs(a.astype(float)).max(initial=0) + 1) * n < 2.0 ** 61:
        return (a * n - np.array(sums, np.int64)) / n
    return a - np.array([s / n for s in sums])


def deviations(raw: bytes, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n*x - S)^2 of each row, exact; null where it does not fit a long."""
    a = np.frombuffer(raw, np.int64).reshape(-1, len(sums))
    if (np.abs(a.astype(float)).max(initial=0) + 1) * n * 2.0 < (2.0 ** 62 / len(sums)) ** 0.5:
        return ((a * n - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    exact = ((a.astype(object) * n - np.array(sums, object)) ** 2).sum(1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


def block_matrix(blocks: DataFrame, n: int, sums: list[int], count: int) -> BlockMatrix:
    """The centred rows as a BlockMatrix of full blocks; rows added at a block's end are zero and add nothing."""
    dim = len(sums)

    def full(row):
        a = centred(row.x, n, sums)
        a = np.concatenate([a, np.zeros((BLOCK - len(a), dim))])
        return (row.block, 0), DenseMatrix(BLOCK, dim, a.ravel(), True)

    return BlockMatrix(blocks.rdd.map(full), BLOCK, dim, count * BLOCK, dim)


def scatter(m: BlockMatrix, splits: int) -> np.ndarray:
    """Transpose times matrix.  The long middle dimension is dealt over `splits` partitions (the second argument of the
    JVM's BlockMatrix.multiply), whose partial products Spark adds up; without it one task would hold every block."""
    left, right = m.transpose(), m
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, m.colsPerBlock, m.colsPerBlock).toLocalMatrix().toArray()


def components_of(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a covariance, their unit vectors (columns), and which are not zero."""
    e, u = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-e, kind="stable")[:k]
    e, u = e[order], u[:, order]
    return e, u, e > ZERO * max(e.max(initial=0), 0)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """Each row's whitened coordinates: (key, component, n, deviation, whitened, explained, identity_error).

    Rows whose vector is null, empty, or holds null or non-finite entries are left out, and so are vectors of another
    length than the most frequent one (the greater of two equally frequent), which no common matrix can hold.  Repeated
    rows and null keys stay; repeated vectors count once in the fit.  A component without variance (one distinct vector
    only, or fewer independent dimensions than components) has null `whitened`; `explained` is null where nothing
    varies.  A deviation that does not fit a long is null.  An empty table gives an empty result.  Other columns are
    ignored."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    schema = (f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    good = df.where(finite(F.col(vector))).select(F.col(key).alias("key"), scaled(F.col(vector), scale).alias("x"))
    size = good.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if size is None:
        return spark.createDataFrame([], schema)
    dim = size.dim
    good = good.where(F.size("x") == dim)
    cut = written(row_blocks(good.select("x").distinct(), dim), "whiten-cut")
    blocks = written(numbered(cut), "whiten-blocks")
    count = blocks.count()
    n, sums = column_sums(blocks, dim)
    matrix = block_matrix(blocks, n, sums, count)
    splits = max(1, blocks.rdd.getNumPartitions())
    v = scatter(matrix, splits) / n
    e, u, real = components_of(v, min(components, dim))
    width = len(e)
    project = np.where(real, u / np.sqrt(np.where(real, e, 1)), 0)
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(dim, width, project.ravel("F")))], 1),
                        dim, width, dim, width)
    products = spark.createDataFrame(
        matrix.multiply(right).blocks.map(lambda b: (b[0][0], b[1].toArray().tobytes())), "block long, w binary")
    table = written(unpacked(blocks.join(products, "block"), n, sums, width), "whiten-rows")
    trace = float(np.trace(v))
    explained = [float(x) / trace if trace > 0 else None for x in e]
    wrong = identity_error(table, real)
    rows = good.withColumn("h", F.xxhash64("x")).join(table.withColumn("h", F.xxhash64("x")), ["h", "x"])
    out = rows.select("key", "deviation", F.posexplode("w").alias("at", "whitened"))
    share = F.array(*(F.lit(s).cast("double") for s in explained))
    alive = F.array(*(F.lit(bool(r)) for r in real))
    return out.select(F.col("key").alias(key), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"),
                      "deviation", F.when(alive[F.col("at")], F.col("whitened")).alias("whitened"),
                      share[F.col("at")].alias("explained"), F.lit(wrong).cast("double").alias("identity_error"))


def unpacked(pairs: DataFrame, n: int, sums: list[int], width: int) -> DataFrame:
    """(x, deviation, w) of every row of the joined blocks."""
    dim = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, w in zip(*(batch.column(c).to_pylist() for c in ("rows", "x", "w"))):
                flat = pa.array(np.frombuffer(raw, np.int64))
                proj = np.frombuffer(w, np.float64).reshape(-1, width)[:rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.FixedSizeListArray.from_arrays(flat, dim).cast(pa.list_(pa.int64())),
                     pa.array(deviations(raw, n, sums), pa.int64()),
                     pa.FixedSizeListArray.from_arrays(pa.array(proj.ravel()), width).cast(pa.list_(pa.float64()))],
                    names=["x", "deviation", "w"])

    return pairs.mapInArrow(run, "x array<long>, deviation long, w array<double>")


def identity_error(table: DataFrame, real: np.ndarray) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, over components that vary."""
    at = [int(i) for i in np.flatnonzero(real)]
    if not at:
        return None
    w = lambda i: F.col("w")[i]
    pairs = [(i, j) for i in at for j in at if i <= j]
    got = table.agg(*(F.avg(w(i)).alias(f"m{i}") for i in at), *(F.avg(w(i) * w(j)).alias(f"p{i}_{j}") for i, j in pairs)).first()
    return max(abs(got[f"p{i}_{j}"] - got[f"m{i}"] * got[f"m{j}"] - (i == j)) for i, j in pairs)
