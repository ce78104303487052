"""Tables, scratch storage and connected components shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir).

    A private folder is used only by a local session that names none; a cluster without one is an error."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return str(set_dir).rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="opsledger-llm-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def written(df: DataFrame, tag: str) -> DataFrame:
    """`df` written as a Parquet table in the shared folder and read back: cuts the lineage, survives lost
    executors, and gives joins real sizes (so that adaptive execution can split skewed partitions).
    The shuffles that led to it are released."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/llm-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return back


def released(*tables: DataFrame) -> None:
    """Deletes the files of tables made by `written` that nothing reads any more (a lazy result of theirs is a reader)."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


MARK_BITS = 27  # a bitmap has 2**27 places (16 MB) at most, whatever the number of ids


def marks(ids: DataFrame) -> Broadcast:
    """A bitmap of the low bits of the one long column of `ids` (written), with some eight places for each, for `marked`.

    Its size is bounded, so it lets some other ids through, the more the more ids there are: an exact join follows it."""
    size = min(max(int(8 * ids.count()).bit_length(), 15), MARK_BITS)
    place = F.col(ids.columns[0]).bitwiseAND(F.lit((1 << size) - 1)) + 1  # Spark's buckets have 2**15 places from 1
    rows = ids.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    bits = np.zeros((1 << size - 15, 1 << 12), np.uint8)
    for r in rows:
        bits[r.bucket - 1] = np.frombuffer(r.bits, np.uint8)
    return ids.sparkSession.sparkContext.broadcast(bits.reshape(-1))


def marked(bits: np.ndarray, ident: np.ndarray) -> np.ndarray:
    """Which of the ids (64-bit) may be among those of the bitmap; none that is among them is missed."""
    place = ident & np.uint64(8 * len(bits) - 1)
    return bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & np.uint8(1) == 1


def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Distributed union-find by hooking and pointer jumping.

    `edges(a, b)`: undirected links between long ids.  Returns `(id, root)` for every id in an edge, root being
    the smallest id of its component.  Each round hooks every id to the smallest root among its neighbours'
    (a map-side combined minimum) and then jumps each pointer to its root's pointer; the number of rounds grows
    with the logarithm of the diameter.  Joins are between written tables, so a hot id is split by adaptive
    skew joins; nothing but one counter per round reaches the driver."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                   .where("a <> b").distinct(), tag)
    label = written(both.groupBy("a").agg(F.min("b").alias("m"))
                    .select(F.col("a").alias("id"), F.least("a", "m").alias("root")), tag)
    while True:
        of = lambda name: label.select(F.col("id").alias(name), F.col("root").alias(f"{name}_root"))
        # links between different roots, then the smallest neighbouring root of each root
        hooks = (both.where("a < b").join(of("a"), "a").join(of("b"), "b").where("a_root <> b_root")
                 .select(F.greatest("a_root", "b_root").alias("id"), F.least("a_root", "b_root").alias("to"))
                 .groupBy("id").agg(F.min("to").alias("to")))
        hooks = written(hooks, tag)
        if hooks.isEmpty():
            released(both, hooks)
            return jumped(label, tag)
        moved = (label.join(hooks.withColumnRenamed("id", "root"), "root", "left")
                 .select("id", F.coalesce("to", "root").alias("root")))
        label = jumped(written(moved, tag), tag)


def jumped(label: DataFrame, tag: str) -> DataFrame:
    """Pointer jumping until every pointer of `label(id, root)` reaches a fixed point."""
    while True:
        nxt = label.select(F.col("id").alias("root"), F.col("root").alias("up"))
        step = written(label.join(nxt, "root", "left")
                       .select("id", F.coalesce("up", "root").alias("up"), "root"), tag)
        if step.where("up <> root").isEmpty():
            return step.select("id", "root")
        label = step.select("id", F.col("up").alias("root"))
