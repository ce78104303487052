"""Exact similarity join (edit distance <= tau) with segment blocking.

Instead of comparing all pairs, every name s is cut into tau+1 segments and
indexed by (block, length, segment number, segment text).  If ed(r, s) <= tau,
at most tau segments of s are touched by the edits, so one segment of s occurs
intact in r, shifted by at most tau positions (Pass-Join, Li et al., VLDB 2011).
Each r therefore probes, for every candidate length |s| in |r| +- tau, every
segment number and every shift in [-tau, tau], the substring of r at that
position.  The probe/index join is an equi-join Spark shuffles by key; every
candidate is then verified with the thresholded `levenshtein`.  The result is
exact (no pair is missed), so no cap on candidates is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _segment(length, i, parts: int):
    """Start (0-based) and length of segment i of a string of `length` cut into `parts`."""
    base = F.floor(length / parts).cast("int")
    rem = (length % parts).cast("int")
    longer_from = parts - rem  # the last `rem` segments are one longer
    seg_len = base + F.when(i >= longer_from, 1).otherwise(0)
    start = i * base + F.greatest(F.lit(0), i - longer_from)
    return start, seg_len


def similar_pairs(df: DataFrame, id_col: str, text_col: str, block_col: str | None = None,
                  max_distance: int = 2, min_length: int = 5) -> DataFrame:
    """Pairs (id_a < id_b) with levenshtein(text_a, text_b) <= max_distance, both texts of at
    least `min_length` characters and (if `block_col` is given) sharing a block value.

    Returns (id_a, id_b, text_a, text_b, distance)."""
    tau = max_distance
    parts = tau + 1
    blk = F.col(block_col) if block_col else F.lit("")
    base = (df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), blk.alias("blk"))
            .where(F.length("t") >= F.greatest(F.lit(min_length), F.lit(parts)))
            .withColumn("len", F.length("t").cast("int")))

    seg_no = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    index = base.select("id", "blk", "len", seg_no.alias("seg"), "t")
    start, seg_len = _segment(F.col("len"), F.col("seg"), parts)
    index = index.select("id", "blk", "len", "seg", F.col("t").substr(start + 1, seg_len).alias("piece"))

    probe = (base.select(F.col("id").alias("pid"), "blk", F.col("len").alias("plen"), "t",
                         F.explode(F.sequence(F.lit(-tau), F.lit(tau))).alias("dl"))
             .withColumn("len", F.col("plen") + F.col("dl"))
             .where(F.col("len") >= F.greatest(F.lit(min_length), F.lit(parts)))
             .select("pid", "blk", "len", "plen", "t", seg_no.alias("seg"))
             .select("*", F.explode(F.sequence(F.lit(-tau), F.lit(tau))).alias("shift")))
    pstart, plen_seg = _segment(F.col("len"), F.col("seg"), parts)
    probe = (probe.withColumn("pos", pstart + F.col("shift")).withColumn("sl", plen_seg)
             .where((F.col("pos") >= 0) & (F.col("pos") + F.col("sl") <= F.col("plen")))
             .select("pid", "blk", "len", "seg", F.col("t").substr(F.col("pos") + 1, F.col("sl")).alias("piece"))
             .distinct())

    cand = (probe.join(index, ["blk", "len", "seg", "piece"], "inner")
            .where(F.col("pid") != F.col("id"))
            .select(F.least("pid", "id").alias("id_a"), F.greatest("pid", "id").alias("id_b"))
            .distinct())
    texts = base.select("id", "t").distinct()
    a = texts.select(F.col("id").alias("id_a"), F.col("t").alias("text_a"))
    b = texts.select(F.col("id").alias("id_b"), F.col("t").alias("text_b"))
    pairs = cand.join(a, "id_a").join(b, "id_b")
    dist = F.levenshtein("text_a", "text_b", tau)
    return (pairs.withColumn("distance", dist).where((F.col("distance") >= 0) & (F.col("distance") <= tau))
            .select("id_a", "id_b", "text_a", "text_b", "distance"))
