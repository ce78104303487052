"""Substring join of long texts to short keys, without pairs.

A key of at least GRAM characters can only stand in a text that holds each of its character grams, so it is indexed
under the one that the fewest texts hold; a shorter key is its own gram.  Texts are cut into the same grams, met by an
equi-join, and the meeting is confirmed by `contains`.  Keys with a gram that no text holds never meet a text.  Equal
texts and equal keys are joined once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 6


def grams(c: str, size: Column) -> Column:
    """Distinct substrings of `size` characters."""
    n = F.length(c) - size + 1
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(F.col(c), i, size)))


def rare_gram_index(keys: DataFrame, holders: DataFrame, size: int) -> DataFrame:
    """(gram, key): each distinct key under one gram; `holders(gram, texts)` counts the texts of a gram."""
    short = keys.where(F.length("key") < size).select(F.col("key").alias("gram"), "key")
    of = (keys.where(F.length("key") >= size).select("key", F.explode(grams("key", F.lit(size))).alias("gram"))
          .join(holders.hint("merge"), "gram", "left"))
    best = of.groupBy("key").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("best"))
    return short.unionByName(best.where(F.col("best.texts") > 0).select(F.col("best.gram").alias("gram"), "key"))


def contained_keys(texts: DataFrame, keys: DataFrame, size: int = GRAM) -> DataFrame:
    """All (text, key) of distinct `texts(text)` and non-empty distinct `keys(key)` where the text contains the key.

    Null texts and keys meet nothing."""
    t = texts.select("text").where(F.col("text").isNotNull()).distinct()
    k = keys.select("key").where(F.coalesce(F.length("key"), F.lit(0)) > 0).distinct()
    # The lengths to cut texts into: `size`, and those of shorter keys (fewer than `size` numbers).
    lengths = k.agg(F.collect_set(F.least(F.length("key"), F.lit(size)))).scalar()
    cut = t.select("text", F.explode(lengths).alias("n")).select("text", F.explode(grams("text", F.col("n"))).alias("gram"))
    holders = cut.where(F.length("gram") == size).groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    # By size of file a table of grams looks small (it is one text's grams times the texts), so the joins are told to meet in
    # shuffles: a broadcast would gather them in the driver.
    return (cut.join(rare_gram_index(k, holders, size).hint("merge"), "gram")
            .where(F.col("text").contains(F.col("key"))).select("text", "key"))


def first_contained(texts: DataFrame, text_col: str, keys: DataFrame, key_col: str, order_cols: list[str], value_cols: list[str],
                    size: int = GRAM) -> DataFrame:
    """`texts` with the `value_cols` of the first key row (by `order_cols`) whose key its `text_col` contains, else null.

    An empty key is contained in every text that is not null; rows with a null key never match; repeated texts stay."""
    rank = F.struct(*order_cols)
    one = (keys.where(F.col(key_col).isNotNull()).groupBy(F.col(key_col).alias("key"))
           .agg(F.min_by(F.struct(rank.alias("rank"), F.struct(*value_cols).alias("value")), rank).alias("first")))
    empty = one.where(F.col("key") == "").agg(F.first("first")).scalar()
    met = contained_keys(texts.select(F.col(text_col).alias("text")), one.select("key"), size).join(one.hint("merge"), "key")
    best = met.groupBy("text").agg(F.min_by("first", "first.rank").alias("first"))
    j = texts.join(best.withColumnRenamed("text", text_col).hint("merge"), text_col, "left")
    found = F.when(F.col("first").isNull(), F.when(F.col(text_col).isNotNull(), empty)).when(
        F.coalesce(empty["rank"] < F.col("first.rank"), F.lit(False)), empty).otherwise(F.col("first"))
    return j.withColumn("first", found).select(*texts.columns, *[F.col(f"first.value.{c}").alias(c) for c in value_cols])
