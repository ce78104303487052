"""Entity resolution and keyed upserts: W1/W2, J9/J10, M1-M5.

All are joins and grouped aggregates; no driver-side maps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean
from .common import latest_by


def dedupe_latest(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """Keep one row per key, the greatest `order_cols` tuple (later columns break ties)."""
    rest = [c for c in df.columns if c not in keys]
    # The order holds every column, so the greatest order is the row: no second copy of it goes through the shuffle.
    row = F.max(F.struct(*order_cols, *[c for c in rest if c not in order_cols])).alias("_v")
    return df.groupBy(*keys).agg(row).select(*[F.col(c) if c in keys else F.col(f"_v.{c}").alias(c) for c in df.columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update_cols: list[str],
           order_cols: list[str]) -> DataFrame:
    """Last-writer-wins upsert on a business key.

    Rows of `new` replace the listed `update_cols` of a matching `old` row; the other
    columns keep their old value (`ON CONFLICT DO UPDATE SET` on a column list).  Within
    `new`, the greatest `order_cols` wins.  Keys absent from `new` keep the old row."""
    latest_new = dedupe_latest(new, keys, order_cols)
    o = old.alias("o")
    n = latest_new.alias("n")
    j = o.join(n, keys, "full_outer")
    cols = []
    for c in old.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c in update_cols:
            cols.append(F.when(F.col("n." + keys[0]).isNotNull(), F.col("n." + c)).otherwise(F.col("o." + c)).alias(c))
        else:
            cols.append(F.coalesce(F.col("o." + c), F.col("n." + c)).alias(c))
    return j.select(*cols)


def resolve_alias(df: DataFrame, text_col: str, aliases: DataFrame, out: str = "lot_id") -> DataFrame:
    """The text resolves only if its normalised form maps to exactly one id.

    aliases: (lot_id, alias).  Ambiguous or unknown text gives null."""
    unique = (aliases.select(clean.normalized("alias").alias("_k"), F.col("lot_id"))
              .where(F.col("_k") != "")
              .groupBy("_k").agg(F.count_distinct("lot_id").alias("_n"), F.min("lot_id").alias("_id"))
              .where(F.col("_n") == 1).select("_k", F.col("_id").alias(out)))
    return (df.withColumn("_k", clean.normalized(text_col)).join(unique, "_k", "left").drop("_k"))


def last_lookup(df: DataFrame, on: list[str], dim: DataFrame, dim_on: list[str], order_cols: list[str],
                value_col: str, out: str) -> DataFrame:
    """Last-writer-wins lookup (the dimension row with the greatest order per key)."""
    best = latest_by(dim, dim_on, order_cols, [value_col]).withColumnRenamed(value_col, out)
    cond = [df[a] == best[b] for a, b in zip(on, dim_on)]
    return df.join(best, cond, "left").drop(*[b for b in dim_on if b not in on])


def build_organizations(mentions: DataFrame, name_col: str = "name", role_col: str = "role",
                        order_col: str = "source_row_id") -> DataFrame:
    """M1: one organisation per F3 key; the first-seen legal name is kept; roles as a sorted set.

    Output: (organization_id, legal_name, normalized_name, roles, source_row_id); the id is the
    first source row that introduced the key (deterministic across re-runs)."""
    m = mentions.where(clean.text(name_col) != "").select(
        clean.normalized_organization(name_col).alias("normalized_name"),
        clean.text(name_col).alias("legal_name"), F.col(role_col).alias("role"), F.col(order_col).alias("o"))
    first = m.groupBy("normalized_name").agg(
        F.min_by("legal_name", "o").alias("legal_name"), F.min("o").alias("organization_id"),
        F.array_sort(F.collect_set("role")).alias("roles"))
    return first.select("organization_id", "legal_name", "normalized_name", "roles",
                        F.col("organization_id").alias("source_row_id"))


def organization_aliases(mentions: DataFrame, name_col: str = "name", order_col: str = "source_row_id") -> DataFrame:
    """M1: one alias per normalised name (F2), the first mention's spelling and organisation (F3 key)."""
    m = mentions.where(clean.text(name_col) != "").select(
        clean.text(name_col).alias("alias"), clean.normalized(name_col).alias("normalized_alias"),
        clean.normalized_organization(name_col).alias("normalized_name"), F.col(order_col).alias("o"))
    return m.groupBy("normalized_alias").agg(
        F.min_by(F.struct("normalized_name", "alias"), "o").alias("first"), F.min("o").alias("source_row_id")).select(
        F.col("first.normalized_name").alias("normalized_name"), F.col("first.alias").alias("alias"), "normalized_alias", "source_row_id")


def first_wins_backfill(df: DataFrame, key: str, col: str, source: DataFrame, source_col: str,
                        order_col: str) -> DataFrame:
    """M5: fill a null `col` from the first (smallest `order_col`) matching source row."""
    first = source.groupBy(key).agg(F.min_by(source_col, order_col).alias("_fill"))
    return df.join(first, key, "left").withColumn(col, F.coalesce(F.col(col), F.col("_fill"))).drop("_fill")


def trim_text(c: str) -> Column:
    return clean.text(c)
