"""Versioned calculation rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import latest_by


def load_rules(old: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """Upsert on (code, version): definition/status/approver from the new load; approved_at
    kept when the rule was already approved and still is, stamped `now` when newly approved,
    cleared when the rule is not approved."""
    o = old.select("code", "version", F.col("approved_at").alias("old_approved_at"),
                   F.col("status").alias("old_status"))
    j = new.join(o, ["code", "version"], "left")
    approved = F.col("status") == "approved"
    keep = approved & (F.col("old_status") == "approved") & F.col("old_approved_at").isNotNull()
    stamp = (F.when(keep, F.col("old_approved_at"))
             .when(approved, F.lit(now).cast("timestamp")).otherwise(F.lit(None).cast("timestamp")))
    kept_old = old.join(new.select("code", "version"), ["code", "version"], "left_anti")
    return j.select("code", "version", "definition", "status", "approved_by", stamp.alias("approved_at")) \
        .unionByName(kept_old.select("code", "version", "definition", "status", "approved_by", "approved_at"))


def active_rules(rules: DataFrame) -> DataFrame:
    """The highest approved version of each code, with a kind ('gap' for GAP_* codes, else 'rule')
    and its prompt line 'CODE: definition'."""
    best = latest_by(rules.where(F.col("status") == "approved"), ["code"], ["version"], ["version", "definition"])
    return best.select("code", "version", "definition",
                       F.when(F.col("code").startswith("GAP_"), "gap").otherwise("rule").alias("kind"),
                       F.concat(F.col("code"), F.lit(": "), F.col("definition")).alias("line"))


def rules_block(active: DataFrame) -> DataFrame:
    """One text block per kind, lines sorted by code (the active rule set is small by nature)."""
    return active.groupBy("kind").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("code", "line"))), lambda x: x["line"]), "\n").alias("block"))
