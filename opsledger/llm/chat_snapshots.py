"""Cumulative-snapshot collapse of chat logs, then rendering (operator 10; DataFrame functions only).

A logged conversation that is a prefix of a longer one is an older snapshot of it.  The rolling hash of a prefix is the
XOR of hashes of (place, turn); conversations whose full hash is another one's prefix hash go, of equal ones the
smallest id stays, and the rest are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_ORDER = ["turn", "role", "text"]


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, place, p1, p2, last): each turn with the 128-bit hash of the prefix that it ends.

    A window over one conversation streams (and spills); a hash of a turn tells null from empty."""
    t = turns.where("conv_id is not null").select("conv_id", *_ORDER).distinct()
    by = Window.partitionBy("conv_id").orderBy(*_ORDER)
    rolling = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = lambda salt: F.xxhash64(F.lit(salt), "place", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    t = t.withColumns({"place": F.row_number().over(by), "last": F.lead(F.lit(True)).over(by).isNull()})
    t = t.withColumns({"h1": part(1), "h2": part(2)})
    return t.withColumns({"p1": F.bit_xor("h1").over(rolling), "p2": F.bit_xor("h2").over(rolling)}).drop("h1", "h2")


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations to keep: one of equal ones, none that a longer one begins with.

    Both sides are made distinct before the join, so a first turn that a third of all conversations share is one row."""
    whole = prefixes.where("last").groupBy("place", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("conv_id").alias("n_copies"))
    inner = prefixes.where("not last").select("place", "p1", "p2").distinct()
    return whole.join(inner, ["place", "p1", "p2"], "left_anti").select("conv_id", F.col("place").cast("long").alias("n_turns"), "n_copies")


def rendered(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """`kept` conversations with their turns rendered in order; a null role or text renders as empty."""
    t = turns.where("conv_id is not null").select("conv_id", *_ORDER).distinct().join(kept.select("conv_id"), "conv_id", "left_semi")
    lines = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*_ORDER))).alias("turns"))  # a rendered text is one row anyway
    say = lambda s: F.concat(F.lit(OPEN), F.coalesce(s["role"], F.lit("")), F.lit("\n"), F.coalesce(s["text"], F.lit("")), F.lit(CLOSE))
    return lines.join(kept, "conv_id").select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("turns", say), "").alias("text"))


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies (equal conversations, itself included) and text of every maximal conversation.

    Rows with a null conv_id are left out; equal rows count once; turns are ordered by turn (nulls first), role and
    text; an empty table gives no rows; other columns are ignored."""
    return rendered(turns, maximal(turn_prefixes(turns)))


ORACLE = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT conv_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
         string_agg(coalesce('r' || role, '-') || chr(1) || coalesce('t' || text, '-') || chr(2), '')
           OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pre
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
),
k AS (
  SELECT min(conv_id) AS conv_id, any_value(n) AS n_turns, count(*) AS n_copies FROM p
  WHERE place = n AND pre NOT IN (SELECT pre FROM p WHERE place < n) GROUP BY pre
)
SELECT k.conv_id, k.n_turns, k.n_copies,
       string_agg('{OPEN}' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '{CLOSE.strip()}' || chr(10), ''
                  ORDER BY t.turn NULLS FIRST, t.role NULLS FIRST, t.text NULLS FIRST) AS text
FROM k JOIN t USING (conv_id) GROUP BY k.conv_id, k.n_turns, k.n_copies
"""
