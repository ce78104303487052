"""Small DataFrame helpers shared by operators."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(num: Column, den: Column, to: str) -> Column:
    """num / nullif(den, 0) computed in double, then cast.

    Exact decimal sums are divided as doubles (what SQL engines without exact decimal
    division do) so that rounding to `to` is reproducible across engines."""
    return F.when(den != 0, (num.cast("double") / den.cast("double")).cast(to))


def latest_by(df: DataFrame, keys: list[str], order: list[str], value_cols: list[str] | None = None) -> DataFrame:
    """One row per `keys`, the row with the greatest `order` tuple (descending order).

    Implemented as a `max_by` aggregate over structs: a hash aggregate with map-side
    partial aggregation, so a hot key costs one partial row per task, never a sort
    of the whole group on one executor."""
    value_cols = value_cols or [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*[F.col(c) for c in value_cols]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(picked.alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in value_cols])


def scalar_max(df: DataFrame, col: str, alias: str) -> DataFrame:
    """One-row DataFrame holding max(col); safe to broadcast (exactly one row)."""
    return df.agg(F.max(col).alias(alias))


def signed_quantity(direction: str = "direction", quantity: str = "quantity_mt") -> Column:
    """A3: 'in' adds, anything else subtracts."""
    return F.when(F.col(direction) == "in", F.col(quantity)).otherwise(-F.col(quantity))


def narrow_sum(value: Column, scale: int) -> Column:
    """Exact sum of a decimal of up to 18 digits, `scale` of them decimals, counted in units of the last one: a partial sum is one
    long, where that of a wide decimal takes several words of a group's row in the shuffle."""
    return scaled(F.sum((value * 10 ** scale).cast("bigint")), scale)


def scaled(units: Column, scale: int) -> Column:
    """The decimal of a whole number of units of its last place."""
    return units.cast("decimal(19,0)") * F.lit(Decimal(1).scaleb(-scale))


def sliced(df: DataFrame, group_cols: list[str], order_cols: list, partitions: int | None = None) -> DataFrame:
    """`df` range-partitioned on (group, order), with the partition as `_pid`: contiguous slices of each group's order in
    consecutive partitions, so that a group with most of the rows is spread over many tasks.

    Two separately planned range exchanges may sample different bounds, so the slices are dealt once and the lineage is
    cut with a reliable checkpoint in the session's checkpoint folder; what reads them reads the same slices, and a lost
    executor re-reads them instead of dealing anew."""
    from ..session import checkpoint_dir
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    checkpoint_dir(df.sparkSession)
    return df.repartitionByRange(n, *group_cols, *order_cols).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)


def prefix_sums_before(df: DataFrame, group_cols: list[str], order_cols: list, sums: dict[str, str],
                       partitions: int | None = None) -> DataFrame:
    """Running sums over the rows before each row (exclusive) per group, in `order_cols` order; `sums`: out -> value column.

    A row's sum is that of its slice's rows before it plus the totals of the group's earlier slices (a table of one row
    per slice and group)."""
    rows = sliced(df, group_cols, order_cols, partitions)
    before = Window.unboundedPreceding
    w_off = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(before, -1)
    w_loc = Window.partitionBy("_pid", *group_cols).orderBy(*order_cols).rowsBetween(before, -1)
    totals = rows.groupBy("_pid", *group_cols).agg(*[F.sum(v).alias(f"_t_{o}") for o, v in sums.items()])
    offsets = _renamed(totals.select("_pid", *group_cols, *[F.coalesce(F.sum(f"_t_{o}").over(w_off), F.lit(0)).alias(f"_o_{o}") for o in sums]),
                       ["_pid", *group_cols])
    local = rows.select("*", *[F.coalesce(F.sum(v).over(w_loc), F.lit(0)).alias(f"_l_{o}") for o, v in sums.items()])
    return local.join(offsets, _same(["_pid", *group_cols])).select(
        *df.columns, *[(F.col(f"_o_{o}") + F.col(f"_l_{o}")).alias(o) for o in sums])


def _renamed(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_same_{c}") if c in cols else F.col(c) for c in df.columns])


def _same(cols: list[str]) -> list[Column]:
    """Null-safe equality with the columns of a `_renamed` side."""
    return [F.col(c).eqNullSafe(F.col(f"_same_{c}")) for c in cols]


def prefix_sum_before(df: DataFrame, group_cols: list[str], order_cols: list, value: str, out: str,
                      partitions: int | None = None) -> DataFrame:
    """One running sum; see `prefix_sums_before`."""
    return prefix_sums_before(df, group_cols, order_cols, {out: value}, partitions)


def carried_forward(df: DataFrame, group_cols: list[str], order_cols: list, value: str, partitions: int | None = None) -> DataFrame:
    """`df` with nulls of `value` replaced by the last value before them in their group, in `order_cols` order.

    Within a slice by a window; where a slice begins without one, the last value of the group's earlier slices (a table of
    one row per slice and group)."""
    rows = sliced(df, group_cols, order_cols, partitions)
    up_to = Window.partitionBy("_pid", *group_cols).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_at", F.last(value, ignorenulls=True).over(up_to))
    final = (rows.withColumn("_n", F.row_number().over(Window.partitionBy("_pid", *group_cols).orderBy(*order_cols)))
             .groupBy("_pid", *group_cols).agg(F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col("_n"))).alias("_end")))
    ends = _renamed(final.select("_pid", *group_cols, F.last("_end", ignorenulls=True).over(earlier).alias("_from")), ["_pid", *group_cols])
    return local.join(ends, _same(["_pid", *group_cols])).select(
        *[F.coalesce("_at", "_from").alias(value) if c == value else F.col(c) for c in df.columns])


DIGIT, ROUNDS = 1 << 20, 3  # values of one digit, about, and digits that a decimal(18) difference has at most


def exact_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median (percentile_cont 0.5) and row count per group of a decimal column (18 digits), by selection over digits.

    Values are whole numbers of their last decimal place, counted from the least one, and written in ROUNDS digits, the
    first of which divides the table's range into DIGIT parts at most.  Each
    round counts the values of the groups by their next digit, walks the counts to the digits in which the one or two
    middle ranks fall, and keeps only the values that have them.  A task never holds more than one group's counts of one
    digit, however many rows or distinct values the group has; there is one way for all sizes, and no job runs while
    the query is built.  Output: (keys..., records, median) with median as double."""
    unit = 10 ** df.schema[value].dataType.scale
    whole = (F.col(value).cast(f"decimal(38,{df.schema[value].dataType.scale})") * unit).cast("bigint")
    rows = df.where(F.col(value).isNotNull()).select(*keys, whole.alias("_v")).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    width = lambda before: F.floor(before / F.lit(DIGIT)).cast("bigint") + 1
    least, first = F.min(whole), width(F.max(whole) - F.min(whole))
    scale = df.agg(F.struct(least.alias("least"), first.alias("w0"), width(first).alias("w1")).alias("e")).scalar()
    path = [f"_d{r}" for r in range(ROUNDS)]
    rows = rows.withColumn("_e", scale).withColumn("_off", F.col("_v") - F.col("_e.least")).select(
        *keys, "_c", F.expr("_off div _e.w0").alias("_d0"), F.expr("(_off % _e.w0) div _e.w1").alias("_d1"),
        F.expr("_off % _e.w0 % _e.w1").alias("_d2"))
    picks = None  # (keys, digits so far, ranks, records): where the wanted ranks are, counted within those digits
    found = []
    for r in range(ROUNDS):
        known, name = path[:r], path[r]
        if picks is None:
            counts = rows.groupBy(*keys, name).agg(F.sum("_c").alias("_c"))
        else:
            # parts of one value are settled: nothing is left to read then
            rows = rows.where(scale[f"w{r - 1}"] > 1)
            met = rows.join(_renamed(picks.where(scale[f"w{r - 1}"] > 1), [*keys, *known]), _same([*keys, *known]))
            rows = met.select(*rows.columns)
            counts = met.groupBy(*keys, *known, name, "_ranks", "records").agg(F.sum("_c").alias("_c"))
        w = Window.partitionBy(*keys, *known).orderBy(name)
        walked = counts.withColumn("_before", F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        if picks is None:
            walked = walked.withColumn("records", F.sum("_c").over(Window.partitionBy(*keys)))
            # the two middle places, the same one twice where the number of rows is odd
            walked = walked.withColumn("_ranks", F.array(F.floor((F.col("records") - 1) / 2), F.floor(F.col("records") / 2)))
        inside = F.filter("_ranks", lambda k: (k >= F.col("_before")) & (k < F.col("_before") + F.col("_c")))
        picks = (walked.withColumn("_in", inside).where(F.size("_in") > 0)
                 .select(*keys, *known, name, F.transform("_in", lambda k: k - F.col("_before")).alias("_ranks"), "records"))
        done = picks if r == ROUNDS - 1 else picks.where(scale[f"w{r}"] == 1)
        value = scale["least"]
        for i, d in enumerate(path[:r + 1]):
            value = value + F.col(d) * (scale[f"w{i}"] if i < ROUNDS - 1 else F.lit(1))
        found.append(done.select(*keys, "records", (F.size("_ranks") * value.cast("double")).alias("_sum")))
    return reduce(DataFrame.unionByName, found).groupBy(*keys).agg(
        F.max("records").alias("records"), (F.sum("_sum") / 2 / unit).alias("median"))
