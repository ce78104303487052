"""Monthly series and linear forecasts.

Every series is reduced to (series, month) points by a grouped aggregate, then
to per-series means and centred sums (two grouped aggregates),
so the least-squares fit of any number of series never
brings a series into one task.  Forecast months come from `explode(sequence)`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_index(month: Column) -> Column:
    """year * 12 + month - 1 (the x axis)."""
    return F.year(month) * 12 + F.month(month) - 1


def cutoff_month(snapshot: Column) -> Column:
    """The month before the snapshot's month (first day)."""
    return F.add_months(F.trunc(snapshot, "MM"), -1)


def monthly_series(df: DataFrame, series: str, date_col: str, value_col: str, mode: str,
                   cutoff: Column) -> DataFrame:
    """Sum or mean by month; null, NaN and infinite values and null dates skipped; months after the cutoff dropped; no gap filling."""
    v = F.col(value_col).cast("double")
    rows = df.where(F.col(date_col).isNotNull() & F.col(value_col).isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) \
        .select(F.trunc(F.col(date_col).cast("date"), "MM").alias("month"), v.alias("v"))
    rows = rows.where(F.col("month") <= cutoff)
    agg = F.avg("v") if mode == "average" else F.sum("v")
    return rows.groupBy("month").agg(agg.alias("value")).select(
        F.lit(series).alias("series"), "month", month_index(F.col("month")).alias("x"), "value")


def linear_forecast(points: DataFrame, periods: int = 3) -> DataFrame:
    """Per series least squares; < 3 points -> slope 0, r2 0, 'Insufficient', no forecast.

    r2 = 1 when y has no variance, floored at 0; forecasts floored at 0 and start after the
    last observed month.  Output: (series, n, slope, intercept, r2, confidence, month, x, forecast)
    with one row per forecast month (or one row with null month when insufficient)."""
    # Two passes for numerical stability: means per series (one row per series, broadcast),
    # then centred sums.  RSS = Syy - slope^2 * Sxx for the least-squares line.
    means = points.groupBy("series").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("x").cast("double")).alias("mx"),
        F.avg(F.col("value")).alias("my"), F.max("x").alias("last_x"))
    c = points.join(F.broadcast(means), "series")
    dx = F.col("x").cast("double") - F.col("mx")
    dy = F.col("value") - F.col("my")
    st = c.groupBy("series", "n", "mx", "my", "last_x").agg(
        F.sum(dx * dy).alias("sxy"), F.sum(dx * dx).alias("sxx"), F.sum(dy * dy).alias("syy"))
    st = st.withColumn("slope", F.when(F.col("sxx") != 0, F.col("sxy") / F.col("sxx")).otherwise(0.0))
    st = st.withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    rss = F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx")
    st = st.withColumn("r2", F.when(F.col("syy") != 0, F.greatest(F.lit(0.0), 1 - rss / F.col("syy"))).otherwise(1.0))
    ok = F.col("n") >= 3
    st = st.select(
        "series", "n", F.when(ok, F.col("slope")).otherwise(0.0).alias("slope"),
        F.when(ok, F.col("intercept")).alias("intercept"),
        F.when(ok, F.col("r2")).otherwise(0.0).alias("r2"), "last_x")
    st = st.withColumn("confidence", F.when(~ok, "Insufficient")
                       .when((F.col("n") >= 8) & (F.col("r2") >= 0.6), "Higher")
                       .when((F.col("n") >= 5) & (F.col("r2") >= 0.3), "Moderate").otherwise("Low"))
    steps = F.when(ok, F.sequence(F.lit(1), F.lit(periods))).otherwise(F.array().cast("array<int>"))
    out = st.select("*", F.explode_outer(steps).alias("step"))
    fx = F.col("last_x") + F.col("step")
    return out.select(
        "series", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 2).alias("intercept"),
        F.round("r2", 6).alias("r2"), "confidence",
        F.when(F.col("step").isNotNull(), F.make_date((fx / 12).cast("int"), (fx % 12 + 1).cast("int"), F.lit(1)))
        .alias("month"),
        F.when(F.col("step").isNotNull(), fx).alias("x"),
        F.round(F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope") * fx), 4).alias("forecast"))
