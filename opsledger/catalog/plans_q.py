"""Registered forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import StagedLedger
from ..operators import marts
from ..plans import forecast
from ..registry import register
from .marts_q import V7_SQL

SERIES_SQL = """
SELECT series, month, year(month) * 12 + month(month) - 1 AS x, value FROM (
  SELECT 'production_feed' AS series, CAST(date_trunc('month', run_date) AS DATE) AS month,
         sum(CAST(feed_quantity_mt AS DOUBLE)) AS value
  FROM v7_r, cutoff_r WHERE run_date IS NOT NULL AND feed_quantity_mt IS NOT NULL
    AND CAST(date_trunc('month', run_date) AS DATE) <= cutoff GROUP BY 1, 2
  UNION ALL
  SELECT 'sales_order_quantity', CAST(date_trunc('month', po_date) AS DATE), sum(CAST(ordered_quantity_mt AS DOUBLE))
  FROM sales_orders_r, cutoff_r WHERE po_date IS NOT NULL AND ordered_quantity_mt IS NOT NULL
    AND CAST(date_trunc('month', po_date) AS DATE) <= cutoff GROUP BY 1, 2
  UNION ALL
  SELECT 'quality_recorded_inward', CAST(date_trunc('month', sample_on) AS DATE),
         sum(CAST(represented_quantity_mt AS DOUBLE))
  FROM quality_samples_r, cutoff_r WHERE sample_stage = 'inward' AND sample_on IS NOT NULL
    AND represented_quantity_mt IS NOT NULL AND CAST(date_trunc('month', sample_on) AS DATE) <= cutoff GROUP BY 1, 2
  UNION ALL
  SELECT 'average_auction_price', CAST(date_trunc('month', closes_on) AS DATE), avg(CAST(current_price AS DOUBLE))
  FROM auction_lots_r, cutoff_r WHERE closes_on IS NOT NULL AND current_price IS NOT NULL
    AND CAST(date_trunc('month', closes_on) AS DATE) <= cutoff GROUP BY 1, 2)"""
EXTRA = {
    "v7_r": V7_SQL,
    "cutoff_r": "SELECT CAST(date_trunc('month', max(snapshot_on)) - INTERVAL 1 MONTH AS DATE) AS cutoff "
                "FROM stock_snapshots_r",
    "series_r": SERIES_SQL,
    "fit_r": """
SELECT series, n, mx, my, last_x, slope, my - slope * mx AS intercept,
       CASE WHEN syy <> 0 THEN greatest(0.0, 1 - (syy - slope * slope * sxx) / syy) ELSE 1.0 END AS r2
FROM (SELECT s.series, m.n, m.mx, m.my, m.last_x,
             sum((x - mx) * (value - my)) AS sxy, sum((x - mx) * (x - mx)) AS sxx,
             sum((value - my) * (value - my)) AS syy,
             CASE WHEN sum((x - mx) * (x - mx)) <> 0
                  THEN sum((x - mx) * (value - my)) / sum((x - mx) * (x - mx)) ELSE 0.0 END AS slope
      FROM series_r s JOIN (SELECT series, count(*) AS n, avg(CAST(x AS DOUBLE)) AS mx, avg(value) AS my,
                                   max(x) AS last_x FROM series_r GROUP BY 1) m ON m.series = s.series
      GROUP BY s.series, m.n, m.mx, m.my, m.last_x)""",
}


def series_points(spark, sf_dir):
    L = StagedLedger(spark, sf_dir)
    cutoff = L.stock_snapshots.agg(forecast.cutoff_month(F.max("snapshot_on")).alias("cutoff")).scalar()

    def one(df, name, date_col, value_col, mode):
        return forecast.monthly_series(df, name, date_col, value_col, mode, cutoff)

    v7 = marts.production_recovery(L.production_runs, L.production_inputs, L.production_outputs)
    return (one(v7, "production_feed", "run_date", "feed_quantity_mt", "sum")
            .unionByName(one(L.sales_orders, "sales_order_quantity", "po_date", "ordered_quantity_mt", "sum"))
            .unionByName(one(L.quality_samples.where(F.col("sample_stage") == "inward"), "quality_recorded_inward",
                             "sample_on", "represented_quantity_mt", "sum"))
            .unionByName(one(L.auction_lots, "average_auction_price", "closes_on", "current_price", "average")))


@register("t1_monthly_series", "SELECT series, month, x, round(value, 4) AS value FROM series_r", extra=EXTRA)
def t1(spark, sf_dir):
    return series_points(spark, sf_dir).withColumn("value", F.round("value", 4))


@register("t5_linear_forecasts", """
SELECT series, n, round(CASE WHEN n >= 3 THEN slope ELSE 0.0 END, 6) AS slope,
       round(CASE WHEN n >= 3 THEN intercept END, 2) AS intercept,
       round(CASE WHEN n >= 3 THEN r2 ELSE 0.0 END, 6) AS r2,
       CASE WHEN n < 3 THEN 'Insufficient' WHEN n >= 8 AND r2 >= 0.6 THEN 'Higher'
            WHEN n >= 5 AND r2 >= 0.3 THEN 'Moderate' ELSE 'Low' END AS confidence,
       CASE WHEN step IS NOT NULL THEN make_date(CAST((last_x + step) // 12 AS INTEGER),
                                                 CAST((last_x + step) % 12 + 1 AS INTEGER), 1) END AS month,
       CASE WHEN step IS NOT NULL THEN last_x + step END AS x,
       round(greatest(0.0, intercept + slope * (last_x + step)), 4) AS forecast
FROM fit_r LEFT JOIN (SELECT unnest([1, 2, 3]) AS step) st ON n >= 3""", extra=EXTRA)
def t5(spark, sf_dir):
    return forecast.linear_forecast(series_points(spark, sf_dir), 3)
