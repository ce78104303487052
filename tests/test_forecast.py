"""Forecast fixtures from the source system's checks."""

import datetime as dt

from pyspark.sql import functions as F

from opsledger.plans import forecast


def test_exact_line(spark):
    pts = spark.createDataFrame([("s", dt.date(2026, m, 1), float(v)) for m, v in [(1, 12), (2, 14), (3, 16)]],
                                "series string, month date, value double") \
        .withColumn("x", forecast.month_index(F.col("month")))
    out = forecast.linear_forecast(pts, 3).orderBy("x").collect()
    assert [r["forecast"] for r in out] == [18.0, 20.0, 22.0]
    assert out[0]["r2"] == 1.0 and out[0]["slope"] == 2.0


def test_blank_prices_skipped(spark):
    rows = [(dt.date(2026, 4, 1), 100.0), (dt.date(2026, 4, 2), None), (dt.date(2026, 5, 1), 200.0),
            (dt.date(2026, 6, 1), 300.0)]
    df = spark.createDataFrame(rows, "d date, price double")
    cutoff = forecast.cutoff_month(F.lit(dt.date(2026, 7, 24)))
    pts = forecast.monthly_series(df, "auction", "d", "price", "average", cutoff).orderBy("month").collect()
    assert [r["value"] for r in pts] == [100.0, 200.0, 300.0]


def test_insufficient(spark):
    pts = spark.createDataFrame([("s", dt.date(2026, 1, 1), 1.0, 24312)], "series string, month date, value double, x int")
    r = forecast.linear_forecast(pts, 3).collect()
    assert len(r) == 1 and r[0]["confidence"] == "Insufficient" and r[0]["month"] is None
