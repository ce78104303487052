"""B4 leaves out pairs of grades that cost more than known mixes, and loses none that counts."""

from __future__ import annotations

import random
from decimal import Decimal

from opsledger.operators.resolve import dedupe_latest
from opsledger.plans import blend

STOCK = "product string, lot string, quantity decimal(18,3), fe decimal(8,4), landed_cost decimal(18,4)"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bounded_pairs_are_the_cheapest_of_all_pairs(spark):
    rnd, cents = random.Random(5), lambda x: Decimal(x) / 100
    rows = [("p", f"l{i}", cents(rnd.randint(100, 4000)), cents(rnd.randint(1000, 4000)), cents(rnd.randint(90000, 99900))) for i in range(300)]
    stock = spark.createDataFrame(rows, STOCK)
    sizes = {"small": 5, "large": 39, "none": 70}  # 'none' is more than any lot holds: no bound, and mixes only of two lots
    demands = spark.createDataFrame([(n, "p", Decimal(q), Decimal("25.5")) for n, q in sizes.items()],
                                    "demand_id string, product string, quantity decimal(18,3), target_fe decimal(8,4)")
    from pyspark.sql import functions as F
    d = demands.select("demand_id", "product", F.col("quantity").cast("double").alias("dq"), F.col("target_fe").alias("t"))
    assert {r.demand_id for r in blend._enough(blend.useful_lots(stock, 5), d, 5).collect()} == {"small", "large"}
    best: dict[str, list] = {n: [] for n in sizes}
    q3 = Decimal("0.001")
    for n, dq in sizes.items():
        for _, lo, lq, lf, lc in rows:
            for _, hi, hq, hf, hc in rows:
                if lf < Decimal("25.5") < hf:
                    share = dq * (float(hf) - 25.5) / (float(hf) - float(lf))
                    a, b = Decimal(share).quantize(q3), Decimal(dq - share).quantize(q3)
                    if a <= lq and b <= hq:
                        best[n].append((a * lc + b * hc, lo, hi))
    got = {(r.demand_id, r.rank): (r.low_lot, r.high_lot) for r in blend.cheapest_pairs_by_grade(stock, demands).collect()}
    assert got == {(n, i + 1): m[1:] for n, ms in best.items() for i, m in enumerate(sorted(ms)[:5])}


def test_grades_are_cut_by_partition_not_one_call_each(spark):
    assert "FlatMapGroupsInPandas" not in plan(blend.useful_lots(spark.createDataFrame([], STOCK), 5))


def test_dedupe_carries_a_row_once(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 2, "y"), (None, 3, "z")], "k string, n long, v string")
    out = dedupe_latest(df, ["k"], ["n"])
    assert "max_by" not in plan(out)
    assert out.columns == df.columns and sorted((r.k or "", r.n, r.v) for r in out.collect()) == [("", 3, "z"), ("a", 2, "y")]
