"""A grade meets only the bands of the other side's grades in which a mix might cost little enough, and misses none."""

from __future__ import annotations

import random
from decimal import Decimal

from pyspark.sql import functions as F

from opsledger.plans import blend


def cents(x: int) -> Decimal:
    return Decimal(x) / 100


def met(spark, grades, demands):
    """(demand, low grade, high grade) of the bands that pass, and of all pairs that cost no more than `enough`."""
    g = spark.createDataFrame(grades, "product string, fe decimal(8,4), cost decimal(18,4)")
    banded, bands = blend._bands(g)
    d = spark.createDataFrame(demands, "demand_id string, product string, dq double, t decimal(8,4), enough decimal(38,7)")
    low = d.join(g.select("product", F.col("fe").alias("low_fe"), F.col("cost").alias("low_cost")), "product").where("low_fe < t")
    near = low.join(bands, "product").where("band_to > t").where(blend._may_do())
    passed = near.join(banded.select("product", "band", F.col("fe").alias("high_fe")), ["product", "band"]).where("high_fe > t")
    pairs = low.join(g.select("product", F.col("fe").alias("high_fe"), F.col("cost").alias("high_cost")), "product").where("high_fe > t")
    cheap = blend._mixed(pairs).where(F.col("enough").isNull() | (blend._total() <= F.col("enough")))
    of = lambda df: {(r.demand_id, r.low_fe, r.high_fe) for r in df.collect()}
    return of(passed), of(cheap), pairs.count()


def test_no_cheap_pair_is_lost_and_most_others_do_not_meet(spark):
    rnd = random.Random(3)
    grades = [("p", cents(f), cents(rnd.randint(1000, 400000))) for f in rnd.sample(range(100, 9999), 400)]
    grades += [("q", cents(2000), cents(-500)), ("q", cents(2600), cents(0)), ("q", cents(9000), cents(7)), ("r", cents(2550), cents(1)), ("r", cents(2551), cents(1))]
    demands = [(f"d{i}", p, q, Decimal("25.5"), e) for i, (p, q, e) in enumerate([
        ("p", 125.0, Decimal(6000)), ("p", 0.004, Decimal(1)), ("p", 10.0, Decimal(-5)), ("q", 50.0, Decimal(3)), ("q", 50.0, None), ("r", 1.0, Decimal(9))])]
    passed, cheap, everything = met(spark, grades, demands)
    assert cheap and cheap <= passed
    some, few, all_of = met(spark, grades, demands[:1])
    assert few <= some and len(some) < all_of / 5


def test_the_cheapest_mixes_stay_the_same(spark):
    rnd = random.Random(11)
    rows = [("p", f"l{i:03}", cents(rnd.randint(100, 30000)), cents(rnd.randint(100, 9900)), cents(rnd.randint(1000, 300000))) for i in range(160)]
    stock = spark.createDataFrame(rows, "product string, lot string, quantity decimal(18,3), fe decimal(8,4), landed_cost decimal(18,4)")
    demands = spark.createDataFrame([("d", "p", Decimal(100), Decimal("25.5"))],
                                    "demand_id string, product string, quantity decimal(18,3), target_fe decimal(8,4)")
    best = []
    for _, lo, lq, lf, lc in rows:
        for _, hi, hq, hf, hc in rows:
            if lf < Decimal("25.5") < hf:
                share = 100 * (float(hf) - 25.5) / (float(hf) - float(lf))
                a, b = (Decimal(x).quantize(Decimal("0.001")) for x in (share, 100 - share))
                if a <= lq and b <= hq:
                    best.append((a * lc + b * hc, lo, hi))
    got = [(r.low_lot, r.high_lot) for r in blend.cheapest_pairs_by_grade(stock, demands).orderBy("rank").collect()]
    assert got == [m[1:] for m in sorted(best)[:5]]
