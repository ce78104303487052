"""Blend and purchase planning.

B1-B3 (`blend_candidates`, `blend_plans`) and B4 (`cheapest_pairs`) rank one- and two-lot
mixes for a demand.  Two-lot candidates are pairs of a lot at or below the target grade
with a lot at or above it inside one product, so their number is quadratic in the lots of
that product; they are meant for a planner's stock list (a product's current lots for a
handful of demands), not for whole tables, and are not registered as table queries.

`cheapest_pairs_by_grade` is B4 over whole tables: it pairs grades, not lots.  B5 (`achievable_range`) and B6 (`assess_purchase`) are grouped aggregates / prefix sums and
run over whole tables.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SINGLE_TOLERANCE = Decimal("0.05")
QUANTITY_TOLERANCE = Decimal("0.001")
RESIDUAL = Decimal("0.01")


def _r(c: Column, places: int = 2) -> Column:
    return F.round(c.cast("decimal(38,10)"), places)


def blend_candidates(stock: DataFrame, demands: DataFrame) -> DataFrame:
    """B1-B2: valid single lots and lever-rule pairs per demand, with their metrics.

    stock:   (product, lot, description, quantity, fe, landed_cost, age_days)
    demands: (demand_id, product, quantity, target_fe, sale_rate)
    Output:  (demand_id, key, lots, parts, quantity, blended_fe, unit_cost, total_cost,
              expected_realization, margin, average_age)"""
    s = stock.where((F.col("quantity") > 0) & (F.col("fe") > 0))
    d = demands.select("demand_id", "product", F.col("quantity").alias("dq"), F.col("target_fe").alias("t"),
                       "sale_rate")
    singles = (d.join(s, "product")
               .where((F.abs(F.col("fe") - F.col("t")) <= SINGLE_TOLERANCE) & (F.col("quantity") >= F.col("dq")))
               .select("demand_id", "dq", "t", "sale_rate",
                       F.array(F.struct(F.col("lot"), F.col("description"), F.col("dq").alias("q"),
                                        F.col("fe"), F.col("landed_cost").alias("cost"),
                                        (F.col("quantity") - F.col("dq")).alias("remaining"),
                                        F.col("age_days").alias("age"))).alias("parts")))
    lo = s.select("product", *[F.col(c).alias("l_" + c) for c in s.columns if c != "product"])
    hi = s.select("product", *[F.col(c).alias("h_" + c) for c in s.columns if c != "product"])
    pairs = (d.join(lo, "product").where(F.col("l_fe") <= F.col("t"))
             .join(hi, "product")
             .where((F.col("h_fe") >= F.col("t")) & (F.col("l_fe") < F.col("h_fe"))))
    low_q = F.col("dq") * (F.col("h_fe") - F.col("t")) / (F.col("h_fe") - F.col("l_fe"))
    pairs = pairs.withColumn("lq", low_q.cast("double")).withColumn("hq", (F.col("dq") - low_q).cast("double"))
    pairs = pairs.where((F.col("lq") <= F.col("l_quantity") + float(QUANTITY_TOLERANCE))
                        & (F.col("hq") <= F.col("h_quantity") + float(QUANTITY_TOLERANCE)))
    pairs = pairs.select("demand_id", "dq", "t", "sale_rate", F.array(
        F.struct(F.col("l_lot").alias("lot"), F.col("l_description").alias("description"), F.col("lq").alias("q"),
                 F.col("l_fe").alias("fe"), F.col("l_landed_cost").alias("cost"),
                 (F.col("l_quantity") - F.col("lq")).alias("remaining"), F.col("l_age_days").alias("age")),
        F.struct(F.col("h_lot").alias("lot"), F.col("h_description").alias("description"), F.col("hq").alias("q"),
                 F.col("h_fe").alias("fe"), F.col("h_landed_cost").alias("cost"),
                 (F.col("h_quantity") - F.col("hq")).alias("remaining"), F.col("h_age_days").alias("age"))
    ).alias("parts"))
    cand = singles.unionByName(pairs)
    # B2: parts rounded to 2 dp first; cost and grades from the rounded parts.
    rounded = F.transform("parts", lambda p: p.withField("q", _r(p["q"]).cast("decimal(18,2)"))
                          .withField("remaining", _r(p["remaining"]).cast("decimal(18,2)")))
    cand = cand.withColumn("parts", rounded)
    total_cost = F.aggregate("parts", F.lit(0).cast("decimal(38,10)"),
                             lambda acc, p: (acc + p["q"] * p["cost"].cast("decimal(20,6)")).cast("decimal(38,10)"))
    fe_sum = F.aggregate("parts", F.lit(0).cast("decimal(38,10)"),
                         lambda acc, p: (acc + p["q"] * p["fe"].cast("decimal(20,6)")).cast("decimal(38,10)"))
    age_sum = F.aggregate("parts", F.lit(0).cast("decimal(38,10)"),
                          lambda acc, p: (acc + p["q"] * F.coalesce(p["age"], F.lit(0)).cast("decimal(20,6)"))
                          .cast("decimal(38,10)"))
    q = F.col("dq").cast("decimal(38,10)")
    return cand.select(
        "demand_id",
        F.array_join(F.transform("parts", lambda p: p["lot"]), "+").alias("key"),
        "parts", _r(q).alias("quantity"), F.col("t").alias("target_fe"),
        _r(fe_sum / q).alias("blended_fe"), _r(total_cost / q).alias("unit_cost"), _r(total_cost).alias("total_cost"),
        _r(q * F.col("sale_rate").cast("decimal(20,6)")).alias("expected_realization"),
        _r(q * F.col("sale_rate").cast("decimal(20,6)") - total_cost).alias("margin"),
        _r(age_sum / q, 1).alias("average_age"))


def blend_plans(candidates: DataFrame) -> DataFrame:
    """Per demand, 'Maximum profit', 'Balanced' (0.6 normalised cost + 0.4 (1 - normalised age))
    and 'Fastest-moving' (oldest), choosing three different keys when possible, else the best."""
    w_all = Window.partitionBy("demand_id")
    c = candidates
    for col, nm in (("unit_cost", "cost"), ("average_age", "age")):
        c = c.withColumn(f"min_{nm}", F.min(col).over(w_all)).withColumn(f"max_{nm}", F.max(col).over(w_all))

    def norm(v, lo, hi):
        return F.when(F.col(hi) == F.col(lo), F.lit(0.0)).otherwise(
            (F.col(v) - F.col(lo)).cast("double") / (F.col(hi) - F.col(lo)).cast("double"))

    c = c.withColumn("balance_score", norm("unit_cost", "min_cost", "max_cost") * 0.6
                     + (1 - norm("average_age", "min_age", "max_age")) * 0.4)
    by_profit = Window.partitionBy("demand_id").orderBy(F.col("margin").desc(), "key")
    by_balance = Window.partitionBy("demand_id").orderBy("balance_score", "key")
    by_age = Window.partitionBy("demand_id").orderBy(F.col("average_age").desc(), F.col("margin").desc(), "key")
    c = (c.withColumn("r_profit", F.row_number().over(by_profit))
         .withColumn("r_balance", F.row_number().over(by_balance))
         .withColumn("r_age", F.row_number().over(by_age)))
    # Each pick skips at most two keys, so the first three of every ranking suffice.
    top = c.where((F.col("r_profit") <= 3) | (F.col("r_balance") <= 3) | (F.col("r_age") <= 3))
    per = top.groupBy("demand_id").agg(
        F.array_sort(F.collect_list(F.struct("r_profit", "key"))).alias("p"),
        F.array_sort(F.collect_list(F.struct("r_balance", "key"))).alias("b"),
        F.array_sort(F.collect_list(F.struct("r_age", "key"))).alias("a"))
    first = F.col("p")[0]["key"]
    b_keys = F.filter(F.transform("b", lambda x: x["key"]), lambda k: k != first)
    second = F.coalesce(F.try_element_at(b_keys, F.lit(1)), F.col("b")[0]["key"])
    a_keys = F.filter(F.transform("a", lambda x: x["key"]), lambda k: (k != first) & (k != second))
    third = F.coalesce(F.try_element_at(a_keys, F.lit(1)), F.col("a")[0]["key"])
    picks = per.select("demand_id", F.explode(F.array(
        F.struct(F.lit(1).alias("plan_no"), F.lit("Maximum profit").alias("name"), first.alias("key")),
        F.struct(F.lit(2).alias("plan_no"), F.lit("Balanced").alias("name"), second.alias("key")),
        F.struct(F.lit(3).alias("plan_no"), F.lit("Fastest-moving").alias("name"), third.alias("key")))).alias("x"))
    picks = picks.select("demand_id", "x.plan_no", "x.name", "x.key")
    return picks.join(candidates, ["demand_id", "key"]).orderBy("demand_id", "plan_no")


def cheapest_pairs(stock: DataFrame, demands: DataFrame, k: int = 5) -> DataFrame:
    """Two-lot mixes with 3-dp quantities, strict low < t < high, exact stock limit; cheapest k."""
    d = demands.select("demand_id", "product", F.col("quantity").alias("dq"), F.col("target_fe").alias("t"))
    lo = stock.select("product", *[F.col(c).alias("l_" + c) for c in stock.columns if c != "product"])
    hi = stock.select("product", *[F.col(c).alias("h_" + c) for c in stock.columns if c != "product"])
    p = (d.join(lo, "product").where(F.col("l_fe") < F.col("t")).join(hi, "product").where(F.col("h_fe") > F.col("t")))
    lq = F.round(F.col("dq") * (F.col("h_fe") - F.col("t")) / (F.col("h_fe") - F.col("l_fe")), 3)
    hq = F.round(F.col("dq") - F.col("dq") * (F.col("h_fe") - F.col("t")) / (F.col("h_fe") - F.col("l_fe")), 3)
    p = p.withColumn("low_qty", lq).withColumn("high_qty", hq).where(
        (F.col("low_qty") <= F.col("l_quantity")) & (F.col("high_qty") <= F.col("h_quantity")))
    p = p.withColumn("blended_cost", F.round((F.col("low_qty") * F.col("l_landed_cost")
                                              + F.col("high_qty") * F.col("h_landed_cost")) / F.col("dq"), 2))
    w = Window.partitionBy("demand_id").orderBy("blended_cost", "l_lot", "h_lot")
    return p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "demand_id", "rank", F.col("l_lot").alias("low_lot"), F.col("h_lot").alias("high_lot"), "low_qty", "high_qty",
        F.col("l_fe").alias("low_fe"), F.col("h_fe").alias("high_fe"), "blended_cost")


def useful_lots(stock: DataFrame, k: int) -> DataFrame:
    """The lots of `stock(product, lot, quantity, fe, landed_cost)` that can be among the k cheapest of their product and
    grade for some needed quantity: fewer than k cheaper ones (ties by lot) hold as much.

    Each partition first reduces its own lots, so that a grade with most of the lots reaches its task reduced.  Rows
    without a lot, a positive quantity, a grade or a cost are left out."""
    cols = ["product", "lot", "quantity", "fe", "landed_cost"]
    s = stock.select(*cols).where((F.col("quantity") > 0) & F.col("fe").isNotNull() & F.col("landed_cost").isNotNull()
                                  & F.col("lot").isNotNull() & F.col("product").isNotNull())

    by = ["product", "fe"]

    def keep(pdf):
        import heapq
        pdf = pdf.sort_values([*by, "landed_cost", "lot"], kind="stable", ignore_index=True)
        first = pdf.groupby(by, sort=False).cumcount() < k  # the k cheapest of a grade always stay
        again = pdf[pdf.groupby(by, sort=False)["lot"].transform("size") > k]
        out = []
        for _, g in again.groupby(by, sort=False):
            most = list(g["quantity"][:k])  # the k largest quantities so far
            heapq.heapify(most)
            for i, q in zip(g.index[k:], g["quantity"][k:]):
                if q > most[0]:
                    heapq.heapreplace(most, q)
                    out.append(i)
        first.loc[out] = True
        return pdf[first]

    def each(batches):
        import pandas as pd
        held, waiting, rows = None, [], 0
        for pdf in batches:
            waiting.append(pdf)
            rows += len(pdf)
            if held is None or rows > len(held):  # so that what is held is sorted again only once it has doubled
                held, waiting, rows = keep(pd.concat([*([] if held is None else [held]), *waiting], ignore_index=True)), [], 0
        if held is not None:
            yield keep(pd.concat([held, *waiting], ignore_index=True)) if waiting else held

    return s.mapInPandas(each, s.schema).repartition(*by).mapInPandas(each, s.schema)


NEAR = 64  # lots of a side whose mixes bound the cost of a demand's k cheapest


def _mixed(pairs: DataFrame) -> DataFrame:
    """Pairs of a grade below and one above the target `t` with what a demand of `dq` takes of each."""
    lf, hf, t = (F.col(c).cast("double") for c in ("low_fe", "high_fe", "t"))
    share = F.try_divide(F.col("dq") * (hf - t), hf - lf)  # may run before the filters above
    return pairs.withColumn("low_qty", F.round(share, 3).cast("decimal(18,3)")).withColumn(
        "high_qty", F.round(F.col("dq") - share, 3).cast("decimal(18,3)"))


def _total() -> Column:
    return (F.col("low_qty") * F.col("low_cost") + F.col("high_qty") * F.col("high_cost")).cast("decimal(38,7)")


def _enough(lots: DataFrame, d: DataFrame, k: int) -> DataFrame:
    """(demand_id, enough): a total that k mixes of a demand do not exceed, from the mixes of the NEAR cheapest lots of each
    side that hold the whole demand; no row for a demand with fewer than k of them."""
    met = d.join(lots, "product").where((F.col("quantity") >= F.col("dq")) & (F.col("fe") != F.col("t")))
    w = Window.partitionBy("demand_id", F.col("fe") < F.col("t")).orderBy("landed_cost", "lot")
    near = met.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= NEAR)
    low = near.where(F.col("fe") < F.col("t")).select("demand_id", "dq", "t", F.col("fe").alias("low_fe"), F.col("landed_cost").alias("low_cost"),
                                                      F.col("quantity").alias("low_has"))
    high = near.where(F.col("fe") > F.col("t")).select("demand_id", F.col("fe").alias("high_fe"), F.col("landed_cost").alias("high_cost"),
                                                       F.col("quantity").alias("high_has"))
    mixes = _mixed(low.join(high, "demand_id")).where((F.col("low_qty") <= F.col("low_has")) & (F.col("high_qty") <= F.col("high_has")))
    return (mixes.withColumn("enough", _total()).withColumn("_r", F.row_number().over(Window.partitionBy("demand_id").orderBy("enough")))
            .where(F.col("_r") == k).select("demand_id", "enough"))


BANDS = 256  # bands of equal width into which a product's grades are cut


def _bands(grades: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`grades(product, fe, cost)` with the band of each, and the bands: their least and greatest grade and least cost."""
    fe = F.col("fe").cast("double")
    ends = grades.groupBy("product").agg(F.min(fe).alias("_least"), F.max(fe).alias("_most"))
    share = F.coalesce(F.try_divide(fe - F.col("_least"), F.col("_most") - F.col("_least")), F.lit(0.0))
    banded = grades.join(ends, "product").withColumn("band", F.floor(share * (BANDS - 1)).cast("int")).drop("_least", "_most")
    return banded, banded.groupBy("product", "band").agg(F.min(fe).alias("band_from"), F.max(fe).alias("band_to"),
                                                         F.min("cost").cast("double").alias("band_cost"))


def _may_do() -> Column:
    """Whether a grade below the target with some grade of a band above it may cost no more than `enough`.

    With the band's least cost a mix costs, per tonne, (low cost x (h - t) + band cost x (t - low grade)) / (h - low grade) for a
    high grade h: this only rises or only falls with h, so it is least at an end of the band.  The quantities that are
    taken are rounded to thousandths, which is allowed for."""
    low, t, cost, least = F.col("low_fe").cast("double"), F.col("t").cast("double"), F.col("low_cost").cast("double"), F.col("band_cost")
    at = lambda h: F.try_divide(cost * (h - t) + least * (t - low), h - low)
    total = F.col("dq") * F.least(at(F.greatest("band_from", t)), at(F.col("band_to")))
    enough = F.col("enough").cast("double")
    slack = 0.0006 * (F.abs(cost) + F.abs(least)) + 1e-6 * (1 + F.abs(enough))
    return F.coalesce((F.col("dq") <= 0) | (total - slack <= enough), F.lit(True))


def cheapest_pairs_by_grade(stock: DataFrame, demands: DataFrame, k: int = 5) -> DataFrame:
    """B4 and J6 over whole tables: each demand's k cheapest mixes of a lot below and a lot above its target grade.

    What a mix takes of its two lots depends on their grades only, so a demand meets the pairs of its product's grades,
    not of its lots.  For one pair of grades the k cheapest mixes are made of the k cheapest lots of either grade that
    hold enough, so each side is cut to k lots first and the k x k mixes are ranked.  A pair of grades is left out before it
    meets lots where even the cheapest lots of both cost more than k mixes that are known to do (`_enough`), and a grade meets
    only those bands of the other side's grades in which some mix might cost less (`_bands`).

    stock:   (product, lot, quantity, fe, landed_cost), decimals
    demands: (demand_id, product, quantity, target_fe)
    Output:  (demand_id, rank, low_lot, high_lot, low_qty, high_qty, low_fe, high_fe, blended_cost), by exact cost, then
    lots"""
    from ..session import checkpoint_dir
    checkpoint_dir(stock.sparkSession)
    lots = useful_lots(stock, k).checkpoint(eager=True)  # read five times below
    grades = lots.groupBy("product", "fe").agg(F.min("landed_cost").alias("cost"))
    d = demands.select("demand_id", "product", F.col("quantity").cast("double").alias("dq"), F.col("target_fe").alias("t"))
    of = lambda name: grades.select("product", F.col("fe").alias(f"{name}_fe"), F.col("cost").alias(f"{name}_cost"))
    bound = d.join(_enough(lots, d, k), "demand_id", "left")
    # A table of grades is small and its pairs are not: they are made in as many tasks as there are shuffle partitions.
    tasks = int(stock.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    banded, bands = _bands(grades)
    near = (bound.join(of("low"), "product").where(F.col("low_fe") < F.col("t")).repartition(tasks, "demand_id", "low_fe")
            .join(bands, "product").where(F.col("band_to") > F.col("t")).where(_may_do()).drop("band_from", "band_to", "band_cost"))
    high = banded.select("product", "band", F.col("fe").alias("high_fe"), F.col("cost").alias("high_cost"))
    pairs = near.join(high, ["product", "band"]).where(F.col("high_fe") > F.col("t")).drop("band")
    pairs = (_mixed(pairs).where(F.col("enough").isNull() | F.coalesce(_total() <= F.col("enough"), F.lit(True)))
             .drop("enough", "low_cost", "high_cost"))

    def side(name: str) -> DataFrame:
        """The k cheapest lots of one side that hold what each pair of grades takes of it."""
        of = lots.select("product", F.col("fe").alias(f"{name}_fe"), F.col("lot").alias(f"{name}_lot"), "quantity",
                         F.col("landed_cost").alias(f"{name}_cost"))
        met = pairs.join(of, ["product", f"{name}_fe"]).where(F.col("quantity") >= F.col(f"{name}_qty"))
        w = Window.partitionBy("demand_id", "low_fe", "high_fe").orderBy(f"{name}_cost", f"{name}_lot")
        return met.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r", "quantity")

    both = side("low").join(side("high").select("demand_id", "low_fe", "high_fe", "high_lot", "high_cost"), ["demand_id", "low_fe", "high_fe"])
    w = Window.partitionBy("demand_id").orderBy("total", "low_lot", "high_lot")
    best = both.withColumn("total", _total()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select("demand_id", "rank", "low_lot", "high_lot", "low_qty", "high_qty", "low_fe", "high_fe",
                       F.round(F.col("total").cast("double") / F.col("dq"), 2).alias("blended_cost"))


def achievable_range(stock: DataFrame) -> DataFrame:
    """Per product the lowest and highest grade in stock and the total quantity."""
    s = stock.where(F.col("quantity") > 0)
    return s.groupBy("product").agg(F.min("fe").alias("min_fe"), F.max("fe").alias("max_fe"),
                                    F.sum("quantity").alias("total_quantity"))


def assess_purchase(stock: DataFrame, purchases: DataFrame) -> DataFrame:
    """Lift each purchase to its target with the highest-grade lots first (greedy).

    Sorted by grade (highest first) and lot, a lot can add quantity * (grade - target) grade-tonnes.  Before[i] is what the
    lots before it add.  A purchase that needs R uses every lot with before[i] < R, all whole but the last: so its row
    in the sorted union of purchases (at R) and lots (at before[i]) only needs the last lot before it, with the sums of
    quantity and cost up to that lot.  Both the sums and the search go over slices of the order, so a product with
    most of the lots or purchases is split over many tasks, and no purchase meets more than one lot.

    stock:     (product, lot, quantity, fe, landed_cost)
    purchases: (purchase_id, product, grade, quantity, landed_cost, target_fe)
    Output: (purchase_id, feasible, high_quantity, total_quantity, blended_cost, lots_used)"""
    from ..operators.common import carried_forward, prefix_sums_before
    targets = purchases.select("product", "target_fe").distinct()
    q, above = F.col("quantity").cast("double"), (F.col("fe") - F.col("target_fe")).cast("double")
    s = stock.where(F.col("quantity") > 0).join(targets, "product").where(F.col("fe") > F.col("target_fe"))
    s = s.select("product", "target_fe", "fe", "lot", q.alias("lq"), above.alias("above"), F.col("landed_cost").cast("double").alias("lc"),
                 (q * above).alias("lift"), (q * F.col("landed_cost").cast("double")).alias("cost"), F.lit(1).alias("one"))
    s = prefix_sums_before(s, ["product", "target_fe"], [F.col("fe").desc(), "lot"],
                           {"before": "lift", "q_before": "lq", "cost_before": "cost", "n_before": "one"})
    lot = F.struct("before", "lift", "lq", "above", "lc", "q_before", "cost_before", "n_before")
    p = purchases.withColumn("required", q * (F.col("target_fe") - F.col("grade")).cast("double"))
    none = F.lit(None)
    both = p.select("product", "target_fe", F.col("required").alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("place"),
                    F.struct("purchase_id", "quantity", "landed_cost", "required").alias("row"),
                    none.cast(s.select(lot.alias("l")).schema["l"].dataType).alias("last"))
    lots = s.select("product", "target_fe", F.col("before").alias("at"), F.lit(1).alias("kind"), F.col("n_before").cast("bigint").alias("place"),
                    none.cast(both.schema["row"].dataType).alias("row"), lot.alias("last"))
    # at one place purchases come first: a lot is used only where something is still required before it
    found = carried_forward(both.unionByName(lots), ["product", "target_fe"], ["at", "kind", "place"], "last").where("kind = 0")
    take = F.least(F.col("last.lq"), (F.col("row.required") - F.col("last.before")) / F.col("last.above"))
    has = F.col("last").isNotNull() & (F.col("row.required") > 0)
    out = found.select(
        "row.*", F.when(has, F.col("last.q_before") + take).otherwise(0.0).alias("high_quantity"),
        F.when(has, F.col("last.cost_before") + take * F.col("last.lc")).otherwise(0.0).alias("high_cost"),
        F.when(has, F.col("last.n_before") + 1).otherwise(0).cast("bigint").alias("lots_used"),
        (F.col("row.required") - F.when(has, F.least(F.col("last.before") + F.col("last.lift"), F.col("row.required"))).otherwise(0.0)).alias("residual"))
    feasible = (F.col("required") <= 0) | (F.col("residual") <= float(RESIDUAL))
    total_q = F.col("quantity").cast("double") + F.col("high_quantity")
    return out.select(
        "purchase_id", feasible.alias("feasible"),
        F.when(feasible, F.round(F.col("high_quantity"), 2)).alias("high_quantity"),
        F.when(feasible, F.round(total_q, 2)).alias("total_quantity"),
        F.when(feasible, F.round((F.col("quantity").cast("double") * F.col("landed_cost").cast("double")
                                  + F.col("high_cost")) / F.nullif(total_q, F.lit(0.0)), 2)).alias("blended_cost"),
        "lots_used")
