"""Calculations and KPIs C1-C27 over marts and facts.

Top-k results use `orderBy().limit()` (a TakeOrderedAndProject: each task keeps
its own k best rows, the driver merges k x tasks rows).  Per-group "best row"
uses `max_by`, never a sort of the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import latest_by


def _dispatch_status(df: DataFrame) -> DataFrame:
    return df.withColumn("status", F.when(F.col("rows_missing_lot") > 0, "flagged").otherwise("verified"))


def highest_daily_dispatch(daily: DataFrame) -> DataFrame:
    """The single highest (date, customer) dispatch total; ties by date, customer."""
    top = daily.orderBy(F.col("dispatched_quantity_mt").desc(), "business_date", "customer", "customer_id").limit(1)
    return _dispatch_status(top)


def highest_daily_dispatch_per_customer(daily: DataFrame) -> DataFrame:
    """C3 for every customer at once: the highest dispatch day of each customer (earliest on ties)."""
    best = latest_by(daily.withColumn("_neg_date", -F.datediff("business_date", F.lit("1970-01-01"))),
                     ["customer_id"], ["dispatched_quantity_mt", "_neg_date"],
                     ["business_date", "customer", "dispatched_quantity_mt", "dispatch_count", "rows_missing_lot"])
    return _dispatch_status(best.select("business_date", "customer_id", "customer", "dispatched_quantity_mt",
                                        "dispatch_count", "rows_missing_lot"))


DEC3 = "decimal(18,3)"


def _r(c, places: int):
    """Half-away-from-zero rounding of a decimal column."""
    return F.round(c, places)


def stock_position(v3: DataFrame) -> DataFrame:
    """Per category position plus covered stock value (cost-covered quantity x weighted cost)."""
    value = _r(F.col("cost_covered_quantity_mt") * F.coalesce(F.col("weighted_landed_cost_inr_per_mt"), F.lit(0)), 2)
    return v3.select("category", "total_quantity_mt", "quality_covered_quantity_mt", "weighted_fe_pct",
                     "cost_covered_quantity_mt", "weighted_landed_cost_inr_per_mt",
                     value.cast("decimal(20,2)").alias("stock_value"), "status")


def stock_position_with_all(c1: DataFrame) -> DataFrame:
    """An 'all' row re-weighted from the (rounded) category rows, unioned with them.

    verified only if every category is, incomplete if any is, else flagged."""
    from .common import ratio
    qq = F.coalesce(F.col("quality_covered_quantity_mt"), F.lit(0))
    cq = F.coalesce(F.col("cost_covered_quantity_mt"), F.lit(0))
    tot = c1.agg(
        F.sum("total_quantity_mt").alias("t"), F.sum(qq).alias("qq"), F.sum(cq).alias("cq"),
        F.sum(qq * F.coalesce(F.col("weighted_fe_pct"), F.lit(0))).alias("fe_num"),
        F.sum(cq * F.coalesce(F.col("weighted_landed_cost_inr_per_mt"), F.lit(0))).alias("cost_num"),
        F.bool_and(F.col("status") == "verified").alias("all_ok"),
        F.bool_or(F.col("status") == "incomplete").alias("any_incomplete"))
    all_row = tot.select(
        F.lit("all").alias("category"), F.col("t").cast(DEC3).alias("total_quantity_mt"),
        F.col("qq").cast(DEC3).alias("quality_covered_quantity_mt"),
        ratio(F.col("fe_num"), F.col("qq"), "decimal(12,5)").alias("weighted_fe_pct"),
        F.col("cq").cast(DEC3).alias("cost_covered_quantity_mt"),
        ratio(F.col("cost_num"), F.col("cq"), "decimal(18,4)").alias("weighted_landed_cost_inr_per_mt"),
        _r(F.col("cost_num"), 2).cast("decimal(20,2)").alias("stock_value"),
        F.when(F.col("all_ok"), "verified").when(F.col("any_incomplete"), "incomplete").otherwise("flagged")
        .alias("status"))
    return all_row.unionByName(c1)


def top_deviations(v6: DataFrame, k: int = 30) -> DataFrame:
    """Largest absolute grade deviations (ties broken on every remaining column)."""
    return v6.orderBy(F.abs("deviation_fe_points").desc(), "comparison", "actual_source_row_id",
                      "expected_source_row_id", "house_lot_number", "expected_fe_pct", "actual_fe_pct").limit(k)


def dispatch_quality_coverage(dispatches: DataFrame, samples: DataFrame) -> DataFrame:
    """Dispatch rows and rows with a dispatch grade (one row)."""
    ds = samples.where(F.col("sample_stage") == "dispatch").select("dispatch_id", "fe_pct")
    j = dispatches.select("dispatch_id").join(ds, "dispatch_id", "left")
    return j.agg(F.count(F.lit(1)).alias("dispatch_rows"), F.count("fe_pct").alias("rows_with_fe"))


def top_rules(issues: DataFrame, k: int = 12) -> DataFrame:
    """The most frequent rule codes among open issues."""
    return issues.groupBy("rule_code").agg(F.count(F.lit(1)).alias("issue_count")) \
        .orderBy(F.col("issue_count").desc(), "rule_code").limit(k)


# --- fixed value: rules that say a movement is not linked to a lot --------------------------
LOT_LINK_RULES = ("MISSING_DISPATCH_LOT", "MISSING_PRODUCTION_LOT", "UNMAPPED_LOT")
# ----------------------------------------------------------------------------------------------


def quality_status(issues: DataFrame) -> DataFrame:
    """One row: readiness (incomplete while data is missing, else flagged while any issue is open, else verified), the
    open issues, and those of each lot-linkage rule with their sum."""
    from .checks import trust_class
    trust = trust_class(F.col("rule_code"), F.col("severity"))
    of = lambda rule: F.count_if(F.col("rule_code") == rule).alias(rule.lower())
    return issues.agg(
        F.when(F.count_if(trust == "incomplete") > 0, "incomplete").when(F.count(F.lit(1)) > 0, "flagged")
        .otherwise("verified").alias("readiness"),
        F.count(F.lit(1)).alias("open_issues"), *[of(r) for r in LOT_LINK_RULES],
        F.count_if(F.col("rule_code").isin(*LOT_LINK_RULES)).alias("lot_linkage"))


def lead_time_by_customer(dispatches: DataFrame, orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Average days from PO to dispatch per customer, excluding dispatches dated before the PO."""
    j = dispatches.join(orders.select("sales_order_line_id", "po_date"), "sales_order_line_id", "inner") \
        .where(F.col("dispatch_on") >= F.col("po_date"))
    per = j.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("dispatch_count"),
        F.sum(F.datediff("dispatch_on", "po_date")).alias("_days"))
    names = customers.select("customer_id", F.col("legal_name").alias("customer"))
    return per.join(names, "customer_id").select(
        "customer_id", "customer", "dispatch_count",
        _r(F.col("_days").cast("decimal(38,0)") / F.col("dispatch_count"), 1).cast("decimal(12,1)")
        .alias("avg_days_order_to_dispatch"))


def top_buyer_in_period(dispatches: DataFrame, customers: DataFrame, start: str, end: str) -> DataFrame:
    """The buyer with the highest dispatched quantity between two dates (inclusive)."""
    per = dispatches.where(F.col("dispatch_on").between(F.lit(start).cast("date"), F.lit(end).cast("date"))) \
        .groupBy("customer_id").agg(F.sum("quantity_mt").cast(DEC3).alias("dispatched_quantity_mt"),
                                    F.count(F.lit(1)).alias("dispatch_count"))
    names = customers.select("customer_id", F.col("legal_name").alias("customer"))
    return per.join(names, "customer_id").orderBy(F.col("dispatched_quantity_mt").desc(), "customer_id").limit(1)


def transporter_ranking(work_orders: DataFrame) -> DataFrame:
    """C25 (+ C11): per transporter assigned quantity, work orders and mean rate of rated orders."""
    from ..functions import clean
    rate = clean.number("rate_text")
    return work_orders.groupBy("transporter").agg(
        F.sum("awarded_quantity_mt").cast(DEC3).alias("assigned_quantity_mt"),
        F.count(F.lit(1)).alias("work_orders"),
        F.count(rate).alias("rated_orders"),
        F.round(F.avg(rate), 2).alias("average_rate"))


def customer_activity_totals(v5: DataFrame) -> DataFrame:
    """Per customer the totals of each metric as columns, plus the month range."""
    piv = v5.groupBy("customer_id", "customer").pivot("metric", ["ordered", "dispatched", "external_allocated"]) \
        .agg(F.sum("quantity_mt").cast(DEC3))
    rng = v5.groupBy("customer_id").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"))
    return piv.join(rng, "customer_id")


# --- fixed value: what activity without auction allocations must not be read as -------------
NO_EXTERNAL_DATA = "External purchase awards are not available: orders and dispatches are not total market purchases."
# ----------------------------------------------------------------------------------------------


def customer_activity_in_range(v5: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Per customer and metric the total of the months from `start` to `end` (yyyy-MM, both included; none: open), the
    number of months, and the limitation that holds when no customer at all has external allocations."""
    month = F.date_format("month", "yyyy-MM")
    rows = v5
    if start:
        rows = rows.where(month >= start)
    if end:
        rows = rows.where(month <= end)
    external = v5.agg(F.coalesce(F.bool_or(F.col("metric") == "external_allocated"), F.lit(False)).alias("x")).scalar()
    return (rows.groupBy("customer_id", "customer", "metric")
            .agg(F.sum("quantity_mt").cast(DEC3).alias("total_mt"), F.count_distinct("month").alias("months"))
            .withColumn("limitation", F.when(~external, F.lit(NO_EXTERNAL_DATA))))


def monthly_ordered_vs_dispatched(v5: DataFrame, fy_start_year: int) -> DataFrame:
    """Month-wise ordered vs dispatched for the financial year starting April `fy_start_year`."""
    from ..functions import clean
    m = v5.where(clean.financial_year("month") == fy_start_year)
    return m.groupBy("month").pivot("metric", ["ordered", "dispatched"]).agg(F.sum("quantity_mt").cast(DEC3))


def overview(positions: DataFrame, purchases: DataFrame, orders: DataFrame, v7: DataFrame, customers: DataFrame,
             auctions: DataFrame) -> DataFrame:
    """One row of overview KPIs."""
    stock = positions.agg(F.sum("available_quantity_mt").cast(DEC3).alias("current_stock"),
                          F.count(F.lit(1)).alias("stock_lots"),
                          F.round(F.sum(F.col("available_quantity_mt")
                                        * F.coalesce(F.col("landed_cost_inr_per_mt"), F.lit(0))), 2)
                          .cast("decimal(24,2)").alias("stock_value"))
    pend_in = purchases.where(F.col("reported_balance_to_lift_mt") > 0.1).agg(
        F.sum("reported_balance_to_lift_mt").cast(DEC3).alias("pending_inward"),
        F.count(F.lit(1)).alias("pending_purchase_lots"))
    bal = F.col("ordered_quantity_mt") - F.coalesce(F.col("reported_dispatched_quantity_mt"), F.lit(0))
    pend_out = orders.where(bal > 0.1).agg(F.sum(bal).cast(DEC3).alias("pending_dispatch"),
                                          F.count(F.lit(1)).alias("pending_orders"))
    prod = v7.agg(F.sum("feed_quantity_mt").cast(DEC3).alias("total_feed"),
                  F.sum("recovered_quantity_mt").alias("_rec"))
    prod = prod.select("total_feed", F.when(F.col("total_feed") > 0, F.round(
        (F.col("_rec") * 100).cast("double") / F.col("total_feed").cast("double"), 1)).otherwise(0.0).alias("recovery_pct"))
    buyers = customers.agg(F.count(F.lit(1)).alias("buyer_count"))
    auc = auctions.agg(F.count(F.lit(1)).alias("auction_lots"))
    # One-row aggregates combined as scalar subqueries (no join of any kind).
    cols = [F.col(c) for c in stock.columns]
    for one in (pend_in, pend_out, prod, buyers, auc):
        cols += [one.select(c).scalar().alias(c) for c in one.columns]
    return stock.select(*cols)


def supplier_quality(sample_lines: DataFrame) -> DataFrame:
    """Per supplier records, mean received-minus-indicative grade, share below indicative."""
    d = (F.col("fe_raw") - F.col("indicative_fe_raw"))
    rows = sample_lines.where((F.col("l_linestatus") == "O") & F.col("fe_raw").between(0, 100)
                              & F.col("indicative_fe_raw").between(0, 100))
    return rows.groupBy("supplier_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.round(F.avg(d), 2).cast("decimal(12,2)").alias("average_difference"),
        F.round(F.avg(F.when(d < 0, 1).otherwise(0)) * 100, 1).cast("decimal(6,1)").alias("below_share"),
        F.count_if(d < -1).alias("severe_variance"))


def _valid_auctions(auctions: DataFrame) -> DataFrame:
    """C17: offers with a price and a grade that are neither null nor zero."""
    return auctions.where((F.col("current_price") != 0) & (F.col("fe_pct") != 0))


def auction_summary(auctions: DataFrame, min_grade, k: int = 12) -> DataFrame:
    """C17: opportunity screen: valid, of at least the grade, with quantity unsold; the k lowest landed prices."""
    balance = F.when(F.col("sold"), F.lit(0)).otherwise(F.col("offered_quantity_mt")).cast(DEC3)
    return (_valid_auctions(auctions).withColumn("balance_mt", balance)
            .where((F.col("fe_pct") >= min_grade) & (F.col("balance_mt") > 0))
            .orderBy(F.col("landed_price").asc_nulls_last(), "auction_lot_id").limit(k)
            .select("auction_lot_id", "lot_id", "mine", "fe_pct", "balance_mt", "current_price", "landed_price", "premium_pct"))


def auction_overview(auctions: DataFrame, min_grade, k: int = 12) -> DataFrame:
    """C17: valid offers, their mines, the mean recorded premium (none counts as zero), and the unsold quantity of the
    k offers of `auction_summary`."""
    from .common import ratio
    valid = _valid_auctions(auctions).agg(
        F.count(F.lit(1)).alias("lots"), F.count_distinct("mine").alias("mines"),
        F.sum(F.coalesce("premium_pct", F.lit(0))).alias("premiums"))
    unsold = auction_summary(auctions, min_grade, k).agg(F.sum("balance_mt").cast(DEC3).alias("unsold"))
    return valid.select("lots", "mines", F.coalesce(ratio(F.col("premiums"), F.col("lots"), "decimal(12,2)"), F.lit(0).cast("decimal(12,2)"))
                        .alias("mean_premium_pct"),
                        F.coalesce(unsold.scalar(), F.lit(0)).cast(DEC3).alias("opportunity_mt"))


def mean_price_by_mine(auctions: DataFrame, k: int = 7) -> DataFrame:
    """C17: mean current price by mine, top k."""
    valid = auctions.where((F.col("current_price") != 0) & (F.col("fe_pct") != 0))
    return (valid.groupBy("mine").agg(F.count(F.lit(1)).alias("lots"),
                                      F.round(F.avg("current_price"), 2).cast("decimal(18,2)").alias("mean_price"),
                                      F.round(F.avg(F.col("current_price") - F.col("opening_price")), 2)
                                      .cast("decimal(18,2)").alias("mean_premium"))
            .orderBy(F.col("mean_price").desc(), "mine").limit(k))


def customer_ranking(orders: DataFrame, dispatches: DataFrame, customers: DataFrame, k: int = 12) -> DataFrame:
    """C20: customers by ordered quantity, with completion % and realised value (dispatched x rate)."""
    d = dispatches.groupBy("sales_order_line_id").agg(F.sum("quantity_mt").alias("_d"))
    o = orders.join(d, "sales_order_line_id", "left").withColumn("_d", F.coalesce(F.col("_d"), F.lit(0)))
    per = o.groupBy("customer_id").agg(
        F.sum("ordered_quantity_mt").cast(DEC3).alias("ordered_mt"),
        F.sum("_d").cast(DEC3).alias("dispatched_mt"),
        F.round(F.sum(F.col("_d") * F.col("selling_rate_inr_per_mt")), 2).cast("decimal(24,2)").alias("realised_value"))
    names = customers.select("customer_id", F.col("legal_name").alias("customer"))
    from .common import ratio
    return (per.join(names, "customer_id")
            .withColumn("completion_pct", ratio(F.col("dispatched_mt") * 100, F.col("ordered_mt"), "decimal(12,1)"))
            .orderBy(F.col("ordered_mt").desc(), "customer_id").limit(k))


def buyers_by_type(customers: DataFrame, k: int = 8) -> DataFrame:
    """C20: buyer counts by type, top k."""
    return customers.groupBy("buyer_type").agg(F.count(F.lit(1)).alias("buyers")) \
        .orderBy(F.col("buyers").desc(), "buyer_type").limit(k)


def asp_levies(purchases: DataFrame, auctions: DataFrame) -> DataFrame:
    """Royalty 15 % of the last average sale price (ASP) declared before the purchase date,
    DMF 30 % and NMET 3 % of the royalty.

    A month's ASP is declared when the month is over, so a purchase takes the last month with sales before its own.
    The monthly series is filled forward (each month's ASP serves the months up to the next declared one), which makes
    the as-of lookup an equi-join on the purchase's month with one match."""
    asp = auctions.groupBy(F.trunc("closes_on", "MM").alias("asp_month")).agg(
        F.round(F.avg("current_price"), 4).cast("decimal(18,4)").alias("asp"))
    month = F.trunc("purchase_date", "MM")
    last = purchases.agg(F.max(month)).scalar()
    first_served = F.add_months("asp_month", 1)
    until = F.coalesce(F.lead("asp_month").over(Window.orderBy("asp_month")), F.greatest(first_served, last))  # one row a month
    asp = asp.where(F.col("asp_month").isNotNull()).withColumn("until", until)
    asp = asp.withColumn("month", F.explode(F.sequence(first_served, "until", F.expr("INTERVAL 1 MONTH")))).drop("until")
    j = purchases.withColumn("month", month).join(asp, "month", "left")
    royalty = (F.col("asp") * F.lit(__import__("decimal").Decimal("0.15"))).cast("decimal(18,4)")
    return j.select("supplier_id", "lot_id", "purchase_date", "asp_month", "asp",
                    royalty.alias("royalty"),
                    (royalty * F.lit(__import__("decimal").Decimal("0.30"))).cast("decimal(18,4)").alias("dmf"),
                    (royalty * F.lit(__import__("decimal").Decimal("0.03"))).cast("decimal(18,4)").alias("nmet"))


def quality_kpis(sample_lines: DataFrame) -> DataFrame:
    """Quality records, mean received grade, records below indicative and severe (< -1)."""
    rows = sample_lines.where(F.col("l_linestatus") == "O")
    fe = F.when(F.col("fe_raw").between(0, 100), F.col("fe_raw"))
    ind = F.when(F.col("indicative_fe_raw").between(0, 100), F.col("indicative_fe_raw"))
    diff = fe - ind
    return rows.agg(F.count(F.lit(1)).alias("records"),
                    F.round(F.avg(fe), 2).cast("decimal(12,2)").alias("average_fe"),
                    F.count_if(diff < 0).alias("below_indicative"),
                    F.count_if(diff < -1).alias("severe_variance"))


def stock_by_product(positions: DataFrame, k: int = 5) -> DataFrame:
    """Stock quantity by product (category), top k."""
    return (positions.groupBy(F.col("category").alias("product"))
            .agg(F.sum("available_quantity_mt").cast(DEC3).alias("quantity_mt"), F.count(F.lit(1)).alias("lots"))
            .orderBy(F.col("quantity_mt").desc(), "product").limit(k))


def stock_by_status(positions: DataFrame) -> DataFrame:
    """Stock by quality/cost status."""
    return positions.groupBy("quality_status", "cost_status").agg(
        F.sum("available_quantity_mt").cast(DEC3).alias("quantity_mt"), F.count(F.lit(1)).alias("lots"))


def available_permits(dispatches: DataFrame, permits: DataFrame) -> DataFrame:
    """The permitted quantity of each order: the sum over the distinct permits that its dispatches name."""
    # One row of each pair by a sort that can spill, not by two hash tables of all pairs that a task holds at once.
    pair = ["sales_order_line_id", "permit_id"]
    named = (dispatches.select("sales_order_line_id", F.col("permit_supplier_id").alias("permit_id"))
             .withColumn("_n", F.row_number().over(Window.partitionBy(*pair).orderBy(*pair))).where(F.col("_n") == 1).select(*pair))
    return (named.join(permits.select("permit_id", "permitted_quantity_mt"), "permit_id")
            .groupBy("sales_order_line_id").agg(F.sum("permitted_quantity_mt").cast(DEC3).alias("available_permit_mt")))


def _open_orders(orders: DataFrame, dispatches: DataFrame, permits: DataFrame, above) -> DataFrame:
    """Orders whose balance is larger than `above`, with available_permit_mt (no permit: 0) and permit_ready."""
    bal = (F.col("ordered_quantity_mt") - F.coalesce(F.col("reported_dispatched_quantity_mt"), F.lit(0))).cast(DEC3)
    o = orders.withColumn("balance_mt", bal).where(F.col("balance_mt") > above)
    permit = F.coalesce("available_permit_mt", F.lit(0)).cast(DEC3)
    return (o.join(available_permits(dispatches, permits), "sales_order_line_id", "left")
            .withColumn("available_permit_mt", permit).withColumn("permit_ready", permit >= F.col("balance_mt")))


def open_commitments(orders: DataFrame, dispatches: DataFrame, permits: DataFrame, k: int = 5) -> DataFrame:
    """C14: the k largest open balances; an order is permit-ready when its permits cover the balance.

    Permits are looked up for the k orders only."""
    bal = (F.col("ordered_quantity_mt") - F.coalesce(F.col("reported_dispatched_quantity_mt"), F.lit(0))).cast(DEC3)
    top = orders.where(bal > 0).orderBy(bal.desc(), "sales_order_line_id").limit(k)
    theirs = dispatches.join(F.broadcast(top.select("sales_order_line_id")), "sales_order_line_id", "left_semi")
    return _open_orders(top, theirs, permits, 0).select(
        "sales_order_line_id", "customer_id", "po_date", "balance_mt", "available_permit_mt", "permit_ready",
        _r(F.col("balance_mt") * F.col("selling_rate_inr_per_mt"), 2).cast("decimal(24,2)").alias("revenue_waiting"))


def _pending_inward(purchases: DataFrame, lots: DataFrame, as_of: str) -> tuple[DataFrame, list]:
    """Purchases with quantity left to lift, at their lot's landed rate (none: 0), and the measures over them."""
    p = purchases.where(F.col("reported_balance_to_lift_mt") > 0.1).join(lots.select("lot_id", "lot_landed_cost"), "lot_id", "left")
    aged = F.datediff(F.lit(as_of).cast("date"), F.col("purchase_date")) > 90
    balance, permit = F.col("reported_balance_to_lift_mt"), F.col("reported_permit_balance_mt")
    return p, [F.sum(balance).cast(DEC3).alias("pending_mt"), F.count(F.lit(1)).alias("pending_lots"),
               F.round(F.sum(balance * F.coalesce("lot_landed_cost", F.lit(0))), 2).cast("decimal(24,2)").alias("pending_value"),
               F.count_if(aged).alias("aged_over_90_days"),
               F.coalesce(F.sum(F.when(aged, balance)), F.lit(0)).cast(DEC3).alias("aged_mt"),
               F.count_if(F.coalesce(permit, F.lit(0)) == 0).alias("permit_gaps")]


def inward_exposure(purchases: DataFrame, suppliers: DataFrame, lots: DataFrame, as_of: str) -> DataFrame:
    """Of every supplier the pending inward quantity and value, the part older than 90 days and the lots without a
    permit balance."""
    p, measures = _pending_inward(purchases, lots, as_of)
    names = suppliers.select("supplier_id", F.col("legal_name").alias("supplier"))
    return p.groupBy("supplier_id").agg(*measures).join(names, "supplier_id")


def inward_summary(purchases: DataFrame, lots: DataFrame, as_of: str) -> DataFrame:
    """The same measures over all suppliers (one row; sums over no lots are null)."""
    p, measures = _pending_inward(purchases, lots, as_of)
    return p.agg(*measures)


def quality_concerns(v6: DataFrame, k: int = 30) -> DataFrame:
    """Inward grade deviations below -1 point, worst first (top k)."""
    return (v6.where((F.col("comparison") == "inbound_vs_indicative") & (F.col("deviation_fe_points") < -1))
            .orderBy("deviation_fe_points", "actual_source_row_id", "expected_source_row_id", "house_lot_number")
            .limit(k))


def production_summary(v7: DataFrame, runs: DataFrame) -> DataFrame:
    """Feed, recovered and tailings totals, recovery % per material (process)."""
    j = v7.select("production_run_id", "feed_quantity_mt", "recovered_quantity_mt", "tailings_quantity_mt") \
        .join(runs.select("production_run_id", "source_material_name"), "production_run_id")
    from .common import ratio
    return j.groupBy("source_material_name").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("feed_quantity_mt").cast(DEC3).alias("feed_mt"),
        F.sum("recovered_quantity_mt").cast(DEC3).alias("recovered_mt"),
        F.sum("tailings_quantity_mt").cast(DEC3).alias("tailings_mt")).withColumn(
        "recovery_pct", ratio(F.col("recovered_mt") * 100, F.col("feed_mt"), "decimal(12,1)"))


def latest_runs(v7: DataFrame, k: int = 20) -> DataFrame:
    """The k latest production runs."""
    return v7.orderBy(F.col("run_date").desc(), F.col("production_run_id").desc()).limit(k)


def resolve_names(queries: DataFrame, names: DataFrame, max_candidates: int = 10) -> DataFrame:
    """C4: exact normalised match, else a unique case-insensitive substring match, else ambiguous
    with up to `max_candidates` candidates (or not found).

    queries: (query_id, text) - a handful of user-typed names; names: (name).  The substring
    test runs as a join of the queries against the names (queries are few and small)."""
    from ..functions import clean
    q = queries.select("query_id", "text", clean.normalized("text").alias("qk"), F.lower("text").alias("ql"))
    n = names.select("name", clean.normalized("name").alias("nk"), F.lower("name").alias("nl")).distinct()
    exact = q.join(n, q.qk == n.nk).groupBy("query_id").agg(F.min("name").alias("exact"))
    contains = q.join(n, n.nl.contains(q.ql)).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.slice(F.array_sort(F.collect_list("name")), 1, max_candidates).alias("candidates"))
    j = q.select("query_id", "text").join(exact, "query_id", "left").join(contains, "query_id", "left")
    resolved = F.coalesce(F.col("exact"), F.when(F.col("n_candidates") == 1, F.col("candidates")[0]))
    return j.select("query_id", "text", resolved.alias("resolved"),
                    F.when(resolved.isNotNull(), "resolved").when(F.col("n_candidates") > 1, "ambiguous")
                    .otherwise("not_found").alias("status"),
                    F.when(resolved.isNull(), F.coalesce("candidates", F.array().cast("array<string>")))
                    .alias("candidates"))


def closing_stock_rollforward(movements: DataFrame) -> DataFrame:
    """Daily closing stock per lot = previous closing + inward - outward (running sum over days).

    Daily net movements are aggregated first; the running sum is a range-partitioned prefix sum,
    so a lot with most of the history is spread over many tasks."""
    from .common import prefix_sum_before
    daily = movements.groupBy("lot_id", F.col("occurred_on").alias("business_date")).agg(
        F.sum(F.when(F.col("direction") == "in", F.col("quantity_mt")).otherwise(0)).cast(DEC3).alias("inward_mt"),
        F.sum(F.when(F.col("direction") != "in", F.col("quantity_mt")).otherwise(0)).cast(DEC3).alias("outward_mt"))
    daily = daily.withColumn("net_mt", (F.col("inward_mt") - F.col("outward_mt")).cast(DEC3))
    rolled = prefix_sum_before(daily, ["lot_id"], ["business_date"], "net_mt", "opening_mt")
    return rolled.select("lot_id", "business_date", F.col("opening_mt").cast(DEC3).alias("opening_mt"),
                         "inward_mt", "outward_mt", (F.col("opening_mt") + F.col("net_mt")).cast(DEC3).alias("closing_mt"))


def old_stock(positions: DataFrame, movements: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Lots in the latest snapshot whose last inward movement is more than `days` days before `as_of`."""
    last_in = movements.where(F.col("direction") == "in").groupBy("lot_id").agg(
        F.max("occurred_on").alias("last_inward_on"))
    j = positions.select("lot_id", "category", "available_quantity_mt").join(last_in, "lot_id", "left")
    age = F.datediff(F.lit(as_of).cast("date"), F.col("last_inward_on"))
    return j.where(F.col("last_inward_on").isNull() | (age > days)).select(
        "lot_id", "category", "available_quantity_mt", "last_inward_on", age.alias("age_days"))


def transporter_summary(work_orders: DataFrame) -> DataFrame:
    """C11: per transporter the number of work orders and the mean rate of the rated ones.

    Status is always incomplete: the work-order sheet carries no delivery dates."""
    from ..functions import clean
    rate = clean.number("rate_text")
    return work_orders.groupBy("transporter").agg(
        F.count(F.lit(1)).alias("work_orders"),
        F.round(F.avg(rate), 2).alias("average_rate")).withColumn(
        "status", F.lit("incomplete: delivery dates are not present"))


def sales_summary(orders: DataFrame, dispatches: DataFrame, permits: DataFrame) -> DataFrame:
    """Pending orders (balance > 0.1), their balance, the revenue waiting (balance x rate), the permits still needed
    (sum of balance less permit, where positive) and the orders whose permits cover their balance."""
    gap = F.greatest(F.col("balance_mt") - F.col("available_permit_mt"), F.lit(0).cast(DEC3))
    return _open_orders(orders, dispatches, permits, 0.1).agg(
        F.count(F.lit(1)).alias("pending_orders"), F.sum("balance_mt").cast(DEC3).alias("pending_mt"),
        F.round(F.sum(F.col("balance_mt") * F.col("selling_rate_inr_per_mt")), 2).cast("decimal(24,2)").alias("revenue_waiting"),
        F.sum(gap).cast(DEC3).alias("permits_needed_mt"), F.count_if("permit_ready").alias("permit_ready_orders"))


# --- fixed value from the rule text: typical loading charge, Rs per MT ----------------------
LOADING_CHARGE = "50"
# ----------------------------------------------------------------------------------------------


def pending_payment(levies: DataFrame, purchases: DataFrame, lots: DataFrame) -> DataFrame:
    """Pending payment per purchase = quantity x (purchase price + royalty + DMF + NMET + loading)."""
    from decimal import Decimal
    rate = lots.select("lot_id", F.col("lot_landed_cost").alias("purchase_rate"))
    j = (levies.join(purchases.select("supplier_id", "lot_id", "purchased_quantity_mt"), ["supplier_id", "lot_id"])
         .join(rate, "lot_id"))
    per_t = (F.col("purchase_rate") + F.coalesce("royalty", F.lit(0)) + F.coalesce("dmf", F.lit(0))
             + F.coalesce("nmet", F.lit(0)) + F.lit(Decimal(LOADING_CHARGE)))
    return j.select("supplier_id", "lot_id", "purchase_date", per_t.cast("decimal(18,4)").alias("payable_per_mt"),
                    F.round(F.col("purchased_quantity_mt") * per_t, 2).cast("decimal(24,2)").alias("pending_payment"))
