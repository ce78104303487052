"""Analytics marts V1-V11.

Each mart is a function of canonical DataFrames.  Aggregations run before joins
(pre-aggregate, then join the small result), "latest row" selections use
`max_by` aggregates with partial aggregation, and "latest snapshot" is a
scalar-subquery filter (no join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import latest_by, ratio, scalar_max, signed_quantity

DEC3 = "decimal(18,3)"


def current_lot_inventory(lots: DataFrame, movements: DataFrame) -> DataFrame:
    """V1: per lot signed movement sum (0 if none), count, last movement, latest source row."""
    per_lot = movements.groupBy("lot_id").agg(
        F.sum(signed_quantity()).alias("_q"),
        F.count(F.lit(1)).alias("_n"),
        F.max("occurred_on").alias("last_movement_on"),
        F.max("source_row_id").alias("latest_source_row_id"))
    return lots.join(per_lot, "lot_id", "left").select(
        "lot_id", "house_lot_number", "material_code", "category", "size_spec",
        F.coalesce(F.col("_q"), F.lit(0)).cast(DEC3).alias("physical_quantity_mt"),
        F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("movement_count"),
        "last_movement_on", "latest_source_row_id")


def lot_availability(inventory: DataFrame, allocations: DataFrame) -> DataFrame:
    """V2: V1 minus active reservations."""
    reserved = (allocations.where(F.col("reservation_state") == "active")
                .groupBy("lot_id").agg(F.sum("selected_quantity_mt").cast(DEC3).alias("_r")))
    r = F.coalesce(F.col("_r"), F.lit(0).cast(DEC3))
    return inventory.join(reserved, "lot_id", "left").select(
        *inventory.columns,
        r.cast(DEC3).alias("reserved_quantity_mt"),
        (F.col("physical_quantity_mt") - r).cast(DEC3).alias("available_quantity_mt")).drop("_r")


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Rows of the latest snapshot date (a scalar subquery filter)."""
    latest = scalar_max(snapshots, "snapshot_on", "_latest").scalar()
    return snapshots.where(F.col("snapshot_on") == latest)


def latest_quality(samples: DataFrame) -> DataFrame:
    """Per lot: approved first, then newest sample (ties broken on every remaining column)."""
    s = samples.where(F.col("lot_id").isNotNull() & F.col("fe_pct").isNotNull())
    return latest_by(s, ["lot_id"], ["approved", "sample_on", "source_row_id", "sample_stage", "fe_pct"],
                     ["fe_pct", "approved", "source_row_id"])


def lot_costs(components: DataFrame) -> DataFrame:
    """Latest rate per (lot, component), then landed cost and its status per lot."""
    latest = latest_by(components.where(F.col("rate_inr_per_mt").isNotNull()),
                       ["lot_id", "component_code"],
                       ["effective_on", "component_id", "rate_inr_per_mt", "approval_status",
                        "included_in_landed_cost"],
                       ["rate_inr_per_mt", "included_in_landed_cost", "approval_status"])
    approved = F.col("included_in_landed_cost") & (F.col("approval_status") == "approved")
    reported = F.col("component_code") == "REPORTED_LANDED_COST"
    return latest.groupBy("lot_id").agg(
        F.coalesce(F.sum(F.when(approved, F.col("rate_inr_per_mt"))),
                   F.max(F.when(reported, F.col("rate_inr_per_mt")))).alias("landed_cost_inr_per_mt"),
        F.when(F.count_if(approved) > 0, "approved")
        .when(F.count_if(reported) > 0, "reported").otherwise("missing").alias("cost_status"))


def lot_positions(snapshots: DataFrame, lots: DataFrame, samples: DataFrame, components: DataFrame) -> DataFrame:
    """Per lot in the latest snapshot with quantity > 0: grade and cost with their status."""
    ls = latest_snapshot(snapshots).where(F.col("recorded_quantity_mt") > 0)
    lq = latest_quality(samples).select("lot_id", F.col("fe_pct").alias("_lq_fe"),
                                        F.col("approved").alias("_lq_approved"))
    c = lot_costs(components)
    j = (ls.join(lots.select("lot_id", "category"), "lot_id", "inner")
         .join(lq, "lot_id", "left").join(c, "lot_id", "left"))
    return j.select(
        "lot_id", "category",
        F.col("recorded_quantity_mt").alias("available_quantity_mt"),
        F.coalesce("_lq_fe", "reported_fe_pct").alias("fe_pct"),
        F.when(F.col("_lq_approved"), "approved")
        .when(F.col("reported_fe_pct").isNotNull(), "reported").otherwise("missing").alias("quality_status"),
        F.coalesce("landed_cost_inr_per_mt", "reported_landed_cost_inr_per_mt").alias("landed_cost_inr_per_mt"),
        F.coalesce(F.col("cost_status"),
                   F.when(F.col("reported_landed_cost_inr_per_mt").isNull(), "missing").otherwise("reported"))
        .alias("cost_status"),
        "source_row_id")


def stock_quality_cost(positions: DataFrame) -> DataFrame:
    """V3: per category quantity, covered quantities, weighted grade and cost, trust status."""
    q = F.col("available_quantity_mt")
    fe = F.col("fe_pct")
    cost = F.col("landed_cost_inr_per_mt")
    fe_q = F.sum(F.when(fe.isNotNull(), q))
    cost_q = F.sum(F.when(cost.isNotNull(), q))
    return positions.groupBy("category").agg(
        F.sum(q).cast(DEC3).alias("total_quantity_mt"),
        fe_q.cast(DEC3).alias("quality_covered_quantity_mt"),
        ratio(F.sum(F.when(fe.isNotNull(), q * fe)), fe_q, "decimal(12,5)").alias("weighted_fe_pct"),
        cost_q.cast(DEC3).alias("cost_covered_quantity_mt"),
        ratio(F.sum(F.when(cost.isNotNull(), q * cost)), cost_q, "decimal(18,4)")
        .alias("weighted_landed_cost_inr_per_mt"),
        F.when(F.bool_and(F.col("quality_status") == "approved") & F.bool_and(F.col("cost_status") == "approved"),
               "verified")
        .when(F.bool_and(fe.isNotNull()) & F.bool_and(cost.isNotNull()), "flagged")
        .otherwise("incomplete").alias("status"))


def daily_customer_dispatch(dispatches: DataFrame, customers: DataFrame) -> DataFrame:
    """V4: per business date x customer: quantity, rows, rows missing lot."""
    per_day = dispatches.groupBy(F.col("dispatch_on").alias("business_date"), "customer_id").agg(
        F.sum("quantity_mt").cast(DEC3).alias("dispatched_quantity_mt"),
        F.count(F.lit(1)).cast("bigint").alias("dispatch_count"),
        F.count_if(F.col("lot_id").isNull()).cast("bigint").alias("rows_missing_lot"))
    names = customers.select("customer_id", F.col("legal_name").alias("customer"))
    return per_day.join(names, "customer_id", "inner").select(
        "business_date", "customer_id", "customer", "dispatched_quantity_mt", "dispatch_count", "rows_missing_lot")


def customer_monthly_activity(orders: DataFrame, dispatches: DataFrame, awards: DataFrame,
                              customers: DataFrame) -> DataFrame:
    """V5: long table (customer, month, metric, quantity) of ordered, dispatched, external allocated.

    Each arm is aggregated to (customer, month) before the union and the single name join."""
    def arm(df, who, when, qty, metric):
        return (df.select(F.col(who).alias("customer_id"), F.trunc(when, "MM").alias("month"),
                          qty.alias("q"))
                .where(F.col("month").isNotNull() & F.col("q").isNotNull())
                .groupBy("customer_id", "month").agg(F.sum("q").alias("q"))
                .withColumn("metric", F.lit(metric)))

    acts = (arm(orders, "customer_id", F.col("po_date"), F.col("ordered_quantity_mt"), "ordered")
            .unionByName(arm(dispatches, "customer_id", F.col("dispatch_on"), F.col("quantity_mt"), "dispatched"))
            .unionByName(arm(awards, "buyer_id", F.coalesce("event_on", "closes_on"),
                             F.coalesce("allocated_quantity_mt", "bid_quantity_mt"), "external_allocated")))
    names = customers.select("customer_id", F.col("legal_name").alias("customer"))
    return acts.join(names, "customer_id", "inner").select(
        "customer_id", "customer", "month", "metric", F.col("q").cast(DEC3).alias("quantity_mt"))


def quality_deviation(samples: DataFrame, orders: DataFrame, lots: DataFrame) -> DataFrame:
    """V6: inward vs indicative (same source row) and dispatch vs order target, actual - expected."""
    lot_no = lots.select("lot_id", "house_lot_number")
    inward = samples.where((F.col("sample_stage") == "inward") & F.col("fe_pct").isNotNull()).select(
        "lot_id", "source_row_id", F.col("fe_pct").alias("actual"))
    indicative = samples.where((F.col("sample_stage") == "indicative") & F.col("fe_pct").isNotNull()).select(
        F.col("source_row_id").alias("expected_source_row_id"), F.col("fe_pct").alias("expected"))
    arm1 = (inward.join(indicative, inward.source_row_id == indicative.expected_source_row_id, "inner")
            .join(lot_no, "lot_id", "left")
            .select("lot_id", F.coalesce("house_lot_number", F.col("source_row_id").cast("string"))
                    .alias("house_lot_number"),
                    F.lit("inbound_vs_indicative").alias("comparison"),
                    "expected", "actual", F.col("source_row_id").alias("actual_source_row_id"),
                    "expected_source_row_id"))
    dispatched = samples.where((F.col("sample_stage") == "dispatch") & F.col("fe_pct").isNotNull()).select(
        "dispatch_id", "dispatch_lot_id", "sales_order_line_id", "source_row_id", F.col("fe_pct").alias("actual"))
    targets = orders.where(F.col("target_fe_pct").isNotNull()).select(
        "sales_order_line_id", F.col("target_fe_pct").alias("expected"),
        F.col("source_row_id").alias("expected_source_row_id"))
    arm2 = (dispatched.join(targets, "sales_order_line_id", "inner")
            .join(lot_no.withColumnRenamed("lot_id", "dispatch_lot_id"), "dispatch_lot_id", "left")
            .select(F.col("dispatch_lot_id").alias("lot_id"),
                    F.coalesce("house_lot_number", F.col("dispatch_id").cast("string")).alias("house_lot_number"),
                    F.lit("dispatch_vs_order").alias("comparison"),
                    "expected", "actual", F.col("source_row_id").alias("actual_source_row_id"),
                    "expected_source_row_id"))
    return arm1.unionByName(arm2).select(
        "lot_id", "house_lot_number", "comparison",
        F.col("expected").cast("decimal(12,5)").alias("expected_fe_pct"),
        F.col("actual").cast("decimal(12,5)").alias("actual_fe_pct"),
        (F.col("actual") - F.col("expected")).cast("decimal(12,5)").alias("deviation_fe_points"),
        "actual_source_row_id", "expected_source_row_id")


def production_recovery(runs: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """V7: per run feed, recovered, tailings, calculated recovery %, reported recovery."""
    feed = inputs.groupBy("production_run_id").agg(F.sum("quantity_mt").alias("_feed"))
    out = outputs.groupBy("production_run_id").agg(
        F.sum(F.when(F.col("output_type") == "recovered_total", F.col("quantity_mt"))).alias("_rec"),
        F.sum(F.when(F.col("output_type") == "tailings", F.col("quantity_mt"))).alias("_tail"))
    j = runs.join(feed, "production_run_id", "left").join(out, "production_run_id", "left")
    rec = F.coalesce(F.col("_rec"), F.lit(0))
    return j.select(
        "production_run_id", "run_date", "shift", "process",
        F.coalesce(F.col("_feed"), F.lit(0)).cast(DEC3).alias("feed_quantity_mt"),
        rec.cast(DEC3).alias("recovered_quantity_mt"),
        F.coalesce(F.col("_tail"), F.lit(0)).cast(DEC3).alias("tailings_quantity_mt"),
        ratio(rec * 100, F.col("_feed"), "decimal(12,5)").alias("calculated_recovery_pct"),
        "reported_recovery_pct", "source_row_id")


def target_drift(targets: DataFrame, alerts: DataFrame) -> DataFrame:
    """V8: active targets with their latest alert (detected desc, id desc)."""
    latest = latest_by(alerts, ["target_id"], ["detected_on", "alert_id"],
                       ["actual_value", "severity", "status", "detected_on"])
    return targets.where(F.col("active")).join(latest, "target_id", "left").select(
        "target_id", "metric_code", "scope_type", "scope_id", "target_value", "actual_value",
        (F.col("actual_value") - F.col("target_value")).cast("decimal(18,5)").alias("deviation_value"),
        "severity", "status", "detected_on")


def answer_readiness(issues: DataFrame) -> DataFrame:
    """V9: status and severity counts over the open issues of the latest run (one row)."""
    sev = F.col("severity")
    crit = F.count_if(sev == "critical")
    warn = F.count_if(sev == "warning")
    return issues.where(F.col("resolved_at").isNull()).agg(
        F.when(crit > 0, "incomplete").when(warn > 0, "flagged").otherwise("verified").alias("status"),
        crit.cast("bigint").alias("critical_issues"), warn.cast("bigint").alias("warnings"),
        F.count_if(sev == "info").cast("bigint").alias("informational_issues"))


def transporter_work_orders(raw_rows: DataFrame) -> DataFrame:
    """Typed work orders from staged cells (quantity text summed by F14)."""
    from ..functions import clean
    c = F.col("cells")
    rows = raw_rows.where((F.col("row_number") > 2) & (clean.text(F.get(c, 5)) != ""))
    return rows.select(
        "source_row_id",
        F.get(c, 0).alias("work_order_number"), F.get(c, 2).alias("work_order_date_text"),
        F.trim(F.get(c, 5)).alias("transporter"), F.trim(F.get(c, 7)).alias("mine"),
        F.get(c, 8).alias("quantity_text"), clean.quantity_sum(F.get(c, 8)).alias("awarded_quantity_mt"),
        F.get(c, 9).alias("source_lot_text"), F.get(c, 11).alias("rate_text"))


def open_data_issues(issues: DataFrame) -> DataFrame:
    """Issues not resolved."""
    return issues.where(F.col("resolved_at").isNull())
