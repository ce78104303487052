"""Driver tables -> canonical ledger relations.

The verification tables are TPC-H-like; the ledger operators work on canonical
relations (lots, movements, dispatches, orders, samples, ...).  `Ledger` maps
one onto the other with projections and, where a relation is a roll-up, one
aggregation.  Every relation is a lazy DataFrame: nothing is materialised here,
so Catalyst prunes columns, pushes filters into the parquet scans and removes
relations a query does not touch.

The same mapping is written in SQL in `opsledger.oracle` for the DuckDB oracle.
"""

from __future__ import annotations

from decimal import Decimal
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import clean
from .operators.common import scaled
from .sources.tables import Tables

DEC3 = "decimal(18,3)"
DEC4 = "decimal(18,4)"
PCT = "decimal(8,4)"


def source_row_id():
    """Provenance pointer of a line: its place in the table's files."""
    return F.col("l_row")


def sampled_quantity():
    """Quantity that a line's sample stands for: returned lines ('R') are sampled after a loss of their tax share."""
    lost = (dec("l_quantity", 3) * (1 - dec("l_tax"))).cast(DEC3)
    return F.when(F.col("l_returnflag") == "R", lost).otherwise(F.col("l_quantity").cast(DEC3))


def _grade(expr):
    """A measured percentage; values outside 0..100 are kept here and nulled by the sample builder."""
    return expr.cast(PCT)


def dec(c: str, scale: int = 2):
    """A source double with at most `scale` decimals, as an exact decimal."""
    return F.col(c).cast(f"decimal(18,{scale})")


def k(v: str):
    """Exact decimal constant (derived amounts are computed in decimals, never doubles)."""
    return F.lit(Decimal(v))


def unit_price():
    """l_extendedprice / l_quantity rounded half-up to 4 decimals, in exact integer arithmetic."""
    e4 = F.expr("(CAST(round(l_extendedprice * 100) AS BIGINT) * 200 + CAST(l_quantity AS BIGINT))"
                " div (2 * CAST(l_quantity AS BIGINT))")
    return (e4.cast("decimal(18,0)") * k("0.0001")).cast(DEC4)


class Ledger:
    """Canonical relations over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.t = Tables(spark, sf_dir)

    # ---- organisations and master data ---------------------------------------
    @cached_property
    def customers(self) -> DataFrame:
        c = self.t.customer
        return c.select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("legal_name"),
            clean.normalized_organization("c_name").alias("normalized_name"),
            F.col("c_mktsegment").alias("buyer_type"),
            F.col("c_custkey").alias("source_row_id"))

    @cached_property
    def suppliers(self) -> DataFrame:
        s = self.t.supplier
        return s.select(
            F.col("s_suppkey").alias("supplier_id"),
            F.col("s_name").alias("legal_name"),
            clean.normalized_organization("s_name").alias("normalized_name"),
            F.col("s_suppkey").alias("source_row_id"))

    @cached_property
    def lots(self) -> DataFrame:
        p = self.t.part
        return p.select(
            F.col("p_partkey").alias("lot_id"),
            F.concat(F.lit("LOT-"), F.col("p_partkey").cast("string")).alias("house_lot_number"),
            F.col("p_name").alias("description"),
            F.lower("p_type").alias("category"),
            F.col("p_size").cast("string").alias("size_spec"),
            F.concat(F.lit("iron_ore:"), F.lower("p_type"), F.lit(":"), F.col("p_size").cast("string"))
            .alias("material_code"),
            F.col("p_size").cast(PCT).alias("lot_fe_pct"),
            F.col("p_retailprice").cast(DEC4).alias("lot_landed_cost"),
            F.col("p_partkey").alias("source_row_id"))

    # ---- movements, dispatches, orders ---------------------------------------
    @cached_property
    def movements(self) -> DataFrame:
        li = self.t.lineitem
        return li.select(
            source_row_id().alias("movement_id"),
            F.col("l_partkey").alias("lot_id"),
            F.when(F.col("l_linestatus") == "O", "in").otherwise("out").alias("direction"),
            F.col("l_returnflag").alias("event_type"),
            F.col("l_quantity").cast(DEC3).alias("quantity_mt"),
            F.col("l_shipdate").cast("date").alias("occurred_on"),
            source_row_id().alias("source_row_id"))

    @cached_property
    def sales_orders(self) -> DataFrame:
        o = self.t.orders
        return o.select(
            F.col("o_orderkey").alias("sales_order_line_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderkey").cast("string").alias("po_number"),
            F.col("o_orderdate").cast("date").alias("po_date"),
            (dec("o_totalprice") * k("0.0005")).cast(DEC3).alias("ordered_quantity_mt"),
            F.when(F.col("o_orderstatus") != "O", (dec("o_totalprice") * k("0.0004")).cast(DEC3))
            .alias("reported_dispatched_quantity_mt"),
            (dec("o_totalprice") * k("0.000125")).cast(PCT).alias("target_fe_pct"),
            (dec("o_totalprice") * k("0.01")).cast(DEC4).alias("selling_rate_inr_per_mt"),
            F.col("o_orderstatus").alias("order_status"),
            F.col("o_orderkey").alias("source_row_id"))

    @cached_property
    def dispatches(self) -> DataFrame:
        li = self.t.lineitem
        o = self.t.orders.select("o_orderkey", "o_custkey")
        return li.join(o, li.l_orderkey == o.o_orderkey, "inner").select(
            source_row_id().alias("dispatch_id"),
            F.col("l_shipdate").cast("date").alias("dispatch_on"),
            F.col("o_custkey").alias("customer_id"),
            F.col("l_orderkey").alias("sales_order_line_id"),
            F.when(F.col("l_returnflag") != "N", F.col("l_partkey")).alias("lot_id"),
            F.col("l_suppkey").alias("permit_supplier_id"),
            F.col("l_quantity").cast(DEC3).alias("quantity_mt"),
            F.col("l_linenumber").alias("vehicle_count"),
            source_row_id().alias("source_row_id"))

    @cached_property
    def dispatch_lines(self) -> DataFrame:
        """Every line as the dispatch (its source row the id) that it is if its order (`l_orderkey`) is known."""
        return self.t.lineitem.select(
            "l_orderkey", F.col("l_shipdate").cast("date").alias("dispatch_on"),
            F.when(F.col("l_returnflag") != "N", F.col("l_partkey")).alias("lot_id"),
            F.col("l_suppkey").alias("permit_supplier_id"), source_row_id().alias("source_row_id"))

    @cached_property
    def permits(self) -> DataFrame:
        """Outward permits: one per supplier with a positive balance; quantity from the balance."""
        s = self.t.supplier
        return s.where(F.col("s_acctbal") > 0).select(
            F.col("s_suppkey").alias("permit_id"),
            F.concat(F.lit("P-"), F.col("s_suppkey").cast("string")).alias("permit_number"),
            F.lit("outward").alias("direction"),
            (dec("s_acctbal") * 2).cast(DEC3).alias("permitted_quantity_mt"),
            F.col("s_suppkey").alias("source_row_id"))

    # ---- stock, cost, quality -------------------------------------------------
    @cached_property
    def stock_snapshots(self) -> DataFrame:
        """Year-end snapshot per (year, lot): sum of the year's line quantities."""
        li = self.t.lineitem
        p = self.t.part.select("p_partkey", "p_size", "p_retailprice")
        per_year = (li.groupBy(F.year("l_shipdate").alias("y"), F.col("l_partkey"))
                    .agg(F.sum(F.col("l_quantity").cast(DEC3)).cast(DEC3).alias("recorded_quantity_mt"),
                         F.max(source_row_id()).alias("source_row_id")))
        return per_year.join(p, per_year.l_partkey == p.p_partkey, "inner").select(
            F.make_date("y", F.lit(12), F.lit(31)).alias("snapshot_on"),
            F.col("l_partkey").alias("lot_id"),
            "recorded_quantity_mt",
            F.col("p_size").cast(PCT).alias("reported_fe_pct"),
            F.col("p_retailprice").cast(DEC4).alias("reported_landed_cost_inr_per_mt"),
            "source_row_id")

    @cached_property
    def cost_components(self) -> DataFrame:
        li = self.t.lineitem
        lines = li.select(
            source_row_id().alias("component_id"),
            F.col("l_partkey").alias("lot_id"),
            F.col("l_returnflag").alias("component_code"),
            unit_price().alias("rate_inr_per_mt"),
            F.col("l_shipdate").cast("date").alias("effective_on"),
            (F.col("l_returnflag") != "N").alias("included_in_landed_cost"),
            F.when(F.col("l_linestatus") == "F", "approved").otherwise("reported").alias("approval_status"),
            source_row_id().alias("source_row_id"))
        reported = self.stock_snapshots.select(
            F.col("source_row_id").alias("component_id"), "lot_id",
            F.lit("REPORTED_LANDED_COST").alias("component_code"),
            F.col("reported_landed_cost_inr_per_mt").alias("rate_inr_per_mt"),
            F.col("snapshot_on").alias("effective_on"),
            F.lit(False).alias("included_in_landed_cost"),
            F.lit("reported").alias("approval_status"), "source_row_id")
        return lines.unionByName(reported)

    @cached_property
    def sample_lines(self) -> DataFrame:
        """One row per line with raw measures (before range checks)."""
        li = self.t.lineitem
        p = self.t.part.select("p_partkey", "p_retailprice")
        return li.join(p, li.l_partkey == p.p_partkey, "inner").select(
            source_row_id().alias("source_row_id"),
            F.col("l_partkey").alias("lot_id"),
            F.col("l_linestatus"), F.col("l_returnflag"), F.col("l_orderkey"), F.col("l_suppkey").alias("supplier_id"),
            F.col("l_shipdate").cast("date").alias("sample_on"),
            sampled_quantity().alias("represented_quantity_mt"),
            _grade(unit_price() * k("0.05")).alias("fe_raw"),
            _grade(dec("p_retailprice") * k("0.05")).alias("indicative_fe_raw"),
            _grade(dec("l_discount") * 100).alias("sio2_raw"),
            _grade(dec("l_tax") * 100).alias("al2o3_raw"))

    @cached_property
    def quality_samples(self) -> DataFrame:
        """Indicative + inward samples for inward lines (status O), dispatch samples for F lines.

        Values outside 0..100 are nulled (the range rule reports them)."""
        s = self.sample_lines

        def ok(c):
            return F.when(F.col(c).between(0, 100), F.col(c))

        inward = s.where(F.col("l_linestatus") == "O")
        dispatched = s.where(F.col("l_linestatus") == "F")
        common = ["source_row_id", "lot_id", "sample_on", "represented_quantity_mt"]
        ind = inward.select(*common, F.lit("indicative").alias("sample_stage"),
                            ok("indicative_fe_raw").alias("fe_pct"),
                            F.lit(None).cast(PCT).alias("sio2_pct"), F.lit(None).cast(PCT).alias("al2o3_pct"),
                            F.lit(True).alias("approved"), F.lit(None).cast("bigint").alias("dispatch_id"),
                            F.lit(None).cast("bigint").alias("dispatch_lot_id"),
                            F.lit(None).cast("bigint").alias("sales_order_line_id"))
        inw = inward.select(*common, F.lit("inward").alias("sample_stage"),
                            ok("fe_raw").alias("fe_pct"), ok("sio2_raw").alias("sio2_pct"),
                            ok("al2o3_raw").alias("al2o3_pct"),
                            (F.col("l_returnflag") != "R").alias("approved"),
                            F.lit(None).cast("bigint").alias("dispatch_id"),
                            F.lit(None).cast("bigint").alias("dispatch_lot_id"),
                            F.lit(None).cast("bigint").alias("sales_order_line_id"))
        dis = dispatched.select(*common, F.lit("dispatch").alias("sample_stage"),
                                ok("fe_raw").alias("fe_pct"), ok("sio2_raw").alias("sio2_pct"),
                                ok("al2o3_raw").alias("al2o3_pct"),
                                (F.col("l_returnflag") != "R").alias("approved"),
                                F.col("source_row_id").alias("dispatch_id"),
                                F.when(F.col("l_returnflag") != "N", F.col("lot_id")).alias("dispatch_lot_id"),
                                F.col("l_orderkey").alias("sales_order_line_id"))
        return ind.unionByName(inw).unionByName(dis)

    # ---- production -----------------------------------------------------------
    @cached_property
    def production_runs(self) -> DataFrame:
        o = self.t.orders
        return o.select(
            F.col("o_orderkey").alias("production_run_id"),
            F.col("o_orderdate").cast("date").alias("run_date"),
            F.col("o_orderstatus").alias("shift"),
            F.col("o_orderpriority").alias("process"),
            F.col("o_orderpriority").alias("source_material_name"),
            (dec("o_totalprice") * k("0.00025")).cast(PCT).alias("reported_recovery_pct"),
            F.col("o_orderkey").alias("source_row_id"))

    @cached_property
    def production_inputs(self) -> DataFrame:
        li = self.t.lineitem
        return li.select(F.col("l_orderkey").alias("production_run_id"),
                         F.col("l_partkey").alias("lot_id"),
                         F.col("l_extendedprice").cast(DEC3).alias("quantity_mt"),
                         source_row_id().alias("source_row_id"))

    @cached_property
    def production_outputs(self) -> DataFrame:
        li = self.t.lineitem
        rec = li.select(F.col("l_orderkey").alias("production_run_id"),
                        F.lit("recovered_total").alias("output_type"),
                        (dec("l_extendedprice") * (1 - dec("l_discount"))).cast(DEC3).alias("quantity_mt"),
                        source_row_id().alias("source_row_id"))
        tail = li.where(dec("l_extendedprice") * dec("l_tax") > 0).select(
            F.col("l_orderkey").alias("production_run_id"),
            F.lit("tailings").alias("output_type"),
            (dec("l_extendedprice") * dec("l_tax")).cast(DEC3).alias("quantity_mt"),
            source_row_id().alias("source_row_id"))
        return rec.unionByName(tail)

    # ---- purchases and receipts -------------------------------------------------
    @cached_property
    def purchase_lots(self) -> DataFrame:
        """Supplier summary per (supplier, lot): reported figures from the supplier's statement."""
        li = self.t.lineitem
        q = (F.col("l_quantity").cast(DEC3) * 1000).cast("bigint")  # thousandths: a partial sum is one long in the shuffle
        of = lambda holds: F.sum(F.when(holds, q).otherwise(F.lit(0).cast("bigint")))
        tonnes = lambda units: scaled(units, 3).cast(DEC3)
        flag, status = F.col("l_returnflag"), F.col("l_linestatus")
        paid = ((dec("l_discount") * 100).cast("bigint") - 5) * q
        return (li.groupBy(F.col("l_suppkey").alias("supplier_id"), F.col("l_partkey").alias("lot_id"))
                .agg(tonnes(F.sum(q)).alias("purchased_quantity_mt"),
                     tonnes(of(flag != "R")).alias("reported_lifted_quantity_mt"),
                     tonnes(of(status == "O") - of(flag == "R")).alias("reported_balance_to_lift_mt"),
                     scaled(F.sum(paid), 5).cast(DEC3).alias("reported_payment_balance_mt"),
                     tonnes(of(status == "F") - of(flag == "N")).alias("reported_permit_balance_mt"),
                     F.min(F.col("l_shipdate").cast("date")).alias("purchase_date"),
                     F.min(source_row_id()).alias("source_row_id")))

    @cached_property
    def receipts(self) -> DataFrame:
        li = self.t.lineitem
        return li.select(source_row_id().alias("receipt_id"),
                         F.col("l_shipdate").cast("date").alias("receipt_on"),
                         F.col("l_suppkey").alias("supplier_id"),
                         F.col("l_partkey").alias("lot_id"),
                         F.col("l_quantity").cast(DEC3).alias("quantity_mt"),
                         F.col("l_linenumber").alias("trip_count"),
                         source_row_id().alias("source_row_id"))

    # ---- auctions, plans, targets --------------------------------------------------
    @cached_property
    def auction_awards(self) -> DataFrame:
        li = self.t.lineitem
        o = self.t.orders.select("o_orderkey", "o_custkey")
        return li.join(o, li.l_orderkey == o.o_orderkey, "inner").select(
            source_row_id().alias("auction_lot_id"),
            F.col("l_shipdate").cast("date").alias("closes_on"),
            F.col("o_custkey").alias("buyer_id"),
            F.when(F.col("l_linestatus") == "F", F.col("l_shipdate").cast("date")).alias("event_on"),
            F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast(DEC3)).alias("allocated_quantity_mt"),
            F.col("l_quantity").cast(DEC3).alias("bid_quantity_mt"),
            source_row_id().alias("source_row_id"))

    @cached_property
    def auction_lots(self) -> DataFrame:
        li = self.t.lineitem
        p = self.t.part.select("p_partkey", "p_size", "p_retailprice")
        s = self.t.supplier.select("s_suppkey", "s_name")
        return (li.join(p, li.l_partkey == p.p_partkey, "inner")
                .join(s, li.l_suppkey == s.s_suppkey, "inner")
                .select(source_row_id().alias("auction_lot_id"),
                        F.col("l_shipdate").cast("date").alias("closes_on"),
                        F.col("l_partkey").alias("lot_id"),
                        F.col("s_name").alias("mine"),
                        F.col("p_size").cast(PCT).alias("fe_pct"),
                        F.col("l_quantity").cast(DEC3).alias("offered_quantity_mt"),
                        (F.col("l_linestatus") == "F").alias("sold"),
                        F.col("p_retailprice").cast(DEC4).alias("opening_price"),
                        unit_price().alias("current_price"),
                        (F.col("p_retailprice").cast(DEC4) * k("1.05")).cast(DEC4).alias("landed_price"),
                        (F.col("p_size").cast(PCT) * k("0.1")).cast("decimal(12,5)").alias("premium_pct"),
                        source_row_id().alias("source_row_id")))

    @cached_property
    def plan_allocations(self) -> DataFrame:
        li = self.t.lineitem
        o = self.t.orders.select("o_orderkey", "o_orderstatus")
        return li.join(o, li.l_orderkey == o.o_orderkey, "inner").select(
            F.col("l_partkey").alias("lot_id"),
            F.col("l_quantity").cast(DEC3).alias("selected_quantity_mt"),
            F.when(F.col("o_orderstatus") == "O", "active").otherwise("released").alias("reservation_state"))

    @cached_property
    def business_targets(self) -> DataFrame:
        c = self.t.customer
        return c.select(
            F.col("c_custkey").alias("target_id"),
            F.lit("CUSTOMER_ORDER_VALUE").alias("metric_code"),
            F.lit("customer").alias("scope_type"),
            F.col("c_custkey").alias("scope_id"),
            F.col("c_acctbal").cast("decimal(18,5)").alias("target_value"),
            (F.col("c_acctbal") > 0).alias("active"))

    @cached_property
    def alert_events(self) -> DataFrame:
        o = self.t.orders
        return o.select(
            F.col("o_orderkey").alias("alert_id"),
            F.col("o_custkey").alias("target_id"),
            F.col("o_orderdate").cast("date").alias("detected_on"),
            F.col("o_totalprice").cast("decimal(18,5)").alias("actual_value"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "critical").otherwise("warning").alias("severity"),
            F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("open").alias("status"))


class StagedLedger(Ledger):
    """Adds the sheet-shaped inputs (positional text cells) some operators read."""

    @cached_property
    def work_order_rows(self) -> DataFrame:
        """Transport work-order sheet: one staged row per order, cells as formatted text.

        Quantity text is 'q1 + q2 + ...' over the order's lines; pending orders ('P') carry an
        unparseable quantity and rate, as hand-kept sheets do."""
        li = self.t.lineitem
        o = self.t.orders.select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice")
        per = (li.join(o, li.l_orderkey == o.o_orderkey, "inner")
               .groupBy("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice")
               .agg(F.array_join(F.array_sort(F.collect_list(F.col("l_quantity").cast("string"))), " + ").alias("q"),
                    F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("LOT-"), F.col("l_partkey").cast("string")))),
                                 ", ").alias("lots"),
                    F.min("l_suppkey").alias("mine"), F.count(F.lit(1)).alias("n")))
        pending = F.col("o_orderstatus") == "P"
        cells = F.array(
            F.concat(F.lit("WO-"), F.col("o_orderkey").cast("string")), F.lit(""),
            F.col("o_orderdate").cast("date").cast("string"), F.lit(""), F.lit(""),
            F.col("o_orderpriority"), F.lit(""), F.concat(F.lit("MINE-"), F.col("mine").cast("string")),
            F.when(pending & (F.col("n") == 1), F.lit("")).when(pending, F.concat(F.col("q"), F.lit(" + pending"))).otherwise(F.col("q")),
            F.col("lots"), F.lit(""),
            F.when(pending, F.lit("TBD")).otherwise(dec("o_totalprice").cast("string")),
            F.lit(""), F.lit(""), F.lit(""), (F.col("n") * 10).cast("string"))
        return per.select(F.lit("transport_work_orders").alias("file_name"), F.lit("INWARD FINAL").alias("sheet_name"),
                          (F.col("o_orderkey") + 3).cast("bigint").alias("row_number"), cells.alias("cells"),
                          F.col("o_orderkey").alias("source_row_id"))

    @cached_property
    def lot_aliases(self) -> DataFrame:
        """Every lot is known by its house number and its description."""
        lots = self.lots
        return (lots.select("lot_id", F.col("house_lot_number").alias("alias"), "source_row_id")
                .unionByName(lots.select("lot_id", F.col("description").alias("alias"), "source_row_id")))

    @cached_property
    def planning_rows(self) -> DataFrame:
        """Opening-stock planning sheet: lots referenced by house number (large sizes) or description."""
        p = self.t.part
        return p.select(
            F.when(F.col("p_size") > 25, F.concat(F.lit("LOT-"), F.col("p_partkey").cast("string")))
            .otherwise(F.col("p_name")).alias("lot_text"),
            (F.col("p_size") * 10).cast(DEC3).alias("planned_quantity_mt"),
            F.col("p_partkey").alias("source_row_id"))

    @cached_property
    def sample_measures(self) -> DataFrame:
        """Raw measures per sample (before range checks) keyed by stage:source_row; the lines are read once for all their samples."""
        s, inward = self.sample_lines, F.col("l_linestatus") == "O"
        row, none = F.col("source_row_id").cast("string"), F.lit(None).cast(PCT)
        both = s.select("source_row_id", "lot_id", F.stack(
            F.lit(2), F.when(inward, F.concat(F.lit("indicative:"), row)), F.col("indicative_fe_raw"), none, none,
            F.concat(F.when(inward, "inward:").otherwise("dispatch:"), row), F.col("fe_raw"), F.col("sio2_raw"), F.col("al2o3_raw"),
        ).alias("sample_key", "fe_raw", "sio2_raw", "al2o3_raw"))
        return both.where(F.col("sample_key").isNotNull())

    @cached_property
    def inward_samples(self) -> DataFrame:
        """Inward quality rows with the DMG-declared quantity (quantity x (1 + discount))."""
        li = self.t.lineitem
        return li.where(F.col("l_linestatus") == "O").select(
            source_row_id().alias("source_row_id"),
            sampled_quantity().alias("represented_quantity_mt"),
            (dec("l_quantity", 3) * (1 + dec("l_discount"))).cast(DEC3).alias("declared_quantity_mt"))

    @cached_property
    def inward_rows(self) -> DataFrame:
        """'Daily Inward Details' sheet: one staged row per line, cells formatted as hand-kept text
        (d-MMM-yyyy dates, thousands separators); lots are written 'LOT-n', except returned-flag 'A'
        lines which carry an unknown 'L-n' spelling."""
        li = self.t.lineitem
        lot_text = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("L-"), F.col("l_partkey").cast("string"))) \
            .otherwise(F.concat(F.lit("LOT-"), F.col("l_partkey").cast("string")))
        cells = F.array(F.date_format("l_shipdate", "d-MMM-yyyy"), F.lit(""),
                        F.concat(F.lit("SUP-"), F.col("l_suppkey").cast("string")), lot_text,
                        F.format_number("l_quantity", 2), F.col("l_linenumber").cast("string"),
                        F.concat(F.lit("P-"), F.col("l_suppkey").cast("string")),
                        F.format_number("l_extendedprice", 2))
        return li.select(F.lit("inward_report").alias("file_name"), F.lit("Daily Inward Details").alias("sheet_name"),
                         (source_row_id() + 1).cast("bigint").alias("row_number"), cells.alias("cells"),
                         source_row_id().alias("source_row_id"))

    @cached_property
    def day_book_rows(self) -> DataFrame:
        """'DAILY BOOKS' sheet: one row per line with signed inward / outward columns by line status;
        the event text comes from the return flag (R = shortage/loss, A = production feed, N = inward)."""
        li = self.t.lineitem
        q = F.format_number("l_quantity", 3)
        event = (F.when(F.col("l_returnflag") == "R", F.lit("Shortage / loss"))
                 .when(F.col("l_returnflag") == "A", F.lit("Feed to plant")).otherwise(F.lit("Inward receipt")))
        cells = F.array(F.date_format("l_shipdate", "M/d/yyyy"), F.concat(F.lit("LOT-"), F.col("l_partkey").cast("string")),
                        F.lit(""), F.lit(""), event,
                        F.when(F.col("l_linestatus") == "O", q).otherwise(F.lit("-")),
                        F.when(F.col("l_linestatus") == "F", q).otherwise(F.lit("")),
                        *[F.lit("")] * 18, F.concat(F.lit("REF-"), F.col("l_orderkey").cast("string")))
        return li.select(F.lit("stock_report").alias("file_name"), F.lit("DAILY BOOKS").alias("sheet_name"),
                         (source_row_id() + 1).cast("bigint").alias("row_number"), cells.alias("cells"),
                         source_row_id().alias("source_row_id"))

    @cached_property
    def outward_rows(self) -> DataFrame:
        """'Daily Outward Detail' sheet: one staged row per line with the customer's name, the PO
        number, quantity, vehicles, permit number and the measured grade (formatted text)."""
        li = self.t.lineitem
        o = self.t.orders.select("o_orderkey", "o_custkey")
        c = self.t.customer.select("c_custkey", "c_name")
        j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey"))
        cells = F.array(F.date_format("l_shipdate", "d-MMM-yyyy"), F.col("c_name"), F.col("l_orderkey").cast("string"),
                        F.format_number("l_quantity", 3), F.col("l_linenumber").cast("string"),
                        F.concat(F.lit("P-"), F.col("l_suppkey").cast("string")), *[F.lit("")] * 4,
                        F.concat(F.format_number(unit_price() * k("0.05"), 6), F.lit("%")))
        return j.select(F.lit("outward_report").alias("file_name"), F.lit("Daily Outward Detail").alias("sheet_name"),
                        (source_row_id() + 1).cast("bigint").alias("row_number"), cells.alias("cells"),
                        source_row_id().alias("source_row_id"))

    @cached_property
    def production_rows(self) -> DataFrame:
        """'PRODUCTION AND RECOVERY' sheet: one staged row per run (order) with formatted totals of
        its lines; finished runs ('F') name the lot they fed, the others only a kind of material; pending runs ('P') leave the recovered column (40) blank so readers fall back to
        the product column (32)."""
        li = self.t.lineitem
        o = self.t.orders.select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority", "o_totalprice")
        rec_line = (dec("l_extendedprice") * (1 - dec("l_discount"))).cast(DEC3)
        tail_line = (dec("l_extendedprice") * dec("l_tax")).cast(DEC3)
        per = li.groupBy("l_orderkey").agg(
            F.sum(F.col("l_extendedprice").cast(DEC3)).alias("feed"), F.sum(rec_line).alias("rec"),
            F.sum(F.when(tail_line > 0, tail_line)).alias("tail"), F.min("l_partkey").alias("least"))
        j = per.join(o, per.l_orderkey == o.o_orderkey)
        blank = [F.lit("")]
        cells = F.array(
            F.date_format("o_orderdate", "d-MMM-yyyy"), F.col("o_orderstatus"), F.lit("RUN"), F.col("o_orderpriority"),
            F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("LOT-"), F.col("least").cast("string"))).otherwise(F.col("o_orderpriority")),
            F.format_number("feed", 3), *blank * 23,
            F.coalesce(F.format_number("tail", 3), F.lit("-")), *blank * 2,
            F.format_number("rec", 3), *blank * 7,
            F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.format_number("rec", 3)),
            F.format_number((dec("o_totalprice") * k("0.00025")).cast(PCT), 4))
        return j.select(F.lit("production_report").alias("file_name"),
                        F.lit("PRODUCTION AND RECOVERY").alias("sheet_name"),
                        (F.col("o_orderkey") + 5).cast("bigint").alias("row_number"), cells.alias("cells"),
                        F.col("o_orderkey").alias("source_row_id"))

    @cached_property
    def purchase_rows(self) -> DataFrame:
        """'Purchased Details' sheet: one staged row per (supplier, lot) purchase with formatted
        quantities, a lifecycle status text and a payment text."""
        p = self.purchase_lots
        lots = self.lots.select("lot_id", "category", "lot_landed_cost")
        j = p.join(lots, "lot_id")
        status = (F.when(F.col("reported_lifted_quantity_mt") == 0, F.lit("Un-lifted"))
                  .when(F.col("reported_balance_to_lift_mt") <= 0, F.lit("Finished"))
                  .otherwise(F.lit("In progress")))
        payment = (F.when(F.col("reported_payment_balance_mt") < 0, F.lit("Payment pending"))
                   .when(F.col("reported_payment_balance_mt") == 0, F.lit("Paid"))
                   .otherwise(F.lit("Partially paid")))
        blank = [F.lit("")]
        cells = F.array(
            F.date_format("purchase_date", "d-MMM-yyyy"), F.col("category"), *blank,
            F.concat(F.lit("SUP-"), F.col("supplier_id").cast("string")),
            F.concat(F.lit("LOT-"), F.col("lot_id").cast("string")),
            F.format_number("purchased_quantity_mt", 3),
            F.concat(F.lit("₹"), F.format_number("lot_landed_cost", 4)), F.format_number("lot_landed_cost", 4), *blank,
            F.format_number("reported_lifted_quantity_mt", 3), F.format_number("reported_balance_to_lift_mt", 3),
            *blank * 3, F.format_number("reported_payment_balance_mt", 3), F.format_number("reported_permit_balance_mt", 3), *blank * 3,
            status, payment)
        return j.select(F.lit("inward_report").alias("file_name"), F.lit("Purchased Details").alias("sheet_name"),
                        (F.col("source_row_id") + 2).cast("bigint").alias("row_number"), cells.alias("cells"),
                        "source_row_id")

    @cached_property
    def stock_rows(self) -> DataFrame:
        """'IRON ORE' stock sheet of the latest snapshot: the date in row 1 cell 2, data from row 5."""
        from .operators.marts import latest_snapshot
        s = latest_snapshot(self.stock_snapshots).join(self.lots.select("lot_id", "category"), "lot_id")
        blank = [F.lit("")]
        data = s.select(
            F.array(F.col("category"), F.concat(F.lit("LOT-"), F.col("lot_id").cast("string")),
                    F.format_number("recorded_quantity_mt", 3), *blank * 2,
                    F.format_number("reported_fe_pct", 4), *blank * 3,
                    F.concat(F.lit("₹"), F.format_number("reported_landed_cost_inr_per_mt", 4)),
                    F.lit("OK")).alias("cells"),
            (F.col("lot_id") + 5).cast("bigint").alias("row_number"), F.col("source_row_id"))
        header = self.stock_snapshots.agg(F.max("snapshot_on").alias("d")).select(
            F.array(F.lit("HO STOCK"), F.lit("as on"), F.date_format("d", "d-MMM-yyyy")).alias("cells"),
            F.lit(1).cast("bigint").alias("row_number"), F.lit(None).cast("bigint").alias("source_row_id"))
        return header.unionByName(data).select(
            F.lit("stock_report").alias("file_name"), F.lit("IRON ORE").alias("sheet_name"),
            "row_number", "cells", "source_row_id")

    @cached_property
    def order_rows(self) -> DataFrame:
        """'Outward Details' sheet: one staged row per order line with the customer's name."""
        o = self.sales_orders
        c = self.t.customer.select(F.col("c_custkey").alias("customer_id"), "c_name")
        j = o.join(c, "customer_id")
        blank = [F.lit("")]
        cells = F.array(
            F.col("c_name"), *blank * 2, F.col("po_number"), F.date_format("po_date", "d-MMM-yyyy"),
            F.format_number("target_fe_pct", 4), *blank * 2, F.concat(F.lit("₹"), F.format_number("selling_rate_inr_per_mt", 4)),
            F.format_number("ordered_quantity_mt", 3),
            F.coalesce(F.format_number("reported_dispatched_quantity_mt", 3), F.lit("-")), *blank * 7,
            F.col("order_status"))
        return j.select(F.lit("outward_report").alias("file_name"), F.lit("Outward Details").alias("sheet_name"),
                        (F.col("source_row_id") + 3).cast("bigint").alias("row_number"), cells.alias("cells"),
                        "source_row_id")

    @cached_property
    def permit_rows(self) -> DataFrame:
        """'Permit Detail's (outward)' sheet: one row per supplier account, held by the customer of the same number for
        that customer's greatest order number."""
        s = self.t.supplier
        o = self.t.orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("po"), F.max("o_orderdate").alias("on"))
        c = self.t.customer.select("c_custkey", "c_name").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
        j = s.join(c, s.s_suppkey == F.col("c_custkey"), "left")
        blank = [F.lit("")]
        cells = F.array(F.coalesce("c_name", F.lit("")), *blank, F.coalesce(F.col("po").cast("string"), F.lit("")),
                        F.concat(F.lit("P-"), F.col("s_suppkey").cast("string")),
                        F.coalesce(F.date_format("on", "d-MMM-yyyy"), F.lit("")), F.format_number(dec("s_acctbal") * 2, 3), *blank,
                        F.when(F.col("s_acctbal") > 0, F.lit("Active")).otherwise(F.lit("")), *blank,
                        F.when(F.col("s_acctbal") > 5000, F.lit("Lumps")).otherwise(F.lit("Fines")))
        return j.select(F.lit("outward_report").alias("file_name"), F.lit("Permit Details").alias("sheet_name"),
                        (F.col("s_suppkey") + 2).cast("bigint").alias("row_number"), cells.alias("cells"),
                        F.col("s_suppkey").alias("source_row_id"))

    @cached_property
    def lot_master_rows(self) -> DataFrame:
        """'LOT MASTER' sheet: one row per part; lots of large sizes are written again further down, as closed and under
        another source lot."""
        p = self.t.part
        text = lambda c: F.col(c).cast("string")
        status = F.when(F.col("p_size") > 30, F.lit("Un-lifted")).when(F.col("p_size") > 15, F.lit("Finished")).otherwise(F.lit("in plant"))
        cells = lambda status, source: F.array(
            F.concat(F.lit("LOT-"), text("p_partkey")), status, F.col("p_type"), F.col("p_brand"), F.col("p_name"), text("p_size"), source)
        first = p.select(cells(status, F.concat(F.lit("SL "), text("p_partkey"))).alias("cells"), F.col("p_partkey").alias("source_row_id"))
        again = p.where(F.col("p_size") > 40).select(cells(F.lit("Closed"), F.lit("")).alias("cells"),
                                                     (F.col("p_partkey") + (1 << 40)).alias("source_row_id"))
        return first.unionByName(again).select(
            F.lit("stock_report").alias("file_name"), F.lit("LOT MASTER").alias("sheet_name"),
            (F.col("source_row_id") + 2).cast("bigint").alias("row_number"), "cells", "source_row_id")

    @cached_property
    def organization_mentions(self) -> DataFrame:
        """(name, role, source_row_id) of the sheets that name organisations, in the order in which they are read."""
        def of(place, rows, cell, role):
            return rows.select(F.get("cells", cell).alias("name"), F.lit(role).alias("role"),
                               (F.lit(place << 50) + F.col("source_row_id")).cast("bigint").alias("source_row_id"))
        return (of(1, self.buyer_rows, 0, "customer").unionByName(of(2, self.purchase_rows, 3, "supplier"))
                .unionByName(of(3, self.permit_rows, 0, "customer")).unionByName(of(4, self.auction_rows, 19, "mine_owner"))
                .unionByName(of(5, self.work_order_rows, 5, "transporter")).unionByName(of(6, self.work_order_rows, 7, "mine_owner")))

    @cached_property
    def inward_permit_rows(self) -> DataFrame:
        """'Permit Detail's (inward)' sheet: one row per purchase; a supplier's purchases of lots whose numbers begin alike
        share a permit number."""
        p = self.purchase_lots.join(self.lots.select("lot_id", "category"), "lot_id")
        blank = [F.lit("")]
        lot, sup = F.col("lot_id").cast("string"), F.col("supplier_id").cast("string")
        cells = F.array(F.concat(F.lit("SUP-"), sup), F.concat(F.lit("LOT-"), lot), *blank,
                        F.format_number("purchased_quantity_mt", 3), F.concat(F.lit("IP-"), sup, F.lit("-"), F.substring(lot, 1, 2)),
                        F.date_format("purchase_date", "d-MMM-yyyy"), *blank,
                        F.when(F.col("reported_lifted_quantity_mt") > 0, F.lit("Active")).otherwise(F.lit("")), *blank, F.col("category"))
        return p.select(F.lit("inward_report").alias("file_name"), F.lit("Permit Details").alias("sheet_name"),
                        (F.col("source_row_id") + 1).cast("bigint").alias("row_number"), cells.alias("cells"), "source_row_id")

    @cached_property
    def auction_rows(self) -> DataFrame:
        """'Consolidated Data' auction sheet: one row per offered lot, the auctions of a month under one number."""
        a = self.auction_lots
        blank = [F.lit("")]
        cells = F.array(F.date_format("closes_on", "d-MMM-yyyy"), F.concat(F.lit("EA-"), F.date_format("closes_on", "yyyyMM")),
                        F.concat(F.lit("LOT-"), F.col("lot_id").cast("string")), F.concat(F.lit("Pit "), F.col("mine")),
                        F.when(F.col("fe_pct") > 25, F.lit("LUMPS")).otherwise(F.lit("FINES")),
                        F.format_number("fe_pct", 4), *blank, F.format_number("offered_quantity_mt", 3), *blank,
                        F.when(F.col("sold"), F.format_number("offered_quantity_mt", 3)).otherwise(F.lit("-")), *blank,
                        F.format_number("opening_price", 4), F.concat(F.lit("₹"), F.format_number("current_price", 4)), *blank,
                        F.format_number("landed_price", 4), *blank,
                        F.concat(F.format_number("premium_pct", 5), F.lit("%")), *blank * 2, F.col("mine"))
        return a.select(F.lit("auction").alias("file_name"), F.lit("Consolidated Data").alias("sheet_name"),
                        (F.col("auction_lot_id") + 1).cast("bigint").alias("row_number"), cells.alias("cells"),
                        F.col("source_row_id"))

    @cached_property
    def quality_rows(self) -> DataFrame:
        """'Inward Quality Report' sheet: one row per inward line with seven measures; the lots of returned lines ('R')
        are written in a spelling that no lot has."""
        s = self.sample_lines.where(F.col("l_linestatus") == "O")
        blank = [F.lit("")]
        pct = lambda c, n=4: F.coalesce(F.format_number(c, n), F.lit("-"))
        cells = F.array(
            F.date_format("sample_on", "d-MMM-yyyy"), *blank,
            F.concat(F.when(F.col("l_returnflag") == "R", F.lit("L-")).otherwise(F.lit("LOT-")), F.col("lot_id").cast("string")),
            *blank * 4, F.format_number("represented_quantity_mt", 3), *blank * 2, pct("indicative_fe_raw"), *blank,
            pct("fe_raw"), pct("sio2_raw"), pct("al2o3_raw"), pct(F.col("sio2_raw") - 2), pct("al2o3_raw"), *blank * 2,
            pct("represented_quantity_mt", 3), *blank * 10, F.concat(pct(k("106") - F.col("al2o3_raw") * 4), F.lit("%")))
        return s.select(F.lit("quality_report").alias("file_name"), F.lit("Inward Quality Report").alias("sheet_name"),
                        (F.col("source_row_id") + 1).cast("bigint").alias("row_number"), cells.alias("cells"), "source_row_id")

    @cached_property
    def buyer_rows(self) -> DataFrame:
        """'Buyer Type' sheet: buyer, type and destination (the buyer's nation) per customer."""
        c = self.t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
        n = self.t.nation.select("n_nationkey", "n_name")
        j = c.join(n, c.c_nationkey == n.n_nationkey, "left")
        blank = [F.lit("")]
        cells = F.array(F.col("c_name"), F.col("c_mktsegment"), *blank * 5, F.coalesce(F.col("n_name"), F.lit("")))
        return j.select(F.lit("buyers").alias("file_name"), F.lit("Buyer Type").alias("sheet_name"),
                        (F.col("c_custkey") + 2).cast("bigint").alias("row_number"), cells.alias("cells"),
                        F.col("c_custkey").alias("source_row_id"))


class MaterializedLedger(StagedLedger):
    """A StagedLedger whose shared relations are written once (parquet, under the session's
    checkpoint folder) and read back, so the ~30 rule branches of the issue table read tables
    instead of re-deriving joins and aggregates from the raw scans.  For large runs."""

    SHARED = ("dispatches", "movements", "stock_snapshots", "cost_components", "quality_samples",
              "purchase_lots", "receipts", "sample_lines", "work_order_rows")

    def __init__(self, spark: SparkSession, sf_dir: str, root: str | None = None):
        super().__init__(spark, sf_dir)
        import uuid
        from .session import checkpoint_dir
        self.root = root or f"{checkpoint_dir(spark).rstrip('/')}/opsledger-facts/{uuid.uuid4().hex}"
        for name in self.SHARED:
            df = getattr(StagedLedger, name).func(self)
            df.write.mode("overwrite").parquet(f"{self.root}/{name}")
            self.__dict__[name] = spark.read.parquet(f"{self.root}/{name}")
