"""Sales, inward and auction figures on small tables with nulls, ties and shared permits."""

import datetime as dt
from decimal import Decimal as D

import pytest

from opsledger.operators import kpis

DAY = dt.date(2001, 6, 1)


@pytest.fixture(scope="module")
def sales(spark):
    orders = spark.createDataFrame(
        [(1, 9, DAY, D("100"), D("20"), D("3")), (2, 9, DAY, D("80"), None, D("2")), (3, 8, DAY, D("50"), D("50"), D("1")),
         (4, 8, DAY, D("10"), D("9.95"), None)],
        "sales_order_line_id long, customer_id long, po_date date, ordered_quantity_mt decimal(18,3), "
        "reported_dispatched_quantity_mt decimal(18,3), selling_rate_inr_per_mt decimal(18,4)")
    # order 1 names permit 5 twice and 6 once; order 2 a permit that does not exist; order 4 none
    dispatches = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, 7), (3, 5)], "sales_order_line_id long, permit_supplier_id long")
    permits = spark.createDataFrame([(5, D("60")), (6, D("20"))], "permit_id long, permitted_quantity_mt decimal(18,3)")
    return orders, dispatches, permits


def test_permit_ready_orders(sales):
    got = {r.sales_order_line_id: (r.balance_mt, r.available_permit_mt, r.permit_ready) for r in kpis.open_commitments(*sales, 2).collect()}
    assert got == {1: (D("80"), D("80"), True), 2: (D("80"), D("0"), False)}  # a tie goes by the order's number
    assert {r.sales_order_line_id for r in kpis.open_commitments(*sales, 9).collect()} == {1, 2, 4}  # 0.05 is open here


def test_sales_summary(sales):
    r = kpis.sales_summary(*sales).first()
    assert (r.pending_orders, r.pending_mt, r.revenue_waiting, r.permits_needed_mt, r.permit_ready_orders) == (2, D("160"), D("400"), D("80"), 1)
    none = kpis.sales_summary(sales[0].limit(0), *sales[1:]).first()
    assert (none.pending_orders, none.pending_mt, none.permit_ready_orders) == (0, None, 0)


def test_inward(spark):
    purchases = spark.createDataFrame(
        [(1, 10, D("5"), D("0"), dt.date(2001, 1, 1)), (1, 11, D("7"), D("-2"), DAY), (1, 12, D("0.1"), None, DAY),
         (2, 99, D("2"), None, None)],
        "supplier_id long, lot_id long, reported_balance_to_lift_mt decimal(18,3), reported_permit_balance_mt decimal(18,3), purchase_date date")
    lots = spark.createDataFrame([(10, D("100")), (11, None), (12, D("9"))], "lot_id long, lot_landed_cost decimal(18,4)")
    suppliers = spark.createDataFrame([(1, "A"), (2, "B")], "supplier_id long, legal_name string")
    per = {r.supplier: tuple(r[c] for c in ("pending_mt", "pending_lots", "pending_value", "aged_over_90_days", "aged_mt", "permit_gaps"))
           for r in kpis.inward_exposure(purchases, suppliers, lots, "2001-06-30").collect()}
    assert per == {"A": (D("12"), 2, D("500"), 1, D("5"), 1), "B": (D("2"), 1, D("0"), 0, D("0"), 1)}
    r = kpis.inward_summary(purchases, lots, "2001-06-30").first()
    assert (r.pending_mt, r.pending_lots, r.pending_value, r.aged_mt, r.permit_gaps) == (D("14"), 3, D("500"), D("5"), 2)


def test_auction_screen(spark):
    shape = ("auction_lot_id long, lot_id long, mine string, fe_pct decimal(8,4), offered_quantity_mt decimal(18,3), sold boolean, "
             "current_price decimal(18,4), landed_price decimal(18,4), premium_pct decimal(12,5)")
    rows = [(1, 1, "M", D("60"), D("5"), False, D("10"), D("30"), D("4")), (2, 1, "M", D("60"), D("6"), False, D("99"), D("20"), None),
            (3, 1, "N", D("60"), D("7"), True, D("1"), D("1"), D("2")), (4, 1, "N", D("57"), D("8"), False, D("1"), D("1"), D("3")),
            (5, 1, "O", D("60"), D("9"), False, D("0"), D("1"), D("50")), (6, 1, "P", D("60"), D("2"), False, D("7"), None, D("1"))]
    auctions = spark.createDataFrame(rows, shape)
    assert [r.auction_lot_id for r in kpis.auction_summary(auctions, 58).collect()] == [2, 1, 6]  # landed price, not current
    r = kpis.auction_overview(auctions, 58, 2).first()
    assert (r.lots, r.mines, r.mean_premium_pct, r.opportunity_mt) == (5, 3, D("2.00"), D("11"))
    none = kpis.auction_overview(auctions.limit(0), 58).first()
    assert (none.lots, none.mean_premium_pct, none.opportunity_mt) == (0, D("0"), D("0"))


def test_activity_of_a_range_and_its_limitation(spark):
    rows = [(1, "A", dt.date(2001, m, 1), metric, D(m)) for m in (3, 4, 5) for metric in ("ordered", "dispatched")]
    v5 = spark.createDataFrame(rows, "customer_id long, customer string, month date, metric string, quantity_mt decimal(18,3)")
    got = {r.metric: (r.total_mt, r.months, r.limitation) for r in kpis.customer_activity_in_range(v5, "2001-04").collect()}
    assert got == {m: (D("9"), 2, kpis.NO_EXTERNAL_DATA) for m in ("ordered", "dispatched")}
    other = spark.createDataFrame([(2, "B", dt.date(1999, 1, 1), "external_allocated", D(1))], v5.schema)
    got = kpis.customer_activity_in_range(v5.union(other), "2001-03", "2001-03").collect()
    assert [(r.total_mt, r.limitation) for r in got] == [(D("3"), None)] * 2  # external data of anyone lifts it
    assert kpis.customer_activity_in_range(v5, "2002-01").count() == 0


def test_quality_status(spark):
    shape = "rule_code string, severity string"
    rows = [("UNMAPPED_LOT", "critical"), ("MISSING_DISPATCH_LOT", "critical"), ("UNMAPPED_LOT", "critical")]
    r = kpis.quality_status(spark.createDataFrame(rows, shape)).first()
    assert tuple(r) == ("incomplete", 3, 1, 0, 2, 3)
    assert kpis.quality_status(spark.createDataFrame([*rows, ("STOCK_MISMATCH", "warning")], shape)).first().readiness == "incomplete"
    assert kpis.quality_status(spark.createDataFrame([("STOCK_MISMATCH", "info")], shape)).first().readiness == "flagged"
    assert tuple(kpis.quality_status(spark.createDataFrame([], shape)).first()) == ("verified", 0, 0, 0, 0, 0)


def test_permits_of_an_order_are_held_once(sales, spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    permits = kpis.available_permits(sales[1], sales[2])
    assert {r.sales_order_line_id: r.available_permit_mt for r in permits.collect()} == {1: D("80"), 3: D("60")}
    assert "HashAggregate(keys=[sales_order_line_id" in plan(permits) and ", permit_id" not in "".join(
        x for x in plan(permits).splitlines() if "HashAggregate" in x)  # no hash table of (order, permit) pairs
    # the k largest orders are known before the dispatches are dealt by order
    assert "LeftSemi" in plan(kpis.open_commitments(*sales, 2)) and "LeftSemi" not in plan(kpis.sales_summary(*sales))
    odd = spark.createDataFrame([(1, 5), (1, 5), (None, 5), (2, None), (2, 6), (2, 6)], "sales_order_line_id long, permit_supplier_id long")
    got = {r.sales_order_line_id: r.available_permit_mt for r in kpis.open_commitments(sales[0].union(sales[0]), odd, sales[2].union(sales[2]), 9).collect()}
    assert got == {1: D("120"), 2: D("40"), 4: D("0")}
