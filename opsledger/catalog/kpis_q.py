"""Registered KPI queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import StagedLedger
from ..operators import kpis, marts
from ..registry import register
from .marts_q import POSITIONS_SQL, V3_SQL, V4_SQL, V5_SQL, V6_SQL, V7_SQL, positions
from .rules_q import EXTRA as RULE_EXTRA, number_sql

EX = dict(RULE_EXTRA)
EX.update({"positions_r": POSITIONS_SQL, "v3_r": V3_SQL, "v4_r": V4_SQL, "v5_r": V5_SQL, "v6_r": V6_SQL,
           "v7_r": V7_SQL})
EX["c1_r"] = """
SELECT category, total_quantity_mt, quality_covered_quantity_mt, weighted_fe_pct, cost_covered_quantity_mt,
       weighted_landed_cost_inr_per_mt,
       CAST(round(cost_covered_quantity_mt * COALESCE(weighted_landed_cost_inr_per_mt, 0), 2) AS DECIMAL(20,2))
           AS stock_value, status
FROM v3_r"""
FY = 1998
PERIOD = ("1998-01-01", "1998-12-31")
MIN_AUCTION_GRADE = 45


def L(spark, sf_dir):
    return StagedLedger(spark, sf_dir)


@register("c1_stock_position", "SELECT * FROM c1_r", extra=EX)
def c1(spark, sf_dir):
    return kpis.stock_position(marts.stock_quality_cost(positions(L(spark, sf_dir))))


@register("c2_stock_position_all", """
SELECT 'all' AS category, CAST(sum(total_quantity_mt) AS DECIMAL(18,3)) AS total_quantity_mt,
       CAST(sum(COALESCE(quality_covered_quantity_mt, 0)) AS DECIMAL(18,3)) AS quality_covered_quantity_mt,
       CAST(CAST(sum(COALESCE(quality_covered_quantity_mt, 0) * COALESCE(weighted_fe_pct, 0)) AS DOUBLE)
            / NULLIF(CAST(sum(COALESCE(quality_covered_quantity_mt, 0)) AS DOUBLE), 0) AS DECIMAL(12,5)) AS weighted_fe_pct,
       CAST(sum(COALESCE(cost_covered_quantity_mt, 0)) AS DECIMAL(18,3)) AS cost_covered_quantity_mt,
       CAST(CAST(sum(COALESCE(cost_covered_quantity_mt, 0) * COALESCE(weighted_landed_cost_inr_per_mt, 0)) AS DOUBLE)
            / NULLIF(CAST(sum(COALESCE(cost_covered_quantity_mt, 0)) AS DOUBLE), 0) AS DECIMAL(18,4))
           AS weighted_landed_cost_inr_per_mt,
       CAST(round(sum(COALESCE(cost_covered_quantity_mt, 0) * COALESCE(weighted_landed_cost_inr_per_mt, 0)), 2)
            AS DECIMAL(20,2)) AS stock_value,
       CASE WHEN bool_and(status = 'verified') THEN 'verified' WHEN bool_or(status = 'incomplete') THEN 'incomplete'
            ELSE 'flagged' END AS status
FROM c1_r
UNION ALL SELECT * FROM c1_r""", extra=EX)
def c2(spark, sf_dir):
    return kpis.stock_position_with_all(c1(spark, sf_dir))


RANGE = ("1995-04", "1996-03")


@register("c5_customer_activity_in_range", f"""
SELECT customer_id, customer, metric, CAST(sum(quantity_mt) AS DECIMAL(18,3)) AS total_mt, count(DISTINCT month) AS months,
       CASE WHEN NOT EXISTS (SELECT 1 FROM v5_r WHERE metric = 'external_allocated') THEN '{kpis.NO_EXTERNAL_DATA}' END AS limitation
FROM v5_r WHERE strftime(month, '%Y-%m') BETWEEN '{RANGE[0]}' AND '{RANGE[1]}'
GROUP BY customer_id, customer, metric""", extra=EX)
def c5r(spark, sf_dir):
    x = L(spark, sf_dir)
    v5 = marts.customer_monthly_activity(x.sales_orders, x.dispatches, x.auction_awards, x.customers)
    return kpis.customer_activity_in_range(v5, *RANGE)


@register("c5_customer_activity_totals", """
SELECT p.*, r.first_month, r.last_month FROM (
  SELECT customer_id, customer,
         CAST(sum(quantity_mt) FILTER (WHERE metric = 'ordered') AS DECIMAL(18,3)) AS ordered,
         CAST(sum(quantity_mt) FILTER (WHERE metric = 'dispatched') AS DECIMAL(18,3)) AS dispatched,
         CAST(sum(quantity_mt) FILTER (WHERE metric = 'external_allocated') AS DECIMAL(18,3)) AS external_allocated
  FROM v5_r GROUP BY customer_id, customer) p
JOIN (SELECT customer_id, min(month) AS first_month, max(month) AS last_month FROM v5_r GROUP BY 1) r
  ON r.customer_id = p.customer_id""", extra=EX)
def c5(spark, sf_dir):
    x = L(spark, sf_dir)
    return kpis.customer_activity_totals(
        marts.customer_monthly_activity(x.sales_orders, x.dispatches, x.auction_awards, x.customers))


@register("c6_top_grade_deviations", """
SELECT * FROM v6_r ORDER BY abs(deviation_fe_points) DESC, comparison, actual_source_row_id, expected_source_row_id,
         house_lot_number, expected_fe_pct, actual_fe_pct LIMIT 30""", extra=EX)
def c6(spark, sf_dir):
    x = L(spark, sf_dir)
    return kpis.top_deviations(marts.quality_deviation(x.quality_samples, x.sales_orders, x.lots), 30)


@register("c7_dispatch_quality_coverage", """
SELECT count(*) AS dispatch_rows, count(q.fe_pct) AS rows_with_fe
FROM dispatches_r d LEFT JOIN (SELECT dispatch_id, fe_pct FROM quality_samples_r WHERE sample_stage = 'dispatch') q
  ON q.dispatch_id = d.dispatch_id""", extra=EX)
def c7(spark, sf_dir):
    x = L(spark, sf_dir)
    return kpis.dispatch_quality_coverage(x.dispatches, x.quality_samples)


@register("c8_top_issue_rules", """
SELECT rule_code, count(*) AS issue_count FROM issues_r GROUP BY rule_code
ORDER BY issue_count DESC, rule_code LIMIT 12""", extra=EX)
def c8(spark, sf_dir):
    from .rules_q import open_issue_table
    return kpis.top_rules(open_issue_table(spark, sf_dir), 12)


@register("c8_quality_status", """
SELECT CASE WHEN count(*) FILTER (WHERE regexp_matches(rule_code, '^(MISSING_|UNMAPPED_|INVALID_NUMBER)')) > 0 THEN 'incomplete'
            WHEN count(*) > 0 THEN 'flagged' ELSE 'verified' END AS readiness,
       count(*) AS open_issues, count(*) FILTER (WHERE rule_code = 'MISSING_DISPATCH_LOT') AS missing_dispatch_lot,
       count(*) FILTER (WHERE rule_code = 'MISSING_PRODUCTION_LOT') AS missing_production_lot,
       count(*) FILTER (WHERE rule_code = 'UNMAPPED_LOT') AS unmapped_lot,
       count(*) FILTER (WHERE rule_code IN ('MISSING_DISPATCH_LOT', 'MISSING_PRODUCTION_LOT', 'UNMAPPED_LOT')) AS lot_linkage
FROM issues_r""", extra=EX)
def c8s(spark, sf_dir):
    from .rules_q import open_issue_table
    return kpis.quality_status(open_issue_table(spark, sf_dir))


@register("c9_overview", """
SELECT * FROM
 (SELECT CAST(sum(available_quantity_mt) AS DECIMAL(18,3)) AS current_stock, count(*) AS stock_lots,
         CAST(round(sum(available_quantity_mt * COALESCE(landed_cost_inr_per_mt, 0)), 2) AS DECIMAL(24,2)) AS stock_value
  FROM positions_r),
 (SELECT CAST(sum(reported_balance_to_lift_mt) AS DECIMAL(18,3)) AS pending_inward, count(*) AS pending_purchase_lots
  FROM purchase_lots_r WHERE reported_balance_to_lift_mt > 0.1),
 (SELECT CAST(sum(b) AS DECIMAL(18,3)) AS pending_dispatch, count(*) AS pending_orders FROM
    (SELECT ordered_quantity_mt - COALESCE(reported_dispatched_quantity_mt, 0) AS b FROM sales_orders_r) WHERE b > 0.1),
 (SELECT total_feed, CASE WHEN total_feed > 0 THEN round(CAST(rec * 100 AS DOUBLE) / CAST(total_feed AS DOUBLE), 1)
                          ELSE 0.0 END AS recovery_pct
  FROM (SELECT CAST(sum(feed_quantity_mt) AS DECIMAL(18,3)) AS total_feed, sum(recovered_quantity_mt) AS rec FROM v7_r)),
 (SELECT count(*) AS buyer_count FROM customers_r),
 (SELECT count(*) AS auction_lots FROM auction_lots_r)""", extra=EX)
def c9(spark, sf_dir):
    x = L(spark, sf_dir)
    v7 = marts.production_recovery(x.production_runs, x.production_inputs, x.production_outputs)
    return kpis.overview(positions(x), x.purchase_lots, x.sales_orders, v7, x.customers, x.auction_lots)


@register("c10_supplier_quality", """
SELECT supplier_id, count(*) AS records,
       CAST(round(avg(fe_raw - indicative_fe_raw), 2) AS DECIMAL(12,2)) AS average_difference,
       CAST(round(avg(CASE WHEN fe_raw - indicative_fe_raw < 0 THEN 1 ELSE 0 END) * 100, 1) AS DECIMAL(6,1)) AS below_share,
       count(*) FILTER (WHERE fe_raw - indicative_fe_raw < -1) AS severe_variance
FROM sample_lines_r
WHERE l_linestatus = 'O' AND fe_raw BETWEEN 0 AND 100 AND indicative_fe_raw BETWEEN 0 AND 100
GROUP BY supplier_id""", extra=EX)
def c10(spark, sf_dir):
    return kpis.supplier_quality(L(spark, sf_dir).sample_lines)


EX["opportunities_r"] = f"""
SELECT auction_lot_id, lot_id, mine, fe_pct, offered_quantity_mt AS balance_mt, current_price, landed_price, premium_pct
FROM auction_lots_r WHERE current_price <> 0 AND fe_pct <> 0 AND NOT sold AND offered_quantity_mt > 0 AND fe_pct >= {MIN_AUCTION_GRADE}
ORDER BY landed_price, auction_lot_id LIMIT 12"""


@register("c17_auction_opportunities", "SELECT * FROM opportunities_r", extra=EX)
def c17(spark, sf_dir):
    return kpis.auction_summary(L(spark, sf_dir).auction_lots, MIN_AUCTION_GRADE, 12)


@register("c17_auction_overview", """
SELECT count(*) AS lots, count(DISTINCT mine) AS mines,
       CAST(COALESCE(CAST(sum(premium_pct) AS DOUBLE) / NULLIF(CAST(count(*) AS DOUBLE), 0), 0) AS DECIMAL(12,2)) AS mean_premium_pct,
       CAST(COALESCE((SELECT sum(balance_mt) FROM opportunities_r), 0) AS DECIMAL(18,3)) AS opportunity_mt
FROM auction_lots_r WHERE current_price <> 0 AND fe_pct <> 0""", extra=EX)
def c17o(spark, sf_dir):
    return kpis.auction_overview(L(spark, sf_dir).auction_lots, MIN_AUCTION_GRADE, 12)


@register("c17_mean_price_by_mine", """
SELECT mine, count(*) AS lots, CAST(round(avg(current_price), 2) AS DECIMAL(18,2)) AS mean_price,
       CAST(round(avg(current_price - opening_price), 2) AS DECIMAL(18,2)) AS mean_premium
FROM auction_lots_r WHERE current_price <> 0 AND fe_pct <> 0
GROUP BY mine ORDER BY mean_price DESC, mine LIMIT 7""", extra=EX)
def c17b(spark, sf_dir):
    return kpis.mean_price_by_mine(L(spark, sf_dir).auction_lots, 7)


@register("c20_customer_ranking", """
SELECT p.customer_id, p.ordered_mt, p.dispatched_mt, p.realised_value, c.legal_name AS customer,
       CAST(CAST(p.dispatched_mt * 100 AS DOUBLE) / NULLIF(CAST(p.ordered_mt AS DOUBLE), 0) AS DECIMAL(12,1))
           AS completion_pct
FROM (SELECT s.customer_id, CAST(sum(s.ordered_quantity_mt) AS DECIMAL(18,3)) AS ordered_mt,
             CAST(sum(COALESCE(d.q, 0)) AS DECIMAL(18,3)) AS dispatched_mt,
             CAST(round(sum(COALESCE(d.q, 0) * s.selling_rate_inr_per_mt), 2) AS DECIMAL(24,2)) AS realised_value
      FROM sales_orders_r s
      LEFT JOIN (SELECT sales_order_line_id, sum(quantity_mt) AS q FROM dispatches_r GROUP BY 1) d
        ON d.sales_order_line_id = s.sales_order_line_id
      GROUP BY s.customer_id) p
JOIN customers_r c ON c.customer_id = p.customer_id
ORDER BY p.ordered_mt DESC, p.customer_id LIMIT 12""", extra=EX)
def c20(spark, sf_dir):
    x = L(spark, sf_dir)
    return kpis.customer_ranking(x.sales_orders, x.dispatches, x.customers, 12)


@register("c20_buyers_by_type", """
SELECT buyer_type, count(*) AS buyers FROM customers_r GROUP BY buyer_type ORDER BY buyers DESC, buyer_type LIMIT 8""",
          extra=EX)
def c20b(spark, sf_dir):
    return kpis.buyers_by_type(L(spark, sf_dir).customers, 8)


@register("c21_monthly_ordered_vs_dispatched", f"""
SELECT month, CAST(sum(quantity_mt) FILTER (WHERE metric = 'ordered') AS DECIMAL(18,3)) AS ordered,
       CAST(sum(quantity_mt) FILTER (WHERE metric = 'dispatched') AS DECIMAL(18,3)) AS dispatched
FROM v5_r WHERE year(month) - CASE WHEN month(month) < 4 THEN 1 ELSE 0 END = {FY}
GROUP BY month HAVING count(*) FILTER (WHERE metric IN ('ordered', 'dispatched')) > 0""", extra=EX)
def c21(spark, sf_dir):
    x = L(spark, sf_dir)
    v5 = marts.customer_monthly_activity(x.sales_orders, x.dispatches, x.auction_awards, x.customers)
    return kpis.monthly_ordered_vs_dispatched(v5, FY)


@register("c22_coverage", """
SELECT CAST(CAST(sum(quality_covered_quantity_mt) * 100 AS DOUBLE) / NULLIF(CAST(sum(total_quantity_mt) AS DOUBLE), 0)
            AS DECIMAL(8,2)) AS quality_coverage_pct,
       CAST(CAST(sum(cost_covered_quantity_mt) * 100 AS DOUBLE) / NULLIF(CAST(sum(total_quantity_mt) AS DOUBLE), 0)
            AS DECIMAL(8,2)) AS cost_coverage_pct
FROM v3_r""", extra=EX)
def c22(spark, sf_dir):
    from ..operators.common import ratio
    v3 = marts.stock_quality_cost(positions(L(spark, sf_dir)))
    return v3.agg(ratio(F.sum("quality_covered_quantity_mt") * 100, F.sum("total_quantity_mt"), "decimal(8,2)")
                  .alias("quality_coverage_pct"),
                  ratio(F.sum("cost_covered_quantity_mt") * 100, F.sum("total_quantity_mt"), "decimal(8,2)")
                  .alias("cost_coverage_pct"))


@register("c23_lead_time_by_customer", """
SELECT d.customer_id, c.legal_name AS customer, count(*) AS dispatch_count,
       CAST(round(CAST(sum(d.dispatch_on - s.po_date) AS DECIMAL(38,0)) / count(*), 1) AS DECIMAL(12,1))
           AS avg_days_order_to_dispatch
FROM dispatches_r d JOIN sales_orders_r s ON s.sales_order_line_id = d.sales_order_line_id
JOIN customers_r c ON c.customer_id = d.customer_id
WHERE d.dispatch_on >= s.po_date GROUP BY d.customer_id, c.legal_name""", extra=EX)
def c23(spark, sf_dir):
    x = L(spark, sf_dir)
    return kpis.lead_time_by_customer(x.dispatches, x.sales_orders, x.customers)


@register("c24_top_buyer_in_period", f"""
SELECT d.customer_id, CAST(sum(d.quantity_mt) AS DECIMAL(18,3)) AS dispatched_quantity_mt,
       count(*) AS dispatch_count, c.legal_name AS customer
FROM dispatches_r d JOIN customers_r c ON c.customer_id = d.customer_id
WHERE d.dispatch_on BETWEEN DATE '{PERIOD[0]}' AND DATE '{PERIOD[1]}'
GROUP BY d.customer_id, c.legal_name ORDER BY dispatched_quantity_mt DESC, d.customer_id LIMIT 1""", extra=EX)
def c24(spark, sf_dir):
    x = L(spark, sf_dir)
    return kpis.top_buyer_in_period(x.dispatches, x.customers, *PERIOD)


@register("c25_transporter_ranking", f"""
SELECT transporter, CAST(sum(awarded_quantity_mt) AS DECIMAL(18,3)) AS assigned_quantity_mt,
       count(*) AS work_orders, count({number_sql('rate_text')}) AS rated_orders,
       round(avg({number_sql('rate_text')}), 2) AS average_rate
FROM work_orders_r GROUP BY transporter""", extra=EX)
def c25(spark, sf_dir):
    return kpis.transporter_ranking(marts.transporter_work_orders(L(spark, sf_dir).work_order_rows))


EX["asp_r"] = """SELECT asp_month, asp, lead(asp_month) OVER (ORDER BY asp_month) AS valid_to FROM (
    SELECT CAST(date_trunc('month', closes_on) AS DATE) AS asp_month,
           CAST(round(avg(current_price), 4) AS DECIMAL(18,4)) AS asp FROM auction_lots_r GROUP BY 1)"""


@register("c26_asp_levies", """
SELECT p.supplier_id, p.lot_id, p.purchase_date, a.asp_month, a.asp,
       CAST(a.asp * 0.15 AS DECIMAL(18,4)) AS royalty,
       CAST(CAST(a.asp * 0.15 AS DECIMAL(18,4)) * 0.30 AS DECIMAL(18,4)) AS dmf,
       CAST(CAST(a.asp * 0.15 AS DECIMAL(18,4)) * 0.03 AS DECIMAL(18,4)) AS nmet
FROM purchase_lots_r p LEFT JOIN asp_r a
  ON date_trunc('month', p.purchase_date) > a.asp_month
     AND (a.valid_to IS NULL OR date_trunc('month', p.purchase_date) <= a.valid_to)""", extra=EX)
def c26(spark, sf_dir):
    x = L(spark, sf_dir)
    return kpis.asp_levies(x.purchase_lots, x.auction_lots)


AS_OF = "2002-01-01"


@register("c12_quality_kpis", """
SELECT count(*) AS records,
       CAST(round(avg(CASE WHEN fe_raw BETWEEN 0 AND 100 THEN fe_raw END), 2) AS DECIMAL(12,2)) AS average_fe,
       count(*) FILTER (WHERE (CASE WHEN fe_raw BETWEEN 0 AND 100 THEN fe_raw END)
                              - (CASE WHEN indicative_fe_raw BETWEEN 0 AND 100 THEN indicative_fe_raw END) < 0)
           AS below_indicative,
       count(*) FILTER (WHERE (CASE WHEN fe_raw BETWEEN 0 AND 100 THEN fe_raw END)
                              - (CASE WHEN indicative_fe_raw BETWEEN 0 AND 100 THEN indicative_fe_raw END) < -1)
           AS severe_variance
FROM sample_lines_r WHERE l_linestatus = 'O'""", extra=EX)
def c12(spark, sf_dir):
    return kpis.quality_kpis(L(spark, sf_dir).sample_lines)


@register("c13_stock_by_product", """
SELECT category AS product, CAST(sum(available_quantity_mt) AS DECIMAL(18,3)) AS quantity_mt, count(*) AS lots
FROM positions_r GROUP BY category ORDER BY quantity_mt DESC, product LIMIT 5""", extra=EX)
def c13(spark, sf_dir):
    return kpis.stock_by_product(positions(L(spark, sf_dir)), 5)


@register("c13_stock_by_status", """
SELECT quality_status, cost_status, CAST(sum(available_quantity_mt) AS DECIMAL(18,3)) AS quantity_mt, count(*) AS lots
FROM positions_r GROUP BY 1, 2""", extra=EX)
def c13s(spark, sf_dir):
    return kpis.stock_by_status(positions(L(spark, sf_dir)))


EX["open_orders_r"] = """
SELECT *, COALESCE(permit, 0) AS available_permit_mt, COALESCE(permit, 0) >= balance_mt AS permit_ready
FROM (SELECT *, CAST(ordered_quantity_mt - COALESCE(reported_dispatched_quantity_mt, 0) AS DECIMAL(18,3)) AS balance_mt
      FROM sales_orders_r) o LEFT JOIN (
    SELECT order_id, CAST(sum(permitted_quantity_mt) AS DECIMAL(18,3)) AS permit
    FROM (SELECT DISTINCT sales_order_line_id AS order_id, permit_supplier_id FROM dispatches_r) d
    JOIN permits_r ON permit_id = permit_supplier_id GROUP BY order_id) p ON p.order_id = o.sales_order_line_id"""


@register("c14_open_commitments", """
SELECT sales_order_line_id, customer_id, po_date, balance_mt, CAST(available_permit_mt AS DECIMAL(18,3)) AS available_permit_mt,
       permit_ready, CAST(round(balance_mt * selling_rate_inr_per_mt, 2) AS DECIMAL(24,2)) AS revenue_waiting
FROM open_orders_r WHERE balance_mt > 0 ORDER BY balance_mt DESC, sales_order_line_id LIMIT 5""", extra=EX)
def c14(spark, sf_dir):
    x = L(spark, sf_dir)
    return kpis.open_commitments(x.sales_orders, x.dispatches, x.permits, 5)


_INWARD = f"""CAST(sum(reported_balance_to_lift_mt) AS DECIMAL(18,3)) AS pending_mt, count(*) AS pending_lots,
       CAST(round(sum(reported_balance_to_lift_mt * COALESCE(lot_landed_cost, 0)), 2) AS DECIMAL(24,2)) AS pending_value,
       count(*) FILTER (WHERE DATE '{AS_OF}' - purchase_date > 90) AS aged_over_90_days,
       CAST(COALESCE(sum(reported_balance_to_lift_mt) FILTER (WHERE DATE '{AS_OF}' - purchase_date > 90), 0) AS DECIMAL(18,3)) AS aged_mt,
       count(*) FILTER (WHERE COALESCE(reported_permit_balance_mt, 0) = 0) AS permit_gaps"""


@register("c15_inward_exposure", f"""
SELECT p.supplier_id, {_INWARD}, s.legal_name AS supplier
FROM purchase_lots_r p JOIN suppliers_r s ON s.supplier_id = p.supplier_id LEFT JOIN lots_r l ON l.lot_id = p.lot_id
WHERE reported_balance_to_lift_mt > 0.1 GROUP BY p.supplier_id, s.legal_name""", extra=EX)
def c15(spark, sf_dir):
    x = L(spark, sf_dir)
    return kpis.inward_exposure(x.purchase_lots, x.suppliers, x.lots, AS_OF)


@register("c15_inward_summary", f"""
SELECT {_INWARD} FROM purchase_lots_r p LEFT JOIN lots_r l ON l.lot_id = p.lot_id
WHERE reported_balance_to_lift_mt > 0.1""", extra=EX)
def c15s(spark, sf_dir):
    x = L(spark, sf_dir)
    return kpis.inward_summary(x.purchase_lots, x.lots, AS_OF)


@register("c18_quality_concerns", """
SELECT * FROM v6_r WHERE comparison = 'inbound_vs_indicative' AND deviation_fe_points < -1
ORDER BY deviation_fe_points, actual_source_row_id, expected_source_row_id, house_lot_number LIMIT 30""", extra=EX)
def c18(spark, sf_dir):
    x = L(spark, sf_dir)
    return kpis.quality_concerns(marts.quality_deviation(x.quality_samples, x.sales_orders, x.lots), 30)


@register("c19_production_summary", """
SELECT r.source_material_name, count(*) AS runs, CAST(sum(v.feed_quantity_mt) AS DECIMAL(18,3)) AS feed_mt,
       CAST(sum(v.recovered_quantity_mt) AS DECIMAL(18,3)) AS recovered_mt,
       CAST(sum(v.tailings_quantity_mt) AS DECIMAL(18,3)) AS tailings_mt,
       CAST(CAST(CAST(sum(v.recovered_quantity_mt) AS DECIMAL(18,3)) * 100 AS DOUBLE)
            / NULLIF(CAST(CAST(sum(v.feed_quantity_mt) AS DECIMAL(18,3)) AS DOUBLE), 0) AS DECIMAL(12,1)) AS recovery_pct
FROM v7_r v JOIN production_runs_r r ON r.production_run_id = v.production_run_id
GROUP BY r.source_material_name""", extra=EX)
def c19(spark, sf_dir):
    x = L(spark, sf_dir)
    v7 = marts.production_recovery(x.production_runs, x.production_inputs, x.production_outputs)
    return kpis.production_summary(v7, x.production_runs)


@register("c19_latest_runs", """
SELECT * FROM v7_r ORDER BY run_date DESC, production_run_id DESC LIMIT 20""", extra=EX)
def c19l(spark, sf_dir):
    x = L(spark, sf_dir)
    return kpis.latest_runs(marts.production_recovery(x.production_runs, x.production_inputs, x.production_outputs), 20)


@register("c26_closing_stock_rollforward", """
SELECT lot_id, business_date,
       CAST(COALESCE(sum(net_mt) OVER (PARTITION BY lot_id ORDER BY business_date
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DECIMAL(18,3)) AS opening_mt,
       inward_mt, outward_mt,
       CAST(sum(net_mt) OVER (PARTITION BY lot_id ORDER BY business_date
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,3)) AS closing_mt
FROM (SELECT lot_id, occurred_on AS business_date,
             CAST(sum(CASE WHEN direction = 'in' THEN quantity_mt ELSE 0 END) AS DECIMAL(18,3)) AS inward_mt,
             CAST(sum(CASE WHEN direction <> 'in' THEN quantity_mt ELSE 0 END) AS DECIMAL(18,3)) AS outward_mt,
             CAST(sum(CASE WHEN direction = 'in' THEN quantity_mt ELSE 0 END)
                  - sum(CASE WHEN direction <> 'in' THEN quantity_mt ELSE 0 END) AS DECIMAL(18,3)) AS net_mt
      FROM movements_r GROUP BY lot_id, occurred_on)""", extra=EX)
def c26r(spark, sf_dir):
    return kpis.closing_stock_rollforward(L(spark, sf_dir).movements)


@register("c26_old_stock", f"""
SELECT p.lot_id, p.category, p.available_quantity_mt, m.last_inward_on,
       CAST(DATE '{AS_OF}' - m.last_inward_on AS INTEGER) AS age_days
FROM positions_r p LEFT JOIN (SELECT lot_id, max(occurred_on) AS last_inward_on FROM movements_r
                              WHERE direction = 'in' GROUP BY lot_id) m ON m.lot_id = p.lot_id
WHERE m.last_inward_on IS NULL OR DATE '{AS_OF}' - m.last_inward_on > 30""", extra=EX)
def c26o(spark, sf_dir):
    x = L(spark, sf_dir)
    return kpis.old_stock(positions(x), x.movements, AS_OF, 30)


@register("c11_transporter_summary", f"""
SELECT transporter, count(*) AS work_orders, round(avg({number_sql('rate_text')}), 2) AS average_rate,
       'incomplete: delivery dates are not present' AS status
FROM work_orders_r GROUP BY transporter""", extra=EX)
def c11(spark, sf_dir):
    return kpis.transporter_summary(marts.transporter_work_orders(L(spark, sf_dir).work_order_rows))


@register("c16_sales_summary", """
SELECT count(*) AS pending_orders, CAST(sum(balance_mt) AS DECIMAL(18,3)) AS pending_mt,
       CAST(round(sum(balance_mt * selling_rate_inr_per_mt), 2) AS DECIMAL(24,2)) AS revenue_waiting,
       CAST(sum(greatest(balance_mt - available_permit_mt, 0)) AS DECIMAL(18,3)) AS permits_needed_mt,
       count(*) FILTER (WHERE permit_ready) AS permit_ready_orders
FROM open_orders_r WHERE balance_mt > 0.1""", extra=EX)
def c16(spark, sf_dir):
    x = L(spark, sf_dir)
    return kpis.sales_summary(x.sales_orders, x.dispatches, x.permits)


@register("c27_inventory_page_rows", """
SELECT p.lot_id, l.house_lot_number, p.category, p.available_quantity_mt, p.fe_pct, p.landed_cost_inr_per_mt,
       p.quality_status, p.cost_status, 'lineitem.parquet' AS source_file, 'latest snapshot' AS source_sheet,
       p.source_row_id
FROM positions_r p JOIN lots_r l ON l.lot_id = p.lot_id""", extra=EX)
def c27(spark, sf_dir):
    """The inventory page's normalised rows, each with its source reference."""
    x = L(spark, sf_dir)
    return positions(x).join(x.lots.select("lot_id", "house_lot_number"), "lot_id").select(
        "lot_id", "house_lot_number", "category", "available_quantity_mt", "fe_pct", "landed_cost_inr_per_mt",
        "quality_status", "cost_status", F.lit("lineitem.parquet").alias("source_file"),
        F.lit("latest snapshot").alias("source_sheet"), "source_row_id")


@register("c26_pending_payment", """
SELECT p.supplier_id, p.lot_id, p.purchase_date,
       CAST(l.lot_landed_cost + COALESCE(CAST(a.asp * 0.15 AS DECIMAL(18,4)), 0)
            + COALESCE(CAST(CAST(a.asp * 0.15 AS DECIMAL(18,4)) * 0.30 AS DECIMAL(18,4)), 0)
            + COALESCE(CAST(CAST(a.asp * 0.15 AS DECIMAL(18,4)) * 0.03 AS DECIMAL(18,4)), 0) + 50 AS DECIMAL(18,4))
           AS payable_per_mt,
       CAST(round(p.purchased_quantity_mt * (l.lot_landed_cost + COALESCE(CAST(a.asp * 0.15 AS DECIMAL(18,4)), 0)
            + COALESCE(CAST(CAST(a.asp * 0.15 AS DECIMAL(18,4)) * 0.30 AS DECIMAL(18,4)), 0)
            + COALESCE(CAST(CAST(a.asp * 0.15 AS DECIMAL(18,4)) * 0.03 AS DECIMAL(18,4)), 0) + 50), 2) AS DECIMAL(24,2))
           AS pending_payment
FROM purchase_lots_r p JOIN lots_r l ON l.lot_id = p.lot_id
LEFT JOIN asp_r a ON date_trunc('month', p.purchase_date) > a.asp_month
  AND (a.valid_to IS NULL OR date_trunc('month', p.purchase_date) <= a.valid_to)""",
          extra=EX)
def c26p(spark, sf_dir):
    x = L(spark, sf_dir)
    return kpis.pending_payment(kpis.asp_levies(x.purchase_lots, x.auction_lots), x.purchase_lots, x.lots)
