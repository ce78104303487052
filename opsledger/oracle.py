"""The canonical-relation mapping of `opsledger.adapters`, written in plain SQL.

`with_relations(sql)` prefixes a query with the CTEs it names (and their
dependencies), so oracle queries read like the reference's views.  Only the
driver's pre-registered views (lineitem, orders, part, ...) are referenced.
"""

from __future__ import annotations

import re

SRC = "l_row"
UNIT = ("CAST(CAST((CAST(round(l_extendedprice * 100) AS BIGINT) * 200 + CAST(l_quantity AS BIGINT))"
        " // (2 * CAST(l_quantity AS BIGINT)) AS DECIMAL(18,0)) * 0.0001 AS DECIMAL(18,4))")

SAMPLED = ("CASE WHEN l_returnflag = 'R' THEN CAST(CAST(l_quantity AS DECIMAL(18,3)) * (1 - CAST(l_tax AS DECIMAL(18,2)))"
           " AS DECIMAL(18,3)) ELSE CAST(l_quantity AS DECIMAL(18,3)) END")

RELATIONS: dict[str, str] = {
    "lineitem_r": "SELECT *, row_number() OVER () AS l_row FROM lineitem",
    "customers_r": """
        SELECT c_custkey AS customer_id, c_name AS legal_name, c_mktsegment AS buyer_type,
               c_custkey AS source_row_id
        FROM customer""",
    "suppliers_r": """
        SELECT s_suppkey AS supplier_id, s_name AS legal_name, s_suppkey AS source_row_id
        FROM supplier""",
    "lots_r": """
        SELECT p_partkey AS lot_id, 'LOT-' || CAST(p_partkey AS VARCHAR) AS house_lot_number,
               p_name AS description, lower(p_type) AS category, CAST(p_size AS VARCHAR) AS size_spec,
               'iron_ore:' || lower(p_type) || ':' || CAST(p_size AS VARCHAR) AS material_code,
               CAST(p_size AS DECIMAL(8,4)) AS lot_fe_pct,
               CAST(p_retailprice AS DECIMAL(18,4)) AS lot_landed_cost, p_partkey AS source_row_id
        FROM part""",
    "movements_r": f"""
        SELECT {SRC} AS movement_id, l_partkey AS lot_id,
               CASE WHEN l_linestatus = 'O' THEN 'in' ELSE 'out' END AS direction,
               l_returnflag AS event_type, CAST(l_quantity AS DECIMAL(18,3)) AS quantity_mt,
               CAST(l_shipdate AS DATE) AS occurred_on, {SRC} AS source_row_id
        FROM lineitem_r""",
    "sales_orders_r": """
        SELECT o_orderkey AS sales_order_line_id, o_custkey AS customer_id,
               CAST(o_orderkey AS VARCHAR) AS po_number, CAST(o_orderdate AS DATE) AS po_date,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 0.0005 AS DECIMAL(18,3)) AS ordered_quantity_mt,
               CASE WHEN o_orderstatus <> 'O' THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 0.0004 AS DECIMAL(18,3)) END
                   AS reported_dispatched_quantity_mt,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 0.000125 AS DECIMAL(8,4)) AS target_fe_pct,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 0.01 AS DECIMAL(18,4)) AS selling_rate_inr_per_mt,
               o_orderstatus AS order_status, o_orderkey AS source_row_id
        FROM orders""",
    "dispatches_r": f"""
        SELECT {SRC} AS dispatch_id, CAST(l_shipdate AS DATE) AS dispatch_on, o_custkey AS customer_id,
               l_orderkey AS sales_order_line_id,
               CASE WHEN l_returnflag <> 'N' THEN l_partkey END AS lot_id,
               l_suppkey AS permit_supplier_id, CAST(l_quantity AS DECIMAL(18,3)) AS quantity_mt,
               l_linenumber AS vehicle_count, {SRC} AS source_row_id
        FROM lineitem_r JOIN orders ON l_orderkey = o_orderkey""",
    "permits_r": """
        SELECT s_suppkey AS permit_id, 'P-' || CAST(s_suppkey AS VARCHAR) AS permit_number,
               'outward' AS direction, CAST(CAST(s_acctbal AS DECIMAL(18,2)) * 2 AS DECIMAL(18,3)) AS permitted_quantity_mt,
               s_suppkey AS source_row_id
        FROM supplier WHERE s_acctbal > 0""",
    "stock_snapshots_r": f"""
        SELECT make_date(CAST(y AS INTEGER), 12, 31) AS snapshot_on, l_partkey AS lot_id, recorded_quantity_mt,
               CAST(p_size AS DECIMAL(8,4)) AS reported_fe_pct,
               CAST(p_retailprice AS DECIMAL(18,4)) AS reported_landed_cost_inr_per_mt, source_row_id
        FROM (SELECT year(l_shipdate) AS y, l_partkey,
                     CAST(sum(CAST(l_quantity AS DECIMAL(18,3))) AS DECIMAL(18,3)) AS recorded_quantity_mt,
                     max({SRC}) AS source_row_id
              FROM lineitem_r GROUP BY 1, 2) s
        JOIN part ON l_partkey = p_partkey""",
    "cost_components_r": f"""
        SELECT {SRC} AS component_id, l_partkey AS lot_id, l_returnflag AS component_code,
               {UNIT} AS rate_inr_per_mt,
               CAST(l_shipdate AS DATE) AS effective_on, l_returnflag <> 'N' AS included_in_landed_cost,
               CASE WHEN l_linestatus = 'F' THEN 'approved' ELSE 'reported' END AS approval_status,
               {SRC} AS source_row_id
        FROM lineitem_r
        UNION ALL
        SELECT source_row_id, lot_id, 'REPORTED_LANDED_COST', reported_landed_cost_inr_per_mt, snapshot_on,
               false, 'reported', source_row_id
        FROM stock_snapshots_r""",
    "sample_lines_r": f"""
        SELECT {SRC} AS source_row_id, l_partkey AS lot_id, l_linestatus, l_returnflag, l_orderkey,
               l_suppkey AS supplier_id,
               CAST(l_shipdate AS DATE) AS sample_on, {SAMPLED} AS represented_quantity_mt,
               CAST({UNIT} * 0.05 AS DECIMAL(8,4)) AS fe_raw,
               CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 0.05 AS DECIMAL(8,4)) AS indicative_fe_raw,
               CAST(CAST(l_discount AS DECIMAL(18,2)) * 100 AS DECIMAL(8,4)) AS sio2_raw,
               CAST(CAST(l_tax AS DECIMAL(18,2)) * 100 AS DECIMAL(8,4)) AS al2o3_raw
        FROM lineitem_r JOIN part ON l_partkey = p_partkey""",
    "quality_samples_r": """
        SELECT source_row_id, lot_id, sample_on, represented_quantity_mt, 'indicative' AS sample_stage,
               CASE WHEN indicative_fe_raw BETWEEN 0 AND 100 THEN indicative_fe_raw END AS fe_pct,
               CAST(NULL AS DECIMAL(8,4)) AS sio2_pct, CAST(NULL AS DECIMAL(8,4)) AS al2o3_pct,
               true AS approved, CAST(NULL AS BIGINT) AS dispatch_id,
               CAST(NULL AS BIGINT) AS dispatch_lot_id, CAST(NULL AS BIGINT) AS sales_order_line_id
        FROM sample_lines_r WHERE l_linestatus = 'O'
        UNION ALL
        SELECT source_row_id, lot_id, sample_on, represented_quantity_mt, 'inward',
               CASE WHEN fe_raw BETWEEN 0 AND 100 THEN fe_raw END,
               CASE WHEN sio2_raw BETWEEN 0 AND 100 THEN sio2_raw END,
               CASE WHEN al2o3_raw BETWEEN 0 AND 100 THEN al2o3_raw END,
               l_returnflag <> 'R', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
        FROM sample_lines_r WHERE l_linestatus = 'O'
        UNION ALL
        SELECT source_row_id, lot_id, sample_on, represented_quantity_mt, 'dispatch',
               CASE WHEN fe_raw BETWEEN 0 AND 100 THEN fe_raw END,
               CASE WHEN sio2_raw BETWEEN 0 AND 100 THEN sio2_raw END,
               CASE WHEN al2o3_raw BETWEEN 0 AND 100 THEN al2o3_raw END,
               l_returnflag <> 'R', source_row_id,
               CASE WHEN l_returnflag <> 'N' THEN lot_id END, l_orderkey
        FROM sample_lines_r WHERE l_linestatus = 'F'""",
    "production_runs_r": """
        SELECT o_orderkey AS production_run_id, CAST(o_orderdate AS DATE) AS run_date, o_orderstatus AS shift,
               o_orderpriority AS process, o_orderpriority AS source_material_name,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 0.00025 AS DECIMAL(8,4)) AS reported_recovery_pct, o_orderkey AS source_row_id
        FROM orders""",
    "production_inputs_r": f"""
        SELECT l_orderkey AS production_run_id, l_partkey AS lot_id,
               CAST(l_extendedprice AS DECIMAL(18,3)) AS quantity_mt, {SRC} AS source_row_id
        FROM lineitem_r""",
    "production_outputs_r": f"""
        SELECT l_orderkey AS production_run_id, 'recovered_total' AS output_type,
               CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))) AS DECIMAL(18,3)) AS quantity_mt, {SRC} AS source_row_id
        FROM lineitem_r
        UNION ALL
        SELECT l_orderkey, 'tailings', CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2)) AS DECIMAL(18,3)), {SRC}
        FROM lineitem_r WHERE CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2)) > 0""",
    "purchase_lots_r": f"""
        SELECT l_suppkey AS supplier_id, l_partkey AS lot_id,
               CAST(sum(CAST(l_quantity AS DECIMAL(18,3))) AS DECIMAL(18,3)) AS purchased_quantity_mt,
               CAST(sum(CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS DECIMAL(18,3)) ELSE 0 END)
                    AS DECIMAL(18,3)) AS reported_lifted_quantity_mt,
               CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS DECIMAL(18,3)) ELSE 0 END)
                    - sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS DECIMAL(18,3)) ELSE 0 END)
                    AS DECIMAL(18,3)) AS reported_balance_to_lift_mt,
               CAST(sum((CAST(l_discount AS DECIMAL(18,2)) - 0.05) * CAST(l_quantity AS DECIMAL(18,3))) AS DECIMAL(18,3)) AS reported_payment_balance_mt,
               CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS DECIMAL(18,3)) ELSE 0 END)
                    - sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS DECIMAL(18,3)) ELSE 0 END)
                    AS DECIMAL(18,3)) AS reported_permit_balance_mt,
               min(CAST(l_shipdate AS DATE)) AS purchase_date, min({SRC}) AS source_row_id
        FROM lineitem_r GROUP BY l_suppkey, l_partkey""",
    "receipts_r": f"""
        SELECT {SRC} AS receipt_id, CAST(l_shipdate AS DATE) AS receipt_on, l_suppkey AS supplier_id,
               l_partkey AS lot_id, CAST(l_quantity AS DECIMAL(18,3)) AS quantity_mt,
               l_linenumber AS trip_count, {SRC} AS source_row_id
        FROM lineitem_r""",
    "auction_awards_r": f"""
        SELECT {SRC} AS auction_lot_id, CAST(l_shipdate AS DATE) AS closes_on, o_custkey AS buyer_id,
               CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) END AS event_on,
               CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS DECIMAL(18,3)) END AS allocated_quantity_mt,
               CAST(l_quantity AS DECIMAL(18,3)) AS bid_quantity_mt, {SRC} AS source_row_id
        FROM lineitem_r JOIN orders ON l_orderkey = o_orderkey""",
    "auction_lots_r": f"""
        SELECT {SRC} AS auction_lot_id, CAST(l_shipdate AS DATE) AS closes_on, l_partkey AS lot_id,
               s_name AS mine, CAST(p_size AS DECIMAL(8,4)) AS fe_pct,
               CAST(l_quantity AS DECIMAL(18,3)) AS offered_quantity_mt, l_linestatus = 'F' AS sold,
               CAST(p_retailprice AS DECIMAL(18,4)) AS opening_price,
               {UNIT} AS current_price,
               CAST(CAST(p_retailprice AS DECIMAL(18,4)) * 1.05 AS DECIMAL(18,4)) AS landed_price,
               CAST(CAST(p_size AS DECIMAL(8,4)) * 0.1 AS DECIMAL(12,5)) AS premium_pct, {SRC} AS source_row_id
        FROM lineitem_r JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "plan_allocations_r": """
        SELECT l_partkey AS lot_id, CAST(l_quantity AS DECIMAL(18,3)) AS selected_quantity_mt,
               CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'released' END AS reservation_state
        FROM lineitem_r JOIN orders ON l_orderkey = o_orderkey""",
    "business_targets_r": """
        SELECT c_custkey AS target_id, 'CUSTOMER_ORDER_VALUE' AS metric_code, 'customer' AS scope_type,
               c_custkey AS scope_id, CAST(c_acctbal AS DECIMAL(18,5)) AS target_value, c_acctbal > 0 AS active
        FROM customer""",
    "alert_events_r": """
        SELECT o_orderkey AS alert_id, o_custkey AS target_id, CAST(o_orderdate AS DATE) AS detected_on,
               CAST(o_totalprice AS DECIMAL(18,5)) AS actual_value,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'critical' ELSE 'warning' END AS severity,
               CASE WHEN o_orderstatus = 'F' THEN 'resolved' ELSE 'open' END AS status
        FROM orders""",
    "work_order_rows_r": """
        SELECT 'transport_work_orders' AS file_name, 'INWARD FINAL' AS sheet_name,
               CAST(o_orderkey + 3 AS BIGINT) AS row_number,
               [ 'WO-' || CAST(o_orderkey AS VARCHAR), '', CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '', '',
                 o_orderpriority, '', 'MINE-' || CAST(mine AS VARCHAR),
                 CASE WHEN o_orderstatus = 'P' AND n = 1 THEN '' WHEN o_orderstatus = 'P' THEN q || ' + pending' ELSE q END,
                 lots, '',
                 CASE WHEN o_orderstatus = 'P' THEN 'TBD' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END,
                 '', '', '', CAST(n * 10 AS VARCHAR) ] AS cells,
               o_orderkey AS source_row_id
        FROM (SELECT o_orderkey, o_orderdate, o_orderpriority, o_orderstatus, o_totalprice,
                     string_agg(CAST(l_quantity AS VARCHAR), ' + ' ORDER BY CAST(l_quantity AS VARCHAR)) AS q,
                     string_agg(DISTINCT 'LOT-' || CAST(l_partkey AS VARCHAR), ', '
                                ORDER BY 'LOT-' || CAST(l_partkey AS VARCHAR)) AS lots,
                     min(l_suppkey) AS mine, count(*) AS n
              FROM lineitem_r JOIN orders ON l_orderkey = o_orderkey
              GROUP BY o_orderkey, o_orderdate, o_orderpriority, o_orderstatus, o_totalprice) w""",
    "lot_aliases_r": """
        SELECT lot_id, house_lot_number AS alias, source_row_id FROM lots_r
        UNION ALL
        SELECT lot_id, description, source_row_id FROM lots_r""",
    "planning_rows_r": """
        SELECT CASE WHEN p_size > 25 THEN 'LOT-' || CAST(p_partkey AS VARCHAR) ELSE p_name END AS lot_text,
               CAST(p_size * 10 AS DECIMAL(18,3)) AS planned_quantity_mt, p_partkey AS source_row_id
        FROM part""",
    "sample_measures_r": """
        SELECT source_row_id, 'indicative:' || CAST(source_row_id AS VARCHAR) AS sample_key,
               indicative_fe_raw AS fe_raw, CAST(NULL AS DECIMAL(8,4)) AS sio2_raw,
               CAST(NULL AS DECIMAL(8,4)) AS al2o3_raw
        FROM sample_lines_r WHERE l_linestatus = 'O'
        UNION ALL
        SELECT source_row_id,
               CASE WHEN l_linestatus = 'O' THEN 'inward:' ELSE 'dispatch:' END || CAST(source_row_id AS VARCHAR),
               fe_raw, sio2_raw, al2o3_raw
        FROM sample_lines_r""",
    "inward_samples_r": f"""
        SELECT {SRC} AS source_row_id, {SAMPLED} AS represented_quantity_mt,
               CAST(CAST(l_quantity AS DECIMAL(18,3)) * (1 + CAST(l_discount AS DECIMAL(18,2))) AS DECIMAL(18,3))
                   AS declared_quantity_mt
        FROM lineitem_r WHERE l_linestatus = 'O'""",
}

_NAME = re.compile(r"\b([a-z_0-9]+_r)\b")


def _deps(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(_NAME.findall(sql)) if n in RELATIONS]


def with_relations(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix `sql` with the CTEs (canonical relations and `extra`) it references, in dependency order."""
    defs = dict(RELATIONS)
    defs.update(extra or {})
    pattern = re.compile(r"\b(" + "|".join(map(re.escape, defs)) + r")\b")
    ordered: list[str] = []

    def visit(name: str, stack: tuple = ()):
        if name in ordered or name in stack:
            return
        for dep in dict.fromkeys(pattern.findall(defs[name])):
            if dep != name:
                visit(dep, stack + (name,))
        ordered.append(name)

    for name in dict.fromkeys(pattern.findall(sql)):
        visit(name)
    if not ordered:
        return sql
    if sql.lstrip().startswith("WITH"):
        sql = f"SELECT * FROM ({sql})"
    ctes = ",\n".join(f"{n} AS ({defs[n]})" for n in ordered)
    return f"WITH {ctes}\n{sql}"
