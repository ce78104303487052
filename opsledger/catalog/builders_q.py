"""Registered master/fact builders: materials (M2), lot aliases (M3), supplier backfill (M5),
quality samples (M11) and movements from the day book (M13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import StagedLedger
from ..functions import clean
from ..operators import facts, resolve
from ..registry import register
from ..sources.tables import Tables
from .rules_q import EXTRA as RULE_EXTRA, cell, norm_sql, number_sql, text_sql

EX = dict(RULE_EXTRA)

_DESC = f"lower(concat_ws(' ', {text_sql('p_type')}, {text_sql('p_name')}, {text_sql('CAST(p_size AS VARCHAR)')}))"
_CAT = (f"CASE WHEN regexp_matches({_DESC}, 'manganese|\\bmn\\b') THEN 'manganese' "
        f"WHEN regexp_matches({_DESC}, 'tail') THEN 'tailings' "
        f"WHEN regexp_matches({_DESC}, 'clean|screen') THEN 'cleaning_screening' "
        f"WHEN regexp_matches({_DESC}, 'lump') THEN 'lump' WHEN regexp_matches({_DESC}, 'fine') THEN 'fine' "
        f"ELSE 'other' END")
_MIN = f"CASE WHEN regexp_matches({_DESC}, 'manganese|\\bmn\\b') THEN 'manganese' ELSE 'iron_ore' END"
_SIZE = f"NULLIF({text_sql('CAST(p_size AS VARCHAR)')}, '')"


@register("m2_build_materials", f"""
SELECT DISTINCT material_code, mineral, category, size_spec,
       CASE category WHEN 'fine' THEN 'FINES' WHEN 'lump' THEN 'LUMPS' WHEN 'cleaning_screening' THEN 'CLEANINGS'
                     WHEN 'tailings' THEN 'TAILS' WHEN 'manganese' THEN 'MANGANESE' ELSE 'OTHER' END AS category_label
FROM (SELECT {_MIN} AS mineral, {_CAT} AS category, {_SIZE} AS size_spec,
             {_MIN} || ':' || {_CAT} || ':' || COALESCE(NULLIF({norm_sql(_SIZE)}, ''), 'unspecified') AS material_code
      FROM part)""")
def m2(spark, sf_dir):
    p = Tables(spark, sf_dir).part.select(F.col("p_type").alias("ore_type"), F.col("p_name").alias("sub_type"),
                                          F.col("p_size").cast("string").alias("size"))
    return facts.build_materials(p)


@register("m3_unique_lot_aliases", "SELECT k AS alias_key, lot_id FROM unique_alias_r", extra=EX)
def m3(spark, sf_dir):
    L = StagedLedger(spark, sf_dir)
    from ..functions import clean
    a = L.lot_aliases.select(clean.normalized("alias").alias("alias_key"), "lot_id").where(F.col("alias_key") != "")
    return (a.groupBy("alias_key").agg(F.count_distinct("lot_id").alias("_n"), F.min("lot_id").alias("lot_id"))
            .where(F.col("_n") == 1).drop("_n"))


@register("m5_lot_supplier_backfill", """
SELECT l.lot_id, l.house_lot_number, f.supplier_id
FROM lots_r l LEFT JOIN (SELECT lot_id, arg_min(supplier_id, source_row_id) AS supplier_id FROM purchase_lots_r GROUP BY 1) f
  ON f.lot_id = l.lot_id""", extra=EX)
def m5(spark, sf_dir):
    L = StagedLedger(spark, sf_dir)
    lots = L.lots.select("lot_id", "house_lot_number", F.lit(None).cast("bigint").alias("supplier_id"))
    return resolve.first_wins_backfill(lots, "lot_id", "supplier_id", L.purchase_lots, "supplier_id", "source_row_id")


LAST = "QUALIFY row_number() OVER (PARTITION BY business_key ORDER BY source_row_id DESC) = 1"


def key_sql(*parts: str) -> str:
    """F7 in SQL."""
    return " || '|' || ".join(f"COALESCE(NULLIF({norm_sql(x)}, ''), '-')" for x in parts)


def text_of(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


EX["book_r"] = f"""
SELECT {key_sql("'book'", text_of('CAST(l_shipdate AS DATE)'), "'LOT-' || CAST(l_partkey AS VARCHAR)",
                "CASE WHEN l_returnflag = 'R' THEN 'Shortage / loss' WHEN l_returnflag = 'A' THEN 'Feed to plant' ELSE 'Inward receipt' END",
                "CASE WHEN l_linestatus = 'O' THEN 'in' ELSE 'out' END", text_of('CAST(l_quantity AS DECIMAL(18,3))'),
                "'REF-' || CAST(l_orderkey AS VARCHAR)", text_of('l_row + 1'))} AS business_key,
       l_row AS source_row_id, CAST(l_shipdate AS DATE) AS occurred_on, l_partkey AS lot_id,
       CASE WHEN l_returnflag = 'R' THEN 'shortage_loss' WHEN l_returnflag = 'A' THEN 'production_feed'
            ELSE 'inward_receipt' END AS event_type,
       CASE WHEN l_linestatus = 'O' THEN 'in' ELSE 'out' END AS direction,
       CAST(l_quantity AS DECIMAL(18,3)) AS quantity_mt, 'REF-' || CAST(l_orderkey AS VARCHAR) AS reference_key
FROM lineitem_r WHERE l_quantity <> 0"""


@register("m13_movements_from_day_book", "SELECT * FROM book_r", extra=EX)
def m13(spark, sf_dir):
    L = StagedLedger(spark, sf_dir)
    return facts.build_movements(L.day_book_rows, L.lot_aliases)[0]


UNIT = ("CAST(CAST((CAST(round(l_extendedprice * 100) AS BIGINT) * 200 + CAST(l_quantity AS BIGINT))"
        " // (2 * CAST(l_quantity AS BIGINT)) AS DECIMAL(18,0)) * 0.0001 AS DECIMAL(18,4))")
EX["outward_typed_r"] = f"""
SELECT {key_sql("'dispatch'", text_of('CAST(l_shipdate AS DATE)'), 'c_name', text_of('l_orderkey'),
                "'P-' || CAST(l_suppkey AS VARCHAR)", text_of('CAST(l_quantity AS DECIMAL(18,3))'), text_of('l_linenumber'))} AS business_key,
       l_row AS source_row_id, CAST(l_shipdate AS DATE) AS dispatch_on,
       o_custkey AS customer_id, l_orderkey AS sales_order_line_id,
       CASE WHEN s_acctbal > 0 THEN l_suppkey END AS permit_id, 'P-' || CAST(l_suppkey AS VARCHAR) AS permit_number,
       CAST(l_quantity AS DECIMAL(18,3)) AS quantity_mt, CAST(l_linenumber AS BIGINT) AS vehicle_count,
       CAST({UNIT} * 0.05 AS DECIMAL(12,6)) AS fe_pct
FROM lineitem_r JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey
     JOIN customer ON c_custkey = o_custkey"""
EX["outward_r"] = f"SELECT * FROM outward_typed_r {LAST}"
DISPATCH_COLUMNS = ("business_key, source_row_id, dispatch_on, customer_id, sales_order_line_id, permit_id, quantity_mt, "
                    "vehicle_count, fe_pct")


@register("m10_build_dispatches", f"SELECT {DISPATCH_COLUMNS} FROM outward_r", extra=EX)
def m10(spark, sf_dir):
    L = StagedLedger(spark, sf_dir)
    return facts.build_dispatches(L.outward_rows, L.customers, L.sales_orders, L.permits)[0]


@register("m10_dispatch_issues", """
SELECT 'MISSING_DISPATCH_PERMIT' AS rule_code, 'critical' AS severity, 'dispatch' AS entity_name,
       business_key AS entity_key, source_row_id,
       'Dispatch permit ' || permit_number || ' does not resolve to an outward permit.' AS message
FROM outward_typed_r WHERE permit_id IS NULL
UNION ALL
SELECT 'MISSING_DISPATCH_LOT', 'critical', 'dispatch', business_key, source_row_id,
       'The dispatch sheet carries no lot.'
FROM outward_typed_r""", extra=EX)
def m10i(spark, sf_dir):
    L = StagedLedger(spark, sf_dir)
    return facts.build_dispatches(L.outward_rows, L.customers, L.sales_orders, L.permits)[1]


@register("m10_dispatch_table_reimported", f"""
SELECT business_key, CASE WHEN dispatch_on >= DATE '1995-01-01' THEN source_row_id ELSE old_row END AS source_row_id, dispatch_on, customer_id,
       CASE WHEN dispatch_on >= DATE '1995-01-01' THEN sales_order_line_id END AS sales_order_line_id,
       CASE WHEN dispatch_on >= DATE '1995-01-01' THEN permit_id END AS permit_id, quantity_mt, vehicle_count
FROM (SELECT {DISPATCH_COLUMNS}, source_row_id AS old_row FROM outward_r)""", extra=EX)
def m10t(spark, sf_dir):
    """The keyed dispatch table after two imports: all sheets while the order and permit registers were still empty, then
    the sheets from 1995 on with both registers."""
    from ..operators.books import Books
    L = StagedLedger(spark, sf_dir)
    books = Books.scratch(spark)
    none = lambda df: df.where("false")
    books.upsert("dispatch", facts.build_dispatches(L.outward_rows, L.customers, none(L.sales_orders), none(L.permits))[0])
    late = L.outward_rows.where(clean.date(F.get("cells", 0)) >= F.lit("1995-01-01").cast("date"))
    books.upsert("dispatch", facts.build_dispatches(late, L.customers, L.sales_orders, L.permits)[0])
    return books["dispatch"].read()


from .marts_q import V7_SQL  # noqa: E402

EX["v7_r"] = V7_SQL


def _production(spark, sf_dir):
    L = StagedLedger(spark, sf_dir)
    return facts.build_production(L.production_rows, L.lot_aliases)


@register("m16_production_from_sheet", """
SELECT * FROM v7_r WHERE production_run_id IN (SELECT l_orderkey FROM lineitem)""", extra=EX)
def m16(spark, sf_dir):
    from ..operators import marts
    runs, inputs, outputs, _ = _production(spark, sf_dir)
    runs = runs.withColumn("process", F.regexp_replace("process", "^RUN ", ""))
    return marts.production_recovery(runs.drop("source_material_name", "business_key"), inputs, outputs)


EX["fed_r"] = f"""
SELECT o_orderkey AS source_row_id, CAST(o_orderdate AS DATE) AS run_date, o_orderstatus AS shift, o_orderpriority AS kind,
       CASE WHEN o_orderstatus = 'F' THEN 'LOT-' || CAST(least_lot AS VARCHAR) ELSE o_orderpriority END AS material,
       CASE WHEN o_orderstatus = 'F' THEN least_lot END AS lot_id, feed,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 0.00025 AS DECIMAL(8,4)) AS recovery
FROM orders JOIN (SELECT l_orderkey, min(l_partkey) AS least_lot, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,3))) AS DECIMAL(18,3)) AS feed
                  FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""
EX["runs_keyed_r"] = f"""
SELECT {key_sql("'production'", text_of('run_date'), 'shift', "'RUN'", 'material', text_of('source_row_id + 5'))} AS run_key, *
FROM fed_r"""


@register("m16_production_inputs", """
SELECT run_key, source_row_id AS production_run_id, lot_id, feed AS quantity_mt, source_row_id FROM runs_keyed_r""", extra=EX)
def m16i(spark, sf_dir):
    return _production(spark, sf_dir)[1]


@register("m16_production_issues", """
SELECT 'MISSING_PRODUCTION_LOT' AS rule_code, 'warning' AS severity, 'production_run' AS entity_name, run_key AS entity_key,
       source_row_id, 'Production material ' || material || ' is not a known input lot.' AS message
FROM runs_keyed_r WHERE lot_id IS NULL
UNION ALL
SELECT 'INVALID_RECOVERY_RANGE', 'critical', 'production_run', run_key, source_row_id,
       'Reported recovery ' || CAST(CAST(recovery AS DECIMAL(12,4)) AS VARCHAR) || '% is outside 0 to 100%.'
FROM runs_keyed_r WHERE recovery < 0 OR recovery > 100""", extra=EX)
def m16p(spark, sf_dir):
    return _production(spark, sf_dir)[3]


@register("m6_build_purchases", f"""
SELECT 'purchaselot|sup' || CAST(p.supplier_id AS VARCHAR) || '|lot' || CAST(p.lot_id AS VARCHAR) || '|'
         || {norm_sql('CAST(p.purchase_date AS VARCHAR)')} AS business_key,
       'SUP-' || CAST(p.supplier_id AS VARCHAR) AS supplier, p.lot_id,
       'LOT-' || CAST(p.lot_id AS VARCHAR) AS source_lot_number, p.purchase_date, p.purchased_quantity_mt,
       l.lot_landed_cost AS purchase_rate_inr_per_mt, l.lot_landed_cost AS reported_landed_cost_inr_per_mt, p.reported_lifted_quantity_mt,
       p.reported_balance_to_lift_mt, p.reported_payment_balance_mt,
       p.reported_permit_balance_mt,
       CASE WHEN p.reported_lifted_quantity_mt = 0 THEN 'unlifted' WHEN p.reported_balance_to_lift_mt <= 0 THEN 'finished'
            ELSE 'unknown' END AS lifecycle_status,
       CASE WHEN p.reported_payment_balance_mt < 0 THEN 'unpaid' WHEN p.reported_payment_balance_mt = 0 THEN 'paid'
            ELSE 'partly_paid' END AS payment_status,
       p.source_row_id
FROM purchase_lots_r p JOIN lots_r l ON l.lot_id = p.lot_id""", extra=EX)
def m6(spark, sf_dir):
    L = StagedLedger(spark, sf_dir)
    return facts.build_purchases(L.purchase_rows, L.lot_aliases)[0]


EX["latest_snap_r"] = """SELECT * FROM stock_snapshots_r WHERE snapshot_on = (SELECT max(snapshot_on) FROM stock_snapshots_r)"""


@register("m12_build_stock_snapshot", """
SELECT snapshot_on, lot_id, recorded_quantity_mt, reported_fe_pct, reported_landed_cost_inr_per_mt,
       'OK' AS reported_status, source_row_id
FROM latest_snap_r""", extra=EX)
def m12(spark, sf_dir):
    L = StagedLedger(spark, sf_dir)
    return facts.build_stock_snapshot(L.stock_rows, L.lot_aliases)[0]


@register("m12_reported_cost_components", f"""
SELECT 'snapshotcost|' || CAST(lot_id AS VARCHAR) || '|' || {norm_sql('CAST(snapshot_on AS VARCHAR)')} AS business_key,
       lot_id, 'REPORTED_LANDED_COST' AS component_code, reported_landed_cost_inr_per_mt AS rate_inr_per_mt,
       snapshot_on AS effective_on, false AS included_in_landed_cost, 'reported' AS approval_status, source_row_id
FROM latest_snap_r WHERE reported_landed_cost_inr_per_mt IS NOT NULL""", extra=EX)
def m12c(spark, sf_dir):
    L = StagedLedger(spark, sf_dir)
    return facts.build_stock_snapshot(L.stock_rows, L.lot_aliases)[1]


@register("m9_build_sales_orders", f"""
SELECT 'salesline|' || {norm_sql('c_name')} || '|' || {norm_sql('po_number')} || '|-|-' AS business_key, customer_id,
       po_number, po_date, CAST(NULL AS VARCHAR) AS size_spec, ordered_quantity_mt, reported_dispatched_quantity_mt, target_fe_pct,
       selling_rate_inr_per_mt, order_status, source_row_id
FROM sales_orders_r JOIN customer ON c_custkey = customer_id""", extra=EX)
def m9(spark, sf_dir):
    L = StagedLedger(spark, sf_dir)
    return facts.build_sales_orders(L.order_rows, L.customers)


EX["m17_src_r"] = f"""
SELECT p.lot_id, p.purchase_date, l.lot_landed_cost AS rate, p.source_row_id,
       'purchasecost|' || CAST(p.lot_id AS VARCHAR) || '|' || {norm_sql('CAST(p.purchase_date AS VARCHAR)')} AS business_key
FROM purchase_lots_r p JOIN lots_r l ON l.lot_id = p.lot_id"""


@register("m17_purchase_cost_components", """
SELECT business_key, lot_id, 'REPORTED_LANDED_COST' AS component_code, arg_max(rate, source_row_id) AS rate_inr_per_mt,
       purchase_date AS effective_on, false AS included_in_landed_cost, 'reported' AS approval_status,
       max(source_row_id) AS source_row_id
FROM m17_src_r GROUP BY business_key, lot_id, purchase_date""", extra=EX)
def m17(spark, sf_dir):
    L = StagedLedger(spark, sf_dir)
    return facts.purchase_cost_components(facts.build_purchases(L.purchase_rows, L.lot_aliases)[0])


MATERIAL_SQL = ("CASE WHEN regexp_matches(lower({0}), 'manganese|\\bmn\\b') THEN 'manganese:manganese' WHEN regexp_matches(lower({0}), 'tail') "
                "THEN 'iron_ore:tailings' WHEN regexp_matches(lower({0}), 'clean|screen') THEN 'iron_ore:cleaning_screening' "
                "WHEN regexp_matches(lower({0}), 'lump') THEN 'iron_ore:lump' WHEN regexp_matches(lower({0}), 'fine') THEN 'iron_ore:fine' "
                "ELSE 'iron_ore:other' END")


@register("m7_build_permits", f"""
SELECT 'P-' || CAST(s_suppkey AS VARCHAR) AS permit_number, 'outward' AS direction, c_custkey AS organization_id,
       CAST(NULL AS BIGINT) AS purchase_lot_id, po AS sales_order_line_id, CAST(day AS DATE) AS issued_on,
       CAST(CAST(s_acctbal AS DECIMAL(18,2)) * 2 AS DECIMAL(18,3)) AS permitted_quantity_mt,
       CASE WHEN s_acctbal > 5000 THEN 'iron_ore:lump:unspecified' ELSE 'iron_ore:fine:unspecified' END AS material_code,
       CASE WHEN s_acctbal > 0 THEN 'Active' ELSE 'unknown' END AS status, s_suppkey AS source_row_id
FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey
LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS po, max(o_orderdate) AS day FROM orders GROUP BY 1) ON o_custkey = c_custkey
UNION ALL
SELECT permit_number, 'inward', supplier_id, source_row_id, NULL, purchase_date, purchased_quantity_mt, material_code, status, source_row_id
FROM (SELECT 'IP-' || CAST(p.supplier_id AS VARCHAR) || '-' || substr(CAST(p.lot_id AS VARCHAR), 1, 2) AS permit_number, p.*,
             {MATERIAL_SQL.format('l.category')} || ':unspecified' AS material_code,
             CASE WHEN p.reported_lifted_quantity_mt > 0 THEN 'Active' ELSE 'unknown' END AS status
      FROM purchase_lots_r p JOIN lots_r l ON l.lot_id = p.lot_id)
QUALIFY row_number() OVER (PARTITION BY permit_number ORDER BY source_row_id DESC) = 1""", extra=EX)
def m7(spark, sf_dir):
    """Both registers: outward permits of customers with their order lines, inward ones of suppliers with purchases."""
    L = StagedLedger(spark, sf_dir)
    named = lambda c: F.concat(F.lit(c), F.col("id").cast("string"))
    orders = L.sales_orders.select(F.col("customer_id").alias("organization_id"), F.col("po_number").alias("subject"),
                                   F.col("sales_order_line_id").alias("subject_id"), "source_row_id")
    outward = facts.build_permits(L.permit_rows, "outward", L.customers.select(F.col("customer_id").alias("organization_id"), "legal_name"), orders)
    suppliers = L.suppliers.select(F.col("supplier_id").alias("organization_id"), F.col("supplier_id").alias("id")).withColumn(
        "legal_name", named("SUP-"))
    lots = L.purchase_lots.select(F.col("supplier_id").alias("organization_id"), F.col("lot_id").alias("id"), "source_row_id",
                                  F.col("source_row_id").alias("subject_id")).withColumn("subject", named("LOT-"))
    return outward.unionByName(facts.build_permits(L.inward_permit_rows, "inward", suppliers, lots))


EX["auction_typed_r"] = f"""
SELECT {key_sql("'auction-lot'", "'EA-' || strftime(closes_on, '%Y%m')", "'LOT-' || CAST(lot_id AS VARCHAR)")} AS business_key,
       'EA-' || strftime(closes_on, '%Y%m') AS auction_number, 'LOT-' || CAST(lot_id AS VARCHAR) AS external_lot_number, closes_on,
       {norm_sql('mine')} AS seller_key, 'Pit ' || mine AS site_name,
       CASE WHEN fe_pct > 25 THEN 'iron_ore:lump:lumps' ELSE 'iron_ore:fine:fines' END AS material_code, offered_quantity_mt,
       CASE WHEN sold THEN offered_quantity_mt END AS sold_quantity_mt, fe_pct AS indicative_fe_pct,
       opening_price AS opening_price_inr_per_mt, current_price AS current_price_inr_per_mt,
       CAST(opening_price * 1.05 AS DECIMAL(18,4)) AS reported_landed_price_inr_per_mt,
       CAST(fe_pct * 0.1 AS DECIMAL(12,5)) AS reported_premium_pct, source_row_id
FROM auction_lots_r"""


@register("m14_build_auction_lots", f"SELECT * FROM auction_typed_r {LAST}", extra=EX)
def m14(spark, sf_dir):
    return facts.build_auction_lots(StagedLedger(spark, sf_dir).auction_rows)[0]


@register("m14_mine_owners_and_sites", """
SELECT seller_key AS organization_key, regexp_replace(lower(site_name), '[^a-z0-9]+', '', 'g') AS site_key, min(site_name) AS name,
       max(source_row_id) AS source_row_id
FROM auction_typed_r GROUP BY 1, 2""", extra=EX)
def m14s(spark, sf_dir):
    return facts.build_auction_lots(StagedLedger(spark, sf_dir).auction_rows)[2]


EX["auction_latest_r"] = f"SELECT * FROM auction_typed_r {LAST}"


@register("m14_auction_table_by_month", "SELECT * FROM auction_latest_r", extra=EX)
def m14t(spark, sf_dir):
    """The keyed auction table after three imports in file order: the first half of the sheet's rows, all of them, and all
    again, which must change nothing."""
    from ..operators.books import Books
    L = StagedLedger(spark, sf_dir)
    books = Books.scratch(spark)
    half = L.auction_rows.agg(F.expr("(min(row_number) + max(row_number)) div 2")).scalar()
    books.upsert("auction_lot", facts.build_auction_lots(L.auction_rows.where(F.col("row_number") <= half))[0])
    whole = facts.build_auction_lots(L.auction_rows)[0].checkpoint()  # imported twice below, read from the sheet once
    after = books.upsert("auction_lot", whole)
    again = books.upsert("auction_lot", whole)
    if again != {"version": after["version"], "inserted": 0, "updated": 0}:
        raise AssertionError(f"a repeated import changed {again}")
    return books["auction_lot"].read()


EX["inward_quality_r"] = f"""
SELECT s.source_row_id, s.sample_on, s.lot_id AS number, l_returnflag = 'R' AS odd,
       CASE WHEN l_returnflag = 'R' THEN 'L-' ELSE 'LOT-' END || CAST(s.lot_id AS VARCHAR) AS lot_text, represented_quantity_mt,
       indicative_fe_raw, fe_raw, sio2_raw, al2o3_raw
FROM sample_lines_r s WHERE l_linestatus = 'O'"""
EX["quality_long_r"] = f"""
SELECT {key_sql("'inward-quality'", text_of('sample_on'), 'lot_text', text_of('represented_quantity_mt'), text_of('source_row_id + 1'))} AS business_key,
       'inward' AS sample_stage, r.receipt_id AS inward_receipt_id, fe_raw AS fe, sio2_raw AS sio2, al2o3_raw AS al2o3, sio2_raw - 2 AS loi,
       al2o3_raw AS p, CAST(represented_quantity_mt AS DECIMAL(12,4)) AS moisture, 106 - al2o3_raw * 4 AS mass_balance, q.*
FROM inward_quality_r q LEFT JOIN (SELECT receipt_on, lot_id, arg_max(receipt_id, source_row_id) AS receipt_id FROM receipts_r GROUP BY 1, 2) r
  ON r.receipt_on = q.sample_on AND r.lot_id = q.number AND NOT odd
UNION ALL
SELECT {key_sql("'inward-quality-indicative'", text_of('sample_on'), 'lot_text', text_of('source_row_id + 1'))}, 'indicative', NULL,
       indicative_fe_raw, NULL, NULL, NULL, NULL, NULL, NULL, q.*
FROM inward_quality_r q WHERE indicative_fe_raw IS NOT NULL"""


def _pct(c: str, name: str) -> str:
    return f"CAST(CASE WHEN {c} BETWEEN 0 AND 100 THEN {c} END AS DECIMAL(8,4)) AS {name}_pct"


@register("m11_quality_samples", f"""
SELECT business_key, sample_on, sample_stage, CASE WHEN NOT odd THEN number END AS lot_id, lot_text AS source_lot_number,
       inward_receipt_id, CAST(NULL AS BIGINT) AS dispatch_id, represented_quantity_mt,
       {_pct('fe', 'fe')}, {_pct('sio2', 'sio2')}, {_pct('al2o3', 'al2o3')}, {_pct('loi', 'loi')}, {_pct('p', 'p')}, {_pct('moisture', 'moisture')},
       CAST(NULL AS DECIMAL(8,4)) AS mn_pct, {_pct('mass_balance', 'mass_balance')}, true AS approved, source_row_id
FROM quality_long_r""", extra=EX)
def m11(spark, sf_dir):
    return _quality(spark, sf_dir)[0]


def _quality(spark, sf_dir):
    L = StagedLedger(spark, sf_dir)
    receipts = L.receipts.select("receipt_on", "receipt_id", "source_row_id", F.concat(F.lit("LOT-"), F.col("lot_id").cast("string")).alias("lot_text"))
    return facts.build_quality_samples(L.quality_rows, L.lot_aliases, receipts)


EX["quality_measures_r"] = """
SELECT business_key, source_row_id, m.code, CAST(m.v AS DECIMAL(12,4)) AS v FROM (
  SELECT business_key, source_row_id, unnest([{'code': 'FE', 'v': CAST(fe AS DECIMAL(12,4))}, {'code': 'SIO2', 'v': sio2},
    {'code': 'AL2O3', 'v': al2o3}, {'code': 'LOI', 'v': loi}, {'code': 'P', 'v': p}, {'code': 'MOISTURE', 'v': moisture},
    {'code': 'MASS_BALANCE', 'v': mass_balance}]) AS m
  FROM quality_long_r) WHERE m.v IS NOT NULL"""
_BANDS = ", ".join(f"('{c}', {lo}, {hi})" for c, (lo, hi) in clean.PLAUSIBLE_BANDS.items())


@register("m11_quality_issues", f"""
SELECT 'UNMAPPED_LOT' AS rule_code, 'critical' AS severity, 'quality_sample' AS entity_name, lot_text AS entity_key, source_row_id,
       'Quality result lot ' || lot_text || ' does not resolve to the lot master.' AS message
FROM inward_quality_r WHERE odd
UNION ALL
SELECT 'INVALID_QUALITY_RANGE', 'critical', 'quality_sample', business_key, source_row_id,
       code || ' value ' || CAST(v AS VARCHAR) || ' is outside 0 to 100%.'
FROM quality_measures_r WHERE v < 0 OR v > 100
UNION ALL
SELECT 'QUALITY_PLAUSIBILITY', 'warning', 'quality_sample', business_key, source_row_id,
       q.code || ' value ' || CAST(v AS VARCHAR) || '% is outside the plausible band ' || CAST(lo AS VARCHAR) || '-' || CAST(hi AS VARCHAR) || '%.'
FROM quality_measures_r q JOIN (SELECT * FROM (VALUES {_BANDS}) AS b(code, lo, hi)) b ON b.code = q.code
WHERE v BETWEEN 0 AND 100 AND (v < lo OR v > hi)""", extra=EX)
def m11i(spark, sf_dir):
    """R4, R18 and R19 of the quality sheet, all measures."""
    return _quality(spark, sf_dir)[1]


@register("m15_transport_cost_components", f"""
SELECT 'transportworkorderunknown' || {norm_sql('work_order_number')} || '|' || {norm_sql('source_lot_text')} AS business_key,
       CAST(substr(source_lot_text, 5) AS BIGINT) AS lot_id, 'INWARD_TRANSPORT' AS component_code,
       CAST({number_sql('rate_text')} AS DECIMAL(18,4)) AS rate_inr_per_mt,
       CAST(work_order_date_text AS DATE) AS effective_on, false AS included_in_landed_cost,
       'reported' AS approval_status, source_row_id
FROM work_orders_r
WHERE NOT regexp_matches(source_lot_text, '[+,&]') AND {number_sql('rate_text')} IS NOT NULL""", extra=EX)
def m15(spark, sf_dir):
    L = StagedLedger(spark, sf_dir)
    return facts.build_transport(L.work_order_rows, L.lot_aliases)[2]


@register("m15_transporters", f"""
SELECT min(source_row_id) AS organization_id, arg_min({text_sql('transporter')}, source_row_id) AS legal_name,
       {norm_sql('transporter')} AS normalized_name, ['transporter'] AS roles, min(source_row_id) AS source_row_id
FROM work_orders_r GROUP BY {norm_sql('transporter')}""", extra=EX)
def m15o(spark, sf_dir):
    L = StagedLedger(spark, sf_dir)
    return facts.build_transport(L.work_order_rows, L.lot_aliases)[0]


@register("m15_mine_owners", f"""
SELECT min(source_row_id) AS organization_id, arg_min({text_sql('mine')}, source_row_id) AS legal_name,
       {norm_sql('mine')} AS normalized_name, ['mine_owner'] AS roles, min(source_row_id) AS source_row_id
FROM (SELECT {cell(7)} AS mine, source_row_id FROM work_order_rows_r) GROUP BY {norm_sql('mine')}""", extra=EX)
def m15m(spark, sf_dir):
    return facts.transport_mine_owners(StagedLedger(spark, sf_dir).work_order_rows)


_ORG_KEY = ("COALESCE(NULLIF(" + norm_sql("regexp_replace(regexp_replace(" + text_sql("c_name")
            + ", '\\\\([^)]*[0-9][^)]*\\\\)\\\\s*$', ''), '(?i)\\\\b(private limited|pvt\\\\.? ltd\\\\.?|limited|ltd\\\\.?|llp)"
            "\\\\s*$', '')") + ", ''), " + norm_sql("c_name") + ")")


@register("m4_build_sites", f"""
SELECT {_ORG_KEY} AS organization_key, {norm_sql('n_name')} AS site_key, n_name AS name, 'customer' AS site_type,
       c_custkey AS source_row_id
FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def m4(spark, sf_dir):
    return facts.build_sites(StagedLedger(spark, sf_dir).buyer_rows)


EX["lot_master_r"] = """
SELECT p_partkey AS source_row_id, 'LOT-' || CAST(p_partkey AS VARCHAR) AS house, CASE WHEN p_size > 30 THEN 'unlifted' WHEN p_size > 15 THEN 'finished'
       ELSE 'unknown' END AS status, 'SL ' || CAST(p_partkey AS VARCHAR) AS source_lot, p_name, p_type, p_brand, p_size FROM part
UNION ALL
SELECT p_partkey + 1099511627776, 'LOT-' || CAST(p_partkey AS VARCHAR), 'closed', NULL, p_name, p_type, p_brand, p_size FROM part WHERE p_size > 40"""


@register("m3_build_lots", f"""
SELECT min(source_row_id) OVER (PARTITION BY house) AS lot_id, house AS house_lot_number,
       {MATERIAL_SQL.format("concat_ws(' ', p_brand, p_type, p_size)")} || ':' || CAST(p_size AS VARCHAR) AS material_code,
       source_lot AS source_lot_number, p_name AS description, status AS lifecycle_status, source_row_id
FROM lot_master_r QUALIFY row_number() OVER (PARTITION BY house ORDER BY source_row_id DESC) = 1""", extra=EX)
def m3l(spark, sf_dir):
    return facts.build_lots(StagedLedger(spark, sf_dir).lot_master_rows)[0]


@register("m3_lot_alias_table", f"""
SELECT min(p_partkey) AS lot_id, k AS normalized_alias, arg_min(a, source_row_id * 3 + place) AS alias, max(source_row_id) AS source_row_id
FROM (SELECT source_row_id, source_row_id % 1099511627776 AS p_partkey, a, place, {norm_sql('a')} AS k FROM (
        SELECT source_row_id, house AS a, 0 AS place FROM lot_master_r UNION ALL SELECT source_row_id, source_lot, 1 FROM lot_master_r
        UNION ALL SELECT source_row_id, p_name, 2 FROM lot_master_r) WHERE a IS NOT NULL)
WHERE k <> '' GROUP BY p_partkey, k""", extra=EX)
def m3a(spark, sf_dir):
    """The keyed alias table after two imports of the lot master: its first rows, then all of them."""
    from ..operators.books import Books
    rows = StagedLedger(spark, sf_dir).lot_master_rows
    books = Books.scratch(spark)
    books.upsert("lot_alias", facts.build_lots(rows.where(F.col("row_number") <= 1 << 40))[1])
    books.upsert("lot_alias", facts.build_lots(rows)[1])
    return books["lot_alias"].read()


EX["mentions_r"] = f"""
SELECT c_name AS name, 'customer' AS role, 1125899906842624 + c_custkey AS o FROM customer
UNION ALL SELECT 'SUP-' || CAST(supplier_id AS VARCHAR), 'supplier', 2251799813685248 + source_row_id FROM purchase_lots_r
UNION ALL SELECT c_name, 'customer', 3377699720527872 + s_suppkey FROM supplier JOIN customer ON c_custkey = s_suppkey
UNION ALL SELECT mine, 'mine_owner', 4503599627370496 + source_row_id FROM auction_lots_r
UNION ALL SELECT {cell(5)}, 'transporter', 5629499534213120 + source_row_id FROM work_order_rows_r
UNION ALL SELECT {cell(7)}, 'mine_owner', 6755399441055744 + source_row_id FROM work_order_rows_r"""


@register("m1_organizations_of_all_sheets", f"""
SELECT min(o) AS organization_id, arg_min({text_sql('name')}, o) AS legal_name, {norm_sql('name')} AS normalized_name,
       list_sort(list_distinct(list(role))) AS roles, min(o) AS source_row_id
FROM mentions_r GROUP BY {norm_sql('name')}""", extra=EX)
def m1all(spark, sf_dir):
    return resolve.build_organizations(StagedLedger(spark, sf_dir).organization_mentions)


@register("m1_organization_aliases", f"""
SELECT {norm_sql('name')} AS normalized_name, arg_min({text_sql('name')}, o) AS alias, {norm_sql('name')} AS normalized_alias, min(o) AS source_row_id
FROM mentions_r GROUP BY {norm_sql('name')}""", extra=EX)
def m1alias(spark, sf_dir):
    return resolve.organization_aliases(StagedLedger(spark, sf_dir).organization_mentions)
