"""Registered data-quality rules (R2-R31), the issue table (V11) and readiness (V9)."""

from __future__ import annotations

import hashlib
import sys
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import adapters
from ..adapters import StagedLedger
from ..functions import clean
from ..operators import checks, common, constraints, issues, marts, resolve, similarity
from ..operators.checks import SEVERITIES
from ..registry import register
from ..session import checkpoint_dir, shuffles_for
from ..sources.runs import RunStore, fingerprint
from ..sources.store import code_version, landed_files
from ..sources.tables import Tables
from .marts_q import V7_SQL

AS_OF = "2002-01-01 00:00:00"
WO_REQUIRED = {0: "work order", 5: "transporter", 8: "quantity"}
WO_NUMBERS = {11: "rate", 15: "distance"}

# ---------------------------------------------------------------------------- SQL helpers


def text_sql(x: str) -> str:
    return f"trim(regexp_replace(COALESCE({x}, ''), '\\s+', ' ', 'g'))"


def norm_sql(x: str) -> str:
    return f"regexp_replace(lower({text_sql(x)}), '[^a-z0-9]+', '', 'g')"


def number_sql(x: str) -> str:
    src = f"regexp_replace({text_sql(x)}, '[₹,%\\s]', '', 'g')"
    shape = "'^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$'"
    return (f"(CASE WHEN regexp_full_match({src}, {shape}) AND isfinite(TRY_CAST({src} AS DOUBLE)) "
            f"THEN TRY_CAST({src} AS DOUBLE) END)")


def s_sql(x: str) -> str:
    return f"COALESCE(CAST({x} AS VARCHAR), 'missing')"


def iss(code: str, entity: str, key: str, src: str, message: str, rest: str) -> str:
    sev = SEVERITIES.get(code, "warning")
    return (f"SELECT '{code}' AS rule_code, '{sev}' AS severity, '{entity}' AS entity_name, "
            f"CAST({key} AS VARCHAR) AS entity_key, CAST({src} AS BIGINT) AS source_row_id, "
            f"{message} AS message {rest}")


def cell(i: int) -> str:
    return f"cells[{i + 1}]"


SQL: dict[str, str] = {}
EXTRA: dict[str, str] = {}

EXTRA["order_totals_r"] = """
SELECT s.*, CAST(COALESCE(d.calc, 0) AS DECIMAL(18,3)) AS calculated_quantity_mt, d.first_dispatch_on
FROM sales_orders_r s
LEFT JOIN (SELECT sales_order_line_id, sum(quantity_mt) AS calc, min(dispatch_on) AS first_dispatch_on
           FROM dispatches_r GROUP BY 1) d ON d.sales_order_line_id = s.sales_order_line_id"""
EXTRA["recon_r"] = """
SELECT ss.lot_id, ss.source_row_id, ss.recorded_quantity_mt,
       CAST(COALESCE(m.calc, 0) AS DECIMAL(18,3)) AS calculated_quantity_mt
FROM stock_snapshots_r ss
LEFT JOIN (SELECT lot_id, sum(CASE direction WHEN 'in' THEN quantity_mt ELSE -quantity_mt END) AS calc
           FROM movements_r WHERE occurred_on <= (SELECT max(snapshot_on) FROM stock_snapshots_r)
           GROUP BY lot_id) m ON m.lot_id = ss.lot_id
WHERE ss.snapshot_on = (SELECT max(snapshot_on) FROM stock_snapshots_r)"""
EXTRA["v7_r"] = V7_SQL
EXTRA["work_orders_r"] = f"""
SELECT source_row_id, {cell(0)} AS work_order_number, {cell(2)} AS work_order_date_text,
       trim({cell(5)}) AS transporter, trim({cell(7)}) AS mine, {cell(8)} AS quantity_text,
       CASE WHEN regexp_full_match({cell(8)}, '^\\s*[0-9]+(\\.[0-9]+)?(\\s*\\+\\s*[0-9]+(\\.[0-9]+)?)*\\s*$')
            THEN CAST(list_sum(list_transform(regexp_split_to_array(trim({cell(8)}), '\\s*\\+\\s*'),
                                              lambda x: CAST(x AS DECIMAL(38,6)))) AS DECIMAL(18,3)) END
           AS awarded_quantity_mt,
       {cell(9)} AS source_lot_text, {cell(11)} AS rate_text
FROM work_order_rows_r WHERE row_number > 2 AND {text_sql(cell(5))} <> ''"""
EXTRA["unique_alias_r"] = f"""
SELECT k, min(lot_id) AS lot_id FROM (SELECT {norm_sql('alias')} AS k, lot_id FROM lot_aliases_r)
WHERE k <> '' GROUP BY k HAVING count(DISTINCT lot_id) = 1"""
EXTRA["planning_resolved_r"] = f"""
SELECT p.*, u.lot_id FROM planning_rows_r p LEFT JOIN unique_alias_r u ON u.k = {norm_sql('p.lot_text')}"""
EXTRA["measure_long_r"] = """
SELECT source_row_id, sample_key, code, value FROM (
  SELECT source_row_id, sample_key, 'FE' AS code, fe_raw AS value FROM sample_measures_r
  UNION ALL SELECT source_row_id, sample_key, 'SIO2', sio2_raw FROM sample_measures_r
  UNION ALL SELECT source_row_id, sample_key, 'AL2O3', al2o3_raw FROM sample_measures_r) WHERE value IS NOT NULL"""
EXTRA["orgs_r"] = f"""
SELECT min(p_partkey) AS organization_id, arg_min({text_sql('p_name')}, p_partkey) AS legal_name, nk AS normalized_name,
       list_sort(list_distinct(list(p_brand))) AS roles
FROM (SELECT *, COALESCE(NULLIF({norm_sql(
    "regexp_replace(regexp_replace(" + text_sql('p_name') + ", '\\([^)]*[0-9][^)]*\\)\\s*$', ''), "
    "'(?i)\\b(private limited|pvt\\.? ltd\\.?|limited|ltd\\.?|llp)\\s*$', '')")}, ''), {norm_sql('p_name')}) AS nk
      FROM part WHERE {text_sql('p_name')} <> '')
GROUP BY nk"""
EXTRA["freshness_r"] = """
SELECT * FROM (
  SELECT 'stock_report' AS workbook_name, 'daily' AS cadence, 36 AS maximum_age_hours, max(t) AS latest_business_at,
         (list(source_row_id ORDER BY t DESC, source_row_id DESC))[1] AS source_row_id
  FROM (SELECT snapshot_on + TIME '23:59:59' AS t, source_row_id FROM stock_snapshots_r)
  UNION ALL
  SELECT 'inward_report', 'daily', 36, max(t), (list(source_row_id ORDER BY t DESC, source_row_id DESC))[1]
  FROM (SELECT receipt_on + TIME '12:00:00' AS t, source_row_id FROM receipts_r)
  UNION ALL
  SELECT 'outward_report', 'daily', 36, max(t), (list(source_row_id ORDER BY t DESC, source_row_id DESC))[1]
  FROM (SELECT dispatch_on + TIME '12:00:00' AS t, source_row_id FROM dispatches_r)
  UNION ALL
  SELECT 'production_report', 'daily', 36, max(t), (list(source_row_id ORDER BY t DESC, source_row_id DESC))[1]
  FROM (SELECT run_date + TIME '00:00:00' AS t, source_row_id FROM production_runs_r)
  UNION ALL
  SELECT 'quality_report', 'weekly', 192, max(t), (list(source_row_id ORDER BY t DESC, source_row_id DESC))[1]
  FROM (SELECT sample_on + TIME '12:00:00' AS t, source_row_id FROM quality_samples_r WHERE sample_stage = 'inward')
) WHERE latest_business_at IS NOT NULL"""

TOL = "0.05"

SQL["r02_missing_required_field"] = iss(
    "MISSING_REQUIRED_FIELD", "transport_work_order", "row_number", "source_row_id",
    "'Required field(s) missing: ' || concat_ws(', ', "
    + ", ".join(f"CASE WHEN {text_sql(cell(i))} = '' THEN '{n}' END" for i, n in WO_REQUIRED.items()) + ") || '.'",
    "FROM work_order_rows_r WHERE " + " OR ".join(f"{text_sql(cell(i))} = ''" for i in WO_REQUIRED))
SQL["r03_invalid_number"] = "\nUNION ALL\n".join(
    iss("INVALID_NUMBER", "transport_work_order", "row_number", "source_row_id",
        f"'{n} value ''' || {text_sql(cell(i))} || ''' is not a number.'",
        f"FROM work_order_rows_r WHERE {text_sql(cell(i))} <> '' AND NOT regexp_full_match({text_sql(cell(i))}, '^-+$') "
        f"AND {number_sql(cell(i))} IS NULL")
    for i, n in WO_NUMBERS.items())
SQL["r04_unmapped_lot"] = iss(
    "UNMAPPED_LOT", "planning_stock", "lot_text", "source_row_id",
    "'Planning lot ' || lot_text || ' does not resolve to the lot master.'",
    "FROM planning_resolved_r WHERE lot_id IS NULL")
SQL["r05_missing_sales_order"] = iss(
    "MISSING_SALES_ORDER", "dispatch", "l_orderkey", "l_row",
    f"'Dispatch for PO ' || {s_sql('l_orderkey')} || ' has no sales order line.'",
    "FROM lineitem_r WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)")
SQL["r06_missing_dispatch_lot"] = iss(
    "MISSING_DISPATCH_LOT", "dispatch", "dispatch_id", "source_row_id",
    f"'Dispatch on ' || {s_sql('dispatch_on')} || ' has no lot linkage.'",
    "FROM dispatches_r WHERE lot_id IS NULL")
SQL["r07_missing_dispatch_permit"] = iss(
    "MISSING_DISPATCH_PERMIT", "dispatch", "dispatch_id", "source_row_id",
    f"'Dispatch permit P-' || {s_sql('permit_supplier_id')} || ' does not resolve to an outward permit.'",
    "FROM dispatches_r d WHERE NOT EXISTS (SELECT 1 FROM permits_r p WHERE p.direction = 'outward' "
    "AND p.permit_id = d.permit_supplier_id)")
SQL["r08_missing_production_lot"] = iss(
    "MISSING_PRODUCTION_LOT", "production_run", "production_run_id", "source_row_id",
    f"'Production input lot ' || {s_sql('lot_id')} || ' is not in the lot master.'",
    "FROM production_inputs_r i WHERE NOT EXISTS (SELECT 1 FROM lots_r l WHERE l.lot_id = i.lot_id)")
SQL["r09_summary_detail_mismatch"] = iss(
    "SUMMARY_DETAIL_MISMATCH", "purchase_lot", "CAST(p.supplier_id AS VARCHAR) || ':' || CAST(p.lot_id AS VARCHAR)",
    "p.source_row_id",
    f"'Reported lifted quantity ' || {s_sql('p.reported_lifted_quantity_mt')} || ' MT differs from calculated inward "
    f"receipts ' || {s_sql('p.calc')} || ' MT.'",
    f"""FROM (SELECT pl.*, CAST(COALESCE(r.q, 0) AS DECIMAL(18,3)) AS calc FROM purchase_lots_r pl
              LEFT JOIN (SELECT supplier_id, lot_id, sum(quantity_mt) AS q FROM receipts_r GROUP BY 1, 2) r
              ON r.supplier_id = pl.supplier_id AND r.lot_id = pl.lot_id) p
        WHERE p.reported_lifted_quantity_mt IS NOT NULL AND abs(p.reported_lifted_quantity_mt - p.calc) > {TOL}""") + \
    "\nUNION ALL\n" + iss(
    "SUMMARY_DETAIL_MISMATCH", "sales_order_line", "sales_order_line_id", "source_row_id",
    f"'Reported dispatched quantity ' || {s_sql('reported_dispatched_quantity_mt')} || ' MT differs from calculated "
    f"dispatches ' || {s_sql('calculated_quantity_mt')} || ' MT.'",
    f"FROM order_totals_r WHERE reported_dispatched_quantity_mt IS NOT NULL "
    f"AND abs(reported_dispatched_quantity_mt - calculated_quantity_mt) > {TOL}")
SQL["r10_order_over_dispatch"] = iss(
    "ORDER_OVER_DISPATCH", "sales_order_line", "sales_order_line_id", "source_row_id",
    f"'Calculated dispatch ' || {s_sql('calculated_quantity_mt')} || ' MT exceeds ordered quantity ' || "
    f"{s_sql('ordered_quantity_mt')} || ' MT.'",
    f"FROM order_totals_r WHERE calculated_quantity_mt > ordered_quantity_mt + {TOL}")
SQL["r11_permit_over_dispatch"] = iss(
    "PERMIT_OVER_DISPATCH", "permit", "permit_number", "source_row_id",
    f"'Dispatch ' || {s_sql('dispatched')} || ' MT exceeds permit quantity ' || {s_sql('permitted_quantity_mt')} || ' MT.'",
    f"""FROM (SELECT p.*, CAST(COALESCE(d.q, 0) AS DECIMAL(18,3)) AS dispatched FROM permits_r p
              LEFT JOIN (SELECT permit_supplier_id, sum(quantity_mt) AS q FROM dispatches_r GROUP BY 1) d
              ON d.permit_supplier_id = p.permit_id WHERE p.direction = 'outward')
        WHERE permitted_quantity_mt IS NOT NULL AND dispatched > permitted_quantity_mt + {TOL}""")
SQL["r12_dispatch_before_po_date"] = iss(
    "DISPATCH_BEFORE_PO_DATE", "sales_order_line", "sales_order_line_id", "source_row_id",
    f"'PO ' || po_number || ' is dated ' || {s_sql('po_date')} || ' but its first dispatch happened on ' || "
    f"{s_sql('first_dispatch_on')} || '.'",
    "FROM order_totals_r WHERE first_dispatch_on < po_date")
SQL["r13_stock_snapshot_mismatch"] = iss(
    "STOCK_SNAPSHOT_MISMATCH", "lot", "lot_id", "source_row_id",
    f"'Snapshot quantity ' || {s_sql('recorded_quantity_mt')} || ' MT differs from movement quantity ' || "
    f"{s_sql('calculated_quantity_mt')} || ' MT.'",
    f"FROM recon_r WHERE abs(recorded_quantity_mt - calculated_quantity_mt) > {TOL}")
SQL["r14_stock_aggregate_mass_balance"] = iss(
    "STOCK_AGGREGATE_MASS_BALANCE", "stock_snapshot", "'latest-aggregate'", "source_row_id",
    f"'Aggregate closing stock ' || {s_sql('recorded')} || ' MT does not reconcile with movements ' || "
    f"{s_sql('calculated')} || ' MT within ' || {s_sql('tol')} || ' MT.'",
    f"""FROM (SELECT *, CAST(greatest({TOL}, recorded * 0.001) AS DECIMAL(18,3)) AS tol FROM (
              SELECT CAST(sum(recorded_quantity_mt) AS DECIMAL(18,3)) AS recorded,
                     CAST(sum(calculated_quantity_mt) AS DECIMAL(18,3)) AS calculated,
                     min(source_row_id) AS source_row_id, count(*) AS n FROM recon_r))
        WHERE n > 0 AND abs(recorded - calculated) > tol""")
SQL["r15_production_mass_balance"] = iss(
    "PRODUCTION_MASS_BALANCE", "production_run", "production_run_id", "source_row_id",
    f"'Feed ' || {s_sql('feed_quantity_mt')} || ' MT does not reconcile with produced plus tailings ' || "
    f"{s_sql('out')} || ' MT within ' || {s_sql('tol')} || ' MT.'",
    f"""FROM (SELECT *, CAST(recovered_quantity_mt + tailings_quantity_mt AS DECIMAL(18,3)) AS out,
                 CAST(greatest({TOL}, feed_quantity_mt * 0.01) AS DECIMAL(18,3)) AS tol
          FROM v7_r WHERE feed_quantity_mt > 0) WHERE abs(feed_quantity_mt - out) > tol""")
SQL["r16_dmg_stock_difference"] = iss(
    "DMG_STOCK_DIFFERENCE", "quality_sample", "source_row_id", "source_row_id",
    f"'DMG-declared quantity ' || {s_sql('declared_quantity_mt')} || ' MT differs from inward quantity ' || "
    f"{s_sql('represented_quantity_mt')} || ' MT.'",
    f"FROM inward_samples_r WHERE declared_quantity_mt IS NOT NULL "
    f"AND abs(declared_quantity_mt - represented_quantity_mt) > {TOL}")
SQL["r17_quality_inward_mismatch"] = iss(
    "QUALITY_INWARD_MISMATCH", "quality_sample", "q.source_row_id", "q.source_row_id",
    f"'Quality record quantity ' || {s_sql('q.represented_quantity_mt')} || ' MT differs from linked inward receipt ' || "
    f"{s_sql('r.quantity_mt')} || ' MT.'",
    f"FROM inward_samples_r q JOIN receipts_r r ON r.source_row_id = q.source_row_id "
    f"WHERE abs(r.quantity_mt - q.represented_quantity_mt) > {TOL}")
SQL["r18_invalid_quality_range"] = iss(
    "INVALID_QUALITY_RANGE", "quality_sample", "sample_key", "source_row_id",
    f"code || ' value ' || {s_sql('value')} || ' is outside 0 to 100%.'",
    "FROM measure_long_r WHERE value < 0 OR value > 100")
_BANDS = " ".join(f"WHEN '{c}' THEN [CAST({lo} AS DECIMAL(6,1)), CAST({hi} AS DECIMAL(6,1))]"
                  for c, (lo, hi) in clean.PLAUSIBLE_BANDS.items())
SQL["r19_quality_plausibility"] = iss(
    "QUALITY_PLAUSIBILITY", "quality_sample", "sample_key", "source_row_id",
    f"code || ' value ' || {s_sql('value')} || '% is outside the plausible band ' || {s_sql('band[1]')} || '-' || "
    f"{s_sql('band[2]')} || '%.'",
    f"FROM (SELECT *, CASE code {_BANDS} END AS band FROM measure_long_r WHERE value BETWEEN 0 AND 100) "
    f"WHERE band IS NOT NULL AND (value < band[1] OR value > band[2])")
SQL["r20_invalid_recovery_range"] = iss(
    "INVALID_RECOVERY_RANGE", "production_run", "production_run_id", "source_row_id",
    f"'Reported recovery ' || {s_sql('reported_recovery_pct')} || '% is outside 0 to 100%.'",
    "FROM production_runs_r WHERE reported_recovery_pct < 0 OR reported_recovery_pct > 100")
SQL["r21_recovery_outlier"] = iss(
    "RECOVERY_OUTLIER", "production_run", "pr.production_run_id", "pr.source_row_id",
    f"'Recovery ' || {s_sql('pr.reported_recovery_pct')} || '% is far from the material mean.'",
    """FROM production_runs_r pr JOIN (
         SELECT source_material_name, count(*) AS records, avg(CAST(reported_recovery_pct AS DOUBLE)) AS mean_recovery,
                stddev_samp(CAST(reported_recovery_pct AS DOUBLE)) AS sd
         FROM production_runs_r WHERE reported_recovery_pct BETWEEN 0 AND 100 GROUP BY 1) s
       ON s.source_material_name = pr.source_material_name
       WHERE s.records >= 5 AND abs(CAST(pr.reported_recovery_pct AS DOUBLE) - s.mean_recovery)
             > greatest(10.0, 3 * COALESCE(s.sd, 0.0))""")
SQL["r22_quantity_magnitude_jump"] = iss(
    "QUANTITY_MAGNITUDE_JUMP", "inventory_movement", "m.movement_id", "m.source_row_id",
    f"'Quantity ' || {s_sql('m.quantity_mt')} || ' is at least 10x above or below the group median.'",
    """FROM movements_r m JOIN (
         SELECT lot_id, event_type, direction, count(*) AS records,
                quantile_cont(CAST(quantity_mt AS DOUBLE), 0.5) AS median
         FROM movements_r WHERE quantity_mt IS NOT NULL GROUP BY 1, 2, 3) s
       ON s.lot_id = m.lot_id AND s.event_type = m.event_type AND s.direction = m.direction
       WHERE s.records >= 3 AND s.median > 0
         AND (CAST(m.quantity_mt AS DOUBLE) >= s.median * 10 OR CAST(m.quantity_mt AS DOUBLE) <= s.median / 10)""")
SQL["r23_rate_magnitude_jump"] = iss(
    "RATE_MAGNITUDE_JUMP", "lot_cost_component", "c.component_id", "c.source_row_id",
    f"'Rate ' || {s_sql('c.rate_inr_per_mt')} || ' is at least 10x above or below the group median.'",
    """FROM cost_components_r c JOIN (
         SELECT lot_id, component_code, count(*) AS records,
                quantile_cont(CAST(rate_inr_per_mt AS DOUBLE), 0.5) AS median
         FROM cost_components_r WHERE rate_inr_per_mt IS NOT NULL GROUP BY 1, 2) s
       ON s.lot_id = c.lot_id AND s.component_code = c.component_code
       WHERE s.records >= 3 AND s.median > 0 AND c.rate_inr_per_mt IS NOT NULL
         AND (CAST(c.rate_inr_per_mt AS DOUBLE) >= s.median * 10
              OR CAST(c.rate_inr_per_mt AS DOUBLE) <= s.median / 10)""")
SQL["r24_stale_source"] = iss(
    "STALE_SOURCE", "source_file", "workbook_name", "source_row_id",
    "workbook_name || ' is stale for its ' || cadence || ' cadence; latest business date is ' || "
    "strftime(latest_business_at, '%Y-%m-%d %H:%M:%S') || '.'",
    f"FROM freshness_r WHERE (epoch(TIMESTAMP '{AS_OF}') - epoch(latest_business_at)) / 3600.0 > maximum_age_hours")
SQL["r25_negative_reported_balance"] = iss(
    "NEGATIVE_REPORTED_BALANCE", "purchase_lot", "CAST(supplier_id AS VARCHAR) || ':' || CAST(lot_id AS VARCHAR)",
    "source_row_id", f"'Source reports ' || label || ' of ' || {s_sql('value')} || ' MT.'",
    """FROM (SELECT supplier_id, lot_id, source_row_id, 'balance to lift' AS label, reported_balance_to_lift_mt AS value
             FROM purchase_lots_r
             UNION ALL SELECT supplier_id, lot_id, source_row_id, 'payment-based balance', reported_payment_balance_mt
             FROM purchase_lots_r
             UNION ALL SELECT supplier_id, lot_id, source_row_id, 'permit balance', reported_permit_balance_mt
             FROM purchase_lots_r) WHERE value < 0""")
SQL["r26_transport_multi_lot"] = iss(
    "TRANSPORT_MULTI_LOT", "transport_work_order", "work_order_number", "source_row_id",
    "'Work order ' || work_order_number || ' covers several lots.'",
    "FROM work_orders_r WHERE regexp_matches(COALESCE(source_lot_text, ''), '[+,&]') "
    "OR contains(COALESCE(quantity_text, ''), '+')")
SQL["r27_possible_duplicate_organization"] = iss(
    "POSSIBLE_DUPLICATE_ORGANIZATION", "organization",
    "CAST(a.organization_id AS VARCHAR) || ':' || CAST(b.organization_id AS VARCHAR)", "b.organization_id",
    "'Possible spelling drift: ''' || a.legal_name || ''' and ''' || b.legal_name || '''.'",
    """FROM orgs_r a JOIN orgs_r b ON a.organization_id < b.organization_id
       WHERE length(a.normalized_name) >= 5 AND length(b.normalized_name) >= 5
         AND len(list_intersect(a.roles, b.roles)) > 0
         AND levenshtein(a.normalized_name, b.normalized_name) <= 2""")
SQL["r28_planning_stock_mismatch"] = iss(
    "PLANNING_STOCK_MISMATCH", "planning_stock", "p.lot_text", "p.source_row_id",
    f"'Planning quantity ' || {s_sql('p.planned_quantity_mt')} || ' MT differs from stock snapshot ' || "
    f"{s_sql('st.recorded_quantity_mt')} || ' MT.'",
    f"""FROM planning_resolved_r p
        LEFT JOIN (SELECT * FROM stock_snapshots_r WHERE snapshot_on = (SELECT max(snapshot_on) FROM stock_snapshots_r)) st
               ON st.lot_id = p.lot_id
        WHERE p.lot_id IS NOT NULL
          AND (st.recorded_quantity_mt IS NULL OR abs(st.recorded_quantity_mt - p.planned_quantity_mt) > {TOL})""")
SQL["r29_missing_payment_ledger"] = iss(
    "MISSING_PAYMENT_LEDGER", "payment", "NULL", "NULL",
    "'The payment ledger source is not available; payment status cannot be verified.'", "")
SQL["r30_missing_auction_buyer_source"] = iss(
    "MISSING_AUCTION_BUYER_SOURCE", "auction_bid_award", "NULL", "NULL",
    "'The auction buyer award source is empty.'",
    "WHERE NOT EXISTS (SELECT 1 FROM auction_awards_r)")

RULE_KEYS = list(SQL)
ISSUES_SQL = "SELECT DISTINCT * FROM (\n" + "\nUNION ALL\n".join(f"({SQL[k]})" for k in RULE_KEYS) + "\n)"
EXTRA["issues_r"] = ISSUES_SQL

# ---------------------------------------------------------------------------- Spark side


def duplicate_organization_pairs(L: StagedLedger) -> DataFrame:
    """Organisations (M1 over part names, brand as role) and their J7 similar pairs with names."""
    orgs = resolve.build_organizations(L.t.part, "p_name", "p_brand", "p_partkey")
    org_roles = orgs.select("organization_id", "normalized_name", F.explode("roles").alias("role"))
    pairs = (similarity.similar_pairs(org_roles, "organization_id", "normalized_name", "role")
             .select("id_a", "id_b").distinct())
    names = orgs.select("organization_id", "legal_name", "source_row_id")
    return (pairs.join(names.select(F.col("organization_id").alias("id_a"), F.col("legal_name").alias("name_a")), "id_a")
            .join(names.select(F.col("organization_id").alias("id_b"), F.col("legal_name").alias("name_b"),
                               F.col("source_row_id").alias("source_row_id_b")), "id_b"))


def freshness_rows(L: StagedLedger) -> DataFrame:
    return checks.source_freshness({
        "stock_report": (L.stock_snapshots, "snapshot_on", "daily", 36, "23:59:59"),
        "inward_report": (L.receipts, "receipt_on", "daily", 36, "12:00:00"),
        "outward_report": (L.dispatches, "dispatch_on", "daily", 36, "12:00:00"),
        "production_report": (L.production_runs, "run_date", "daily", 36, "00:00:00"),
        "quality_report": (L.quality_samples.where(F.col("sample_stage") == "inward"), "sample_on", "weekly", 192,
                           "12:00:00"),
    })


class _Lazy(dict):
    """name -> DataFrame, built on first access."""

    def __init__(self, builders):
        super().__init__()
        self.builders = builders

    def __missing__(self, key):
        value = self[key] = self.builders[key]()
        return value

    passes: list = []
    apart: list = []  # passes that count repeated findings once by themselves, none of which can be another pass's
    once: list = []  # passes none of whose findings can repeat, or be another pass's
    alone: list = []  # rules whose findings can repeat, but not be those of a rule that is not listed with them

    def in_passes(self) -> list[DataFrame]:
        """All findings: the rules that share a pass together, the others one by one."""
        return [f for group in self.groups() for f in group] + self.unrepeated()

    def unrepeated(self) -> list[DataFrame]:
        return [build() for _, build in [*self.apart, *self.once]]

    def groups(self) -> list[list[DataFrame]]:
        """All findings but those of `apart` and `once`, in groups of which no two can have the same one."""
        done = {k for keys, _ in [*self.passes, *self.apart, *self.once] for k in keys} | {k for keys in self.alone for k in keys}
        rest = [build() for _, build in self.passes] + [self[k] for k in self.builders if k not in done]
        return [[self[k] for k in keys] for keys in self.alone] + [rest]


def rule_frames(spark, sf_dir, materialize: bool = False) -> _Lazy:
    """Every rule's issue DataFrame over the canonical relations of `sf_dir` (built on access).

    With `materialize=True` the shared relations are written once and read back
    (`MaterializedLedger`), which is how a 100 TB run should execute the issue table."""
    from ..adapters import MaterializedLedger
    L = MaterializedLedger(spark, sf_dir) if materialize else StagedLedger(spark, sf_dir)
    cache = {}

    def once(name, fn):
        def get():
            if name not in cache:
                cache[name] = fn()
            return cache[name]
        return get

    totals = once("totals", lambda: checks.order_dispatch_totals(L.sales_orders, L.dispatches))
    recon = once("recon", lambda: checks.snapshot_reconciliation(L.stock_snapshots, L.movements))
    planning = once("planning", lambda: resolve.resolve_alias(L.planning_rows, "lot_text", L.lot_aliases))
    long = once("long", lambda: checks.measure_long(L.sample_measures, "lot_id"))
    lines = once("lines", lambda: L.t.lineitem.select(
        "l_orderkey", F.col("l_row").alias("source_row_id")))
    pairs = once("pairs", lambda: duplicate_organization_pairs(L))
    freshness = once("freshness", lambda: freshness_rows(L))
    run = once("run", lambda: spark.range(1).select(F.lit(1).alias("import_run_id")))
    recovery = once("recovery", lambda: marts.production_recovery(L.production_runs, L.production_inputs,
                                                                   L.production_outputs))
    builders = {
        "r02_missing_required_field": lambda: checks.missing_required_fields(L.work_order_rows, WO_REQUIRED,
                                                                     "transport_work_order"),
        "r03_invalid_number": lambda: checks.invalid_numbers(L.work_order_rows, WO_NUMBERS, "transport_work_order"),
        "r04_unmapped_lot": lambda: checks.unmapped(planning(), "planning_stock", "lot_text", "Planning"),
        "r05_missing_sales_order": lambda: checks.missing_sales_order(lines(), L.sales_orders),
        "r06_missing_dispatch_lot": lambda: checks.missing_dispatch_lot(L.dispatches),
        "r07_missing_dispatch_permit": lambda: checks.missing_dispatch_permit(L.dispatches, L.permits),
        "r08_missing_production_lot": lambda: checks.missing_production_lot(L.production_inputs, L.lots),
        "r09_summary_detail_mismatch": lambda: checks.summary_detail_mismatch(L.purchase_lots, L.receipts, totals()),
        "r10_order_over_dispatch": lambda: checks.order_over_dispatch(totals()),
        "r11_permit_over_dispatch": lambda: checks.permit_over_dispatch(L.permits, L.dispatches),
        "r12_dispatch_before_po_date": lambda: checks.dispatch_before_po_date(totals()),
        "r13_stock_snapshot_mismatch": lambda: checks.stock_snapshot_mismatch(recon()),
        "r14_stock_aggregate_mass_balance": lambda: checks.stock_aggregate_mass_balance(recon()),
        "r15_production_mass_balance": lambda: checks.production_mass_balance(recovery()),
        "r16_dmg_stock_difference": lambda: checks.dmg_stock_difference(L.inward_samples),
        "r17_quality_inward_mismatch": lambda: checks.quality_inward_mismatch(L.inward_samples, L.receipts),
        "r18_invalid_quality_range": lambda: checks.invalid_quality_range(long()),
        "r19_quality_plausibility": lambda: checks.quality_plausibility(long()),
        "r20_invalid_recovery_range": lambda: checks.invalid_recovery_range(L.production_runs),
        "r21_recovery_outlier": lambda: checks.recovery_outlier(L.production_runs),
        "r22_quantity_magnitude_jump": lambda: checks.magnitude_jumps(
            L.movements, ["lot_id", "event_type", "direction"], "quantity_mt", "QUANTITY_MAGNITUDE_JUMP",
            "inventory_movement", "movement_id", "Quantity"),
        "r23_rate_magnitude_jump": lambda: checks.magnitude_jumps(
            L.cost_components, ["lot_id", "component_code"], "rate_inr_per_mt", "RATE_MAGNITUDE_JUMP",
            "lot_cost_component", "component_id", "Rate"),
        "r24_stale_source": lambda: checks.stale_sources(freshness(), AS_OF),
        "r25_negative_reported_balance": lambda: checks.negative_reported_balance(L.purchase_lots),
        "r26_transport_multi_lot": lambda: checks.transport_multi_lot(marts.transporter_work_orders(L.work_order_rows)),
        "r27_possible_duplicate_organization": lambda: checks.possible_duplicate_organizations(pairs()),
        "r28_planning_stock_mismatch": lambda: checks.planning_stock_mismatch(planning(), marts.latest_snapshot(L.stock_snapshots)),
        "r29_missing_payment_ledger": lambda: checks.empty_source_notice(
            spark.range(0), "MISSING_PAYMENT_LEDGER", "payment",
            "The payment ledger source is not available; payment status cannot be verified.", run()),
        "r30_missing_auction_buyer_source": lambda: checks.empty_source_notice(
            L.auction_awards, "MISSING_AUCTION_BUYER_SOURCE", "auction_bid_award",
            "The auction buyer award source is empty.", run()),
    }
    frames = _Lazy(builders)
    # The issue table applies the rules of one relation in one pass over it; what has no pass here goes by itself.
    frames.passes = [
        (("r04_unmapped_lot", "r28_planning_stock_mismatch"), lambda: checks.planning_findings(
            planning(), marts.latest_snapshot(L.stock_snapshots))),
    ]
    # Orders, runs, work orders and samples repeat where the tables' keys do; equal findings have one source row, so one order or
    # lot, by which the rows lie since they met it: repeated ones are merged there, and no text goes through a shuffle for it.
    frames.apart = [
        (("r02_missing_required_field", "r03_invalid_number", "r26_transport_multi_lot"), lambda: checks.findings(
            L.work_order_rows, checks.required_field_rule(WO_REQUIRED, "transport_work_order"),
            *checks.number_rules(WO_NUMBERS, "transport_work_order"), checks.multi_lot_rule(), by="source_row_id")),
        (("r05_missing_sales_order", "r06_missing_dispatch_lot", "r07_missing_dispatch_permit"), lambda: checks.line_findings(
            L.dispatch_lines, L.sales_orders, L.permits)),
        (("r09_summary_detail_mismatch", "r10_order_over_dispatch", "r12_dispatch_before_po_date"), lambda: checks.order_findings(
            totals(), by="sales_order_line_id")),
        (("r15_production_mass_balance",), lambda: checks.production_mass_balance(recovery(), by="production_run_id")),
        (("r18_invalid_quality_range", "r19_quality_plausibility"), lambda: checks.measure_findings(long(), by="lot_id")),
    ]
    frames.alone = [("r22_quantity_magnitude_jump",), ("r23_rate_magnitude_jump",), ("r24_stale_source",),
                    ("r08_missing_production_lot", "r11_permit_over_dispatch")]
    # Purchases are groups of lines, samples are lines, receipts are one per line: each has a source row of its own, whatever
    # repeats in the tables, and a rule fires once on it with one text.
    frames.once = [
        (("r09_summary_detail_mismatch", "r25_negative_reported_balance"), lambda: checks.purchase_findings(L.purchase_lots, L.receipts)),
        (("r16_dmg_stock_difference", "r17_quality_inward_mismatch"), lambda: checks.sample_findings(L.inward_samples, L.receipts)),
    ]
    return frames


def all_issues(spark, sf_dir, materialize: bool = False) -> DataFrame:
    """The run's findings: every rule, unioned and de-duplicated on the open-issue key."""
    return checks.union_issues(*rule_frames(spark, sf_dir, materialize).in_passes())


RUN_AT = "2002-01-01 00:00:00"  # the time of a run is a parameter, so that a repeated run gives the same table


def run_store(spark, sf_dir) -> RunStore:
    """The import runs of these rules over one landed folder, in the session's checkpoint folder."""
    rules = code_version(sys.modules[__name__], checks, issues, marts, resolve, similarity, adapters, clean, common)
    name = hashlib.sha256(f"{sf_dir}|{rules}".encode()).hexdigest()[:16]
    return RunStore(spark, f"{checkpoint_dir(spark).rstrip('/')}/opsledger-runs/{name}")


LANDED = ("nation", "customer", "supplier", "part", "orders", "lineitem")


def landed_size(t: Tables) -> int:
    """Bytes of the files that the ledger is made of."""
    return sum(int(v.split("|")[0]) for n in LANDED for v in landed_files(t.spark, t.path(n)).values())


def published_run(spark, sf_dir) -> RunStore:
    """The store of `sf_dir` with a completed run over its present files: checked once, read by every reader."""
    store, t = run_store(spark, sf_dir), Tables(spark, sf_dir)

    def check(store: RunStore, run: int):
        frames = rule_frames(spark, sf_dir)  # the history merges repeated findings
        if store.latest():
            after = [issues.next_history(store.read("issue_history"), checks.all_findings(*frames.in_passes()), run, RUN_AT)]
        else:
            none = issues.empty_history(spark)
            after = [issues.next_history(none, checks.all_findings(*group), run, RUN_AT) for group in frames.groups()]
            after += [issues.opened(found, run, RUN_AT) for found in frames.unrepeated()]
        history = store.write_parts(run, "issue_history", after)
        L = StagedLedger(spark, sf_dir)
        counted = lambda names, of: spark.createDataFrame([], "n long").unionByName(
            reduce(DataFrame.unionByName, [getattr(of, n).agg(F.count(F.lit(1)).alias("n")) for n in names])).agg(F.sum("n")).first()[0]
        return ["issue_history"], {
            "files_seen": len(LANDED), "rows_seen": counted(LANDED, t),
            "core_records_written": counted(("lots", "purchase_lots", "receipts", "sales_orders", "dispatches", "movements"), L),
            "issue_count": issues.open_issues(history).count()}

    with shuffles_for(spark, landed_size(t)):
        store.ensure(fingerprint(spark, [t.path(n) for n in LANDED]), RUN_AT, check)
    return store


def open_issue_table(spark, sf_dir) -> DataFrame:
    """The open issues of the latest completed run, as every reader takes them."""
    return issues.open_issues(published_run(spark, sf_dir).read("issue_history"))


def _rule_query(key):
    def q(spark, sf_dir):
        return rule_frames(spark, sf_dir)[key]
    q.__name__ = key
    return q


# R29's notice is part of the issue table; alone it would read no given table, so it is no query of its own.
for _k in (k for k in RULE_KEYS if k != "r29_missing_payment_ledger"):
    register(_k, SQL[_k], extra=EXTRA)(_rule_query(_k))


@register("v11_open_data_issues", f"""
SELECT *, TIMESTAMP '{RUN_AT}' AS opened_at FROM issues_r""", extra=EXTRA)
def v11(spark, sf_dir):
    return open_issue_table(spark, sf_dir).select(*checks.ISSUE_COLUMNS, "opened_at")


@register("v9_answer_readiness", """
SELECT CASE WHEN count(*) FILTER (WHERE severity = 'critical') > 0 THEN 'incomplete'
            WHEN count(*) FILTER (WHERE severity = 'warning') > 0 THEN 'flagged' ELSE 'verified' END AS status,
       CAST(count(*) FILTER (WHERE severity = 'critical') AS BIGINT) AS critical_issues,
       CAST(count(*) FILTER (WHERE severity = 'warning') AS BIGINT) AS warnings,
       CAST(count(*) FILTER (WHERE severity = 'info') AS BIGINT) AS informational_issues
FROM issues_r""", extra=EXTRA)
def v9(spark, sf_dir):
    return marts.answer_readiness(published_run(spark, sf_dir).read("issue_history"))


@register("s7_run_ledger", f"""
SELECT 'completed' AS status, '{RUN_AT}' AS started_at, '{RUN_AT}' AS finished_at, CAST(6 AS BIGINT) AS files_seen,
       (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part)
         + (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) AS rows_seen,
       (SELECT count(*) FROM lots_r) + (SELECT count(*) FROM purchase_lots_r) + (SELECT count(*) FROM receipts_r)
         + (SELECT count(*) FROM sales_orders_r) + (SELECT count(*) FROM dispatches_r) + (SELECT count(*) FROM movements_r) AS core_records_written,
       (SELECT count(*) FROM issues_r) AS issue_count, CAST(NULL AS VARCHAR) AS error_message""", extra=EXTRA)
def s7_ledger(spark, sf_dir):
    """The latest completed run's row of the ledger."""
    ledger = published_run(spark, sf_dir).ledger().where(F.col("status") == "completed")
    return ledger.orderBy(F.desc("run_id")).limit(1).drop("run_id")


CUT = "1995-06-30"
_TOTALS = EXTRA["order_totals_r"]
EXTRA["early_totals_r"] = _TOTALS.replace("FROM dispatches_r GROUP", f"FROM dispatches_r WHERE dispatch_on <= DATE '{CUT}' GROUP")
_ORDER_SQL = "\nUNION ALL\n".join([SQL["r09_summary_detail_mismatch"].split("\nUNION ALL\n")[1], SQL["r10_order_over_dispatch"],
                                    SQL["r12_dispatch_before_po_date"]])
EXTRA["late_found_r"] = _ORDER_SQL
EXTRA["early_found_r"] = _ORDER_SQL.replace("order_totals_r", "early_totals_r")


@register("s8_issue_lifecycle", """
SELECT rule_code, severity, entity_name, entity_key, source_row_id, message, CAST(2 AS BIGINT) AS opened_run, TIMESTAMP '1999-01-01' AS opened_at,
       CAST(NULL AS BIGINT) AS resolved_run, CAST(NULL AS TIMESTAMP) AS resolved_at
FROM (SELECT * FROM late_found_r EXCEPT SELECT * FROM early_found_r)
UNION ALL
SELECT *, 1, TIMESTAMP '1995-07-01', NULL, NULL FROM (SELECT * FROM late_found_r INTERSECT SELECT * FROM early_found_r)
UNION ALL
SELECT *, 1, TIMESTAMP '1995-07-01', 2, TIMESTAMP '1999-01-01' FROM (SELECT * FROM early_found_r EXCEPT SELECT * FROM late_found_r)""", extra=EXTRA)
def s8(spark, sf_dir):
    """The history of the order rules over two runs: with the dispatches to mid-1995, then with all of them."""
    L = StagedLedger(spark, sf_dir)
    store = RunStore(spark, f"{checkpoint_dir(spark).rstrip('/')}/opsledger-runs/{uuid.uuid4().hex}")
    early = L.dispatches.where(F.col("dispatch_on") <= F.lit(CUT).cast("date"))
    for at, dispatches in (("1995-07-01", early), ("1999-01-01", L.dispatches)):
        run = store.begin(at)
        before = store.read("issue_history") if store.latest() else issues.empty_history(spark)
        found = checks.union_issues(checks.order_findings(checks.order_dispatch_totals(L.sales_orders, dispatches)))
        store.write(run, "issue_history", issues.next_history(before, found, run, at))
        store.complete(run, at, ["issue_history"])
    return store.read("issue_history")


@register("v10_transporter_work_order_activity", "SELECT * FROM work_orders_r", extra=EXTRA)
def v10(spark, sf_dir):
    return marts.transporter_work_orders(StagedLedger(spark, sf_dir).work_order_rows)


@register("p8_issue_trust_summary", """
SELECT trust, CAST(count(*) AS BIGINT) AS issues, CAST(count(DISTINCT source_row_id) AS BIGINT) AS affected_rows,
       CAST(count(DISTINCT rule_code) AS BIGINT) AS rule_types
FROM (SELECT *, CASE WHEN regexp_matches(rule_code, '^(MISSING_|UNMAPPED_|INVALID_NUMBER)') THEN 'incomplete'
                     WHEN severity = 'info' THEN 'verified' ELSE 'flagged' END AS trust FROM issues_r)
GROUP BY trust""", extra=EXTRA)
def p8(spark, sf_dir):
    i = open_issue_table(spark, sf_dir).withColumn("trust", checks.trust_class(F.col("rule_code"), F.col("severity")))
    return i.groupBy("trust").agg(F.count(F.lit(1)).alias("issues"),
                                  F.count_distinct("source_row_id").alias("affected_rows"),
                                  F.count_distinct("rule_code").alias("rule_types"))


@register("r31_constraint_audit", "\nUNION ALL\n".join(constraints.audit_sql(n, spec) for n, spec in constraints.RELATIONS.items()))
def r31(spark, sf_dir):
    """Every declared constraint of the twenty fact relations."""
    L = StagedLedger(spark, sf_dir)
    with shuffles_for(spark, landed_size(L.t)):  # the offending keys are found at once
        return constraints.audit_all(lambda name: getattr(L, name))
