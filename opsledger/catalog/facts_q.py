"""Registered fact builders from staged sheets (M8) and their unmapped-lot issues."""

from __future__ import annotations

from ..adapters import StagedLedger
from ..operators import facts
from ..registry import register
from .rules_q import norm_sql

LOT_TEXT = "CASE WHEN l_returnflag = 'A' THEN 'L-' || CAST(l_partkey AS VARCHAR) ELSE 'LOT-' || CAST(l_partkey AS VARCHAR) END"
EXTRA = {
    "inward_typed_r": f"""
        SELECT l_row AS source_row_id, CAST(l_shipdate AS DATE) AS receipt_on,
               'SUP-' || CAST(l_suppkey AS VARCHAR) AS supplier, {LOT_TEXT} AS lot_text, l_quantity AS quantity,
               CAST(l_linenumber AS BIGINT) AS trip_count, 'P-' || CAST(l_suppkey AS VARCHAR) AS permit_number,
               CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_partkey END AS lot_id
        FROM lineitem_r""",
}
_KEY = ["CAST(receipt_on AS VARCHAR)", "supplier", "lot_text", "permit_number", "CAST(CAST(quantity AS DECIMAL(18,3)) AS VARCHAR)",
        "CAST(trip_count AS VARCHAR)"]
EXTRA["inward_keyed_r"] = f"""
    SELECT *, 'inward|' || {" || '|' || ".join(norm_sql(k) for k in _KEY)} AS business_key
    FROM inward_typed_r"""


@register("m8_build_receipts", """
SELECT business_key, receipt_on, supplier, lot_id, lot_text, CAST(quantity AS DECIMAL(18,3)) AS quantity_mt,
       trip_count, permit_number, source_row_id
FROM (SELECT *, row_number() OVER (PARTITION BY business_key ORDER BY source_row_id DESC, receipt_on DESC,
        supplier DESC, lot_text DESC, quantity DESC, trip_count DESC, permit_number DESC, lot_id DESC) AS rn
      FROM inward_keyed_r) WHERE rn = 1""", extra=EXTRA)
def m8(spark, sf_dir):
    L = StagedLedger(spark, sf_dir)
    return facts.build_receipts(L.inward_rows, L.lot_aliases)[0]


@register("m8_unmapped_receipt_lots", """
SELECT 'UNMAPPED_LOT' AS rule_code, 'critical' AS severity, 'inward_receipt' AS entity_name, lot_text AS entity_key,
       source_row_id, 'Inward receipt lot ' || lot_text || ' does not resolve to the lot master.' AS message
FROM inward_typed_r WHERE lot_id IS NULL""", extra=EXTRA)
def m8u(spark, sf_dir):
    L = StagedLedger(spark, sf_dir)
    return facts.build_receipts(L.inward_rows, L.lot_aliases)[1]
