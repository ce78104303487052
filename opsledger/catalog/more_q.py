"""Registered queries: mart documents (D1), context text (D3), organisations (M1), lot-register filter (P4),
whole-text normalisation (F1/F2) and JSON cell numbers (F4/F15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import StagedLedger
from ..functions import clean
from ..operators import marts, resolve, search
from ..registry import register
from ..sources.tables import Tables
from .marts_q import POSITIONS_SQL, V3_SQL, positions
from .rules_q import EXTRA as RULE_EXTRA, norm_sql, number_sql, text_sql
from .search_q import EXTRA as SEARCH_EXTRA, K, docs

EX = dict(RULE_EXTRA)
EX.update(SEARCH_EXTRA)
EX.update({"positions_r": POSITIONS_SQL, "v3_r": V3_SQL})

V3_COLS = ["category", "total_quantity_mt", "quality_covered_quantity_mt", "weighted_fe_pct",
           "cost_covered_quantity_mt", "weighted_landed_cost_inr_per_mt", "status"]


def _record_sql(cols):
    return "concat_ws('; ', " + ", ".join(
        f"CASE WHEN {c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '' THEN '{c}=' || CAST({c} AS VARCHAR) END"
        for c in cols) + ")"


@register("d1_mart_documents", f"""
SELECT 'inventory-' || category AS id, 'inventory stock lot quantity landed cost grade fe' AS area,
       {_record_sql(V3_COLS)} AS text, 'stock_quality_cost' AS source
FROM v3_r
UNION ALL
SELECT CAST(doc_id AS VARCHAR), area, text, source FROM docs_r""", extra=EX)
def d1(spark, sf_dir):
    v3 = marts.stock_quality_cost(positions(StagedLedger(spark, sf_dir)))
    mart_docs = v3.select(F.concat(F.lit("inventory-"), F.col("category")).alias("id"),
                          F.lit("inventory stock lot quantity landed cost grade fe").alias("area"),
                          clean.record_text(*V3_COLS).alias("text"), F.lit("stock_quality_cost").alias("source"))
    table_docs = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "area", "text", "source")
    return search.build_documents(mart_docs, table_docs)


@register("d3_context_text", f"""
SELECT r.item_id, string_agg('[' || CAST(r.rank AS VARCHAR) || '] ' || d.area || chr(10) || 'Source: ' || d.source
                             || chr(10) || 'Data: ' || d.text, chr(10) || chr(10) ORDER BY r.rank) AS context
FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
      FROM scored_r) r
JOIN docs_r d ON d.doc_id = r.doc_id WHERE r.rank <= {K} GROUP BY r.item_id
UNION ALL
SELECT b.item_id, string_agg('[' || CAST(f.rank AS VARCHAR) || '] ' || d.area || chr(10) || 'Source: ' || d.source
                             || chr(10) || 'Data: ' || d.text, chr(10) || chr(10) ORDER BY f.rank)
FROM benchmark b
JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents ORDER BY doc_id LIMIT 2) f ON true
JOIN docs_r d ON d.doc_id = f.doc_id
WHERE b.item_id NOT IN (SELECT item_id FROM scored_r) GROUP BY b.item_id""", extra=EX)
def d3(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d = docs(spark, sf_dir)
    return search.context_text(search.retrieve(t.benchmark, d, K), d)


@register("m1_build_organizations", "SELECT organization_id, legal_name, normalized_name, roles, "
                                     "organization_id AS source_row_id FROM orgs_r", extra=EX)
def m1(spark, sf_dir):
    return resolve.build_organizations(Tables(spark, sf_dir).part, "p_name", "p_brand", "p_partkey")


P4_TEXT, P4_CATEGORY, P4_MIN_GRADE = "ring", "promo", 30


@register("p4_lot_register_filter", f"""
SELECT CAST(sum(available_quantity_mt) AS DECIMAL(18,3)) AS total_quantity_mt, count(*) AS lots,
       CAST(round(sum(available_quantity_mt * COALESCE(landed_cost_inr_per_mt, 0)), 2) AS DECIMAL(24,2)) AS stock_value,
       CAST(CAST(sum(available_quantity_mt * COALESCE(fe_pct, 0)) AS DOUBLE)
            / NULLIF(CAST(sum(available_quantity_mt) AS DOUBLE), 0) AS DECIMAL(12,5)) AS weighted_fe_all_pct,
       CAST(sum(available_quantity_mt) FILTER (WHERE fe_pct >= {P4_MIN_GRADE}) AS DECIMAL(18,3)) AS high_grade_quantity_mt
FROM positions_r p JOIN lots_r l ON l.lot_id = p.lot_id
WHERE contains(lower(concat_ws(' ', l.house_lot_number, l.description, l.category)), '{P4_TEXT}')
  AND p.category = '{P4_CATEGORY}'""", extra=EX)
def p4(spark, sf_dir):
    from ..operators.common import ratio
    L = StagedLedger(spark, sf_dir)
    pos = positions(L).join(L.lots.select("lot_id", "house_lot_number", "description"), "lot_id")
    hay = F.lower(F.concat_ws(" ", "house_lot_number", "description", "category"))
    sel = pos.where(hay.contains(P4_TEXT) & (F.col("category") == P4_CATEGORY))
    q = F.col("available_quantity_mt")
    # missing grade counts as 0 in this register view (unlike the mart, which excludes it)
    return sel.agg(F.sum(q).cast("decimal(18,3)").alias("total_quantity_mt"), F.count(F.lit(1)).alias("lots"),
                   F.round(F.sum(q * F.coalesce("landed_cost_inr_per_mt", F.lit(0))), 2).cast("decimal(24,2)")
                   .alias("stock_value"),
                   ratio(F.sum(q * F.coalesce("fe_pct", F.lit(0))), F.sum(q), "decimal(12,5)").alias("weighted_fe_all_pct"),
                   F.sum(F.when(F.col("fe_pct") >= P4_MIN_GRADE, q)).cast("decimal(18,3)").alias("high_grade_quantity_mt"))


@register("f2_normalized_documents", f"""
SELECT doc_id, sha256({norm_sql('text')}) AS normalized_hash, CAST(length({norm_sql('text')}) AS BIGINT) AS normalized_length,
       CAST(length({text_sql('text')}) AS BIGINT) AS text_length
FROM documents""")
def f2(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    n = clean.normalized("text")
    return d.select("doc_id", F.sha2(n, 256).alias("normalized_hash"), F.length(n).cast("bigint").alias("normalized_length"),
                    F.length(clean.text("text")).cast("bigint").alias("text_length"))


@register("f4_event_prop_numbers", f"""
SELECT event_type, count(*) AS events, count(v) AS parsed, CAST(sum(CAST(v AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total
FROM (SELECT event_type, {number_sql("json_extract_string(props, '$.k')")} AS v FROM events) GROUP BY event_type""")
def f4(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    v = clean.number(F.get_json_object("props", "$.k"))
    return e.select("event_type", v.alias("v")).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count("v").alias("parsed"),
        F.sum(F.col("v").cast("decimal(18,2)")).cast("decimal(18,2)").alias("total"))
