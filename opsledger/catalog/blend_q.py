"""Registered planning queries over whole tables: B5 achievable range, B6 purchase assessment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import StagedLedger
from ..plans import blend
from ..registry import register
from .marts_q import POSITIONS_SQL, positions

TARGET_FE = 40
EXTRA = {
    "positions_r": POSITIONS_SQL,
    "stock_r": """SELECT category AS product, CAST(lot_id AS VARCHAR) AS lot, available_quantity_mt AS quantity,
                         fe_pct AS fe, landed_cost_inr_per_mt AS landed_cost FROM positions_r""",
    "purchases_r": f"""SELECT CAST(p.supplier_id AS VARCHAR) || ':' || CAST(p.lot_id AS VARCHAR) AS purchase_id,
                             l.category AS product, l.lot_fe_pct AS grade, p.purchased_quantity_mt AS quantity,
                             l.lot_landed_cost AS landed_cost, CAST({TARGET_FE} AS DECIMAL(8,4)) AS target_fe
                      FROM purchase_lots_r p JOIN lots_r l ON l.lot_id = p.lot_id""",
}


def stock(L):
    return positions(L).select(F.col("category").alias("product"), F.col("lot_id").cast("string").alias("lot"),
                               F.col("available_quantity_mt").alias("quantity"), F.col("fe_pct").alias("fe"),
                               F.col("landed_cost_inr_per_mt").alias("landed_cost"))


def purchases(L):
    lots = L.lots.select("lot_id", "category", "lot_fe_pct", "lot_landed_cost")
    return L.purchase_lots.join(lots, "lot_id").select(
        F.concat_ws(":", F.col("supplier_id").cast("string"), F.col("lot_id").cast("string")).alias("purchase_id"),
        F.col("category").alias("product"), F.col("lot_fe_pct").alias("grade"),
        F.col("purchased_quantity_mt").alias("quantity"), F.col("lot_landed_cost").alias("landed_cost"),
        F.lit(TARGET_FE).cast("decimal(8,4)").alias("target_fe"))


@register("b5_achievable_range", """
SELECT product, min(fe) AS min_fe, max(fe) AS max_fe, sum(quantity) AS total_quantity
FROM stock_r WHERE quantity > 0 GROUP BY product""", extra=EXTRA)
def b5(spark, sf_dir):
    return blend.achievable_range(stock(StagedLedger(spark, sf_dir)))


EXTRA["b6s_r"] = """
  SELECT st.*, CAST(st.quantity AS DOUBLE) * CAST(st.fe - st.target_fe AS DOUBLE) AS lift FROM (
    SELECT b6s_r.*, t.target_fe FROM stock_r b6s_r JOIN (SELECT DISTINCT product, target_fe FROM purchases_r) t
      ON t.product = b6s_r.product WHERE b6s_r.quantity > 0 AND b6s_r.fe > t.target_fe) st"""
EXTRA["b6pre_r"] = """SELECT *, COALESCE(sum(lift) OVER (PARTITION BY product, target_fe ORDER BY fe DESC, lot
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b6s_r"""
EXTRA["b6tot_r"] = """SELECT product, target_fe, sum(lift) AS available_lift FROM b6s_r GROUP BY 1, 2"""
EXTRA["b6p_r"] = """SELECT *, CAST(quantity AS DOUBLE) * CAST(target_fe - grade AS DOUBLE) AS required FROM purchases_r"""
EXTRA["b6used_r"] = """
  SELECT b6p_r.purchase_id,
         least(CAST(b6pre_r.quantity AS DOUBLE), greatest(0.0, b6p_r.required - b6pre_r.before) / CAST(b6pre_r.fe - b6pre_r.target_fe AS DOUBLE))
             AS take, b6pre_r.landed_cost AS lc
  FROM b6p_r JOIN b6pre_r ON b6pre_r.product = b6p_r.product AND b6pre_r.target_fe = b6p_r.target_fe WHERE b6pre_r.before < b6p_r.required"""
EXTRA["b6agg_r"] = """SELECT purchase_id, sum(take) AS high_quantity, sum(take * CAST(lc AS DOUBLE)) AS high_cost,
               count(*) AS lots_used FROM b6used_r WHERE take > 0 GROUP BY 1"""
EXTRA["b6o_r"] = """
  SELECT b6p_r.*, COALESCE(a.high_quantity, 0) AS hq, COALESCE(a.high_cost, 0) AS hc, COALESCE(a.lots_used, 0) AS lots_used,
         b6p_r.required - least(COALESCE(t.available_lift, 0), greatest(b6p_r.required, 0)) AS residual
  FROM b6p_r LEFT JOIN b6tot_r t ON t.product = b6p_r.product AND t.target_fe = b6p_r.target_fe
  LEFT JOIN b6agg_r a ON a.purchase_id = b6p_r.purchase_id"""


@register("b6_assess_purchase", """
SELECT purchase_id, (required <= 0 OR residual <= 0.01) AS feasible,
       CASE WHEN required <= 0 OR residual <= 0.01 THEN round(hq, 2) END AS high_quantity,
       CASE WHEN required <= 0 OR residual <= 0.01 THEN round(CAST(quantity AS DOUBLE) + hq, 2) END AS total_quantity,
       CASE WHEN required <= 0 OR residual <= 0.01
            THEN round((CAST(quantity AS DOUBLE) * CAST(landed_cost AS DOUBLE) + hc) / (CAST(quantity AS DOUBLE) + hq), 2)
       END AS blended_cost,
       lots_used
FROM b6o_r""", extra=EXTRA)
def b6(spark, sf_dir):
    L = StagedLedger(spark, sf_dir)
    return blend.assess_purchase(stock(L), purchases(L))


EX_J8 = {
    "stock_texts_r": """
SELECT p_partkey AS stock_id, lower(regexp_replace(p_name || ' lot-' || CAST(p_partkey AS VARCHAR) || ' / '
                                    || CAST(p_size AS VARCHAR), '[^A-Za-z0-9]', '', 'g')) AS description
FROM part""",
    "purchase_keys_r": """
SELECT 'lot' || CAST(lot_id AS VARCHAR) AS lot_key, lot_id, supplier_id, purchase_date, source_row_id FROM purchase_lots_r"""}


@register("j8_stock_purchases_by_substring", """
SELECT s.stock_id, s.description, m.lot_id, m.supplier_id, m.purchase_date, m.source_row_id
FROM stock_texts_r s LEFT JOIN (
  SELECT description, arg_min(struct_pack(lot_id := lot_id, supplier_id := supplier_id, purchase_date := purchase_date,
                                          source_row_id := source_row_id), source_row_id) AS f
  FROM (SELECT DISTINCT description FROM stock_texts_r)
  JOIN (SELECT lot_key, arg_min(lot_id, source_row_id) AS lot_id, arg_min(supplier_id, source_row_id) AS supplier_id,
               arg_min(purchase_date, source_row_id) AS purchase_date, min(source_row_id) AS source_row_id
        FROM purchase_keys_r GROUP BY lot_key) ON contains(description, lot_key)
  GROUP BY description) j ON j.description = s.description
LEFT JOIN LATERAL (SELECT j.f.lot_id AS lot_id, j.f.supplier_id AS supplier_id, j.f.purchase_date AS purchase_date,
                          j.f.source_row_id AS source_row_id) m ON true""", extra=EX_J8)
def j8(spark, sf_dir):
    """Each stock description with the first purchase (by source row) whose lot its normalised text contains."""
    from ..functions import clean
    from ..operators.substring import first_contained
    L = StagedLedger(spark, sf_dir)
    stock = L.t.part.select(F.col("p_partkey").alias("stock_id"), clean.normalized(F.concat(
        "p_name", F.lit(" LOT-"), F.col("p_partkey").cast("string"), F.lit(" / "), F.col("p_size").cast("string"))).alias("description"))
    lots = L.purchase_lots.withColumn("key", clean.normalized(F.concat(F.lit("LOT-"), F.col("lot_id").cast("string"))))
    return first_contained(stock, "description", lots, "key", ["source_row_id"],
                           ["lot_id", "supplier_id", "purchase_date", "source_row_id"])


EX_B4 = EXTRA | {
    "demands_r": """
SELECT c_mktsegment || ':' || product AS demand_id, product, quantity, CAST(25.5 AS DECIMAL(8,4)) AS target_fe
FROM (SELECT c_mktsegment, CAST(round(avg(o_totalprice * 0.0005)) AS DECIMAL(18,3)) AS quantity
      FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) CROSS JOIN (SELECT DISTINCT product FROM stock_r)""",
    "b4_pairs_r": """
SELECT d.demand_id, l.lot AS low_lot, h.lot AS high_lot, l.fe AS low_fe, h.fe AS high_fe, l.quantity AS l_quantity, h.quantity AS h_quantity,
       l.landed_cost AS low_cost, h.landed_cost AS high_cost, CAST(d.quantity AS DOUBLE) AS dq,
       CAST(round(CAST(d.quantity AS DOUBLE) * (CAST(h.fe AS DOUBLE) - 25.5) / (CAST(h.fe AS DOUBLE) - CAST(l.fe AS DOUBLE)), 3) AS DECIMAL(18,3)) AS low_qty,
       CAST(round(CAST(d.quantity AS DOUBLE) - CAST(d.quantity AS DOUBLE) * (CAST(h.fe AS DOUBLE) - 25.5)
                  / (CAST(h.fe AS DOUBLE) - CAST(l.fe AS DOUBLE)), 3) AS DECIMAL(18,3)) AS high_qty
FROM demands_r d JOIN stock_r l ON l.product = d.product AND l.fe < d.target_fe JOIN stock_r h ON h.product = d.product AND h.fe > d.target_fe
WHERE l.quantity > 0 AND h.quantity > 0 AND l.landed_cost IS NOT NULL AND h.landed_cost IS NOT NULL"""}


@register("b4_cheapest_pairs", """
SELECT demand_id, rank, low_lot, high_lot, low_qty, high_qty, low_fe, high_fe, round(CAST(total AS DOUBLE) / dq, 2) AS blended_cost
FROM (SELECT *, row_number() OVER (PARTITION BY demand_id ORDER BY total, low_lot, high_lot) AS rank
      FROM (SELECT *, CAST(low_qty * low_cost + high_qty * high_cost AS DECIMAL(38,7)) AS total FROM b4_pairs_r
            WHERE low_qty <= l_quantity AND high_qty <= h_quantity)) WHERE rank <= 5""", extra=EX_B4)
def b4(spark, sf_dir):
    """The five cheapest two-lot mixes at grade 25.5 for each market segment's mean order, in every product."""
    L = StagedLedger(spark, sf_dir)
    means = (L.t.orders.join(L.t.customer, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment")
             .agg(F.round(F.avg(F.col("o_totalprice") * 0.0005)).cast("decimal(18,3)").alias("quantity")))
    lots = stock(L)
    products = F.explode(lots.agg(F.collect_set("product")).scalar())
    demands = means.withColumn("product", products).select(
        F.concat_ws(":", "c_mktsegment", "product").alias("demand_id"), "product", "quantity", F.lit(25.5).cast("decimal(8,4)").alias("target_fe"))
    return blend.cheapest_pairs_by_grade(lots, demands)
