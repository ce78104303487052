"""Fact builders from staged sheets (M-series): cells -> typed, resolved, upserted facts.

The pattern of every builder: skip header rows (P2), require key cells (P1), parse text
cells with the F-functions, resolve lot text through the alias table (J9), derive the
business key (F7) and keep the last write per key (W2).  Receipts and purchases whose lot does
not resolve stay, with a null lot, and raise an UNMAPPED_LOT issue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean
from . import checks
from .resolve import build_organizations, dedupe_latest, last_lookup, resolve_alias


STEP = 2  # expressions that one generator makes


def cell_columns(rows: DataFrame, cells: list[int]) -> DataFrame:
    """(source_row_id, row_number, c<i>...) of staged rows with the given cells as columns, each made once for a row."""
    return made_once(rows, ["source_row_id", "row_number"], {f"c{i}": F.get("cells", F.lit(i)) for i in cells})


def made_once(df: DataFrame, keep: list[str], made: dict[str, Column]) -> DataFrame:
    """The columns `keep` of `df` and the expressions `made`, each evaluated once for a row, whatever reads it.

    What is parsed from a cell is mentioned in the filter on it, in keys and again in the result, and the optimizer would put
    the whole expression in each place; it does not carry one through a generator.  A few go into one generator: a step of
    many is compiled to a method that is too long for the JVM to compile further."""
    names = list(made)
    for i in range(0, len(names), STEP):
        some = names[i:i + STEP]
        df = df.select("*", F.stack(F.lit(1), *[made[n] for n in some]).alias(*some))
    return df.select(*keep, *names)


def build_receipts(rows: DataFrame, aliases: DataFrame, header_rows: int = 1) -> tuple[DataFrame, DataFrame]:
    """M8: inward receipts from a 'Daily Inward Details' sheet.

    cells: 0 date, 2 supplier, 3 lot, 4 quantity, 5 trips, 6 permit.  Keyed by all of them, so a
    second import of the same row changes nothing; a lot that does not resolve is null.
    Returns (receipts, unmapped-lot issues)."""
    c = F.col("cells")
    typed = rows.where(F.col("row_number") > header_rows).select(
        "source_row_id",
        clean.date(F.get(c, 0)).alias("receipt_on"),
        clean.text(F.get(c, 2)).alias("supplier"),
        clean.text(F.get(c, 3)).alias("lot_text"),
        clean.number(F.get(c, 4)).alias("quantity"),
        clean.integer(F.get(c, 5)).alias("trip_count"),
        clean.text(F.get(c, 6)).alias("permit_number"), clean.text(F.get(c, 5)).alias("_trips"))
    typed = typed.where(F.col("receipt_on").isNotNull() & (F.col("supplier") != "") & (F.col("lot_text") != "")
                        & F.col("quantity").isNotNull())
    resolved = resolve_alias(typed, "lot_text", aliases)
    issues = checks.unmapped(resolved, "inward_receipt", "lot_text", "Inward receipt")
    facts = resolved.withColumn(
        "business_key", clean.business_key(F.lit("inward"), F.col("receipt_on").cast("string"), F.col("supplier"),
                                           F.col("lot_text"), F.col("permit_number"),
                                           F.col("quantity").cast("decimal(18,3)").cast("string"), F.col("_trips")))
    facts = dedupe_latest(facts, ["business_key"], ["source_row_id"])
    return facts.select("business_key", "receipt_on", "supplier", "lot_id", "lot_text",
                        F.col("quantity").cast("decimal(18,3)").alias("quantity_mt"), "trip_count",
                        "permit_number", "source_row_id"), issues


def build_materials(lots_text: DataFrame) -> DataFrame:
    """M2: one material per material_code from (ore type, sub type, size) text (F11), with its label."""
    parts = clean.material_parts("ore_type", "sub_type", "size")
    m = lots_text.select(*[v.alias(k) for k, v in parts.items()])
    return m.dropDuplicates(["material_code"]).select(
        "material_code", "mineral", "category", "size_spec", clean.category_label("category").alias("category_label"))


def build_lots(rows: DataFrame, header_rows: int = 1) -> tuple[DataFrame, DataFrame]:
    """M3: lots and their aliases from the 'LOT MASTER' sheet.

    cells: 0 house lot, 1 lifecycle status, 2 sub type, 3 ore type, 4 description, 5 size, 6 source lot.  One lot per house
    lot number, its id the first source row that names it, the rest from the last one.  Every house lot, source lot and
    description that a row gives is an alias of its lot, one per (lot, normalised text): the first spelling, the last source row.
    Rows without a house lot are no lots.  Returns (lots, aliases)."""
    c = F.col("cells")
    t = rows.where(F.col("row_number") > header_rows).select(
        "source_row_id", clean.text(F.get(c, 0)).alias("house_lot_number"), clean.lifecycle_status(F.get(c, 1)).alias("lifecycle_status"),
        F.nullif(clean.text(F.get(c, 6)), F.lit("")).alias("source_lot_number"), F.nullif(clean.text(F.get(c, 4)), F.lit("")).alias("description"),
        clean.material_parts(F.get(c, 3), F.get(c, 2), F.get(c, 5))["material_code"].alias("material_code"))
    t = t.where(F.col("house_lot_number") != "")
    rest = ["material_code", "source_lot_number", "description", "lifecycle_status", "source_row_id"]
    lots = t.groupBy("house_lot_number").agg(F.min("source_row_id").alias("lot_id"),
                                             F.max_by(F.struct(*rest), "source_row_id").alias("last")).select(
        "lot_id", "house_lot_number", *[F.col(f"last.{x}").alias(x) for x in rest])
    named = t.select("house_lot_number", "source_row_id", F.posexplode(F.array("house_lot_number", "source_lot_number", "description"))
                     .alias("place", "alias")).withColumn("normalized_alias", clean.normalized("alias"))
    spelled = named.where(F.col("normalized_alias") != "").groupBy("house_lot_number", "normalized_alias").agg(
        F.min_by("alias", F.struct("source_row_id", "place")).alias("alias"), F.max("source_row_id").alias("source_row_id"))
    aliases = spelled.join(lots.select("house_lot_number", "lot_id"), "house_lot_number").select(
        "lot_id", "alias", "normalized_alias", "source_row_id")
    return lots, aliases


def build_movements(rows: DataFrame, aliases: DataFrame, header_rows: int = 1) -> tuple[DataFrame, DataFrame]:
    """Inventory movements from a day-book sheet: signed in/out columns unpivoted (P5, zeros and
    blanks dropped, absolute quantity), event classified (F10), lot resolved (J9).

    cells: 0 date, 1 lot, 4 event text, 5 inward, 6 outward, 25 reference.  The key holds all of them, the direction and
    the row's number; rows without a known lot raise an issue and are no movement."""
    c = F.col("cells")
    typed = rows.where(F.col("row_number") > header_rows).select(
        "source_row_id", "row_number", clean.date(F.get(c, 0)).alias("occurred_on"), clean.text(F.get(c, 1)).alias("lot_text"),
        clean.text(F.get(c, 4)).alias("event_text"), clean.movement_event(F.get(c, 4)).alias("event_type"),
        clean.number(F.get(c, 5)).alias("inward"), clean.number(F.get(c, 6)).alias("outward"),
        F.nullif(clean.text(F.get(c, 25)), F.lit("")).alias("reference_key"))
    typed = typed.where(F.col("occurred_on").isNotNull() & (F.col("lot_text") != "")
                        & (F.col("inward").isNotNull() | F.col("outward").isNotNull()))
    resolved = resolve_alias(typed, "lot_text", aliases)
    issues = checks.unmapped(resolved, "inventory_movement", "lot_text", "DAILY BOOKS")
    long = resolved.where(F.col("lot_id").isNotNull()).select(
        "*", F.expr("stack(2, 'in', inward, 'out', outward) AS (direction, q)"))
    long = long.where(F.col("q").isNotNull() & (F.col("q") != 0)).withColumn("business_key", clean.business_key(
        F.lit("book"), F.col("occurred_on").cast("string"), F.col("lot_text"), F.col("event_text"), F.col("direction"),
        F.col("q").cast("decimal(18,3)").cast("string"), F.col("reference_key"), F.col("row_number").cast("string")))
    latest = dedupe_latest(long, ["business_key"], ["source_row_id"])
    return latest.select("business_key", "source_row_id", "occurred_on", "lot_id", "event_type", "direction",
                         F.abs(F.col("q")).cast("decimal(18,3)").alias("quantity_mt"), "reference_key"), issues


def build_dispatches(rows: DataFrame, customers: DataFrame, orders: DataFrame, permits: DataFrame,
                     header_rows: int = 1) -> tuple[DataFrame, DataFrame]:
    """Dispatches from a 'Daily Outward Detail' sheet, keyed by date, customer, PO, permit, quantity and vehicles
    (last write wins).

    cells: 0 date, 1 customer, 2 PO, 3 quantity, 4 vehicles, 5 permit, 10 Fe.
    The customer resolves by its normalised organisation name (F3); the order line by the last-written line for
    (customer, normalised PO) (J10); the permit by the last-written outward permit of its number (J10).  Each lookup
    has one row per key, so no row is repeated; what does not resolve is null.  A dispatch's lot is unknown in this
    sheet.  Returns (dispatches, issues R5 + R6 + R7)."""
    typed = made_once(cell_columns(rows.where(F.col("row_number") > header_rows), [0, 1, 2, 3, 4, 5, 10]), ["source_row_id"], {
        "dispatch_on": clean.date("c0"), "customer": clean.text("c1"), "po_number": clean.text("c2"), "quantity": clean.number("c3"),
        "vehicle_count": clean.integer("c4"), "_vehicles": clean.text("c4"), "permit_number": clean.text("c5"), "fe_pct": clean.number("c10")})
    typed = typed.where(F.col("dispatch_on").isNotNull() & (F.col("customer") != "") & (F.col("po_number") != "")
                        & F.col("quantity").isNotNull())
    cust = (customers.groupBy(clean.normalized_organization("legal_name").alias("_ck"))
            .agg(F.min("customer_id").alias("customer_id")))
    typed = (typed.withColumn("_ck", clean.normalized_organization("customer")).join(cust, "_ck", "left").drop("_ck")
             .withColumn("_po", clean.normalized("po_number")))  # what follows from other columns is made after the joins or dropped
    o = orders.select(F.col("customer_id").alias("o_customer"), clean.normalized("po_number").alias("o_po"),
                      "sales_order_line_id", F.col("source_row_id").alias("o_src"))
    typed = last_lookup(typed, ["customer_id", "_po"], o, ["o_customer", "o_po"], ["o_src", "sales_order_line_id"],
                        "sales_order_line_id", "sales_order_line_id").drop("_po")
    p = permits.where(F.col("direction") == "outward").select(F.col("permit_number").alias("p_number"), "permit_id",
                                                              F.col("source_row_id").alias("p_src"))
    typed = last_lookup(typed, ["permit_number"], p, ["p_number"], ["p_src", "permit_id"], "permit_id", "permit_id")
    typed = made_once(typed, typed.columns, {"business_key": clean.business_key(
        F.lit("dispatch"), F.col("dispatch_on").cast("string"), F.col("customer"), F.col("po_number"), F.col("permit_number"),
        F.col("quantity").cast("decimal(18,3)").cast("string"), F.col("_vehicles"))})
    key, row = F.col("business_key"), F.col("source_row_id")
    issues = checks.findings(
        typed, checks.rule("MISSING_SALES_ORDER", "dispatch", F.col("sales_order_line_id").isNull(), F.concat_ws(":", "customer", "po_number"), row,
                           checks.msg("Dispatch for PO ", F.col("po_number"), " has no sales order line.")),
        checks.rule("MISSING_DISPATCH_PERMIT", "dispatch", F.col("permit_id").isNull(), key, row,
                    F.when(F.col("permit_number") == "", checks.msg("Dispatch for PO ", F.col("po_number"), " names no permit.")).otherwise(
                        checks.msg("Dispatch permit ", F.col("permit_number"), " does not resolve to an outward permit."))),
        checks.rule("MISSING_DISPATCH_LOT", "dispatch", F.lit(True), key, row, F.lit("The dispatch sheet carries no lot.")))
    kept = typed.drop("customer", "po_number", "permit_number", "_vehicles")  # the texts are in the key; only what is returned is shuffled
    facts = dedupe_latest(kept, ["business_key"], ["source_row_id"]).select(
        "business_key", "source_row_id", "dispatch_on", "customer_id", "sales_order_line_id", "permit_id",
        F.col("quantity").cast("decimal(18,3)").alias("quantity_mt"), "vehicle_count",
        F.col("fe_pct").cast("decimal(12,6)").alias("fe_pct"))
    return facts, issues


def build_production(rows: DataFrame, aliases: DataFrame, header_rows: int = 4
                     ) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Production runs, inputs and outputs from the production sheet, runs keyed by date, shift, type, material and
    row number (last write wins).

    cells: 0 date, 1 shift, 2 type, 3 material type, 4 material, 5 feed, 29 tailings, 32 product, 40 recovered,
    41 recovery %.  Rows without date, material or feed are no runs.  The input lot is the material's name resolved as
    a lot (J9), null with an R8 issue where that fails.  Recovered falls back from column 40 to column 32; tailings are
    an output only when > 0; outputs carry the material they are of (F11).  A recovery outside 0..100 is kept and
    raises R20.  Returns (runs, inputs, outputs, issues)."""
    c = F.col("cells")
    t = rows.where(F.col("row_number") > header_rows).select(
        "source_row_id", "row_number", clean.date(F.get(c, 0)).alias("run_date"), clean.text(F.get(c, 1)).alias("shift"),
        clean.text(F.get(c, 2)).alias("run_type"), clean.text(F.get(c, 3)).alias("material_type"),
        clean.text(F.get(c, 4)).alias("source_material_name"),
        clean.number(F.get(c, 5)).alias("feed"), clean.number(F.get(c, 29)).alias("tailings"),
        F.coalesce(clean.number(F.get(c, 40)), clean.number(F.get(c, 32))).alias("recovered"),
        clean.number(F.get(c, 41)).alias("recovery_pct"))
    t = t.where(F.col("run_date").isNotNull() & (F.col("source_material_name") != "") & F.col("feed").isNotNull())
    t = resolve_alias(t, "source_material_name", aliases).withColumn("business_key", clean.business_key(
        F.lit("production"), F.col("run_date").cast("string"), F.col("shift"), F.col("run_type"),
        F.col("source_material_name"), F.col("row_number").cast("string")))
    t = t.withColumn("material_code", clean.material_parts("material_type", "material_type", F.lit(None))["material_code"])
    key, row = F.col("business_key"), F.col("source_row_id")
    issues = checks.findings(
        t, checks.rule("MISSING_PRODUCTION_LOT", "production_run", F.col("lot_id").isNull(), key, row,
                       checks.msg("Production material ", F.col("source_material_name"), " is not a known input lot.")),
        checks.rule("INVALID_RECOVERY_RANGE", "production_run", (F.col("recovery_pct") < 0) | (F.col("recovery_pct") > 100), key, row,
                    checks.msg("Reported recovery ", F.col("recovery_pct").cast("decimal(12,4)").cast("string"),
                               "% is outside 0 to 100%.")))
    t = dedupe_latest(t, ["business_key"], ["source_row_id"])
    runs = t.select("business_key", F.col("source_row_id").alias("production_run_id"), "run_date",
                    F.nullif("shift", F.lit("")).alias("shift"),
                    F.nullif(F.trim(F.concat_ws(" ", "run_type", "material_type")), F.lit("")).alias("process"),
                    "source_material_name", F.col("recovery_pct").cast("decimal(8,4)").alias("reported_recovery_pct"),
                    "source_row_id")
    of_run = [F.col("business_key").alias("run_key"), F.col("source_row_id").alias("production_run_id")]
    q = lambda c: F.col(c).cast("decimal(18,3)").alias("quantity_mt")
    inputs = t.select(*of_run, "lot_id", q("feed"), "source_row_id")
    rec = t.where(F.col("recovered").isNotNull()).select(
        *of_run, F.lit("recovered_total").alias("output_type"), "material_code", q("recovered"), "source_row_id")
    tail = t.where(F.col("tailings") > 0).select(
        *of_run, F.lit("tailings").alias("output_type"), F.lit("iron_ore:tailings:unspecified").alias("material_code"),
        q("tailings"), "source_row_id")
    return runs, inputs, rec.unionByName(tail), issues


def build_purchases(rows: DataFrame, aliases: DataFrame, header_rows: int = 2) -> tuple[DataFrame, DataFrame]:
    """M6: purchase lots from the 'Purchased Details' sheet, keyed by (supplier, lot, date) (last write wins);
    a lot that does not resolve is null.

    cells: 0 date, 3 supplier, 4 lot, 5 quantity, 6 rate, 7 landed cost, 9 lifted, 10 balance to lift,
    14 payment balance, 15 permit balance, 19 status (F8), 20 payment text (F9)."""
    c = F.col("cells")
    t = rows.where(F.col("row_number") > header_rows).select(
        "source_row_id", clean.date(F.get(c, 0)).alias("purchase_date"), clean.text(F.get(c, 3)).alias("supplier"),
        clean.text(F.get(c, 4)).alias("lot_text"), clean.number(F.get(c, 5)).alias("quantity"),
        clean.number(F.get(c, 6)).alias("rate"), clean.number(F.get(c, 7)).alias("landed"),
        clean.number(F.get(c, 9)).alias("lifted"),
        clean.number(F.get(c, 10)).alias("balance_to_lift"), clean.number(F.get(c, 14)).alias("payment_balance"),
        clean.number(F.get(c, 15)).alias("permit_balance"),
        clean.lifecycle_status(F.get(c, 19)).alias("lifecycle_status"),
        clean.payment_status(F.get(c, 20)).alias("payment_status"))
    t = t.where(F.col("purchase_date").isNotNull() & (F.col("supplier") != "") & (F.col("lot_text") != "")
                & F.col("quantity").isNotNull())
    resolved = resolve_alias(t, "lot_text", aliases)
    issues = checks.unmapped(resolved, "purchase_lot", "lot_text", "Purchase")
    keyed = resolved.withColumn("business_key", clean.business_key(
        F.lit("purchase-lot"), F.col("supplier"), F.col("lot_text"), F.col("purchase_date").cast("string")))
    latest = dedupe_latest(keyed, ["business_key"], ["source_row_id"])
    return latest.select(
        "business_key", "supplier", "lot_id", F.col("lot_text").alias("source_lot_number"), "purchase_date",
        F.col("quantity").cast("decimal(18,3)").alias("purchased_quantity_mt"),
        F.col("rate").cast("decimal(18,4)").alias("purchase_rate_inr_per_mt"),
        F.col("landed").cast("decimal(18,4)").alias("reported_landed_cost_inr_per_mt"),
        F.col("lifted").cast("decimal(18,3)").alias("reported_lifted_quantity_mt"),
        F.col("balance_to_lift").cast("decimal(18,3)").alias("reported_balance_to_lift_mt"),
        F.col("payment_balance").cast("decimal(18,3)").alias("reported_payment_balance_mt"),
        F.col("permit_balance").cast("decimal(18,3)").alias("reported_permit_balance_mt"),
        "lifecycle_status", "payment_status", "source_row_id"), issues


def build_stock_snapshot(rows: DataFrame, aliases: DataFrame, first_row: int = 5
                         ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stock snapshot rows and their REPORTED_LANDED_COST components from the stock sheet.

    The snapshot date is row 1 cell 2 (one value for the sheet, applied as a scalar subquery);
    when it does not parse the sheet yields no rows and a MISSING_REQUIRED_FIELD issue.
    cells: 0 group, 1 lot, 2 quantity, 3 size, 5 Fe, 9 landed cost, 10 status.  One row per (date, lot), the last
    written one; lots that are not known raise an issue and have no snapshot.
    Returns (snapshots, cost components, issues)."""
    c = F.col("cells")
    snap_date = rows.where(F.col("row_number") == 1).agg(F.max(clean.date(F.get(c, 2))).alias("d")).scalar()
    t = rows.where(F.col("row_number") >= first_row).select(
        "source_row_id", clean.text(F.get(c, 1)).alias("lot_text"), clean.number(F.get(c, 2)).alias("quantity"),
        clean.number(F.get(c, 5)).alias("fe"), clean.number(F.get(c, 9)).alias("cost"),
        F.nullif(clean.text(F.get(c, 10)), F.lit("")).alias("reported_status"))
    t = t.where((F.col("lot_text") != "") & F.col("quantity").isNotNull()).withColumn("snapshot_on", snap_date) \
        .where(F.col("snapshot_on").isNotNull())
    resolved = resolve_alias(t, "lot_text", aliases)
    known = dedupe_latest(resolved.where(F.col("lot_id").isNotNull()), ["snapshot_on", "lot_id"], ["source_row_id"])
    snaps = known.select(
        "snapshot_on", "lot_id", F.col("quantity").cast("decimal(18,3)").alias("recorded_quantity_mt"),
        F.col("fe").cast("decimal(8,4)").alias("reported_fe_pct"),
        F.col("cost").cast("decimal(18,4)").alias("reported_landed_cost_inr_per_mt"), "reported_status",
        "source_row_id")
    comps = snaps.where(F.col("reported_landed_cost_inr_per_mt").isNotNull()).select(
        clean.business_key(F.lit("snapshot-cost"), F.col("lot_id").cast("string"),
                           F.col("snapshot_on").cast("string")).alias("business_key"),
        "lot_id", F.lit("REPORTED_LANDED_COST").alias("component_code"),
        F.col("reported_landed_cost_inr_per_mt").alias("rate_inr_per_mt"), F.col("snapshot_on").alias("effective_on"),
        F.lit(False).alias("included_in_landed_cost"), F.lit("reported").alias("approval_status"), "source_row_id")
    missing = rows.where(F.col("row_number") == 1).agg(F.count(F.lit(1)).alias("n")).where(snap_date.isNull())
    issues = checks.issue(missing, "MISSING_REQUIRED_FIELD", "stock_snapshot", F.lit("snapshot-date"), F.lit(None),
                          F.lit("IRON ORE snapshot date is missing."))
    issues = issues.unionByName(checks.unmapped(resolved, "stock_snapshot", "lot_text", "Stock snapshot"))
    return snaps, comps, issues


def build_sales_orders(rows: DataFrame, customers: DataFrame, header_rows: int = 2) -> DataFrame:
    """M9: sales order lines from the 'Outward Details' sheet; one line per (customer, PO, sub type, size),
    the last written row wins.  A customer that is not among `customers` is null.

    cells: 0 customer, 2 sub type, 3 PO, 4 PO date, 5 target Fe, 8 rate, 9 ordered, 10 dispatched, 13 size,
    18 status."""
    c = F.col("cells")
    t = rows.where(F.col("row_number") > header_rows).select(
        "source_row_id", clean.text(F.get(c, 0)).alias("customer"), clean.text(F.get(c, 3)).alias("po_number"),
        clean.text(F.get(c, 2)).alias("sub_type"), clean.text(F.get(c, 13)).alias("size"),
        clean.date(F.get(c, 4)).alias("po_date"), clean.number(F.get(c, 5)).alias("target_fe"),
        clean.number(F.get(c, 8)).alias("rate"), clean.number(F.get(c, 9)).alias("ordered"),
        clean.number(F.get(c, 10)).alias("dispatched"), clean.text(F.get(c, 18)).alias("order_status"))
    t = t.where((F.col("customer") != "") & (F.col("po_number") != "") & F.col("po_date").isNotNull()
                & F.col("ordered").isNotNull())
    t = t.withColumn("business_key", clean.business_key(F.lit("sales-line"), F.col("customer"), F.col("po_number"),
                                                        F.col("sub_type"), F.col("size")))
    cust = (customers.groupBy(clean.normalized_organization("legal_name").alias("_ck"))
            .agg(F.min("customer_id").alias("customer_id")))
    latest = dedupe_latest(t, ["business_key"], ["source_row_id"])
    latest = latest.withColumn("_ck", clean.normalized_organization("customer")).join(cust, "_ck", "left")
    return latest.select(
        "business_key", "customer_id", "po_number", "po_date", F.nullif("size", F.lit("")).alias("size_spec"),
        F.col("ordered").cast("decimal(18,3)").alias("ordered_quantity_mt"),
        F.col("dispatched").cast("decimal(18,3)").alias("reported_dispatched_quantity_mt"),
        F.col("target_fe").cast("decimal(8,4)").alias("target_fe_pct"),
        F.col("rate").cast("decimal(18,4)").alias("selling_rate_inr_per_mt"), "order_status", "source_row_id")


def purchase_cost_components(purchases: DataFrame) -> DataFrame:
    """The reported landed cost of each purchase whose lot resolves, one component per (lot, date), the last
    written purchase wins; reported, so not itself part of the landed cost."""
    priced = purchases.where(F.col("lot_id").isNotNull() & F.col("reported_landed_cost_inr_per_mt").isNotNull()).select(
        clean.business_key(F.lit("purchase-cost"), F.col("lot_id").cast("string"),
                           F.col("purchase_date").cast("string")).alias("business_key"),
        "lot_id", F.lit("REPORTED_LANDED_COST").alias("component_code"),
        F.col("reported_landed_cost_inr_per_mt").alias("rate_inr_per_mt"), F.col("purchase_date").alias("effective_on"),
        F.lit(False).alias("included_in_landed_cost"), F.lit("reported").alias("approval_status"), "source_row_id")
    return dedupe_latest(priced, ["business_key"], ["source_row_id"])


# Cells of the two permit sheets: party, what it is for (purchased lot, or PO), number, date, quantity, status, material.
PERMIT_CELLS = {"inward": (0, 1, 4, 5, 3, 7, 9), "outward": (0, 2, 3, 4, 5, 7, 9)}


def build_permits(rows: DataFrame, direction: str, parties: DataFrame, subjects: DataFrame, header_rows: int = 1) -> DataFrame:
    """M7: permits keyed by (number, direction), last write wins.

    `parties(organization_id, legal_name)`: suppliers of inward, customers of outward permits, met by the normalised
    organisation name (F3).  `subjects(organization_id, subject, subject_id, source_row_id)`: purchases by lot text or
    order lines by PO; the last-written one of the same party and normalised text (J10).  What does not resolve is null;
    a blank status is 'unknown'; the material code is that of the material's text (F11)."""
    party, subject, number, day, quantity, status, material = PERMIT_CELLS[direction]
    c = F.col("cells")
    t = rows.where(F.col("row_number") > header_rows).select(
        "source_row_id", clean.text(F.get(c, number)).alias("permit_number"), clean.text(F.get(c, party)).alias("party"),
        clean.normalized(F.get(c, subject)).alias("_subject"), clean.date(F.get(c, day)).alias("issued_on"),
        clean.number(F.get(c, quantity)).alias("quantity"),
        F.coalesce(F.nullif(clean.text(F.get(c, status)), F.lit("")), F.lit("unknown")).alias("status"),
        clean.material_parts(F.get(c, material), F.get(c, material), F.lit(None))["material_code"].alias("material_code"))
    t = dedupe_latest(t.where(F.col("permit_number") != ""), ["permit_number"], ["source_row_id"])
    named = (parties.groupBy(clean.normalized_organization("legal_name").alias("_ck"))
             .agg(F.min("organization_id").alias("organization_id")))
    t = t.withColumn("_ck", clean.normalized_organization("party")).join(named, "_ck", "left")
    of = subjects.select(F.col("organization_id").alias("s_party"), clean.normalized("subject").alias("s_text"), "subject_id",
                         F.col("source_row_id").alias("s_src"))
    t = last_lookup(t, ["organization_id", "_subject"], of, ["s_party", "s_text"], ["s_src", "subject_id"], "subject_id", "subject_id")
    mine = F.col("subject_id")
    none = F.lit(None).cast(of.schema["subject_id"].dataType)
    return t.select("permit_number", F.lit(direction).alias("direction"), "organization_id",
                    (mine if direction == "inward" else none).alias("purchase_lot_id"),
                    (mine if direction == "outward" else none).alias("sales_order_line_id"), "issued_on",
                    F.col("quantity").cast("decimal(18,3)").alias("permitted_quantity_mt"), "material_code", "status",
                    "source_row_id")


def build_auction_lots(rows: DataFrame, header_rows: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Auction lots keyed by (auction number, lot), last write wins, with the mine owners they name and their sites.

    cells: 0 closing date, 1 auction number, 2 lot, 3 mine, 4 material, 5 Fe, 7 offered, 9 sold quantity, 11 opening,
    12 current, 14 landed price, 16 premium %, 19 seller.  A row needs an auction number and a lot; its date may be
    missing.  Returns (auction lots, mine owners, sites)."""
    sheet = rows.where(F.col("row_number") > header_rows)

    def named(t: DataFrame) -> DataFrame:
        t = t.where((F.col("auction_number") != "") & (F.col("external_lot_number") != ""))
        return t.withColumn("seller_key", F.nullif(clean.normalized_organization("seller_name"), F.lit("")))

    texts = {name: clean.text(f"c{i}") for i, name in ((1, "auction_number"), (2, "external_lot_number"), (3, "site_name"), (19, "seller_name"))}
    numbers = ((7, "decimal(18,3)", "offered_quantity_mt"), (9, "decimal(18,3)", "sold_quantity_mt"), (5, "decimal(8,4)", "indicative_fe_pct"),
               (11, "decimal(18,4)", "opening_price_inr_per_mt"), (12, "decimal(18,4)", "current_price_inr_per_mt"),
               (14, "decimal(18,4)", "reported_landed_price_inr_per_mt"), (16, "decimal(12,5)", "reported_premium_pct"))
    t = named(made_once(cell_columns(sheet, [0, 1, 2, 3, 19, 4, *[i for i, _, _ in numbers]]), ["source_row_id"], {
        "closes_on": clean.date("c0"), **texts, "material_code": clean.material_parts(F.lit("iron ore"), "c4", "c4")["material_code"],
        **{name: clean.number(f"c{i}").cast(kind) for i, kind, name in numbers}}))
    t = t.withColumn("business_key", clean.business_key(F.lit("auction-lot"), F.col("auction_number"), F.col("external_lot_number")))
    who = named(made_once(cell_columns(sheet, [1, 2, 3, 19]), ["source_row_id"], texts))  # owners and sites need no other cell
    owners = build_organizations(who.select(F.col("seller_name").alias("name"), F.lit("mine_owner").alias("role"), "source_row_id"))
    sites = mine_sites(who.select("seller_key", F.col("site_name").alias("name"), "source_row_id"))
    lots = dedupe_latest(t, ["business_key"], ["source_row_id"]).drop("seller_name")
    return lots.select("business_key", "auction_number", "external_lot_number", "closes_on", "seller_key",
                       F.nullif("site_name", F.lit("")).alias("site_name"), "material_code", "offered_quantity_mt",
                       "sold_quantity_mt", "indicative_fe_pct", "opening_price_inr_per_mt", "current_price_inr_per_mt",
                       "reported_landed_price_inr_per_mt", "reported_premium_pct", "source_row_id"), owners, sites


def mine_sites(named: DataFrame) -> DataFrame:
    """Mine sites of `named(seller_key, name, source_row_id)`, one per (owner, normalised name): the first name, the
    last source row."""
    t = named.where(F.col("name") != "").withColumn("site_key", clean.normalized("name"))
    return t.groupBy(F.col("seller_key").alias("organization_key"), "site_key").agg(
        F.min_by("name", "source_row_id").alias("name"), F.max("source_row_id").alias("source_row_id"))


# Cells of the inward quality sheet that hold measures.
INWARD_MEASURES = {"FE": 12, "SIO2": 13, "AL2O3": 14, "LOI": 15, "P": 16, "MOISTURE": 19, "MASS_BALANCE": 30}
MEASURES = ("FE", "SIO2", "AL2O3", "LOI", "P", "MOISTURE", "MN", "MASS_BALANCE")


def _samples(t: DataFrame, stage: str, cells: dict[str, int]) -> DataFrame:
    """Sample rows of one stage with their measures as read."""
    return t.select("business_key", "sample_on", F.lit(stage).alias("sample_stage"), "lot_id", "lot_text", "inward_receipt_id",
                    "dispatch_id", "quantity", "source_row_id",
                    *[(clean.number(F.get("cells", cells[m])) if m in cells else F.lit(None)).cast("decimal(12,4)").alias(m)
                      for m in MEASURES])


def quality_facts(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples with measures outside 0..100 set to null, last write wins by key, and the issues R18 and R19 of each
    measure (one pass over the samples)."""
    measures = F.array(*[F.struct(F.lit(m).alias("code"), F.col(m).alias("value")) for m in MEASURES])
    long = samples.select("source_row_id", F.col("business_key").alias("sample_key"), F.explode(measures).alias("m")).select(
        "source_row_id", "sample_key", "m.code", "m.value").where(F.col("value").isNotNull())
    issues = checks.measure_findings(long)
    facts = dedupe_latest(samples, ["business_key"], ["source_row_id"]).select(
        "business_key", "sample_on", "sample_stage", "lot_id", F.nullif("lot_text", F.lit("")).alias("source_lot_number"),
        "inward_receipt_id", "dispatch_id", F.col("quantity").cast("decimal(18,3)").alias("represented_quantity_mt"),
        *[F.when(F.col(m).between(0, 100), F.col(m)).cast("decimal(8,4)").alias(f"{m.lower()}_pct") for m in MEASURES],
        F.lit(True).alias("approved"), "source_row_id")
    return facts, issues


def build_quality_samples(rows: DataFrame, aliases: DataFrame, receipts: DataFrame, header_rows: int = 1
                          ) -> tuple[DataFrame, DataFrame]:
    """M11 from an 'Inward Quality Report' sheet: an inward sample per row, and an indicative one where cell 10 has a
    value.

    cells: 0 date, 2 lot, 7 quantity, 10 indicative Fe, and INWARD_MEASURES.  A row needs a date and a lot; the lot's
    last-written receipt of that date is linked (J10).  An inward sample is keyed by date, lot, quantity and row number, an indicative
    one by date, lot and row number.  Returns (samples, issues R4 + R18 + R19)."""
    c = F.col("cells")
    t = rows.where(F.col("row_number") > header_rows).select(
        "source_row_id", "row_number", "cells", clean.date(F.get(c, 0)).alias("sample_on"),
        clean.text(F.get(c, 2)).alias("lot_text"), clean.number(F.get(c, 7)).alias("quantity"), clean.text(F.get(c, 7)).alias("_q"))
    t = resolve_alias(t.where(F.col("sample_on").isNotNull() & (F.col("lot_text") != "")), "lot_text", aliases)
    unknown = checks.unmapped(t, "quality_sample", "lot_text", "Quality result")
    linked = receipts.select(F.col("receipt_on").alias("r_on"), clean.normalized("lot_text").alias("r_lot"), "receipt_id",
                             F.col("source_row_id").alias("r_src"))
    t = t.withColumn("_lot", clean.normalized("lot_text"))
    t = last_lookup(t, ["sample_on", "_lot"], linked, ["r_on", "r_lot"], ["r_src", "receipt_id"], "receipt_id", "inward_receipt_id")
    t = t.withColumn("dispatch_id", F.lit(None).cast("bigint"))
    day, row = F.col("sample_on").cast("string"), F.col("row_number").cast("string")
    inward = t.withColumn("business_key", clean.business_key(F.lit("inward-quality"), day, F.col("lot_text"), F.col("_q"), row))
    early = t.where(clean.number(F.get(c, 10)).isNotNull()).withColumn("inward_receipt_id", F.lit(None).cast("bigint")).withColumn(
        "business_key", clean.business_key(F.lit("inward-quality-indicative"), day, F.col("lot_text"), row))
    facts, issues = quality_facts(_samples(inward, "inward", INWARD_MEASURES).unionByName(_samples(early, "indicative", {"FE": 10})))
    return facts, unknown.unionByName(issues)


def build_transport(rows: DataFrame, aliases: DataFrame, header_rows: int = 2
                    ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Transport work orders -> transporter organisations, mine sites (of the mine's owner) and
    INWARD_TRANSPORT cost components (orders whose lot text resolves, with a rate and a date), keyed by
    financial year, work order and lot text.

    cells: 0 work order, 1 financial year, 2 date, 5 transporter, 7 mine, 8 quantity text, 9 lot text, 11 rate."""
    c = F.col("cells")
    t = rows.where((F.col("row_number") > header_rows) & (clean.text(F.get(c, 0)) != "")
                   & (clean.text(F.get(c, 5)) != "")).select(
        "source_row_id", clean.text(F.get(c, 0)).alias("work_order"), clean.text(F.get(c, 1)).alias("year"), clean.date(F.get(c, 2)).alias("order_on"),
        clean.text(F.get(c, 5)).alias("transporter"), clean.text(F.get(c, 7)).alias("mine"),
        clean.text(F.get(c, 9)).alias("lot_text"), clean.number(F.get(c, 11)).alias("rate"))
    orgs = build_organizations(t.select(F.col("transporter").alias("name"), F.lit("transporter").alias("role"), "source_row_id"))
    sites = mine_sites(t.select(clean.normalized_organization("mine").alias("seller_key"), F.col("mine").alias("name"), "source_row_id"))
    order_key = clean.business_key(F.lit("transport-work-order"), F.coalesce(F.nullif("year", F.lit("")), F.lit("unknown")),
                                   F.col("work_order"))
    dated = t.where(F.col("rate").isNotNull() & F.col("order_on").isNotNull())
    comps = resolve_alias(dated, "lot_text", aliases).where(F.col("lot_id").isNotNull()).select(
        clean.business_key(order_key, F.col("lot_text")).alias("business_key"),
        "lot_id", F.lit("INWARD_TRANSPORT").alias("component_code"),
        F.col("rate").cast("decimal(18,4)").alias("rate_inr_per_mt"), F.col("order_on").alias("effective_on"),
        F.lit(False).alias("included_in_landed_cost"), F.lit("reported").alias("approval_status"), "source_row_id")
    return orgs, sites, dedupe_latest(comps, ["business_key"], ["source_row_id"])


def transport_mine_owners(rows: DataFrame, header_rows: int = 2) -> DataFrame:
    """The mines that complete work orders name, as mine-owner organisations."""
    c = F.col("cells")
    named = rows.where((F.col("row_number") > header_rows) & (clean.text(F.get(c, 0)) != "") & (clean.text(F.get(c, 5)) != ""))
    return build_organizations(named.select(F.get(c, 7).alias("name"), F.lit("mine_owner").alias("role"), "source_row_id"))


def build_sites(rows: DataFrame, header_rows: int = 1) -> DataFrame:
    """M4: customer destination sites keyed by (organisation, normalised site name), last write wins.

    cells: 0 buyer, 1 type, 7 destination."""
    c = F.col("cells")
    t = rows.where(F.col("row_number") > header_rows).select(
        "source_row_id", clean.normalized_organization(F.get(c, 0)).alias("organization_key"),
        clean.text(F.get(c, 7)).alias("name")).where(F.col("name") != "")
    t = t.withColumn("site_key", clean.normalized("name")).withColumn("site_type", F.lit("customer"))
    latest = dedupe_latest(t, ["organization_key", "site_key"], ["source_row_id"])
    return latest.select("organization_key", "site_key", "name", "site_type", "source_row_id")
