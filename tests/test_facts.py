"""Fact builders on hand-made staged sheets (fire each rule once and miss it once)."""

from pyspark.sql import functions as F

from opsledger.operators import facts

SCHEMA = "file_name string, sheet_name string, row_number bigint, cells array<string>, source_row_id bigint"


def aliases(spark):
    return spark.createDataFrame([(1, "LOT-1"), (2, "LOT-2"), (2, "Red fines"), (3, "red fines")],
                                 "lot_id long, alias string")


def test_stock_snapshot_with_and_without_date(spark):
    data = [("s", "IRON ORE", 5, ["Fines", "LOT-1", "1,000.5", "", "", "61.2", "", "", "", "₹2,500", "OK"], 10),
            ("s", "IRON ORE", 6, ["Fines", "red fines", "10", "", "", "-", "", "", "", "", ""], 11)]
    ok = spark.createDataFrame([("s", "IRON ORE", 1, ["HO", "as on", "23-Jul-2026"], None)] + data, SCHEMA)
    snaps, comps, issues = facts.build_stock_snapshot(ok, aliases(spark))
    rows = snaps.collect()
    assert len(rows) == 1 and str(rows[0]["snapshot_on"]) == "2026-07-23" and float(rows[0]["recorded_quantity_mt"]) == 1000.5
    assert comps.count() == 1
    assert [r["rule_code"] for r in issues.collect()] == ["UNMAPPED_LOT"]   # 'red fines' is ambiguous
    bad = spark.createDataFrame([("s", "IRON ORE", 1, ["HO", "as on", "soon"], None)] + data, SCHEMA)
    snaps, comps, issues = facts.build_stock_snapshot(bad, aliases(spark))
    assert snaps.count() == 0
    assert sorted(r["rule_code"] for r in issues.collect()) == ["MISSING_REQUIRED_FIELD"]


def test_movements_unpivot_drops_zero_and_blank(spark):
    cells = lambda d, lot, ev, i, o: [d, lot, "", "", ev, i, o] + [""] * 18 + ["R1"]
    rows = spark.createDataFrame([
        ("s", "DAILY BOOKS", 2, cells("4/15/26", "LOT-1", "Inward", "10", "0"), 1),
        ("s", "DAILY BOOKS", 3, cells("4/16/26", "LOT-2", "Dispatch to customer", "-", "-5.5"), 2),
        ("s", "DAILY BOOKS", 4, cells("4/17/26", "LOT-9", "Inward", "3", ""), 3)], SCHEMA)
    mv, issues = facts.build_movements(rows, aliases(spark))
    got = sorted((r["lot_id"], r["direction"], r["event_type"], float(r["quantity_mt"])) for r in mv.collect())
    assert got == [(1, "in", "inward_receipt", 10.0), (2, "out", "customer_dispatch", 5.5)]
    assert [r["entity_key"] for r in issues.collect()] == ["LOT-9"]


def sheet(spark, name, first, cells, source=None):
    """Staged rows of one sheet from row number `first`; every row is 21 cells wide."""
    data = [("f", name, first + i, c + [""] * (21 - len(c)), (source or 100) + i) for i, c in enumerate(cells)]
    return spark.createDataFrame(data, SCHEMA)


def test_receipts_keep_unmapped_lots_and_repeat_nothing(spark):
    row = ["1-Apr-2026", "", "Acme", "LOT-1", "1,000.5", "3", "P-1"]
    cells = [row, row[:3] + ["LOT-9"] + row[4:], row[:2] + ["", "LOT-1"] + row[4:], row[:4] + ["-"] + row[5:], row, row[:6] + ["P-2"]]
    facts_, issues = facts.build_receipts(sheet(spark, "Daily Inward Details", 2, cells), aliases(spark))
    got = sorted((r.lot_text, r.lot_id or 0, r.permit_number, r.source_row_id) for r in facts_.collect())
    # a row written again replaces the first; no supplier or no quantity: no receipt; an unknown lot is null
    assert got == [("LOT-1", 1, "P-1", 104), ("LOT-1", 1, "P-2", 105), ("LOT-9", 0, "P-1", 101)]
    assert [r.entity_key for r in issues.collect()] == ["LOT-9"]


def test_purchases_are_keyed_by_date_and_price_their_lots(spark):
    def row(day, lot, landed, supplier="Acme"):
        return [day, "Fines", "", supplier, lot, "100", "2,000", landed, "", "40", "60"]

    cells = [row("1-Apr-2026", "LOT-1", "2,500"), row("2-Apr-2026", "LOT-1", "2,600"), row("1-Apr-2026", "LOT-1", "2,550"),
             row("1-Apr-2026", "LOT-9", "9"), row("soon", "LOT-2", "1"), row("1-Apr-2026", "LOT-2", "")]
    purchases, issues = facts.build_purchases(sheet(spark, "Purchased Details", 3, cells), aliases(spark))
    got = sorted((r.source_lot_number, str(r.purchase_date), r.lot_id or 0, r.source_row_id) for r in purchases.collect())
    assert got == [("LOT-1", "2026-04-01", 1, 102), ("LOT-1", "2026-04-02", 1, 101), ("LOT-2", "2026-04-01", 2, 105),
                   ("LOT-9", "2026-04-01", 0, 103)]
    assert [r.entity_key for r in issues.collect()] == ["LOT-9"]
    costs = sorted((r.lot_id, str(r.effective_on), float(r.rate_inr_per_mt), r.component_code, r.included_in_landed_cost)
                   for r in facts.purchase_cost_components(purchases).collect())
    assert costs == [(1, "2026-04-01", 2550.0, "REPORTED_LANDED_COST", False), (1, "2026-04-02", 2600.0, "REPORTED_LANDED_COST", False)]


def test_order_lines_keep_sub_type_size_and_unknown_customers(spark):
    def row(customer, po, sub, size, ordered, day="1-Apr-2026"):
        return [customer, "Iron", sub, po, day, "61", "", "", "5,000", ordered, "", "", "", size]

    cells = [row("Acme Ltd", "PO 1", "Fines", "0-10", "100"), row("Acme Ltd", "PO 1", "Lumps", "0-10", "200"),
             row("Acme Ltd", "PO 1", "Fines", "10-20", "300"), row("ACME LTD", "po-1", "fines", "0-10", "150"),
             row("Nobody", "PO 2", "", "", "5"), row("Acme Ltd", "PO 3", "", "", "5", "soon")]
    customers = spark.createDataFrame([(7, "Acme Limited"), (8, "ACME LTD.")], "customer_id long, legal_name string")
    got = sorted((r.po_number, r.size_spec or "", float(r.ordered_quantity_mt), r.customer_id or 0)
                 for r in facts.build_sales_orders(sheet(spark, "Outward Details", 3, cells), customers).collect())
    assert got == [("PO 1", "0-10", 200.0, 7), ("PO 1", "10-20", 300.0, 7), ("PO 2", "", 5.0, 0), ("po-1", "0-10", 150.0, 7)]


def test_transport_costs_and_mine_sites(spark):
    def row(order, year, day, lots, rate, mine="North Mine", transporter="Fast Ltd"):
        return [order, year, day, "", "", transporter, "", mine, "10", lots, "", rate]

    cells = [row("1", "26-27", "1-Apr-2026", "LOT-1", "100"), row("1", "25-26", "1-Apr-2026", "LOT-1", "90"),
             row("2", "", "soon", "LOT-1", "80"), row("3", "", "1-Apr-2026", "LOT-1 + LOT-2", "70"),
             row("4", "", "1-Apr-2026", "LOT-2", "TBD"), row("", "", "1-Apr-2026", "LOT-2", "60"), row("1", "26-27", "1-Apr-2026", "LOT-1", "110")]
    orgs, sites, costs = facts.build_transport(sheet(spark, "INWARD FINAL", 3, cells), aliases(spark))
    assert orgs.count() == 1
    assert [(r.organization_key, r.site_key) for r in sites.collect()] == [("northmine", "northmine")]
    got = sorted((float(r.rate_inr_per_mt), r.lot_id, r.included_in_landed_cost) for r in costs.collect())
    assert got == [(90.0, 1, False), (110.0, 1, False)]


def test_envelope_counts_all_ids_and_needs_provenance(spark):
    from opsledger.operators import evidence
    result = spark.range(60).selectExpr("id AS sid")
    prov = spark.range(60).selectExpr("id AS source_row_id", "'f' AS file_name", "'s' AS sheet_name")
    issues = spark.createDataFrame([(59, "R")], "source_row_id long, rule_code string")
    got = evidence.provenance_envelope(result, "sid", prov, issues).first()
    assert (got.status, got.source_count, got.warning_issues) == ("flagged", 60, 1)
    assert evidence.provenance_envelope(result, "sid", prov, issues.where("false")).first().status == "verified"
    assert evidence.provenance_envelope(result, "sid", prov.where("false"), issues).first().status == "incomplete"


def test_transport_mines_are_owners(spark):
    cells = [["1", "", "", "", "", "Fast", "", "North Mine"], ["2", "", "", "", "", "Fast", "", ""], ["3", "", "", "", "", "", "", "South Mine"],
             ["4", "", "", "", "", "Slow", "", "north mine"]]
    got = facts.transport_mine_owners(sheet(spark, "INWARD FINAL", 3, cells)).collect()
    assert [(r.legal_name, r.roles, r.source_row_id) for r in got] == [("North Mine", ["mine_owner"], 100)]


def test_dispatches_keep_one_row_per_key_and_look_up_the_last_write(spark):
    row = ["1-Apr-2026", "Acme Ltd", "PO-1", "10", "2", "P1"] + [""] * 4 + ["61"]
    cells = [row, row, row[:2] + ["po 1"] + row[3:], row[:2] + [""] + row[3:], row[:5] + [""], row[:1] + ["Nobody"] + row[2:5] + ["P9"]]
    customers = spark.createDataFrame([(7, "ACME"), (9, "Acme Ltd")], "customer_id long, legal_name string")
    orders = spark.createDataFrame([(1, 7, "PO-1", 10), (2, 7, "PO 1", 11)], "sales_order_line_id long, customer_id long, po_number string, source_row_id long")
    permits = spark.createDataFrame([(1, "P1", "outward", 1), (2, "P1", "outward", 2), (3, "P9", "inward", 3)],
                                    "permit_id long, permit_number string, direction string, source_row_id long")
    got, issues = facts.build_dispatches(sheet(spark, "Daily Outward Detail", 2, cells), customers, orders, permits)
    rows = {r.source_row_id: r for r in got.collect()}
    # two writes of one row, one of them spelled otherwise, are the same dispatch; a row without a PO is none
    assert sorted(rows) == [102, 104, 105]
    assert (rows[102].customer_id, rows[102].sales_order_line_id, rows[102].permit_id) == (7, 2, 2)
    assert (rows[105].customer_id, rows[105].sales_order_line_id, rows[105].permit_id) == (None, None, None)
    assert rows[102].business_key == "dispatch|20260401|acmeltd|po1|p1|10000|2"
    codes = sorted((r.rule_code, r.source_row_id) for r in issues.collect())
    assert codes == sorted([("MISSING_SALES_ORDER", 105), ("MISSING_DISPATCH_PERMIT", 104), ("MISSING_DISPATCH_PERMIT", 105)]
                           + [("MISSING_DISPATCH_LOT", i) for i in (100, 101, 102, 104, 105)])


def test_permits_of_both_registers(spark):
    parties = spark.createDataFrame([(1, "Acme Pvt Ltd"), (1, "Acme"), (2, "Other")], "organization_id long, legal_name string")
    subjects = spark.createDataFrame([(1, "LOT-1", 11, 1), (1, "lot 1", 12, 2), (2, "LOT-1", 13, 3)],
                                     "organization_id long, subject string, subject_id long, source_row_id long")
    inward = [["Acme", "Lot-1", "", "1,000", "N1", "1-Apr-2026", "", "", "", "lump ore"], ["Other", "LOT-1", "", "5", "N1", "", "", "Open", "", ""],
              ["Acme", "", "", "5", "", "", "", "Open"], ["Who", "LOT-1", "", "-", "N2"]]
    got = {r.permit_number: r for r in facts.build_permits(sheet(spark, "Permit Details", 2, inward), "inward", parties, subjects).collect()}
    assert set(got) == {"N1", "N2"}
    assert (got["N1"].organization_id, got["N1"].purchase_lot_id, got["N1"].status, got["N1"].material_code) == (2, 13, "Open", "iron_ore:other:unspecified")
    assert (got["N2"].organization_id, got["N2"].purchase_lot_id, got["N2"].permitted_quantity_mt, got["N2"].status) == (None, None, None, "unknown")
    outward = [["Acme", "", "LOT 1", "N1", "4/2/26", "7", "", "Done", "", "Fines"]]
    one = facts.build_permits(sheet(spark, "Permit Details", 2, outward), "outward", parties, subjects).first()
    assert (one.sales_order_line_id, one.purchase_lot_id, str(one.issued_on), float(one.permitted_quantity_mt)) == (12, None, "2026-04-02", 7.0)


def test_quality_samples_null_what_is_out_of_range(spark):
    def row(lot, day="1-Apr-2026", early="", **measures):
        cells = [day, "", lot] + [""] * 4 + ["100", "", "", early] + [""] * 20
        for m, v in measures.items():
            cells[facts.INWARD_MEASURES[m]] = v
        return cells

    cells = [row("LOT-1", FE="62", LOI="-1", MASS_BALANCE="79"), row("LOT-9", early="101", FE="20"), row("LOT-1", day="?"), row("LOT-1", P="5.5")]
    data = [("q", "s", 2 + i, c, 100 + i) for i, c in enumerate(cells)]
    receipts = spark.createDataFrame([("2026-04-01", "lot 1", 5, 1), ("2026-04-01", "LOT-1", 6, 2)], "d string, lot_text string, receipt_id long, source_row_id long")
    receipts = receipts.selectExpr("CAST(d AS DATE) AS receipt_on", "lot_text", "receipt_id", "source_row_id")
    got, issues = facts.build_quality_samples(spark.createDataFrame(data, SCHEMA), aliases(spark), receipts)
    rows = {(r.source_row_id, r.sample_stage): r for r in got.collect()}
    assert sorted(rows) == [(100, "inward"), (101, "indicative"), (101, "inward"), (103, "inward")]
    one = rows[100, "inward"]
    assert (one.lot_id, one.inward_receipt_id, float(one.fe_pct), one.loi_pct, float(one.mass_balance_pct), one.sio2_pct) == (1, 6, 62.0, None, 79.0, None)
    assert rows[101, "indicative"].fe_pct is None and rows[101, "inward"].lot_id is None and float(rows[103, "inward"].p_pct) == 5.5
    assert sorted((r.rule_code, r.source_row_id) for r in issues.collect()) == [
        ("INVALID_QUALITY_RANGE", 100), ("INVALID_QUALITY_RANGE", 101), ("QUALITY_PLAUSIBILITY", 100), ("QUALITY_PLAUSIBILITY", 101),
        ("QUALITY_PLAUSIBILITY", 103), ("UNMAPPED_LOT", 101)]


def test_auction_lots_name_owners_and_sites(spark):
    row = ["", "A1", "L1", "North pit", "Lumps", "61", "", "100", "", "-", "", "5", "6", "", "7", "", "8%", "", "", "Mines Ltd"]
    cells = [row, row[:9] + ["40"] + row[10:], row[:1] + [""] + row[2:], row[:2] + ["L2", "north PIT"] + row[4:19] + [""]]
    lots, owners, sites = facts.build_auction_lots(sheet(spark, "Consolidated Data", 2, cells))
    got = {r.external_lot_number: r for r in lots.collect()}
    assert set(got) == {"L1", "L2"} and got["L1"].source_row_id == 101 and float(got["L1"].sold_quantity_mt) == 40.0
    assert got["L1"].closes_on is None and got["L1"].seller_key == "mines" and got["L2"].seller_key is None
    assert [(r.legal_name, r.roles) for r in owners.collect()] == [("Mines Ltd", ["mine_owner"])]
    assert sorted(((r.organization_key, r.site_key, r.name) for r in sites.collect()), key=repr) == [("mines", "northpit", "North pit"), (None, "northpit", "north PIT")]


def test_production_resolves_its_input_lot(spark):
    def row(material, feed="100", rec="", prod="", tail="", pct="55"):
        return ["1-Apr-2026", "A", "Wet", "Fines", material, feed] + [""] * 23 + [tail, "", "", prod] + [""] * 7 + [rec, pct]

    cells = [row("LOT-1", rec="60", tail="0"), row("Red fines", prod="50", tail="9", pct="101"), row(""), row("LOT-2", feed="-")]
    data = [("p", "s", 5 + i, c, 100 + i) for i, c in enumerate(cells)]
    runs, inputs, outputs, issues = facts.build_production(spark.createDataFrame(data, SCHEMA), aliases(spark))
    assert sorted((r.source_row_id, r.process) for r in runs.collect()) == [(100, "Wet Fines"), (101, "Wet Fines")]
    assert sorted((r.source_row_id, r.lot_id) for r in inputs.collect()) == [(100, 1), (101, None)]  # two lots are called 'red fines'
    assert sorted((r.source_row_id, r.output_type, float(r.quantity_mt), r.material_code) for r in outputs.collect()) == [
        (100, "recovered_total", 60.0, "iron_ore:fine:unspecified"), (101, "recovered_total", 50.0, "iron_ore:fine:unspecified"),
        (101, "tailings", 9.0, "iron_ore:tailings:unspecified")]
    assert sorted((r.rule_code, r.source_row_id) for r in issues.collect()) == [("INVALID_RECOVERY_RANGE", 101), ("MISSING_PRODUCTION_LOT", 101)]


def test_production_issues_take_the_sheet_once(spark):
    row = spark.range(1).select(F.array([F.col("id").cast("string")] * 42).alias("cells"), F.lit(9).cast("bigint").alias("row_number"), F.col("id").alias("source_row_id"))
    issues = facts.build_production(row, aliases(spark))[3]
    assert "Union" not in issues._jdf.queryExecution().optimizedPlan().toString()


def test_second_import_of_every_sheet_changes_nothing(spark, tmp_path):
    from opsledger.operators.books import TABLES, Books

    books = Books(spark, str(tmp_path / "books"), buckets=4)
    row = ["1-Apr-2026", "A", "Wet", "Fines", "LOT-1", "10"] + [""] * 23 + ["1", "", "", "5"] + [""] * 7 + ["", "50"]
    rows = spark.createDataFrame([("p", "s", 5 + i, row, 100 + i) for i in range(3)], SCHEMA)
    runs, inputs, outputs, _ = facts.build_production(rows, aliases(spark))
    lots = facts.build_auction_lots(sheet(spark, "a", 2, [["", "A1", "L1"], ["", "A1", "L2"], ["", "A1", "L1"]]))[0]
    loads = [("production_run", runs), ("production_input", inputs), ("production_output", outputs), ("auction_lot", lots)]
    first = {name: books.upsert(name, df) for name, df in loads}
    assert {n: d["inserted"] for n, d in first.items()} == {"production_run": 3, "production_input": 3, "production_output": 6, "auction_lot": 2}
    assert all(books.upsert(name, df) == first[name] | {"inserted": 0, "updated": 0} for name, df in loads)
    assert all(set(kept) <= set(spark.createDataFrame([], schema).columns) and set(keys) <= set(spark.createDataFrame([], schema).columns)
               for schema, keys, kept in TABLES.values())


def test_lots_keep_their_first_id_and_last_row(spark):
    row = lambda lot, status, desc, size, source: [lot, status, "Lump ore", "Iron", desc, size, source]
    cells = [row("L-1", "Un-lifted", "Red Hill", "5-18", "S 1"), row("", "", "nobody", "", ""), row("L-2", "", "", "", "S1"),
             row("L-1", "Closed", "RED hill", "10-40", "")]
    lots, aliases = facts.build_lots(sheet(spark, "LOT MASTER", 2, cells))
    got = {r.house_lot_number: r for r in lots.collect()}
    assert set(got) == {"L-1", "L-2"}
    one = got["L-1"]
    assert (one.lot_id, one.source_row_id, one.lifecycle_status, one.source_lot_number, one.material_code) == (100, 103, "closed", None, "iron_ore:lump:1040")
    assert got["L-2"].description is None and got["L-2"].lifecycle_status == "unknown"
    assert sorted((r.lot_id, r.alias, r.normalized_alias, r.source_row_id) for r in aliases.collect()) == [
        (100, "L-1", "l1", 103), (100, "Red Hill", "redhill", 103), (100, "S 1", "s1", 100), (102, "L-2", "l2", 102), (102, "S1", "s1", 102)]


def test_organization_aliases_belong_to_their_first_mention(spark):
    from opsledger.operators.resolve import organization_aliases

    mentions = spark.createDataFrame([("ACME Ltd", 2), ("Acme", 1), ("acme ltd.", 3), ("", 4), (None, 5)], "name string, source_row_id long")
    got = sorted((r.normalized_alias, r.alias, r.normalized_name, r.source_row_id) for r in organization_aliases(mentions).collect())
    assert got == [("acme", "Acme", "acme", 1), ("acmeltd", "ACME Ltd", "acme", 2)]
