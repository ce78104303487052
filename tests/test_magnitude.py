"""Jumps against the median: one shuffle of the rows, and the same findings where groups are too large for one task."""

from __future__ import annotations

import statistics
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from opsledger.catalog import rules_q
from opsledger.operators import checks, marts

SCHEMA = "lot long, code string, rate decimal(18,4), id long, source_row_id long"
VALUES = {(1, "A"): ["1", "1", "1", "10", "9.9999", "0.1"], (1, None): ["1", "1", "100"], (None, "A"): ["1", "1", "100"], (2, "A"): ["1", "100"],
          (2, "B"): ["2", "4", "30", "0.3"], (3, "A"): ["-1", "-1", "-50"], (4, "A"): ["5", None, None, "50"], (5, "C"): ["0.0001"] * 7 + ["99.5"]}


def jumps(spark):
    rows = [(*key, v and Decimal(v)) for key, vs in VALUES.items() for v in vs]
    df = spark.createDataFrame([(*r, i, i) for i, r in enumerate(rows)], SCHEMA)
    return rows, checks.magnitude_jumps(df, ["lot", "code"], "rate", "RATE_MAGNITUDE_JUMP", "lot_cost_component", "id", "Rate")


@pytest.mark.parametrize("crowd", [checks.CROWD, 4, 0])
def test_jumps_against_plain_medians(spark, monkeypatch, crowd):
    monkeypatch.setattr(checks, "CROWD", crowd)
    rows, found = jumps(spark)
    want = []
    for i, (lot, code, v) in enumerate(rows):
        group = [x for a, b, x in rows if (a, b) == (lot, code) and x is not None]
        if None not in (lot, code, v) and len(group) >= 3 and (m := float(statistics.median(group))) > 0 and (v >= 10 * m or float(v) <= m / 10):
            want.append(i)
    assert want and sorted(r.source_row_id for r in found.collect()) == want


def test_jumps_move_the_rows_once(spark):
    plan = jumps(spark)[1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_multi_lot_is_a_rule_of_the_staged_row(spark):
    cell = lambda n, who, q, lots: ["W%d" % n, "", "", "", "", who, "", "", q, lots, "", "1"]
    rows = spark.createDataFrame([(n, c, n) for n, c in enumerate([
        cell(0, "t", "1 + 2", "a"), cell(1, "t", "1", "a, b"), cell(2, "t", "1 + 2", "a"), cell(3, "t", "1 + 2", "a"), cell(4, " ", "1 + 2", "a"),
        cell(5, "t", "1", "a & b"), cell(6, "t", None, None), cell(7, "t", "1", "a"), [None] * 9, ["W9"]], 1)],
        "row_number long, cells array<string>, source_row_id long")
    old = checks.transport_multi_lot(marts.transporter_work_orders(rows)).collect()
    assert len(old) == 3 and sorted(checks.findings(rows, checks.multi_lot_rule()).collect()) == sorted(old)


def test_work_order_sheet_is_read_by_one_pass(spark, sf_small):
    frames = rules_q.rule_frames(spark, sf_small).in_passes()
    assert sum("collect_list" in f._jdf.queryExecution().optimizedPlan().toString() for f in frames) == 1
