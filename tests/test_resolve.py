"""W1/W2 upserts, J9/J10 lookups, S9/S10 rule versions on hand-made rows."""

import datetime as dt

from opsledger.operators import governance, resolve


def test_dedupe_latest_breaks_ties_on_all_columns(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (2, 1, "x")], "k int, o int, v string")
    got = sorted(tuple(r) for r in resolve.dedupe_latest(df, ["k"], ["o"]).collect())
    assert got == [(1, 5, "b"), (2, 1, "x")]


def test_upsert_updates_listed_columns_only(spark):
    old = spark.createDataFrame([(1, 10.0, "keep", 1), (2, 20.0, "old", 2)], "k int, q double, note string, src int")
    new = spark.createDataFrame([(1, 11.0, "new", 3), (1, 12.0, "newer", 4), (3, 30.0, "n3", 5)],
                                "k int, q double, note string, src int")
    got = {r["k"]: r for r in resolve.upsert(old, new, ["k"], ["q", "src"], ["src"]).collect()}
    assert got[1]["q"] == 12.0 and got[1]["note"] == "keep" and got[1]["src"] == 4
    assert got[2]["q"] == 20.0 and got[3]["note"] == "n3"


def test_resolve_alias_only_unique(spark):
    aliases = spark.createDataFrame([(1, "LOT-1"), (1, "Red ore"), (2, "LOT-2"), (2, "red ore"), (3, "Blue")],
                                    "lot_id long, alias string")
    rows = spark.createDataFrame([("lot 1",), ("RED ORE",), ("blue",), ("none",)], "t string")
    got = {r["t"]: r["lot_id"] for r in resolve.resolve_alias(rows, "t", aliases).collect()}
    assert got == {"lot 1": 1, "RED ORE": None, "blue": 3, "none": None}


def test_last_lookup(spark):
    facts = spark.createDataFrame([("c1", "po1")], "cust string, po string")
    dim = spark.createDataFrame([("c1", "po1", 7, 1), ("c1", "po1", 8, 2)], "c string, p string, id int, src int")
    r = resolve.last_lookup(facts, ["cust", "po"], dim, ["c", "p"], ["src"], "id", "order_id").collect()[0]
    assert r["order_id"] == 8


def test_rule_versions(spark):
    schema = "code string, version int, definition string, status string, approved_by string, approved_at timestamp"
    t0 = dt.datetime(2026, 1, 1)
    old = spark.createDataFrame([("A", 1, "a1", "approved", "x", t0), ("B", 1, "b1", "approved", "x", t0)], schema)
    new = spark.createDataFrame([("A", 1, "a1 edit", "approved", "x", None), ("A", 2, "a2", "approved", "y", None),
                                 ("B", 1, "b1", "draft", "x", None), ("GAP_PAY", 1, "no ledger", "approved", "z", None)],
                                schema)
    rules = governance.load_rules(old, new, "2026-02-01 00:00:00")
    by = {(r["code"], r["version"]): r for r in rules.collect()}
    assert by[("A", 1)]["approved_at"] == t0 and by[("A", 1)]["definition"] == "a1 edit"
    assert by[("A", 2)]["approved_at"] == dt.datetime(2026, 2, 1)
    assert by[("B", 1)]["approved_at"] is None
    active = {r["code"]: r for r in governance.active_rules(rules).collect()}
    assert active["A"]["version"] == 2 and "B" not in active and active["GAP_PAY"]["kind"] == "gap"
    blocks = {r["kind"]: r["block"] for r in governance.rules_block(governance.active_rules(rules)).collect()}
    assert blocks["rule"] == "A: a2" and blocks["gap"] == "GAP_PAY: no ledger"


def test_prefix_sum_splits_hot_group(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from opsledger.operators.common import prefix_sum_before
    rows = [("hot", i, float(i % 7)) for i in range(3000)] + [(f"g{i % 5}", i, 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, o int, v double")
    got = {(r["g"], r["o"]): r["before"]
           for r in prefix_sum_before(df, ["g"], ["o"], "v", "before", 16).collect()}
    one = {(r["g"], r["o"]): r["before"] for r in prefix_sum_before(df, ["g"], ["o"], "v", "before", 1).collect()}
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    want = {(r["g"], r["o"]): r["b"] for r in df.withColumn("b", F.coalesce(F.sum("v").over(w), F.lit(0.0))).collect()}
    assert got == want      # the hot group lies in several slices
    assert one == want      # a single slice


def test_carried_forward_crosses_slices(spark):
    import random
    from opsledger.operators.common import carried_forward
    rng = random.Random(5)
    rows = [("hot", i, i if rng.random() < 0.01 else None) for i in range(2000)] + [(g, i, None if i else 7) for g in ("a", None) for i in range(3)]
    rows += [("none", i, None) for i in range(5)]
    got = {(r.g, r.o): r.v for r in carried_forward(spark.createDataFrame(rows, "g string, o int, v int"), ["g"], ["o"], "v", 16).collect()}
    want, last = {}, {}
    for g, o, v in rows:
        last[g] = v if v is not None else last.get(g)
        want[g, o] = last[g]
    assert got == want


def test_exact_median_of_any_decimals(spark):
    import random
    from decimal import Decimal
    from pyspark.sql import functions as F
    from opsledger.operators.common import exact_median
    rng = random.Random(9)
    wide = [Decimal(rng.randint(-10 ** 18 + 1, 10 ** 18 - 1)).scaleb(-4) for _ in range(301)]  # digits of every round differ
    near = [Decimal(10 ** 13 + rng.randint(0, 9)).scaleb(-4) for _ in range(100)]
    ends = [Decimal(-10 ** 18 + 1).scaleb(-4), Decimal(10 ** 18 - 1).scaleb(-4)]
    rows = [(g, v) for g, vs in (("wide", wide), ("near", near), ("ends", ends), (None, near[:2]), ("one", near[:1]), ("none", [None])) for v in vs]
    df = spark.createDataFrame(rows, "g string, v decimal(18,4)")
    got = {r.g: (r.records, r.median) for r in exact_median(df, ["g"], "v").collect()}
    for g in ("wide", "near", "ends", None, "one"):
        vs = sorted(v for k, v in rows if k == g)
        assert got.pop(g) == (len(vs), float((vs[(len(vs) - 1) // 2] + vs[len(vs) // 2]) / 2))
    assert not got


def test_exact_median_matches_percentile(spark):
    import random
    from pyspark.sql import functions as F
    from opsledger.operators.common import exact_median
    rnd = random.Random(3)
    rows = [("hot", float(rnd.randint(1, 40))) for _ in range(2001)] + \
           [(f"g{i}", float(rnd.randint(1, 9))) for i in range(30) for _ in range(rnd.randint(1, 6))] + [("nulls", None)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("v", F.col("v").cast("decimal(18,3)"))
    got = {r["g"]: (r["records"], r["median"]) for r in exact_median(df, ["g"], "v").collect()}
    want = {r["g"]: (r["n"], r["m"]) for r in df.where("v is not null").groupBy("g").agg(
        F.count("v").alias("n"), F.percentile("v", 0.5).alias("m")).collect()}
    assert got == want
