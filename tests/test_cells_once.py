"""What a builder parses from a cell is made once for a row, and the findings of dispatches come from one reading of the sheet."""

import pytest
from pyspark.sql import functions as F

from opsledger.operators import facts
from opsledger.sources.keyed import KeyedTable


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def rows(spark):
    """A sheet whose cells are expressions over a row, a different one for each cell."""
    cells = F.array(*[F.when(F.col("id") % 7 != i, F.format_string(f"cell{i:02}-%s", F.col("id"))) for i in range(20)])
    return spark.range(50).select(F.col("id").alias("source_row_id"), (F.col("id") + 2).alias("row_number"), cells.alias("cells"))


def test_cells_of_auctions_and_dispatches_are_made_once(spark, rows):
    none = lambda schema: spark.createDataFrame([], schema)
    lots = plan(facts.build_auction_lots(rows)[0])
    assert all(lots.count(f"cell{i:02}-") == 1 for i in (0, 1, 2, 3, 4, 5, 7, 9, 11, 12, 14, 16, 19))
    dispatches, issues = facts.build_dispatches(
        rows, none("customer_id long, legal_name string"), none("customer_id long, po_number string, sales_order_line_id long, source_row_id long"),
        none("permit_number string, direction string, permit_id long, source_row_id long"))
    for df in (dispatches, issues):
        assert all(plan(df).count(f"cell{i:02}-") == 1 for i in (0, 1, 2, 3, 4, 5))


def test_made_once_gives_what_the_expressions_give(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "n long, t string")
    made = {"x": F.col("n") + 1, "y": F.concat("t", F.lit("!")), "z": F.lit(None).cast("date")}
    want = df.select("n", *[c.alias(n) for n, c in made.items()])
    got = facts.made_once(df, ["n"], made)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert [f.dataType for f in got.schema] == [f.dataType for f in want.schema]


def test_an_upsert_releases_the_shuffles_of_its_steps(spark, tmp_path, monkeypatch):
    from opsledger.sources import keyed
    freed = []
    monkeypatch.setattr(keyed, "release_shuffles", freed.append)
    t = KeyedTable(spark, str(tmp_path / "t"), "k long, v long", ["k"])
    t.upsert(spark.range(9).select(F.col("id").alias("k"), F.col("id").alias("v")))
    assert len(freed) == 3 and t.read().count() == 9  # the rows, the changes, the buckets


def test_dispatches_are_merged_without_the_texts_of_their_key(spark, rows):
    none = lambda schema: spark.createDataFrame([], schema)
    dispatches, _ = facts.build_dispatches(
        rows, none("customer_id long, legal_name string"), none("customer_id long, po_number string, sales_order_line_id long, source_row_id long"),
        none("permit_number string, direction string, permit_id long, source_row_id long"))
    top = plan(dispatches).split("Aggregate", 2)[1].split("\n")[0]
    assert "business_key" in top and "permit_number" not in top and "_vehicles" not in top
