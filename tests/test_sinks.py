"""Tables are published per run and the ledger row is the commit marker."""

import tempfile

from pyspark.sql import functions as F

from opsledger.sources import sinks


def test_publish_and_read_latest(spark):
    root = tempfile.mkdtemp(prefix="opsledger-sink-")
    df = spark.createDataFrame([("2026-01", 1), ("2026-02", 2)], "month string, n int")
    ledger = spark.createDataFrame([(1, 2, 0, "completed")], "files_seen long, rows_seen long, issue_count long, status string")
    sinks.publish({"v4": (df, ["month"])}, root, "0001", ledger)
    sinks.publish({"v4": (df.withColumn("n", F.col("n") * 10), ["month"])}, root, "0002", ledger)
    # a run without ledger row (died before the commit marker) is ignored
    df.write.parquet(f"{root}/run=0003/v4")
    assert sinks.latest_completed_run(spark, root) == "0002"
    got = sorted(r["n"] for r in sinks.read_published(spark, root, "v4").collect())
    assert got == [10, 20]


def test_latest_run_compares_numbers(spark):
    root = tempfile.mkdtemp(prefix="opsledger-sink-")
    df = spark.createDataFrame([(1,)], "n int")
    ledger = spark.createDataFrame([("completed",)], "status string")
    for run in ("9", "10"):
        sinks.publish({"t": (df, [])}, root, run, ledger)
    assert sinks.latest_completed_run(spark, root) == "10"


def test_staged_row_upsert_overwrites_by_position(spark):
    from opsledger.sources import stage
    old = stage.stage_rows(spark.createDataFrame([(1, "a"), (2, "b")], "r long, v string"), "f.xlsx",
                           F.lit("S"), F.col("r"), ["v"])
    new = stage.stage_rows(spark.createDataFrame([(2, "B"), (3, "c")], "r long, v string"), "f.xlsx",
                           F.lit("S"), F.col("r"), ["v"])
    got = {r["row_number"]: r["cells"][0] for r in stage.upsert_rows(old, new).collect()}
    assert got == {1: "a", 2: "B", 3: "c"}
