"""J8's gram tables meet in shuffles, whatever the size of the files they come from."""

from __future__ import annotations

from opsledger.operators.substring import first_contained


def test_no_gram_table_is_broadcast(spark, tmp_path):
    spark.createDataFrame([("bluering" + "lot12345", 1), ("oldplatelot777", 2), ("none", 3)], "text string, id long").write.parquet(f"{tmp_path}/t")
    spark.createDataFrame([("lot12345", 1), ("lot1234", 2), ("lot7", 3)], "key string, n long").write.parquet(f"{tmp_path}/k")
    got = first_contained(spark.read.parquet(f"{tmp_path}/t"), "text", spark.read.parquet(f"{tmp_path}/k"), "key", ["n"], ["n"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 0 and plan.count("SortMergeJoin") >= 4
    assert sorted((r.id, r.n) for r in got.collect()) == [(1, 1), (2, 3), (3, None)]
