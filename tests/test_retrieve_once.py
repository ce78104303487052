"""Retrieval scans the documents once; questions without hits get the first two documents."""

from __future__ import annotations

from opsledger.operators import search


def test_one_scan_and_the_fallback(spark):
    docs = spark.createDataFrame([(3, "kiln", "the kiln feed"), (1, "ore", None), (2, "lump", "ore and lump")], "doc_id long, area string, text string")
    questions = spark.createDataFrame([(7, "kiln"), (8, "zzz"), (8, "zzz"), (9, None), (None, "lump"), (10, "ore lump")], "item_id long, text string")
    got = search.retrieve(questions, docs, 1)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    rows = sorted((r.item_id or 0, r.rank, r.doc_id, r.area, r.score) for r in got.collect())
    none = lambda i: [(i, 1, 1, "ore", 0), (i, 2, 2, "lump", 0)]
    # a question without an id has hits of its own and, as none of them is known to be its, the fallback too
    assert rows == sorted([(7, 1, 3, "kiln", 4), *none(8), *none(8), *none(9), (0, 1, 2, "lump", 4), *none(0), (10, 1, 2, "lump", 5)])
