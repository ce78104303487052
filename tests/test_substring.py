import random

import pytest
from pyspark.sql import functions as F

from opsledger.operators.substring import contained_keys, first_contained


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abc", k=n))
    keys = [word(rng.randint(1, 9)) for _ in range(120)] + ["hot" * 3, "", None, "zzzzzzzz", "abc", "abc"]
    texts = [word(rng.randint(0, 25)) + rng.choice(["", "hothothot"]) for _ in range(200)] + [None, "", "aa", "aa"]
    k = spark.createDataFrame(list(enumerate(keys)), "id int, key string")
    t = spark.createDataFrame(list(enumerate(texts)), "tid int, text string")
    return texts, keys, t, k


@pytest.mark.parametrize("size", [1, 3, 6])
def test_contained_keys_match_brute_force(sides, size):
    texts, keys, t, k = sides
    want = {(x, y) for x in texts for y in keys if x is not None and y and y in x}
    got = [tuple(r) for r in contained_keys(t, k, size).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("with_empty", [True, False])
def test_first_contained_is_the_first_match(sides, with_empty):
    texts, keys, t, k = sides
    if not with_empty:
        k = k.where("key <> ''")
    ok = lambda i, y: y is not None and (y != "" or with_empty)
    # the order of the list, backwards, so that the empty key is neither first nor last
    want = sorted((i, max((j for j, y in enumerate(keys) if x is not None and ok(j, y) and y in x), default=None)) for i, x in enumerate(texts))
    got = first_contained(t, "text", k.withColumn("o", -F.col("id")), "key", ["o"], ["id"], 4)
    assert sorted((r.tid, r.id) for r in got.collect()) == want


def test_no_pairs_of_all_texts_and_keys(sides):
    _, _, t, k = sides
    plan = contained_keys(t, k)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_row_numbers_are_places_in_the_files(spark, tmp_path):
    from opsledger.sources.tables import FILE_STEP, with_row_numbers

    spark.range(100).select((F.col("id") % 7).alias("a")).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = with_row_numbers(spark.read.parquet(str(tmp_path / "one")), "n")
    assert [(r.a, r.n) for r in one.orderBy("n").collect()] == [(i % 7, i + 1) for i in range(100)]
    spark.range(100).select((F.col("id") % 7).alias("a")).repartition(3).write.parquet(str(tmp_path / "three"))
    three = with_row_numbers(spark.read.parquet(str(tmp_path / "three")), "n")
    assert three.columns == ["a", "n"] and three.count() == 100 == three.select("n").distinct().count()
    assert {r.f for r in three.select(F.floor(F.col("n") / FILE_STEP).alias("f")).distinct().collect()} == {0, 1, 2}
    assert three.where("n = 1").count() == 1
