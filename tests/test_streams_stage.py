"""Trailing counts of long windows, landed folders as tables, and the last closed month's price."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from opsledger.operators import kpis
from opsledger.sources import stage
from opsledger.streaming import streams


@pytest.mark.parametrize("seconds", [600, 3600, 7200, 50000])
def test_trailing_counts_match_brute_force(spark, seconds):
    rng = random.Random(seconds)
    start = dt.datetime(1969, 12, 31, 12)
    data = [(i, i % 2, start + dt.timedelta(seconds=rng.randrange(2 * 86400))) for i in range(300)]
    events = spark.createDataFrame(data, "event_id long, user_id long, ts timestamp_ntz")
    got = {r.event_id: r.trailing_count for r in streams.trailing_counts(events, seconds).collect()}
    assert got == {i: sum(v == u and dt.timedelta(0) <= t - s < dt.timedelta(seconds=seconds) for _, v, s in data) for i, u, t in data}


def test_folder_of_part_files_is_one_file(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(f"{tmp_path}/a.parquet")
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/tmp/x")
    one = next((tmp_path / "tmp" / "x").glob("part-*.parquet"))
    (tmp_path / "b.parquet").write_bytes(one.read_bytes())
    (tmp_path / "c.parquet").write_bytes(one.read_bytes())
    files = stage.file_hashes(spark, f"{tmp_path}/*.parquet")
    got = {r.file_name: r for r in files.collect()}
    assert set(got) == {"a.parquet", "b.parquet", "c.parquet"}
    assert got["b.parquet"].file_hash == got["c.parquet"].file_hash != got["a.parquet"].file_hash
    assert got["a.parquet"].file_size_bytes == sum(p.stat().st_size for p in (tmp_path / "a.parquet").glob("part-*.parquet"))
    assert stage.dedupe_files(files).count() == 2


def test_streams_keep_events_of_unordered_files(spark, tmp_path):
    start = dt.datetime(2026, 1, 1)
    rng = random.Random(3)
    data = [(i, i % 3, "ab"[i % 2], start + dt.timedelta(minutes=rng.randrange(20 * 1440)), 1.5) for i in range(400)]
    data += [(1000 + i, 7, "a", start + dt.timedelta(days=i // 4, minutes=i % 4), 0.25) for i in range(40)]
    events = spark.createDataFrame(data, "event_id long, user_id long, event_type string, ts timestamp_ntz, value double")
    path = f"{tmp_path}/events.parquet"
    events.orderBy(F.desc("ts")).repartitionByRange(4, F.desc("ts")).write.parquet(path)
    got = {(r.day, r.event_type): (r.events, r.value_sum) for r in streams.daily_event_totals(spark, path).collect()}
    want = {}
    for _, _, kind, ts, value in data:
        n, total = want.get((ts.date(), kind), (0, Decimal(0)))
        want[ts.date(), kind] = n + 1, total + Decimal(str(value))
    assert got == want
    bursts = streams.burst_windows_batch(events, 2).collect()
    assert bursts and sorted(streams.burst_windows(spark, path, 2).collect()) == sorted(bursts)


def test_second_call_reads_new_files_only_and_late_rows_count(spark, tmp_path):
    start = dt.datetime(2026, 1, 1)
    path, root = f"{tmp_path}/events.parquet", f"{tmp_path}/stream"
    schema = "event_id long, user_id long, event_type string, ts timestamp_ntz, value double"
    land = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    row = lambda i, minute, user=1: (i, user, "a", start + dt.timedelta(minutes=minute), 1.25)
    land([row(i, 50_000 + i) for i in range(5)])
    first = streams.daily_event_totals(spark, path, f"{root}/x2", 1).collect()
    streams.burst_windows(spark, path, 2, f"{root}/x3", 1)
    land([row(100 + i, i, 2) for i in range(4)])  # weeks before what has been read
    land([row(200, 50_002)])
    calls, upsert = [], streams.KeyedTable.upsert

    def counted(self, rows, *a, **k):
        calls.append(rows.count())
        return upsert(self, rows, *a, **k)

    streams.KeyedTable.upsert = counted
    try:
        second = streams.daily_event_totals(spark, path, f"{root}/x2", 1).collect()
        assert len(calls) == 2, "one batch for each new file"
        third = streams.daily_event_totals(spark, path, f"{root}/x2", 1).collect()
        assert len(calls) == 2 and sorted(third) == sorted(second)
    finally:
        streams.KeyedTable.upsert = upsert
    assert {(r.day, r.events) for r in first} == {(dt.date(2026, 2, 4), 5)}
    assert {(r.day, r.events, r.value_sum) for r in second} == {(dt.date(2026, 1, 1), 4, Decimal("5.00")), (dt.date(2026, 2, 4), 6, Decimal("7.50"))}
    want = streams.burst_windows_batch(spark.read.parquet(path), 2).collect()
    assert sorted(streams.burst_windows(spark, path, 2, f"{root}/x3", 1).collect()) == sorted(want)
    spark.createDataFrame([row(0, 0)], schema).coalesce(1).write.mode("overwrite").parquet(path)  # what was read is gone
    assert [(r.day, r.events) for r in streams.daily_event_totals(spark, path, f"{root}/x2", 1).collect()] == [(dt.date(2026, 1, 1), 1)]


@pytest.mark.parametrize("files_per_batch", [1, None])
def test_staging_keeps_the_row_written_last(spark, tmp_path, files_per_batch):
    import time

    path, root = f"{tmp_path}/d.parquet", f"{tmp_path}/s"
    stage_fn = lambda df: stage.stage_rows(df, "d", F.lit("s"), F.col("n"), ["text"], [c for c in ("_time", "_file", "_row") if c in df.columns])
    for texts in (["z", "y", "x"], ["a", "y"]):  # the second file has the smaller texts, and hashes in any order
        spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1, texts[1] + "!")], "n long, text string").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    keys = ["file_name", "sheet_name", "row_number"]
    got = streams.incremental_staging(spark, path, stage_fn, keys, root, files_per_batch)
    assert sorted((r.row_number, r.cells[0]) for r in got.collect()) == [(0, "a"), (1, "y!"), (2, "x")]
    assert "_time" not in got.columns


def test_asp_is_the_last_closed_month(spark):
    day = dt.date.fromisoformat
    auctions = spark.createDataFrame([(day("2026-01-20"), Decimal(100)), (day("2026-04-02"), Decimal(300)), (day("2026-04-30"), Decimal(500))],
                                     "closes_on date, current_price decimal(18,4)")
    dates = ["2025-12-31", "2026-01-25", "2026-02-01", "2026-04-15", "2026-05-01", "2027-03-03"]
    purchases = spark.createDataFrame([(1, i, day(d)) for i, d in enumerate(dates)], "supplier_id long, lot_id long, purchase_date date")
    got = {r.lot_id: r.asp for r in kpis.asp_levies(purchases, auctions).collect()}
    assert got == {0: None, 1: None, 2: 100, 3: 100, 4: 400, 5: 400}


def test_content_hash_is_of_rows_in_their_places(spark, tmp_path):
    rows = spark.range(500).select("id", F.col("id").cast("string").alias("s"), F.array("id").alias("a"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/a")
    rows.coalesce(1).write.option("compression", "gzip").parquet(f"{tmp_path}/b")
    rows.orderBy(F.desc("id")).coalesce(1).write.parquet(f"{tmp_path}/c")
    rows.where("id <> 7").coalesce(1).write.parquet(f"{tmp_path}/d")
    rows.where("false").write.parquet(f"{tmp_path}/e")
    read = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in "abcde"}
    got = {r.file_name: r for r in stage.content_hashes(read).collect()}
    assert got["a"].file_hash == got["b"].file_hash and len({r.file_hash for r in got.values()}) == 4
    assert [got[n].rows for n in "abcde"] == [500, 500, 500, 499, 0]


def test_files_move_to_the_run_that_sees_them_again(spark, tmp_path):
    from opsledger.operators.books import Books

    books = Books(spark, str(tmp_path / "books"), buckets=4)
    shape = "file_hash string, file_name string, path string, file_size_bytes long, file_modified_at timestamp"
    at = dt.datetime(2026, 1, 1)
    one = [("h1", "a.xlsx", "in/a.xlsx", 5, at), ("h2", "b.xlsx", "in/b.xlsx", 6, at), ("h2", "copy.xlsx", "in/copy.xlsx", 6, at + dt.timedelta(1))]
    assert stage.register_files(books, spark.createDataFrame(one, shape), 1) == {"version": 1, "inserted": 2, "updated": 0}
    again = [("h2", "renamed.xlsx", "in/renamed.xlsx", 6, at), ("h3", "c.xlsx", "in/c.xlsx", 7, at)]
    assert stage.register_files(books, spark.createDataFrame(again, shape), 2) == {"version": 2, "inserted": 1, "updated": 1}
    got = sorted((r.file_hash, r.file_name, r.import_run_id, r.first_run_id) for r in books["source_file"].read().collect())
    assert got == [("h1", "a.xlsx", 1, 1), ("h2", "b.xlsx", 2, 1), ("h3", "c.xlsx", 2, 2)]


def test_absent_sheets_and_old_files(spark):
    from opsledger.operators import checks

    contract = spark.createDataFrame([("a", "s1"), ("a", "s2"), ("gone", "s1")], "file_name string, sheet_name string")
    staged = spark.createDataFrame([("a", "s1"), ("a", "s1"), ("other", "s2")], "file_name string, sheet_name string")
    assert [(r.rule_code, r.entity_key) for r in checks.missing_sheets(contract, staged).collect()] == [("MISSING_REQUIRED_FIELD", "a:s2")]
    noon = dt.datetime(2026, 1, 3, 12)
    files = spark.createDataFrame([("Daily x", noon - dt.timedelta(hours=37)), ("daily y", noon - dt.timedelta(hours=36)),
                                   ("weekly", noon - dt.timedelta(hours=193)), ("event", noon - dt.timedelta(days=900))], "file_name string, file_modified_at timestamp")
    files = files.join(stage.source_contract(files), "file_name")
    assert sorted(r.entity_key for r in checks.stale_files(files, "2026-01-03 12:00:00").collect()) == ["Daily x", "weekly"]
