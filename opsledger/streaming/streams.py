"""Structured Streaming forms of the incremental operators (X1-X3) and the exact
per-event trailing count (W6).

A stream has a folder that lasts: its checkpoint and a keyed table.  Each call reads the files that have landed since the
last one, as one or more batches, and merges each batch into the table by key; the batch's number is its epoch, so that a
batch that is tried again counts once.  Nothing is dropped for being late: a row adds to its key's totals whenever it
arrives, and files may come in any order.  Where a file that was read has changed or gone, or the code is another,
the stream begins anew with what is there.
"""

from __future__ import annotations

import hashlib
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpoint_dir
from ..sources import keyed, stage
from ..sources.keyed import ADD, KeyedTable
from ..sources.store import Folder, Manifests, code_version, landed_files


def stream_root(spark: SparkSession, name: str, path: str) -> str:
    """The folder of a stream over `path`, the same on every call."""
    which = hashlib.md5(f"{path}|{code_version(sys.modules[__name__], stage, keyed)}".encode()).hexdigest()[:16]
    return f"{checkpoint_dir(spark).rstrip('/')}/opsledger-streams/{name}-{which}"


def generation(spark: SparkSession, path: str, root: str) -> str:
    """The part of `root` in which the stream goes on: the last one, unless a file that it has read is not there as it was."""
    files, seen = landed_files(spark, path), Manifests(Folder(spark, root), "landed")
    last = seen.latest() or {"version": 0, "generation": 1, "files": {}}
    same = all(files.get(f) == v for f, v in last["files"].items())
    now = {"generation": last["generation"] + (not same), "files": files}
    if last["files"] != files:
        seen.commit(last["version"] + 1, now, uuid.uuid4().hex)
    return f"{root}/{now['generation']}"


def landed(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of the rows of the files that land at `path`, with their place: file time, file and row (`_time`, `_file`, `_row`)."""
    schema = spark.read.parquet(path).schema
    # A file stream watches a directory; a single landed file is addressed as a glob.
    pattern = path[:-len(".parquet")] + "*.parquet" if path.endswith(".parquet") else path
    s = spark.readStream.schema(schema)
    if files_per_batch:
        s = s.option("maxFilesPerTrigger", files_per_batch)
    m = lambda c: F.col(f"_metadata.{c}")
    return s.parquet(pattern).withColumns({"_time": m("file_modification_time"), "_file": m("file_path"), "_row": m("row_index")})


def merged(stream: DataFrame, to_rows, table: KeyedTable, root: str, order: list[str] = ()) -> DataFrame:
    """Run `stream` over what has landed, merging `to_rows(batch)` of each batch into `table`; the table after it."""

    def merge(batch: DataFrame, epoch: int) -> None:
        table.upsert(to_rows(batch), list(order), epoch=f"batch-{epoch}")

    before = table.version()
    q = (stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    table.squash(before)  # what the batches of this call have replaced
    return table.read()


def daily_event_totals(spark: SparkSession, events_path: str, root: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Per day and event type: events and value total.  Each batch adds its own totals, however late its rows are."""
    root = generation(spark, events_path, root or stream_root(spark, "daily-event-totals", events_path))
    table = KeyedTable(spark, f"{root}/table", "day date, event_type string, events long, value_sum decimal(18,2)",
                       ["day", "event_type"], {"events": ADD, "value_sum": ADD}, buckets=16)

    def totals(batch: DataFrame) -> DataFrame:
        return batch.groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(
            F.count(F.lit(1)).alias("events"), F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(18,2)").alias("value_sum"))

    return merged(landed(spark, events_path, files_per_batch), totals, table, root)


def burst_windows(spark: SparkSession, events_path: str, threshold: int, root: str | None = None,
                  files_per_batch: int | None = None) -> DataFrame:
    """Sliding 10-minute windows (1-minute slide) per user with more than `threshold` events.  Every window's count is
    kept, as a later batch can bring it over the threshold."""
    root = generation(spark, events_path, root or stream_root(spark, "burst-windows", events_path))
    table = KeyedTable(spark, f"{root}/table", "user_id long, window_start timestamp_ntz, events long", ["user_id", "window_start"],
                       {"events": ADD}, buckets=16)

    def counts(batch: DataFrame) -> DataFrame:
        return (batch.groupBy(F.window("ts", "10 minutes", "1 minute").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"))
                .select("user_id", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "events"))

    return merged(landed(spark, events_path, files_per_batch), counts, table, root).where(F.col("events") > threshold)


def burst_windows_batch(events: DataFrame, threshold: int) -> DataFrame:
    """X3 in batch: the same `window()` aggregation (stream = batch check)."""
    return (events.groupBy(F.window("ts", "10 minutes", "1 minute").alias("w"), "user_id")
            .agg(F.count(F.lit(1)).alias("events"))
            .select("user_id", F.col("w.start").alias("window_start"), "events")
            .where(F.col("events") > threshold))


def trailing_counts(events: DataFrame, seconds: int = 600) -> DataFrame:
    """For every event, the number of the same user's events in (ts - seconds, ts].

    A range-frame window partitioned by user would put a hot user in one task, and one by user and hour a hot user's
    busy hour.  Here equal (user, time) pairs are counted first, and the window runs over those counts by (user, bucket of
    `seconds`): a count is placed in its own bucket ("home") and in the next one as context, so that every home row sees
    its whole trailing window.  A task's group is the distinct microseconds of two buckets, never a user's rows."""
    # micros since epoch of the wall-clock timestamp (independent of the session time zone)
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    bucket_us = seconds * 1_000_000
    e = events.select("event_id", "user_id", "ts", us.alias("us"))
    at = e.groupBy("user_id", "us").agg(F.count(F.lit(1)).alias("n"))
    own = F.floor(F.col("us") / bucket_us)
    both = at.select("user_id", "us", "n", F.explode(F.array(F.struct(own.alias("bucket"), F.lit(True).alias("home")),
                                                             F.struct((own + 1).alias("bucket"), F.lit(False).alias("home")))).alias("b"))
    w = Window.partitionBy("user_id", "b.bucket").orderBy("us").rangeBetween(-(bucket_us - 1), 0)
    counts = both.withColumn("trailing_count", F.sum("n").over(w)).where("b.home").select(
        F.col("user_id").alias("_u"), F.col("us").alias("_us"), "trailing_count")
    return (e.join(counts, F.col("user_id").eqNullSafe(F.col("_u")) & F.col("us").eqNullSafe(F.col("_us")))
            .select("event_id", "user_id", "ts", "trailing_count"))


def incremental_staging(spark: SparkSession, path: str, stage_fn, keys: list[str], root: str | None = None,
                        files_per_batch: int | None = None) -> DataFrame:
    """New files are staged as they land and upserted by `keys` (file, sheet, row); the row written last, by file time,
    file and place in the file, wins.  A batch rewrites the buckets it touches, so few large batches (by default one for
    all that has landed) write least.  `stage_fn(batch) -> staged rows` keeps the three place columns of `landed`."""
    root = generation(spark, path, root or stream_root(spark, "staging", path))
    source = landed(spark, path, files_per_batch)
    place = ["_time", "_file", "_row"]
    staged = stage_fn(source)
    schema = [f for f in staged.schema.fields if f.name not in place]
    table = KeyedTable(spark, f"{root}/table", StructType(schema), keys, buckets=16)
    return merged(source, stage_fn, table, root, place)
