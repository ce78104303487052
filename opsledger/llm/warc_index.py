"""WARC archives and their external index merge (operator 1).

Pages are written as WARC 1.1 records by Spark's text writer, one archive file for each task, and read back with the
text reader.  Each record starts with the archive set's own random WARC-Warcinfo-ID, which no payload can contain, so
readers may split an archive of any size at record borders; Content-Length proves that each record is whole.

The capture index is merged externally: every task sorts its captures into a run; the runs are cut into key ranges; a
task merges its range of all runs with a loser tree.  (range_no, place in the range) is the global order, and
capture_no counts the captures of one URL key over range borders.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_dir, written

LEAST_REVISIT = 1000  # payload bytes from which an equal payload is a revisit
RANGE_ROWS = 20_000  # captures in a key range, the unit of a merging task
CRLF2 = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + CRLF2
KEYS = ["url_key", "capture_ts", "page_id", "payload_digest"]
INDEX = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, "
         "capture_ts string, run_no int")


def url_key(url: Column) -> Column:
    """Sort-friendly key: host labels reversed, then path and query without the fragment; '' for a null URL."""
    scheme = "^[A-Za-z][A-Za-z0-9+.-]*://"
    host = F.lower(F.regexp_extract(url, scheme + "([^/?#:]*)", 1))
    rest = F.regexp_extract(url, scheme + "[^/?#]*([^#]*)", 1)
    rest = F.when(rest == "", "/").otherwise(rest)
    key = F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(")"), rest)
    return F.coalesce(F.when(host != "", key).otherwise(url), F.lit(""))


def capture_time(page_id: Column) -> Column:
    """Pages carry no capture time: one second for each id after the start of 2024 (no session time zone involved)."""
    seconds = F.coalesce(F.pmod(page_id, F.lit(1_000_000_000)), F.lit(0)).cast("int")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return F.concat(F.translate(F.substring(at.cast("string"), 1, 19), " ", "T"), F.lit("Z"))


def decided(pages: DataFrame) -> DataFrame:
    """Pages with payload, size, digest, and the page that each revisit refers to (null: a response).

    Of equal payloads the page with the largest id is the response; rows that repeat this id are all responses."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    copies = (p.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest", "payload_bytes")
              .agg(F.max("page_id").alias("refers_to"), F.count("payload_digest").alias("n")).where("n > 1 and refers_to is not null").drop("n"))
    joined = p.join(written(copies, "copies"), ["payload_digest", "payload_bytes"], "left")
    other = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("refers_to")), F.col("refers_to"))
    return joined.withColumn("refers_to", other)


def header_line(name: str, value: Column) -> Column:
    """One header field; '' where the value is null.  Line breaks inside a value become percent escapes."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def record_start(archive: str) -> str:
    return f"WARC/1.1\r\nWARC-Warcinfo-ID: <urn:uuid:{archive}>\r\n"


def write_archives(pages: DataFrame, path: str, archive: str) -> None:
    """Write a record for each row of `pages` (page_id, url, html) below `path`."""
    p = decided(pages)
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(F.lit(HTTP), F.when(revisit, "").otherwise(F.col("payload")))
    ident = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    record = F.concat(
        F.lit(record_start(archive)),
        header_line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header_line("WARC-Record-ID", ident(F.coalesce(F.col("page_id").cast("string"), F.lit("none")))),
        header_line("WARC-Date", capture_time(F.col("page_id"))),
        header_line("WARC-Target-URI", F.col("url")),
        header_line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        header_line("X-Payload-Length", F.col("payload_bytes")),
        header_line("WARC-Refers-To", ident(F.col("refers_to"))),
        header_line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        header_line("Content-Length", F.octet_length(block)), F.lit("\r\n"), block)
    p.select(record.alias("value")).write.option("lineSep", CRLF2).text(path)


def read_archives(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """Captures of the records below `path`; a record cut short is an error.  A response's size and digest are those of
    the payload that was read, a revisit's those of its header."""
    raw = spark.read.option("lineSep", record_start(archive)).text(path).where("value <> ''")
    cut = F.instr("value", CRLF2)
    head = raw.select(F.substr("value", F.lit(1), cut + 1).alias("head"), F.substr("value", cut + 4).alias("rest"))
    field = lambda name: F.regexp_extract("head", f"(?:^|\n){name}: ([^\r]*)\r", 1)
    number = lambda text: F.when(text != "", text).cast("long")
    page = lambda name: number(F.regexp_extract("head", rf"(?:^|\n){name}: <urn:page:(-?\d+)>", 1))
    block = F.substr("rest", F.lit(1), F.length("rest") - len(CRLF2))
    whole = F.octet_length(block) == number(field("Content-Length"))
    payload = F.when(whole, F.substr(block, F.lit(len(HTTP) + 1))).otherwise(F.raise_error(F.lit("WARC record is not whole")))
    kind = field("WARC-Type")
    return head.select(
        page("WARC-Record-ID").alias("page_id"),
        F.when(kind == "response", F.octet_length(payload).cast("long")).otherwise(number(field("X-Payload-Length"))).alias("payload_bytes"),
        F.when(kind == "response", F.sha1(payload)).otherwise(F.substr(field("WARC-Payload-Digest"), F.lit(6))).alias("payload_digest"),
        kind.alias("record_type"), page("WARC-Refers-To").alias("refers_to"),
        url_key(F.when(F.contains("head", F.lit("\nWARC-Target-URI: ")), field("WARC-Target-URI"))).alias("url_key"),
        field("WARC-Date").alias("capture_ts"))


def loser_tree(runs: list[list[tuple]]) -> Iterator[int]:
    """Run numbers in merge order: each step yields the run that holds the smallest next item."""
    k = len(runs)
    at = [0] * k
    beats = lambda a, b: at[b] == len(runs[b]) or (at[a] < len(runs[a]) and (runs[a][at[a]], a) < (runs[b][at[b]], b))
    loser = [-1] * k  # inner nodes; 0 holds the winner
    for leaf in range(k):  # play each leaf up until it waits for an opponent
        winner, node = leaf, (leaf + k) // 2
        while node and loser[node] >= 0:
            if beats(loser[node], winner):
                winner, loser[node] = loser[node], winner
            node //= 2
        loser[node] = winner
    while k and at[loser[0]] < len(runs[loser[0]]):
        winner = loser[0]
        yield winner
        at[winner] += 1
        node = (winner + k) // 2
        while node:  # replay the path of the winner's leaf
            if beats(loser[node], winner):
                winner, loser[node] = loser[node], winner
            node //= 2
        loser[0] = winner


def merge_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge one key range, whose rows come run by run, each run in key order."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    rows = pa.Table.from_batches(got).combine_chunks()
    run = rows.column("run_no").to_numpy()
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    # nulls sort first, as in Spark
    keys = [tuple((v is not None, v) if v is not None else (False,) for v in k) for k in zip(*(rows.column(c).to_pylist() for c in KEYS))]
    ends = np.append(first[1:], len(run))
    place = first.tolist()
    order = []
    for r in loser_tree([keys[a:b] for a, b in zip(first, ends)]):
        order.append(place[r])
        place[r] += 1
    out = rows.take(pa.array(order)).drop_columns(["run_no"])
    key = out.column("url_key").to_numpy(zero_copy_only=False)
    fresh = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    seen = np.arange(len(key)) - np.repeat(fresh, np.diff(np.append(fresh, len(key)))) + 1
    out = out.append_column("seen", pa.array(seen)).append_column("range_no", pa.array(np.full(len(key), TaskContext.get().partitionId(), np.int32)))
    yield from out.to_batches()


def merged_index(captures: DataFrame) -> DataFrame:
    """The captures in global order with capture_no, their number in the history of their URL key.

    A range's first key may have begun in earlier ranges; one row for each range carries the count over."""
    runs = written(captures.withColumn("run_no", F.spark_partition_id()).sortWithinPartitions(*KEYS), "runs")
    ranges = max(1, -(-runs.count() // RANGE_ROWS))
    dealt = runs.repartitionByRange(ranges, *KEYS).sortWithinPartitions("run_no", *KEYS)
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema if f.name != "run_no")
    merged = written(dealt.mapInArrow(merge_range, f"{shape}, seen long, range_no int"), "merged")
    ends = merged.groupBy("range_no").agg(F.min("url_key").alias("first_key"), F.max(F.struct("url_key", "seen")).alias("tail"))
    ends = ends.select("range_no", "first_key", F.col("tail.url_key").alias("last_key"), F.col("tail.seen").alias("n"))
    before = Window.partitionBy("last_key").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    ends = written(ends.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "ends")
    total = ends.groupBy(F.col("last_key").alias("first_key")).agg(F.sum("n").alias("total"))
    carry = ends.join(total, "first_key", "left").select(
        "range_no", F.col("first_key").alias("url_key"),
        F.when(F.col("first_key") == F.col("last_key"), F.col("before")).otherwise(F.coalesce("total", F.lit(0))).alias("carry"))
    out = merged.join(written(carry, "carry"), ["range_no", "url_key"], "left")
    return out.withColumn("capture_no", F.col("seen") + F.coalesce("carry", F.lit(0)))


def captures(pages: DataFrame) -> DataFrame:
    """Write `pages` as archives in the shared folder, read them back and return their merged index.

    Null html is an empty payload, a null url gives the key '', a null page_id a record without a number (never the
    target of a revisit); repeated rows give repeated records; an empty table gives no rows."""
    spark = pages.sparkSession
    archive = str(uuid.uuid4())
    path = f"{scratch_dir(spark)}/llm-warc-{archive}"
    write_archives(pages, path, archive)
    return merged_index(read_archives(spark, path, archive)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_ts", "capture_no")


ORACLE = f"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS rest
  FROM pages
),
k AS (
  SELECT page_id, payload_bytes, payload_digest,
         CASE WHEN payload_bytes >= {LEAST_REVISIT} THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS top,
         CASE WHEN url IS NULL THEN '' WHEN host = '' THEN url
              ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END END AS url_key,
         strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id % 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS capture_ts
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to, url_key, capture_ts,
       row_number() OVER (PARTITION BY url_key ORDER BY capture_ts, page_id, payload_digest) AS capture_no
FROM k
"""
