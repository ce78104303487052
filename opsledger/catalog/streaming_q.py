"""Registered stream and staging queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks
from ..sources import stage
from ..sources.tables import TABLES, Tables
from ..streaming import streams
from ..registry import register

BURST_THRESHOLD = 2   # the largest 10-minute count per user is small in the test data


@register("x2_daily_event_totals", """
SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS events,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS value_sum
FROM events GROUP BY 1, 2""")
def x2(spark, sf_dir):
    return streams.daily_event_totals(spark, Tables(spark, sf_dir).path("events"))


BURST_SQL = f"""
SELECT user_id, window_start, count(*) AS events FROM (
  SELECT user_id, date_trunc('minute', ts) - to_minutes(k) AS window_start
  FROM events, (SELECT unnest(range(0, 10)) AS k))
GROUP BY 1, 2 HAVING count(*) > {BURST_THRESHOLD}"""


@register("x3_burst_windows_stream", BURST_SQL)
def x3(spark, sf_dir):
    return streams.burst_windows(spark, Tables(spark, sf_dir).path("events"), BURST_THRESHOLD)


@register("x3_burst_windows_batch", BURST_SQL)
def x3b(spark, sf_dir):
    return streams.burst_windows_batch(Tables(spark, sf_dir).events, BURST_THRESHOLD)


@register("w6_trailing_counts", """
SELECT event_id, user_id, ts,
       count(*) OVER (PARTITION BY user_id ORDER BY ts
                      RANGE BETWEEN to_microseconds(599999999) PRECEDING AND CURRENT ROW) AS trailing_count
FROM events""")
def w6(spark, sf_dir):
    return streams.trailing_counts(Tables(spark, sf_dir).events, 600)


@register("s1_stage_documents", """
SELECT 'documents.parquet' AS file_name, source AS sheet_name, row_number() OVER () AS row_number,
       [text, lang, source, CAST(n_chars AS VARCHAR)] AS cells,
       sha256(to_json([text, lang, source, CAST(n_chars AS VARCHAR)])) AS row_hash
FROM documents""")
def s1(spark, sf_dir):
    d = Tables(spark, sf_dir).numbered("documents")
    return stage.stage_rows(d, "documents.parquet", F.col("source"), F.col("file_row"),
                            ["text", "lang", "source", "n_chars"])


@register("s7_import_run", """
SELECT count(DISTINCT file_name) AS files_seen, count(*) AS rows_seen, CAST(0 AS BIGINT) AS issue_count,
       'completed' AS status
FROM (SELECT 'documents.parquet' AS file_name FROM documents UNION ALL SELECT 'pages.parquet' FROM pages
      UNION ALL SELECT 'conversations.parquet' FROM conversations)""")
def s7(spark, sf_dir):
    t = Tables(spark, sf_dir)
    staged = (stage.stage_rows(t.documents, "documents.parquet", F.col("source"), F.col("doc_id") + 1, ["text"])
              .unionByName(stage.stage_rows(t.pages, "pages.parquet", F.lit("pages"), F.col("page_id") + 1,
                                            ["url", "html"]))
              .unionByName(stage.stage_rows(t.conversations, "conversations.parquet", F.col("role"),
                                            F.col("conv_id") * 1000 + F.col("turn") + 1, ["text"])))
    return stage.import_run(staged)


@register("r01_missing_source_file")
def r01(spark, sf_dir):
    """R1 against the landed files of `sf_dir` (no SQL oracle: it lists the directory)."""
    files = stage.file_hashes(spark, f"{sf_dir.rstrip('/')}/*.parquet").select("file_name")
    contract = spark.createDataFrame([(f"{t}.parquet",) for t in TABLES + ["payments", "auction_bids"]], "file_name string")
    return checks.missing_source_files(contract, files)


def _stage_documents(df):
    place = [c for c in ("_time", "_file", "_row") if c in df.columns]
    return stage.stage_rows(df, "documents.parquet", F.col("source"), F.col("doc_id") + 1,
                            ["text", "lang", "source", "n_chars"], place)


@register("x1_incremental_staging", """
SELECT 'documents.parquet' AS file_name, source AS sheet_name, CAST(doc_id + 1 AS BIGINT) AS row_number,
       [text, lang, source, CAST(n_chars AS VARCHAR)] AS cells,
       sha256(to_json([text, lang, source, CAST(n_chars AS VARCHAR)])) AS row_hash
FROM documents""")
def x1(spark, sf_dir):
    return streams.incremental_staging(spark, Tables(spark, sf_dir).path("documents"), _stage_documents,
                                       ["file_name", "sheet_name", "row_number"])


@register("s6_source_provenance")
def s6(spark, sf_dir):
    """S2 + S4 + S5 + S6: landed files with content hash (identical files de-duplicated) and contract
    cadence, joined to the staged document rows (no SQL oracle: it lists the directory)."""
    files = stage.dedupe_files(stage.file_hashes(spark, f"{sf_dir.rstrip('/')}/documents*.parquet"))
    files = files.join(stage.source_contract(files), "file_name")
    staged = _stage_documents(Tables(spark, sf_dir).documents)
    return staged.join(files.select("file_name", "file_hash", "cadence", "maximum_age_hours"), "file_name").select(
        F.concat_ws(":", "file_name", "sheet_name", F.col("row_number").cast("string")).alias("source_key"),
        "file_name", "sheet_name", "row_number", "file_hash", "row_hash", "cadence", "maximum_age_hours")


@register("r02_missing_sheet", """
WITH books AS (SELECT DISTINCT COALESCE(lang, 'none') || '.xlsx' AS file_name, source AS sheet_name FROM documents),
contract AS (SELECT f.file_name, s.sheet_name FROM (SELECT DISTINCT file_name FROM books) f,
             (SELECT DISTINCT source AS sheet_name FROM documents WHERE source IS NOT NULL UNION SELECT 'summary') s)
SELECT 'MISSING_REQUIRED_FIELD' AS rule_code, 'critical' AS severity, 'source_sheet' AS entity_name,
       file_name || ':' || sheet_name AS entity_key, CAST(NULL AS BIGINT) AS source_row_id,
       'Required sheet ' || sheet_name || ' is missing from ' || file_name || '.' AS message
FROM (SELECT * FROM contract EXCEPT SELECT * FROM books)""")
def r02_sheet(spark, sf_dir):
    """R2: each language's workbook must have a sheet for every source, and a summary."""
    d = Tables(spark, sf_dir).documents
    staged = d.select(F.concat(F.coalesce("lang", F.lit("none")), F.lit(".xlsx")).alias("file_name"), F.col("source").alias("sheet_name")).distinct()
    sheets = d.where(F.col("source").isNotNull()).agg(F.array_union(F.collect_set("source"), F.array(F.lit("summary")))).scalar()
    contract = staged.select("file_name").distinct().withColumn("sheet_name", F.explode(sheets))
    return checks.missing_sheets(contract, staged)


@register("s2_table_content_hashes", """
SELECT 'documents.parquet' AS file_name, count(*) AS rows, true AS same_when_read_again FROM documents
UNION ALL SELECT 'pages.parquet', count(*), true FROM pages UNION ALL SELECT 'events.parquet', count(*), true FROM events""")
def s2(spark, sf_dir):
    """Content hashes of three tables, read whole and read again: they have no SQL form, their agreement and counts do."""
    t = Tables(spark, sf_dir)
    read = lambda: stage.content_hashes({f"{n}.parquet": spark.read.parquet(t.path(n)) for n in ("documents", "pages", "events")})
    again = read().select("file_name", F.col("file_hash").alias("again"))
    return read().join(again, "file_name").select("file_name", "rows", (F.col("file_hash") == F.col("again")).alias("same_when_read_again"))
