"""Staging S1-S8: rows with provenance, hashes, contracts, import-run ledger.

A staged row is (file_name, sheet_name, row_number BIGINT, cells ARRAY<STRING>, row_hash).  Any
table can be staged: its columns, formatted as text, become the positional cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.resolve import dedupe_latest


def stage_rows(df: DataFrame, file_name: str, sheet: Column, row_number: Column, cells: list[str],
               extra: list[str] = ()) -> DataFrame:
    """S1 + S2: positional text cells with a 1-based row number and the row's SHA-256; `extra` columns stay."""
    arr = F.array(*[F.col(c).cast("string") for c in cells])
    return df.select(F.lit(file_name).alias("file_name"), sheet.alias("sheet_name"),
                     row_number.cast("bigint").alias("row_number"), arr.alias("cells"), *extra) \
        .withColumn("row_hash", F.sha2(F.to_json("cells"), 256))


def file_hashes(spark, path_glob: str) -> DataFrame:
    """Content hash and size of every landed file (binaryFile source).

    A table that landed as a folder of part files is one file: its hash is that of its parts' names and hashes in
    order, its size their sum, its time the latest."""
    f = spark.read.format("binaryFile").load(path_glob)
    steps = F.split("path", "/")
    part, folder = F.element_at(steps, -1), F.try_element_at(steps, F.lit(-2))
    inside = F.coalesce(folder.endswith(".parquet"), F.lit(False))
    parts = f.select(F.when(inside, folder).otherwise(part).alias("file_name"),
                     F.when(inside, F.array_join(F.slice(steps, 1, F.size(steps) - 1), "/")).otherwise(F.col("path")).alias("path"),
                     inside.alias("inside"), part.alias("part"), F.sha2("content", 256).alias("hash"), "length", "modificationTime")
    whole = F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("part", "hash")))), 256)
    return parts.groupBy("file_name", "path").agg(
        F.when(F.max("inside"), whole).otherwise(F.max("hash")).alias("file_hash"), F.sum("length").alias("file_size_bytes"),
        F.max("modificationTime").alias("file_modified_at"))


def content_hashes(tables: dict[str, DataFrame]) -> DataFrame:
    """S2 for files of any size: (file_name, file_hash, rows) of freshly read Parquet tables, from their rows alone.

    Each row is hashed with its place in its part file, and a part's row hashes are added and xored up task by task, so no
    file is held as one value; a table's hash is that of its parts' in the order of their hashes.  Equal rows in equal
    places give equal hashes, whatever the compression; 128 bits are kept."""
    out = None
    for name, df in tables.items():
        row = [F.col("_metadata.row_index"), *[F.col(c) for c in df.columns]]
        parts = df.groupBy(F.col("_metadata.file_path").alias("part")).agg(
            F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*row).cast("decimal(38,0)")).alias("total"),
            F.bit_xor(F.xxhash64(F.lit("x"), *row)).alias("mixed"))
        of_part = F.concat_ws("|", "rows", "total", "mixed")
        one = parts.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(of_part))), 256).alias("file_hash"), F.sum("rows").alias("rows"))
        one = one.select(F.lit(name).alias("file_name"), "file_hash", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def register_files(books, files: DataFrame, run_id: int) -> dict:
    """Files by content hash in the keyed `source_file` table: a file that was imported before keeps its row, which
    moves to this run; of files with one content the first by time and path stands."""
    new = dedupe_files(files).select("file_hash", "file_name", F.col("path").alias("relative_path"), "file_size_bytes",
                                     "file_modified_at", F.lit(run_id).cast("bigint").alias("import_run_id"),
                                     F.lit(run_id).cast("bigint").alias("first_run_id"))
    return books["source_file"].upsert(new)


def dedupe_files(files: DataFrame) -> DataFrame:
    """One row per content hash (identical re-imports reuse the first-seen file)."""
    return dedupe_latest(files.withColumn("_neg", -F.unix_micros("file_modified_at")), ["file_hash"],
                         ["_neg", "path"]).drop("_neg")


def source_contract(files: DataFrame) -> DataFrame:
    """Cadence from the file name and its maximum age in hours."""
    n = F.lower("file_name")
    cadence = (F.when(n.rlike("daily|production report"), "daily")
               .when(n.rlike("weekly|work order"), "weekly").otherwise("event-driven"))
    return files.select("file_name", cadence.alias("cadence")).withColumn(
        "maximum_age_hours", F.when(F.col("cadence") == "daily", 36).when(F.col("cadence") == "weekly", 192))


def upsert_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """S3: staged rows keyed by (file, sheet, row): the newer import overwrites hash and cells."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return dedupe_latest(both, ["file_name", "sheet_name", "row_number"], ["_v"]).drop("_v")


def import_run(staged: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """The run ledger row (files seen, rows seen, issue count, status)."""
    counts = staged.agg(F.count_distinct("file_name").alias("files_seen"), F.count(F.lit(1)).alias("rows_seen"))
    n_issues = issues.agg(F.count(F.lit(1))).scalar() if issues is not None else F.lit(0).cast("bigint")
    return counts.select("files_seen", "rows_seen", n_issues.alias("issue_count"), F.lit("completed").alias("status"))
