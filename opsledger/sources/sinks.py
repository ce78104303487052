"""Publish marts and the issue table for readers.

Each run writes its tables under `<root>/run=<run_id>/<table>` (partitioned where readers
filter), then writes the run ledger row last as the commit marker (S7).  Readers take the
latest run that has a ledger row (S8), so a run that dies half-way is never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def publish(tables: dict[str, tuple[DataFrame, list[str]]], root: str, run_id: str, ledger: DataFrame) -> str:
    """Write every (df, partition_cols) under root/run=<run_id>/<name>, then the ledger row."""
    base = f"{root.rstrip('/')}/run={run_id}"
    for name, (df, parts) in tables.items():
        w = df.write.mode("overwrite")
        if parts:
            w = w.partitionBy(*parts)
        w.parquet(f"{base}/{name}")
    ledger.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").parquet(f"{base}/_ledger")
    return base


def latest_completed_run(spark: SparkSession, root: str) -> str | None:
    """The newest run directory whose ledger row says 'completed'; numeric run ids compare as numbers."""
    try:
        ledgers = spark.read.parquet(f"{root.rstrip('/')}/run=*/_ledger")
    except Exception:  # noqa: BLE001 - nothing published yet
        return None
    row = ledgers.where(F.col("status") == "completed").agg(
        F.max(F.struct(F.expr("try_cast(run_id AS DECIMAL(38, 0))").alias("n"), F.col("run_id").cast("string").alias("r"))).alias("m")).first()
    return row["m"]["r"] if row and row["m"] else None


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    run = latest_completed_run(spark, root)
    return None if run is None else spark.read.parquet(f"{root.rstrip('/')}/run={run}/{name}")
