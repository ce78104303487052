"""Driver table access: lazy parquet readers (scan pruning/pushdown left to Catalyst)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


FILE_STEP = 1 << 40  # rows that a file may hold before its numbers reach the next file's


def with_row_numbers(df: DataFrame, out: str) -> DataFrame:
    """A freshly read Parquet table with a unique long `out`: 1, 2, ... in the order of the first file, the next file (by
    name) from FILE_STEP on.  The reader itself gives the place in a file, so no row is moved or sorted to number it,
    repeated rows get numbers of their own, and the column costs nothing where it is not used."""
    files = sorted(df.inputFiles())
    at = F.col("_metadata.row_index") + 1
    if len(files) < 2:
        return df.withColumn(out, at.cast("bigint"))
    # The list of files is as long as the driver's listing of them: shipped to the tasks, so that no row moves to meet it.
    # A URI's root may be spelled in several ways; every spelling is listed, and a row's path is compared as it is.
    spelled = lambda f: {f, *[re.sub("^([A-Za-z0-9+.-]+):/+", rf"\1:{s}", f) for s in ("/", "//", "///")]}
    order = df.sparkSession.createDataFrame([(p, i * FILE_STEP) for i, f in enumerate(files) for p in sorted(spelled(f))],
                                            "_file string, _base bigint")
    cols = df.columns
    placed = df.withColumn(out, at).withColumn("_file", F.col("_metadata.file_path"))
    return placed.join(F.broadcast(order), "_file").select(*cols, (F.col("_base") + F.col(out)).cast("bigint").alias(out))


class Tables:
    """`Tables(spark, sf_dir).lineitem` -> DataFrame over `<sf_dir>/lineitem.parquet`."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self._cache:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            self._cache[name] = with_row_numbers(df, "l_row") if name == "lineitem" else df
        return self._cache[name]

    def numbered(self, name: str, out: str = "file_row") -> DataFrame:
        """The table with each row's place in its files."""
        return with_row_numbers(self.spark.read.parquet(self.path(name)), out)

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"
