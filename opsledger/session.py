"""Session helpers: a configured local session for tests/bench, and the shared checkpoint folder."""

from __future__ import annotations

import gc
import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "opsledger") -> SparkSession:
    """Local session as used by tests and the bench (UI off, AQE on, UTC)."""
    return (SparkSession.builder.master(f"local[{cores}]").appName(app)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", os.environ.get("OPSLEDGER_DRIVER_MEMORY", "16g"))
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .getOrCreate())


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (`spark.checkpoint.dir`).

    Only a local session that names none gets a private scratch folder; a cluster without one is an error."""
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if conf:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(str(conf))
        return str(conf)
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="opsledger-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that have ended: it does so once nothing refers to their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


SHUFFLE_STEP, SHUFFLE_MOST = 4 << 20, 8 << 20  # bytes of input per shuffle partition, and bytes that partitions are merged to


@contextmanager
def shuffles_for(spark: SparkSession, size: int) -> Iterator[None]:
    """Shuffle partitions by the bytes of the input, for the jobs run inside: with a fixed number, or merged until there is one
    for every core, a task's rows grow with the tables, and its sorts spill once they outgrow its memory."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(max(least, -(-size // SHUFFLE_STEP))),
              "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(SHUFFLE_MOST)}
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
