"""Session settings and the few helpers that every operator shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build(master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "8g", app: str = "colloquy") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, pass your own session to the operators instead."""
    builder = SparkSession.builder.master(master).appName(app).config("spark.driver.memory", memory)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).getOrCreate()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the cluster's shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, a temporary one if the whole session is one
    process on one machine, as in tests; on a cluster an error, as executors don't share their temporary folders."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master or ""
    if master == "local" or master.startswith("local["):
        return os.path.join(tempfile.gettempdir(), f"colloquy-{uuid.uuid4().hex}")
    raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Repartitions inputs that arrive in fewer pieces than the cluster has cores, and leaves the rest alone.

    Python-bound stages need all cores, and one small Parquet file is one task; a large table has more splits than
    cores already, so nothing is shuffled at scale.
    """
    wanted = least or 2 * cores(df.sparkSession)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted // 2 else df
