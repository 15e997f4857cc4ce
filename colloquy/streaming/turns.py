"""Structured Streaming over turn logs and events: sources, windows, deduplication, keyed state, upserting sinks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from colloquy.session import shared_folder

def stream(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table's files as a stream; timestamps without a zone are read as UTC, as watermarks need one."""
    path = f"{directory}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    df = spark.readStream.schema(schema).parquet(path if os.path.isdir(path) else f"{directory}/{name}*.parquet")
    return df.select(*[F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in schema])


def work_folder(spark: SparkSession) -> str:
    """A fresh folder for checkpoints and results: the cluster's shared one where it names one."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def drained(df: DataFrame, mode: str, key: list[str] | None = None, order: str | None = None) -> DataFrame:
    """What a stream has said once all available input is read, as a table in the shared folder.

    Complete mode keeps the last batch; update mode the last row of each key by ``order``; append mode all rows.
    """
    spark = df.sparkSession
    folder = work_folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        target = f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    out = spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    if key and order:
        out = out.groupBy(*key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in key]), order).alias("x")).select(*key, "x.*")
    return out


def tumbling(events: DataFrame, size: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "user_id", "n")


def deduplicated(turns: DataFrame, late: str = "8 days") -> DataFrame:
    """Each turn once, whenever its copies arrive within ``late`` of each other."""
    return turns.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["turn_id"])


def counted(turns: DataFrame) -> DataFrame:
    """Keyed state: for each session the number of turns, the latest turn and its role so far."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, last, role = state.get if state.exists else (0, None, None)
        last = pd.Timestamp(last) if last is not None else None
        for pdf in batches:
            n += len(pdf)
            top = pdf.sort_values(["logged_at", "turn_id"]).iloc[-1]
            if last is None or top["logged_at"] >= last:
                last, role = top["logged_at"], top["role"]
        state.update((n, str(last), role))
        yield pd.DataFrame({"session_id": [key[0]], "n": [n], "last_role": [role]})

    return turns.groupBy("session_id").applyInPandasWithState(step, "session_id string, n long, last_role string", "n long, last string, role string", "update", "NoTimeout")


def upserting(target: str, keys: list[str], add: tuple[str, ...] = ()) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that merges each batch into a snapshot table: snapshot k+1 is written beside k, then k goes."""
    from colloquy.operators.store import upsert

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old, new = f"{target}/v={number - 1}", f"{target}/v={number}"
        path = spark._jvm.org.apache.hadoop.fs.Path(old)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        there = files.exists(path)
        (upsert(spark.read.parquet(old), batch, keys, add) if there else batch).write.mode("overwrite").parquet(new)
        if there:
            files.delete(path, True)

    return write
