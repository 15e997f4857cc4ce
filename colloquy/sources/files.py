"""File sources: JSON lines with bad lines skipped, JSON arrays, peeks, manifests and fallback chains."""

from __future__ import annotations

import os

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Records of a JSON lines file; blank and malformed lines are skipped, unknown fields ignored, missing ones null."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    parsed = lines.select(F.from_json("value", f"{ddl}, `__bad` string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"))
    return parsed.where("r is not null and r.`__bad` is null").select("r.*").drop("__bad")


def json_array(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Records of files that each hold one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def peek(spark: SparkSession, path: str, n: int = 3) -> list[str]:
    """The first ``n`` lines, blank ones counted but left out; n is held between 1 and 50."""
    return [r["value"] for r in spark.read.text(path).limit(max(1, min(50, n))).collect() if r["value"].strip()]


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.trim("value") != "").count()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, records) of a manifest file."""
    return spark.read.option("multiLine", True).schema("files array<struct<name:string,path:string,records:bigint>>").json(path).select(F.explode("files").alias("f")).select("f.*")


def audited(spark: SparkSession, path: str, root: str) -> DataFrame:
    """(name, records, found): the manifest's counts beside those of the files; null where a file is missing."""
    rows = manifest(spark, path).collect()  # a manifest lists files, not records
    found = [(r["name"], r["records"], count_lines(spark, p) if os.path.exists(p := os.path.join(root, r["path"])) else None) for r in rows]
    return spark.createDataFrame(found, "name string, records bigint, found bigint")


def first_of(*readers) -> DataFrame:
    """The first source that can be read and holds a row; each reader is a function without arguments."""
    last: Exception | None = None
    for read in readers:
        try:
            df = read()
            if not df.isEmpty():
                return df
        except Exception as e:  # noqa: BLE001  # a missing source is expected here
            last = e
    raise FileNotFoundError("no source could be read") from last


def sessions_of(turns: DataFrame) -> DataFrame:
    """(session_id, specialty, turns): a flat turn log regrouped into sessions in event order.

    A session's array is built from partial sorted runs; sessions are bounded by what one conversation holds. Feeds that
    write endless sessions (kiosks) should be cut by ``windows_of`` first.
    """
    key = F.struct("logged_at", "turn_id", "role", "text")
    return turns.groupBy("session_id").agg(F.max_by("specialty", F.struct("logged_at", "turn_id")).alias("specialty"), F.transform(F.array_sort(F.collect_list(key)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def windows_of(turns: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Turns with their sessions cut wherever nothing was said for ``gap``: session_id gets a running number."""
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("logged_at", "turn_id")
    new = (F.lag("logged_at").over(w).isNull() | (F.col("logged_at") > F.lag("logged_at").over(w) + F.expr(f"interval {gap}"))).cast("int")
    return turns.withColumn("__new", new).withColumn("session_id", F.concat_ws("#", "session_id", F.sum("__new").over(w).cast("string"))).drop("__new")
