"""A small document store over DataFrames: filters, projections, sorts, and copy-on-write mutations.

Mutations return the new snapshot; ``commit`` writes it beside the old one, so readers of the old one aren't disturbed.
"""

from __future__ import annotations

from typing import Any

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window


def predicate(df: DataFrame, query: dict[str, Any]) -> Column:
    """Conjunction of equalities; ``{"$ne": v}`` also passes missing fields and nulls; other operators match nothing."""
    out = F.lit(True)
    for field, value in query.items():
        there = field in df.columns
        if isinstance(value, dict):
            if set(value) == {"$ne"}:
                out &= ~F.col(field).eqNullSafe(F.lit(value["$ne"])) if there else F.lit(value["$ne"] is not None)
            else:
                out &= F.lit(False)
        else:
            out &= F.col(field).eqNullSafe(F.lit(value)) if there else F.lit(value is None)
    return out


def find(df: DataFrame, query: dict[str, Any] | None = None, fields: list[str] | None = None, key: str = "id", sort: tuple[str, int] | None = None, limit: int | None = None) -> DataFrame:
    """Filter, project (the key is always kept, missing fields are null), sort (missing counts as empty, ties by key), limit."""
    out = df.where(predicate(df, query or {}))
    if sort:
        field, way = sort
        value = F.coalesce(F.col(field).cast("string"), F.lit("")) if dict(df.dtypes)[field] == "string" else F.col(field)
        out = out.orderBy(value.desc_nulls_last() if way < 0 else value.asc_nulls_first(), F.col(key))
    if limit is not None:
        out = out.limit(limit)
    if fields:
        out = out.select(key, *[F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields if f != key])
    return out


def upsert(df: DataFrame, changes: DataFrame, keys: list[str], add: tuple[str, ...] = ()) -> DataFrame:
    """A snapshot with ``changes`` merged on ``keys``: their values win where not null, ``add`` columns are summed.

    One full outer join on the keys; several changes of one key must be folded by the caller first.
    """
    both = df.alias("a").join(changes.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    out = []
    for c in df.columns:
        if c in keys:
            out.append(F.coalesce(f"a.{c}", f"b.{c}").alias(c))
        elif c not in changes.columns:
            out.append(F.col(f"a.{c}"))
        elif c in add:
            out.append((F.coalesce(f"a.{c}", F.lit(0)) + F.coalesce(f"b.{c}", F.lit(0))).alias(c))
        else:
            out.append(F.coalesce(f"b.{c}", f"a.{c}").alias(c))
    return both.select(*out)


def delete(df: DataFrame, query: dict[str, Any]) -> DataFrame:
    """A snapshot without the rows that match."""
    return df.where(~predicate(df, query))


def keep_first(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__k = 1").drop("__k")


def append_new(df: DataFrame, new: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """``df`` and those rows of ``new`` whose key it lacks, the first of each key."""
    fresh = keep_first(new.withColumn("__key", key), F.col("__key"), order)
    held = df.select(key.alias("__key")).distinct()
    return df.unionByName(fresh.join(held, "__key", "left_anti").drop("__key"))


def numbered(df: DataFrame, prefix: str, order: list[str], width: int = 4) -> DataFrame:
    """Running ids in a global order, without pulling all rows into one task: counts of range partitions are summed first."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__m").alias("__first"))
    starts = sizes.withColumn("__start", F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)))
    number = F.coalesce("__start", F.lit(0)) + F.col("__m") - F.col("__first")
    return ranged.join(F.broadcast(starts.select("__p", "__start", "__first")), "__p").withColumn("id", F.format_string(f"{prefix}-%0{width}d", number)).drop("__p", "__m", "__start", "__first")
