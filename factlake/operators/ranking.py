"""Orders, ranks and top rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.sources.shared import shared_folder


def directed(df: DataFrame, column: str, direction: str, tie: str) -> DataFrame:
    """Lowest or highest first, ties by id; nulls last."""
    if direction not in ("lowest", "highest"):
        raise ValueError("direction is lowest or highest")
    return df.orderBy(F.asc_nulls_last(column) if direction == "lowest" else F.desc_nulls_last(column), tie)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """First ``most`` rows of each group (the rank limit is applied before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def merged_top(df: DataFrame, keys: list[str], order: list[Column], each: int, limit: int) -> DataFrame:
    """First rows of the merged first rows of each group."""
    return top_per_group(df, keys, order, each).orderBy(*order).limit(limit)


def priority(column: Column, order: list[str]) -> Column:
    """Place in an explicit order, from 1; values that are not in it come behind."""
    at = F.array_position(F.lit(order), column)
    return F.when(at == 0, len(order) + 1).otherwise(at).cast("int")


def lowest_rank(df: DataFrame, keys: list[str], rank: str, tie: str) -> DataFrame:
    best = F.min(F.struct(rank, tie)).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, F.col(f"_b.{rank}").alias(rank), F.col(f"_b.{tie}").alias(tie))


def capped(df: DataFrame, keys: list[str], order: list[str], each: int, total: int) -> DataFrame:
    """At most ``each`` rows of a group and ``total`` overall, with whether the group was cut."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_rn", F.row_number().over(w.orderBy(*order))).withColumn("truncated", F.count("*").over(w) > each)
    return ranked.where(F.col("_rn") <= each).orderBy(*keys, *order).limit(total).drop("_rn")


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the place of each row in the order of the whole table, from 1.

    Rows are sorted into ranges and written to the shared folder with the number of their range, so
    that later steps see the same ranges; ranges are numbered apart, behind the counts of those before.
    """
    spark, at = df.sparkSession, f"{shared_folder(df.sparkSession)}/ranges-{uuid.uuid4().hex}"
    df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(at)
    rows = spark.read.parquet(at)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    # one row for each range
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    return rows.join(F.broadcast(before), "_range").withColumn(name, place.cast("long")).drop("_range", "_before")


def reciprocal_ranks(lists: list[tuple[DataFrame, str, str, float]], k: int = 60, most: int | None = None) -> DataFrame:
    """(id, score): weighted sum of 1 / (k + rank) over ranked lists (table, id, score column, weight); ties by id.

    ``most`` is for reports of the top of short lists: each task keeps its best so many rows, and only they
    are numbered. Left out, every rank of every list counts.
    """
    parts = []
    for df, key, score, weight in lists:
        rows = df.select(F.col(key).alias("id"), F.col(score).alias("_s"))
        order = [F.desc("_s"), F.asc("id")]
        ranked = numbered(rows, order, "_rank") if most is None else rows.orderBy(*order).limit(most).withColumn("_rank", F.row_number().over(Window.orderBy(*order)))
        parts.append(ranked.select("id", (F.lit(weight) / (F.lit(k) + F.col("_rank"))).alias("part")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id").agg(F.sum("part").alias("score"))
