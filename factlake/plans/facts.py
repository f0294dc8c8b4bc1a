"""Typed facts from wide rows, and units for retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facts_from(df: DataFrame, key: list[str], fields: dict[str, Column]) -> DataFrame:
    """(key, field, number): one row for each number that is there."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), c.cast("decimal(18,2)").alias("number")) for n, c in fields.items()]))
    return df.select(*key, pairs.alias("_f")).select(*key, "_f.*").where("number is not null")


def inferred_currency(facts: DataFrame, entity: str, currency: str) -> DataFrame:
    """Facts without a currency take the entity's only one, marked as inferred."""
    only = facts.where(F.col(currency).isNotNull()).groupBy(entity).agg(F.min(currency).alias("_lo"), F.max(currency).alias("_hi"))
    out = facts.join(only.where("_lo = _hi"), entity, "left")
    missing = F.col(currency).isNull() & F.col("_lo").isNotNull()
    return out.withColumn("inferred", missing).withColumn(currency, F.coalesce(currency, "_lo")).drop("_lo", "_hi")


def narrowed_citations(facts: DataFrame, citations: DataFrame, key: str) -> DataFrame:
    """Citations of the best kind a fact has: by label (1), else by number (2), else all (3)."""
    best = citations.groupBy(key).agg(F.min("kind").alias("_best"))
    return facts.select(key).distinct().join(citations, key).join(best, key).where("kind = _best").drop("_best")


def profile_units(df: DataFrame, entity: str, name: str, detail: str) -> DataFrame:
    """(entity, identity_text, detail_text): one unit per entity, details sorted."""
    details = F.array_join(F.array_sort(F.collect_set(detail)), "; ")
    return df.groupBy(entity).agg(F.min(name).alias("identity_text"), details.alias("detail_text"))


def review_tasks(signals: DataFrame, scope: str, reason: str) -> DataFrame:
    """(task_id, scope, reason): one task per scope and reason, with a deterministic id."""
    rows = signals.select(scope, reason).distinct()
    return rows.withColumn("task_id", F.substring(F.sha2(F.concat_ws(":", F.col(scope).cast("string"), reason), 256), 1, 32))
