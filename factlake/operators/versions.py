"""Versions of entities: order, lag, change sets, replacement and supersession."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Adds prev_<column> of the version before of the same key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})


def ranked_versions(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def occurrence(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds occurrence: the number of equal rows before, from 0."""
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def without_repeats(df: DataFrame, key: str, order: list[str], compared: list[str]) -> DataFrame:
    """Rows that differ from the row before in their key."""
    w = Window.partitionBy(key).orderBy(*order)
    seen = F.struct(*compared)
    return df.withColumns({"_before": F.lag(seen).over(w), "_at": F.row_number().over(w)}).where((F.col("_at") == 1) | ~F.col("_before").eqNullSafe(seen)).drop("_before", "_at")


def carried(df: DataFrame, key: str, order: list[str], column: str, name: str) -> DataFrame:
    """Adds the last value of ``column`` that is not null up to this row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(column, ignorenulls=True).over(w))


def change_set(df: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """(key, order, field, previous, current) of changed fields; a first version changes nothing."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumns({**{f"_p_{f}": F.lag(f).over(w) for f in fields}, "_n": F.row_number().over(w)}).where("_n > 1")
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_p_{f}").cast("string").alias("previous"), F.col(f).cast("string").alias("current")) for f in fields]))
    out = rows.select(key, *order, pairs.alias("_c")).select(key, *order, "_c.*")
    return out.where(~F.col("previous").eqNullSafe(F.col("current")))


def provenance_only(df: DataFrame, key: str, order: list[str], content: str, evidence: str) -> DataFrame:
    """Versions with the content of the one before and other evidence."""
    rows = with_previous(df, key, order, [content, evidence])
    return rows.where((F.col(content) == F.col(f"prev_{content}")) & (F.col(evidence) != F.col(f"prev_{evidence}")))


def lost(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Keys found before and not now."""
    return before.select(*keys).distinct().join(now.select(*keys).distinct(), keys, "left_anti")


def replacement(active: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, action): keep, activate or retire, for making the new set the active one."""
    a = active.select(key).distinct().withColumn("_a", F.lit(1))
    b = new.select(key).distinct().withColumn("_b", F.lit(1))
    action = F.when(F.col("_a").isNull(), "activate").when(F.col("_b").isNull(), "retire").otherwise("keep")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def discardable(rows: DataFrame, published: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows that neither set refers to."""
    return rows.join(published.select(key), key, "left_anti").join(other.select(key), key, "left_anti")


def supersede(pending: DataFrame, key: str, parent: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(pending rows with superseded flag, parents left with none pending)."""
    w = Window.partitionBy(key)
    rows = pending.withColumn("superseded", F.struct(*order) < F.max(F.struct(*order)).over(w))
    closed = rows.groupBy(parent).agg(F.bool_and("superseded").alias("_all")).where("_all").select(parent)
    return rows, closed


def active_versions(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds is_active: whether this is the newest version of its key."""
    newest = F.max(F.struct(*order)).over(Window.partitionBy(key))
    return df.withColumn("is_active", F.struct(*order) == newest)


def upsert(stored: DataFrame, arriving: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write wins by ``order``; of equal writes the arriving one."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(arriving.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order], F.desc("_new"))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def insert_if_absent(stored: DataFrame, arriving: DataFrame, keys: list[str]) -> DataFrame:
    """Arriving rows whose key is not stored, one per key."""
    return arriving.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def distinct_in_order(df: DataFrame, keys: list[str], order: str, normalized: Column | None = None) -> DataFrame:
    """First row of each (normalised) value within its key."""
    w = Window.partitionBy(*keys, *([normalized] if normalized is not None else [])).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def line_diff(before: DataFrame, after: DataFrame, key: str, text: str) -> DataFrame:
    """(key, added, removed, kept): lines of two versions, equal lines told apart by their number of occurrence."""

    def numbered(df: DataFrame, mark: str) -> DataFrame:
        lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("_at", "_line")).withColumn("_h", F.xxhash64("_line"))
        n = F.row_number().over(Window.partitionBy(key, "_h").orderBy("_at"))
        return lines.select(key, "_h", n.alias("_n"), F.lit(1).alias(mark))

    both = numbered(before, "_a").join(numbered(after, "_b"), [key, "_h", "_n"], "full_outer")
    return both.groupBy(key).agg(F.count_if(F.col("_a").isNull()).alias("added"), F.count_if(F.col("_b").isNull()).alias("removed"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("kept"))
