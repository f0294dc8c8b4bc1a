"""Projections, filters and keyed reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def scope_filter(df: DataFrame, column: str, values: Sequence | DataFrame) -> DataFrame:
    """Rows whose column is in a list, or in the one column of a table (semi join, for lists too long for a plan)."""
    if isinstance(values, DataFrame):
        return df.join(values.select(F.col(values.columns[0]).alias(column)), column, "left_semi")
    return df.where(F.col(column).isin(*values))


def family_scope(df: DataFrame, column: str, values: Sequence, family_col: str, family) -> DataFrame:
    """Scope filter that takes no row of another family, whatever ids are listed."""
    return scope_filter(df, column, values).where(F.col(family_col) == family)


def time_filter(df: DataFrame, column: str, start=None, end=None, *, closed: bool = False) -> DataFrame:
    """Rows from ``start`` on and before ``end`` (up to it when closed); either bound may be open."""
    if start is not None and end is not None and start > end:
        raise ValueError("the period ends before it starts")
    out = df if start is None else df.where(F.col(column) >= F.lit(start))
    if end is None:
        return out
    return out.where(F.col(column) <= F.lit(end)) if closed else out.where(F.col(column) < F.lit(end))


def bounded(limit: int, most: int) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be 1 to {most}")
    return limit


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """The newest row of each key by a total order; a max over a struct, so hot keys combine before the shuffle."""
    newest = F.max(F.struct(*order, *[c for c in payload if c not in order])).alias("_newest")
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_newest.{c}").alias(c) for c in dict.fromkeys([*order, *payload])])


def latest_before(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, right_id: str, payload: list[str]) -> DataFrame:
    """As-of join: for each left row the newest right row of its key strictly before it.

    Both sides are one sorted stream per key and the last right row is carried on, so no pair of
    rows is made.
    """
    carried = F.struct(F.col(right_ts).alias("ts"), F.col(right_id).alias("id"), *[F.col(c).alias(f"p_{c}") for c in payload])
    r = right.select(F.col(key).alias("_k"), F.col(right_ts).alias("_t"), F.lit(1).alias("_side"), F.col(right_id).cast("long").alias("_tie"), carried.alias("_right"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_left"))
    as_right = r.schema["_right"].dataType
    row = left.select(F.col(key).alias("_k"), F.col(left_ts).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_tie"), F.lit(None).cast(as_right).alias("_right"), F.struct(*left.columns).alias("_left"))
    # at equal times the left row comes first: before is strict
    w = Window.partitionBy("_k").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    out = row.unionByName(r).withColumn("_found", F.last("_right", ignorenulls=True).over(w)).where("_left is not null")
    return out.select(*[F.col(f"_left.{c}").alias(c) for c in left.columns], F.col("_found.id").alias(f"prev_{right_id}"), *[F.col(f"_found.p_{c}").alias(f"prev_{c}") for c in payload])


def history(df: DataFrame, ts: str, tie: str, start, end, limit: int) -> DataFrame:
    """Newest rows of a period first, at most ``limit``."""
    return time_filter(df, ts, start, end).orderBy(F.desc(ts), F.desc(tie)).limit(limit)


def has_newer(df: DataFrame, other: DataFrame, key: str, ts: str, other_ts: str) -> DataFrame:
    """Adds has_newer: whether the key has a row in ``other`` after this row's time."""
    last = other.groupBy(key).agg(F.max(other_ts).alias("_last"))
    return df.join(last, key, "left").withColumn("has_newer", F.coalesce(F.col("_last") > F.col(ts), F.lit(False))).drop("_last")


def entity_states(entities: DataFrame, key: str, pending: DataFrame, latest: DataFrame, accepted: DataFrame) -> DataFrame:
    """(key, pending, state): awaiting_review, never_monitored, run_failed, no_accepted_data or accepted."""
    waiting = pending.groupBy(key).agg(F.count("*").alias("pending"))
    out = entities.select(key).join(waiting, key, "left").join(latest.select(key, "last_status"), key, "left").join(accepted.select(key).distinct().withColumn("_accepted", F.lit(True)), key, "left")
    state = F.when(F.coalesce("pending", F.lit(0)) > 0, "awaiting_review").when(F.col("_accepted"), "accepted").when(F.col("last_status").isNull(), "never_monitored").when(F.col("last_status") == "failed", "run_failed").otherwise("no_accepted_data")
    return out.select(key, F.coalesce("pending", F.lit(0)).cast("long").alias("pending"), state.alias("state"))


def freshness(entities: DataFrame, versions: DataFrame, key: str, ts: str, now, days: int) -> DataFrame:
    """(key, status fresh / stale / missing, age_seconds) for every entity."""
    last = versions.groupBy(key).agg(F.max(ts).alias("_last"))
    age = F.greatest(F.lit(0), F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("_last"))
    status = F.when(F.col("_last").isNull(), "missing").when(age <= days * 86400, "fresh").otherwise("stale")
    return entities.select(key).join(last, key, "left").select(key, status.alias("status"), F.when(F.col("_last").isNotNull(), age).cast("long").alias("age_seconds"))


def reusable(df: DataFrame, ts: str, now, hours: int, partial: Column) -> DataFrame:
    """Rows young enough to be used again: not from the future, not partial."""
    now = F.lit(now).cast("timestamp")
    return df.where((F.col(ts) <= now) & (F.col(ts) >= now - F.expr(f"interval {hours} hours")) & ~partial)


def condition_match(df: DataFrame, *, currency: str | None = None, basis: str | None = None, scope: str | None = None) -> DataFrame:
    """Rows that fit the asked conditions: a row without a currency stays, one of another currency goes."""
    out = df if currency is None else df.where(F.col("currency").isNull() | (F.col("currency") == currency))
    out = out if basis is None else out.where(F.col("basis") == basis)
    return out if scope is None else out.where(F.col("scope") == scope)


def differs(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose column is null or another value."""
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def listing(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(bounded(limit, 500))


def stale_leases(df: DataFrame, heartbeat: str, claimed: str, cutoff) -> DataFrame:
    """Rows whose last sign of life is before the cutoff."""
    return df.where(F.coalesce(heartbeat, claimed) < F.lit(cutoff).cast("timestamp"))


def prefix_match(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.where(F.col(column).startswith(prefix))


def first_submission(df: DataFrame, key: Sequence[str], order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """The first row of each idempotency key and how many repeats it absorbed."""
    first = F.min(F.struct(*order, *payload)).alias("_first")
    return df.groupBy(*key).agg(first, (F.count("*") - 1).alias("repeats")).select(*key, *[F.col(f"_first.{c}").alias(c) for c in (*order, *payload)], "repeats")


def reader_projection(df: DataFrame, citations: str, quote: str, most: int = 3, width: int = 300) -> DataFrame:
    """Citations as at most ``most`` distinct ones in order, quotes cut to ``width``."""
    return df.withColumn(citations, F.slice(F.array_distinct(F.col(citations)), 1, most)).withColumn(quote, F.substring(quote, 1, width))


def citation_list(facts: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """One row per fact and citation, in order within the fact."""
    w = Window.partitionBy(key).orderBy("evidence_order")
    return facts.join(evidence, key).withColumn("position", F.row_number().over(w) - 1)


def fact_line(*parts: Column) -> Column:
    """Deterministic display text of the parts that are present."""
    return F.concat_ws(" | ", *parts)


def traced(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """(stage, n): rows left after each filter, all observed in one pass over the data."""
    seen = []
    for name, condition in steps:
        watch = Observation(name)
        df = df.where(condition).observe(watch, F.count(F.lit(1)).alias("n"))
        seen.append((name, watch))
    df.write.format("noop").mode("overwrite").save()
    return df.sparkSession.createDataFrame([(name, watch.get["n"]) for name, watch in seen], "stage string, n long")
