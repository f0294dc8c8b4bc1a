"""Typed questions: single, overview, compare, rank, history and current, always with a reason for what is missing.

Facts have entity, field, number, unit, grp (what makes numbers comparable) and variant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_in_group(facts: DataFrame, group: list[str], entity: str, number: str, direction: str) -> DataFrame:
    """(group, entity, best, rank): each entity's best number in the group, ranked."""
    best = (F.max if direction == "highest" else F.min)(number)
    out = facts.groupBy(*group, entity).agg(best.alias("best"))
    order = F.desc("best") if direction == "highest" else F.asc("best")
    return out.withColumn("rank", F.rank().over(Window.partitionBy(*group).orderBy(order)))


def rank(facts: DataFrame, scope: DataFrame, direction: str, group: list[str], entity: str = "entity", number: str = "number") -> DataFrame:
    """(entity, group, best, rank, winner, coverage) for every entity in scope.

    Groups with fewer than two entities are not comparable; an entity without a number says so.
    """
    per = best_in_group(facts.where(F.col(number).isNotNull()), group, entity, number, direction)
    w = Window.partitionBy(*group)
    per = per.withColumn("_n", F.count("*").over(w))
    first = F.row_number().over(w.orderBy("rank", entity)) == 1
    per = per.withColumns({"winner": first & (F.col("_n") > 1), "rank": F.when(F.col("_n") > 1, F.col("rank"))})
    out = scope.select(entity).distinct().join(per, entity, "left")
    coverage = F.when(F.col("best").isNull(), "no_value").when(F.col("_n") > 1, "ranked").otherwise("not_comparable")
    return out.select(entity, *group, "best", F.col("rank").cast("long").alias("rank"), F.coalesce("winner", F.lit(False)).alias("winner"), coverage.alias("coverage"))


def single(facts: DataFrame, entity_id, fields: list[str]) -> DataFrame:
    return facts.where((F.col("entity") == entity_id) & F.col("field").isin(*fields))


def overview(facts: DataFrame, scope: DataFrame, fields: list[str], each: int = 6) -> DataFrame:
    """(entity, field, facts shown, truncated, has_fact) for every entity and field."""
    asked = scope.select("entity").distinct().withColumn("field", F.explode(F.array(*[F.lit(f) for f in fields])))
    n = facts.where(F.col("field").isin(*fields)).groupBy("entity", "field").agg(F.count("*").alias("_n"))
    out = asked.join(n, ["entity", "field"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return out.select("entity", "field", F.least("_n", F.lit(each)).cast("long").alias("shown"), (F.col("_n") > each).alias("truncated"), (F.col("_n") > 0).alias("has_fact"))


def overview_facts(facts: DataFrame, scope: DataFrame, fields: list[str], order: list[Column], show: list[str], each: int = 6) -> DataFrame:
    """(entity, field, place, show, truncated): the first ``each`` facts of every wanted field of every entity asked for, side by side and without a verdict.

    An entity without a fact in any wanted field has one row with nulls, so that it is named as being
    without. ``each`` is the listing's length; ``truncated`` says where more facts are. Facts of a
    field are cut to ``each`` before they are shuffled, and counted apart.
    """
    wanted = facts.where(F.col("field").isin(fields))
    asked = scope.select("entity").distinct()
    place = F.row_number().over(Window.partitionBy("entity", "field").orderBy(*order))
    shown = wanted.withColumn("place", place).where(F.col("place") <= each).select("entity", "field", "place", *show)
    more = wanted.groupBy("entity", "field").agg((F.count("*") > each).alias("truncated"))
    return asked.join(shown.join(more, ["entity", "field"]), "entity", "left").select("entity", "field", "place", *show, F.coalesce("truncated", F.lit(False)).alias("truncated"))


def best_variants(facts: DataFrame, group: list[str], conditions: list[str], direction: str, entity: str = "entity", number: str = "number") -> DataFrame:
    """(group, entity, best, variants, tied): each entity's best number of a group with the conditions under which it is reached.

    ``variants`` are the distinct conditions of all facts with the best number, in order; ``tied``
    says that there are several. Null numbers are no fact; the best is taken before facts meet it.
    """
    keys = [*group, entity]
    known = facts.where(F.col(number).isNotNull()).select(*keys, *conditions, F.col(number).alias("_n"))
    best = known.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg((F.max if direction == "highest" else F.min)("_n").alias("_best"))
    same = F.col("_n") == F.col("_best")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    reached = known.join(best, same).select(*keys, *conditions, "_best").distinct()
    out = reached.groupBy(*keys).agg(F.first("_best").alias("best"), F.array_sort(F.collect_list(F.struct(*conditions))).alias("variants"))
    return out.withColumn("tied", F.size("variants") > 1)


def comparison_issue(left: str, right: str):
    """First reason why two facts cannot be compared, or null."""
    differ = lambda c: ~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    missing = F.col(f"{left}.number").isNull() | F.col(f"{right}.number").isNull()
    return F.when(missing, "no_number").when(differ("unit"), "unit_differs").when(differ("currency"), "currency_differs").when(differ("basis"), "basis_differs").when(differ("scope"), "scope_differs")


def compare(facts: DataFrame, left, right) -> DataFrame:
    """(field, comparable, reason): a field is comparable when some pair of facts of both entities is.

    Facts are first reduced to their distinct comparison keys, so the pairs are few.
    """
    keys = ["field", "unit", "currency", "basis", "scope"]
    part = lambda e, name: facts.where(F.col("entity") == e).groupBy(*keys).agg(F.max("number").alias("number")).alias(name)
    both = part(left, "l").join(part(right, "r"), F.col("l.field") == F.col("r.field"), "full_outer")
    reason = F.when(F.col("l.field").isNull() | F.col("r.field").isNull(), "missing_side").otherwise(comparison_issue("l", "r"))
    rows = both.select(F.coalesce("l.field", "r.field").alias("field"), reason.alias("reason"))
    ok = F.bool_or(F.col("reason").isNull())
    return rows.groupBy("field").agg(ok.alias("comparable"), F.when(~ok, F.min("reason")).alias("reason"))


def coverage(scope: DataFrame, facts: DataFrame, pending: DataFrame) -> DataFrame:
    """(entity, state): published, awaiting or never."""
    has = facts.select("entity").distinct().withColumn("_f", F.lit(True))
    waits = pending.select("entity").distinct().withColumn("_p", F.lit(True))
    out = scope.select("entity").distinct().join(has, "entity", "left").join(waits, "entity", "left")
    return out.select("entity", F.when(F.col("_f"), "published").when(F.col("_p"), "awaiting").otherwise("never").alias("state"))


def not_found_reason(scope: DataFrame, facts: DataFrame, checked: DataFrame, field: str) -> DataFrame:
    """(entity, reason) of entities without the field: not_stated if it was looked for, else not_extracted."""
    found = facts.where(F.col("field") == field).select("entity").distinct()
    looked = checked.select("entity").distinct().withColumn("_c", F.lit(True))
    missing = scope.select("entity").distinct().join(found, "entity", "left_anti").join(looked, "entity", "left")
    return missing.select("entity", F.when(F.col("_c"), "not_stated_in_source").otherwise("field_not_extracted").alias("reason"))


def change_status(scope: DataFrame, versions: DataFrame, changes: DataFrame, start, end) -> DataFrame:
    """(entity, status): changes_found, unchanged_in_window, first_observation, history_found or unavailable."""
    inside = lambda c: (F.col(c) >= F.lit(start)) & (F.col(c) < F.lit(end))
    v = versions.groupBy("entity").agg(F.count_if(inside("ts")).alias("in_window"), F.count_if(F.col("ts") < F.lit(start)).alias("before"))
    c = changes.where(inside("ts")).groupBy("entity").agg(F.count("*").alias("n_changes"))
    out = scope.select("entity").distinct().join(v, "entity", "left").join(c, "entity", "left")
    n = lambda x: F.coalesce(F.col(x), F.lit(0))
    status = F.when(n("n_changes") > 0, "changes_found").when((n("in_window") > 0) & (n("before") == 0), "first_observation").when(n("in_window") > 0, "unchanged_in_window").when(n("before") > 0, "history_found").otherwise("unavailable")
    return out.select("entity", status.alias("status"), n("n_changes").cast("long").alias("n_changes"))


def plan_requests(requests: DataFrame, rankable: list[str], now) -> DataFrame:
    """(request_id, operation, reject): single and overview follow the number of entities; rank needs one rankable field, a direction and two entities."""
    n = F.size("entities")
    op = F.when(F.col("operation").isin("single", "overview"), F.when(n == 1, "single").otherwise("overview")).otherwise(F.col("operation"))
    bad_rank = (F.size("fields") != 1) | ~F.element_at("fields", 1).isin(*rankable) | F.col("direction").isNull() | (n < 2)
    reject = F.when(F.col("expires_at") < F.lit(now), "expired").when(n < 1, "no_entities").when((F.col("operation") == "rank") & bad_rank, "rank_not_possible").when((F.col("operation") == "compare") & (n != 2), "compare_needs_two")
    return requests.select("request_id", op.alias("operation"), reject.alias("reject"))
