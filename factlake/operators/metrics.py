"""Operational metrics: grouped counts, rates, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, null for no whole."""
    return F.round(part / F.nullif(whole, F.lit(0)), digits)


def outcomes(runs: DataFrame, waits: DataFrame, key: str, by: list[str], seconds: Column) -> DataFrame:
    """Count, mean and longest active seconds by group, net of the children's waiting."""
    total = waits.groupBy(key).agg(F.sum("wait").alias("_wait"))
    net = runs.join(total, key, "left").withColumn("_net", F.greatest(F.lit(0), seconds - F.coalesce("_wait", F.lit(0))))
    return net.groupBy(*by).agg(F.count("*").alias("runs"), F.avg("_net").alias("mean_seconds"), F.max("_net").alias("longest_seconds"))


def counts_by(df: DataFrame, by: dict[str, Column], **aggregates: Column) -> DataFrame:
    return df.groupBy(*[c.alias(n) for n, c in by.items()]).agg(F.count("*").alias("n"), *[c.alias(n) for n, c in aggregates.items()])


def completeness(df: DataFrame, by: str, found: Column) -> DataFrame:
    n = F.count_if(found)
    return df.groupBy(by).agg(F.count("*").alias("n"), n.alias("found"), F.round(100.0 * n / F.count("*"), 2).alias("found_percent"))


def evidence_coverage(parents: DataFrame, children: DataFrame, key: str, child_key: str, by: str) -> DataFrame:
    from factlake.operators.joins import with_existence

    rows = with_existence(parents, children, key, child_key, "_has")
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if("_has").alias("covered"), F.round(F.count_if("_has") / F.count("*"), 4).alias("share"))


def budget_status(df: DataFrame, cost: str, threshold: float) -> DataFrame:
    known = F.coalesce(F.sum(cost), F.lit(0).cast(MONEY))
    status = F.when(known >= threshold, "threshold_reached").when(F.count_if(F.col(cost).isNull()) > 0, "incomplete").otherwise("within_budget")
    return df.agg(known.cast("double").alias("known"), status.alias("status"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def run_rollup(children: DataFrame, run: str, outcome: Column, code: Column) -> DataFrame:
    """(run, status, failure_code): all good is succeeded, some is partial, none is failed, any waiting is awaiting_review; a code only if all failures share it."""
    rows = children.withColumns({"_o": outcome, "_c": F.when(outcome == "failed", code)})
    good, bad, waiting = (F.count_if(F.col("_o") == s) for s in ("succeeded", "failed", "waiting"))
    status = F.when(waiting > 0, "awaiting_review").when(bad == 0, "succeeded").when(good > 0, "partial").otherwise("failed")
    same = F.count_distinct("_c")
    return rows.groupBy(run).agg(status.alias("status"), F.when(bad > 0, F.when(same == 1, F.max("_c")).otherwise("mixed")).alias("failure_code"))


def inverse_frequency(units: DataFrame, unit: str, terms: str) -> DataFrame:
    """(term, weight): ln((N + 1) / (df + 0.5)) over units; N is one aggregate broadcast as a row."""
    n = units.agg(F.count("*").alias("_n"))
    df = units.select(unit, F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.log((F.col("_n") + 1) / (F.col("df") + 0.5)).alias("weight"))


def unit_scores(units: DataFrame, unit: str, terms: str, labels: DataFrame) -> DataFrame:
    """(unit, label, score): sum of positive weights of the label's terms in the unit."""
    # only the labels' terms are counted and shuffled
    n = units.agg(F.count("*").alias("_n"))
    rows = units.select(unit, F.explode(F.array_distinct(terms)).alias("term")).join(labels.select("term").distinct(), "term", "left_semi")
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    weights = labels.join(df, "term").crossJoin(F.broadcast(n)).select("term", "label", F.log((F.col("_n") + 1) / (F.col("df") + 0.5)).alias("weight"))
    rows = rows.join(weights, "term")
    return rows.groupBy(unit, "label").agg(F.sum(F.greatest("weight", F.lit(0.0))).alias("score"))


def ordered_rollup(df: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """Distinct values in the order of their first place."""
    first = df.groupBy(key, value).agg(F.min(order).alias("_o"))
    return first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda s: s[value]), ",").alias(name))


def word_scores(truth: DataFrame, read: DataFrame, key: str) -> DataFrame:
    """(key, precision, recall, f1) of word multisets (key, word).

    Words are counted where they lie; only those of keys that both sides have move, to meet each
    other. Rows without a key are one group, whose words meet none.
    """

    def met(mine: DataFrame, other: DataFrame, n: str) -> DataFrame:
        return mine.join(other.select(key).distinct(), key, "left_semi").groupBy(key, "word").agg(F.count("*").alias(n))

    none = F.lit(0).cast("long")
    n = F.count("*")
    hit = met(truth, read, "a").join(met(read, truth, "b"), [key, "word"]).groupBy(key).agg(F.sum(F.least("a", "b")).alias("hit"))
    parts = hit.select(key, "hit", none.alias("ta"), none.alias("tb"))
    parts = parts.unionByName(truth.groupBy(key).agg(none.alias("hit"), n.alias("ta"), none.alias("tb"))).unionByName(read.groupBy(key).agg(none.alias("hit"), none.alias("ta"), n.alias("tb")))
    sums = parts.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("hit", "ta", "tb")])
    p, r = F.col("hit") / F.nullif("tb", F.lit(0)), F.col("hit") / F.nullif("ta", F.lit(0))
    return sums.select(key, F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * F.col("hit") / (F.col("ta") + F.col("tb")), 6).alias("f1"))


def nearest_rank(df: DataFrame, by: list[str], value: str, percents: list[int]) -> DataFrame:
    """Nearest-rank percentiles: the smallest value with at least that share of rows at or below it."""
    w = Window.partitionBy(*by)
    ranked = df.withColumns({"_r": F.row_number().over(w.orderBy(value)), "_n": F.count("*").over(w)})
    cols = [F.min(F.when(F.col("_r") >= F.ceil(F.col("_n") * p / 100), F.col(value))).alias(f"p{p}") for p in percents]
    return ranked.groupBy(*by).agg(*cols)


def coverage_gaps(children: DataFrame, key: str, number: str, empty: Column) -> DataFrame:
    """(key, populated, pages, empty): distinct numbers with content, the highest number, and rows without content."""
    return children.groupBy(key).agg(F.count_distinct(F.when(~empty, F.col(number))).alias("populated"), F.max(number).cast("long").alias("pages"), F.count_if(empty).alias("empty"))
