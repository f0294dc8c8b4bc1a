"""Expectations, consistency and review signals, each as rows that say what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(table: str, df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(tbl, rule, key) of rows that break a rule; an unknown outcome breaks it. One scan for all rules."""
    broken = F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()])
    return df.select(F.lit(table).alias("tbl"), F.explode(F.array_compact(broken)).alias("rule"), F.col(key).cast("string").alias("key"))


def tri_state(status: Column, value: Column, evidence: Column) -> Column:
    """found has a value and evidence, not_stated neither, others evidence."""
    return F.when(status == "found", value.isNotNull() & (evidence > 0)).when(status == "not_stated", value.isNull() & (evidence == 0)).otherwise(evidence > 0)


def cardinality(expected: DataFrame, received: DataFrame, key: str) -> DataFrame:
    """(key, received, verdict): missing, ok, duplicate, or unexpected."""
    got = received.groupBy(key).agg(F.count("*").alias("n"))
    out = expected.select(key).distinct().withColumn("_e", F.lit(True)).join(got, key, "full_outer")
    verdict = F.when(F.col("_e").isNull(), "unexpected").when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "ok").otherwise("duplicate")
    return out.select(key, F.coalesce("n", F.lit(0)).alias("received"), verdict.alias("verdict"))


def ungrounded(numbers: Column, quote: Column) -> Column:
    """Whether some number text is none of the quote's own: 5 is not in 15. Readings of numbers are in ``functions.readings``."""
    return F.size(F.array_except(numbers, F.regexp_extract_all(quote, F.lit(r"(\d+)"), 1))) > 0


def alternatives(df: DataFrame, conditions: list[str], value: str) -> DataFrame:
    """Conditions under which several values are given."""
    return df.groupBy(*conditions).agg(F.count_distinct(value).alias("values")).where("values > 1")


def first_rule(df: DataFrame, rules: list[tuple[str, Column]], otherwise: str) -> DataFrame:
    """Adds label: the first rule that holds."""
    label = F.lit(otherwise)
    for name, rule in reversed(rules):
        label = F.when(rule, name).otherwise(label)
    return df.withColumn("label", label)


def signals(df: DataFrame, scope: list[str], rules: list[tuple[str, Column]]) -> DataFrame:
    """(scope, reason) once each, by the first reason that holds for a row."""
    reason = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        reason = F.when(rule, name).otherwise(reason)
    return df.select(*scope, reason.alias("reason")).where("reason is not null").distinct()


def reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with some reason, and all their reasons in order."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return df.withColumn("reasons", F.array_join(found, ",")).where(F.col("reasons") != "")


def page_key(url: Column) -> Column:
    """A page's address without trailing slashes, whatever its case."""
    return F.lower(F.rtrim(url, F.lit("/")))


def canonical_citations(results: DataFrame, citations: DataFrame, evidence: DataFrame, canonical: DataFrame) -> DataFrame:
    """(result, candidates, cited, anchored) for every result of (result, batch).

    A result of a batch must cite at least one of the batch's passages that stand on its canonical
    page, if there are any; a batch without a canonical page or without passages on it asks for none.
    ``citations`` are (result, evidence_id), ``evidence`` (batch, evidence_id, url), ``canonical``
    (batch, url). Repeated rows count once; passages are counted per batch before results meet them.
    """
    own = canonical.where("url is not null").select("batch", page_key(F.col("url")).alias("_page")).distinct()
    on_page = evidence.where("evidence_id is not null").select("batch", "evidence_id", page_key(F.col("url")).alias("_page")).join(own, ["batch", "_page"], "left_semi").select("batch", "evidence_id").distinct()
    held = on_page.groupBy("batch").agg(F.count("*").alias("candidates"))
    wanted = results.select("result", "batch").distinct()
    cited = wanted.join(citations.select("result", "evidence_id").distinct(), "result").join(on_page, ["batch", "evidence_id"], "left_semi").groupBy("result", "batch").agg(F.count("*").alias("cited"))
    out = wanted.join(held, "batch", "left").join(cited, ["result", "batch"], "left").na.fill(0, ["candidates", "cited"])
    return out.select("result", "batch", "candidates", "cited", ((F.col("candidates") == 0) | (F.col("cited") > 0)).alias("anchored"))
