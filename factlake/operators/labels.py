"""Labels of items and their members: settled against quotes and dates, handed down to members, and chosen for each source.

Items are (item, scope, authority, role, relevance, temporal, evidence, title, periods), periods an array
of (raw, starts, ends). Members are (item, member, text); exceptions are (item, member, association, relevance).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.functions.text import collapsed
from factlake.functions.values import period_status

# fixed values: statuses that put an item outside today's terms, and what their members are then
OUTSIDE = {"possibly_stale": "historical_version", "future": "future_version"}
_OF_PERIODS = {"current": "current", "historical": "possibly_stale", "future": "future", "time_bounded": "time_bounded"}
SCOPES_OF_THEIR_OWN = ("block", "table")


def _dates(text: Column) -> Column:
    """The day.month.year dates of a text; two-digit years are 20xx, impossible dates are none."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b(\d{1,2}[./-]\d{1,2}[./-](?:\d{4}|\d{2}))\b"), 1)

    def day(x: Column) -> Column:
        d = F.split(x, "[./-]")
        year = F.when(F.char_length(F.get(d, 2)) == 2, F.concat(F.lit("20"), F.get(d, 2))).otherwise(F.get(d, 2))
        return F.try_to_date(F.concat_ws("-", year, F.lpad(F.get(d, 1), 2, "0"), F.lpad(F.get(d, 0), 2, "0")), "yyyy-MM-dd")

    return F.array_compact(F.transform(parts, day))


def _outside(c: str) -> Column:
    return F.col(c).isin(*OUTSIDE)


def settle_temporal(items: DataFrame, members: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """The items with their settled temporal status and ``moved``, and the exceptions that their members get by it.

    A status outside today's terms needs a quote that the item itself holds and whose dates do not say
    otherwise; dated periods decide whatever the status was. Where only some members, fewer than half,
    carry the dates or the quote, the item's status is unknown and these members become exceptions.
    Members are met with their item once and counted before they move, so an item may have any number.
    """
    markers = F.filter(F.transform(F.concat(F.transform(F.coalesce("periods", F.array().cast("array<struct<raw:string,starts:date,ends:date>>")), lambda p: p["raw"]), F.array("evidence")), lambda x: collapsed(F.coalesce(x, F.lit("")))), lambda x: x != "")
    known = items.select("item", markers.alias("_markers"), collapsed(F.coalesce("evidence", F.lit(""))).alias("_quote"))
    read = members.join(known, "item").withColumn("_text", collapsed(F.coalesce("text", F.lit(""))))
    carries = F.exists("_markers", lambda m: F.contains(F.col("_text"), m))
    marked = read.select("item", "member", carries.alias("_carries"), ((F.col("_quote") != "") & F.contains("_text", F.col("_quote"))).alias("_quotes"))
    counts = marked.groupBy("item").agg(F.count("*").alias("_n"), F.count_if("_carries").alias("_k"), F.bool_or("_quotes").alias("_q"))
    rows = items.join(counts, "item", "left")
    quote = collapsed(F.coalesce("evidence", F.lit("")))
    quoted = F.coalesce("_q", F.lit(False)) | ((quote != "") & F.contains(collapsed(F.coalesce("title", F.lit(""))), quote))
    dates = _dates(F.col("evidence"))
    against = (F.size(dates) > 0) & F.when(F.col("temporal") == "future", F.forall(dates, lambda d: d <= as_of)).otherwise(F.forall(dates, lambda d: d >= as_of))
    status = F.when(_outside("temporal") & (~quoted | against), "unknown").otherwise(F.col("temporal"))
    dated = F.try_element_at(F.create_map(*[F.lit(x) for pair in _OF_PERIODS.items() for x in pair]), period_status(F.col("periods"), as_of))
    rows = rows.withColumn("temporal", F.coalesce(dated, status))
    few = (F.coalesce("_n", F.lit(0)) >= 2) & (F.col("_k") > 0) & (F.col("_k") * 2 < F.col("_n"))
    rows = rows.withColumn("_from", F.when(_outside("temporal") & F.coalesce(few, F.lit(False)), F.col("temporal")))
    moved = rows.where("_from is not null").select("item", "_from")
    edition = F.try_element_at(F.create_map(*[F.lit(x) for pair in OUTSIDE.items() for x in pair]), F.col("_from"))
    exceptions = marked.where("_carries").join(moved, "item").select("item", "member", edition.alias("association"), F.lit("irrelevant").alias("relevance"))
    settled = rows.withColumns({"moved": F.col("_from").isNotNull(), "temporal": F.when(F.col("_from").isNotNull(), "unknown").otherwise(F.col("temporal"))})
    return settled.drop("_n", "_k", "_q", "_from"), exceptions


def inherited(settled: DataFrame, members: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(member, item, role, relevance, temporal, association, decision): members take their item's labels, exceptions keep their own; of several exceptions of a member the first by name counts."""
    own = exceptions.groupBy("item", "member").agg(F.min(F.struct("association", "relevance")).alias("_x"))
    rows = members.select("item", "member").join(settled.select("item", "role", "relevance", "temporal"), "item").join(own, ["item", "member"], "left")
    return rows.select("member", "item", "role", F.coalesce("_x.relevance", "relevance").alias("relevance"), "temporal", F.col("_x.association").alias("association"), F.when(F.col("_x").isNull(), "inherited").otherwise("own").alias("decision"))


def selected_sources(labels: DataFrame) -> DataFrame:
    """(source, item, precedence): the label that decides each source, where it is selected.

    ``labels`` are (source, item, scope, authority, role, relevance, temporal). A label of the source's own
    (block or table) decides it; a container's counts only for sources without one. Irrelevant, stale and
    future labels select nothing. Of what is left the least precedence counts, ties by item.
    """
    own = F.col("scope").isin(*SCOPES_OF_THEIR_OWN)
    chosen = (F.col("relevance") != "irrelevant") & ~F.coalesce(F.col("temporal").isin(*OUTSIDE), F.lit(False))
    rank = F.when(F.col("authority") == "official_terms", 1).when((F.col("scope") == "table") & F.col("role").isin("product_terms", "pricing"), 2).when(F.col("authority") == "official_product_content", 3).otherwise(4)
    best = lambda of: F.min(F.when(chosen & of, F.struct(rank.alias("precedence"), F.col("item").alias("item"))))
    out = labels.groupBy("source").agg(F.bool_or(own).alias("_own"), best(own).alias("_a"), best(~own).alias("_b"))
    found = out.withColumn("_f", F.when(F.col("_own"), F.col("_a")).otherwise(F.col("_b"))).where("_f is not null")
    return found.select("source", "_f.item", F.col("_f.precedence").cast("long").alias("precedence"))
