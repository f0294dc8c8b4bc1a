"""J18-J20 over orders as items and their lines as members."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlake.operators import labels as L
from factlake.queries import query

_AS_OF = "1996-01-01"
_DAY = "lpad(CAST(extract(day FROM {d}) AS VARCHAR), 2, '0') || '.' || lpad(CAST(extract(month FROM {d}) AS VARCHAR), 2, '0') || '.' || extract(year FROM {d})"
_SHIP, _END = _DAY.format(d="CAST(l_shipdate AS DATE)"), _DAY.format(d="(CAST(o_orderdate AS DATE) + 90)")
#: an order's evidence names the earliest day its lines were shipped; every third order also has a dated period
RULES = f"""m AS (SELECT l_orderkey AS item, l_orderkey || '-' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS member, 'line ' || l_linenumber || ' effective from ' || {_SHIP} AS text, CAST(l_shipdate AS DATE) AS day FROM lineitem),
  i AS (SELECT o_orderkey AS item, CASE o_orderstatus WHEN 'F' THEN 'possibly_stale' WHEN 'O' THEN 'future' ELSE 'current' END AS temporal, CASE WHEN o_orderkey % 5 > 0 THEN 'effective from ' || {_DAY.format(d='first')} END AS quote, first, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + 90 END AS ends, CASE WHEN o_orderkey % 3 = 0 THEN 'until ' || {_END} END AS raw
    FROM orders LEFT JOIN (SELECT item, min(day) AS first FROM m GROUP BY 1) f ON f.item = o_orderkey),
  marked AS (SELECT m.item, m.member, coalesce(contains(m.text, i.quote), false) OR coalesce(contains(m.text, i.raw), false) AS carries, coalesce(contains(m.text, i.quote), false) AS quotes FROM m JOIN i USING (item)),
  n AS (SELECT item, count(*) AS n, count(*) FILTER (carries) AS k, bool_or(quotes) AS q FROM marked GROUP BY 1),
  s1 AS (SELECT i.*, n, k, CASE WHEN ends IS NOT NULL THEN CASE WHEN ends < DATE '{_AS_OF}' THEN 'possibly_stale' ELSE 'current' END WHEN temporal = 'current' THEN temporal WHEN NOT coalesce(q, false) THEN 'unknown'
    WHEN temporal = 'future' AND first <= DATE '{_AS_OF}' THEN 'unknown' WHEN temporal = 'possibly_stale' AND first >= DATE '{_AS_OF}' THEN 'unknown' ELSE temporal END AS status FROM i LEFT JOIN n USING (item)),
  s2 AS (SELECT *, status IN ('possibly_stale', 'future') AND coalesce(n >= 2 AND k > 0 AND 2 * k < n, false) AS moved FROM s1)"""


def _members(t):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    day = F.date_format("l_shipdate", "dd.MM.yyyy")
    return t.lineitem.select(F.col("l_orderkey").alias("item"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.row_number().over(w).cast("string")).alias("member"), F.concat(F.lit("Line  "), F.col("l_linenumber").cast("string"), F.lit(" EFFECTIVE from "), day).alias("text"), F.col("l_shipdate").cast("date").alias("day"))


def _items(t, members):
    first = members.groupBy("item").agg(F.min("day").alias("first"))
    ends = F.date_add(F.col("o_orderdate").cast("date"), 90)
    period = F.struct(F.concat(F.lit("until "), F.date_format(ends, "dd.MM.yyyy")).alias("raw"), F.lit(None).cast("date").alias("starts"), ends.alias("ends"))
    rows = t.orders.join(first, F.col("o_orderkey") == F.col("item"), "left")
    temporal = F.when(F.col("o_orderstatus") == "F", "possibly_stale").when(F.col("o_orderstatus") == "O", "future").otherwise("current")
    return rows.select(
        F.col("o_orderkey").alias("item"), F.lit("section").alias("scope"), F.lit("official_product_content").alias("authority"), F.lit("product_terms").alias("role"), F.when(F.col("o_orderpriority").startswith("5"), "irrelevant").otherwise("relevant").alias("relevance"), temporal.alias("temporal"),
        F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("effective from "), F.date_format("first", "dd.MM.yyyy"))).alias("evidence"), F.lit("An order").alias("title"), F.when(F.col("o_orderkey") % 3 == 0, F.array(period)).alias("periods"),
    )


def _settled(t):
    members = _members(t)
    return members, *L.settle_temporal(_items(t, members), members, F.lit(_AS_OF).cast("date"))


@query("J18_settled", f"WITH {RULES} SELECT item, CASE WHEN moved THEN 'unknown' ELSE status END AS temporal, moved FROM s2")
def _(t):
    return _settled(t)[1].select("item", "temporal", "moved")


@query("J18_moved_members", f"WITH {RULES} SELECT s2.item, member, CASE status WHEN 'future' THEN 'future_version' ELSE 'historical_version' END AS association FROM s2 JOIN marked USING (item) WHERE moved AND carries")
def _(t):
    return _settled(t)[2].select("item", "member", "association")


_LABELS = f"""{RULES}, h AS (SELECT m.item, m.member, CASE WHEN moved AND carries THEN 'irrelevant' WHEN o_orderpriority LIKE '5%' THEN 'irrelevant' ELSE 'relevant' END AS relevance, CASE WHEN moved THEN 'unknown' ELSE status END AS temporal, CASE WHEN moved AND carries THEN 'own' ELSE 'inherited' END AS decision FROM marked m JOIN s2 ON s2.item = m.item JOIN orders ON o_orderkey = m.item)"""


@query("J19_member_labels", f"WITH {_LABELS} SELECT item, member, relevance, temporal, decision FROM h")
def _(t):
    members, settled, exceptions = _settled(t)
    return L.inherited(settled, members, exceptions).select("item", "member", "relevance", "temporal", "decision")


@query(
    "J20_selected_members",
    f"""WITH {_LABELS} SELECT source, item, CAST(precedence AS BIGINT) AS precedence FROM (SELECT h.member AS source, h.item, CASE WHEN h.decision = 'own' OR h.item % 2 = 0 THEN CASE WHEN h.relevance = 'relevant' AND h.temporal NOT IN ('possibly_stale', 'future') THEN CASE WHEN h.item % 4 = 0 THEN 2 ELSE 3 END END
      WHEN o_orderpriority NOT LIKE '5%' AND h.temporal NOT IN ('possibly_stale', 'future') THEN 3 END AS precedence FROM h JOIN orders ON o_orderkey = h.item) WHERE precedence IS NOT NULL""",
)
def _(t):
    members, settled, exceptions = _settled(t)
    handed = L.inherited(settled, members, exceptions)
    # lines of even orders, and exceptions, have labels of their own; all have their order's as a container's
    table = F.when(F.col("item") % 4 == 0, "table").otherwise("block")
    own = handed.where("decision = 'own' or item % 2 = 0").select(F.col("member").alias("source"), "item", table.alias("scope"), F.lit("official_product_content").alias("authority"), "role", "relevance", "temporal")
    container = members.join(settled.drop("title"), "item").select(F.col("member").alias("source"), "item", "scope", "authority", "role", "relevance", "temporal")
    return L.selected_sources(own.unionByName(container))
