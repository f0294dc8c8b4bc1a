"""J28-J32: facts and units."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlake.plans import facts as P
from factlake.queries import query


@query("J28_facts", "SELECT l_orderkey, l_linenumber, l_partkey, field, CAST(number AS DOUBLE) AS number FROM (SELECT l_orderkey, l_linenumber, l_partkey, unnest(['price', 'quantity', 'discount']) AS field, unnest([CAST(l_extendedprice AS DECIMAL(18, 2)), CAST(l_quantity AS DECIMAL(18, 2)), CASE WHEN l_discount > 0 THEN CAST(l_discount AS DECIMAL(18, 2)) END]) AS number FROM lineitem) WHERE number IS NOT NULL")
def _(t):
    discount = F.when(F.col("l_discount") > 0, F.col("l_discount"))
    out = P.facts_from(t.lineitem, ["l_orderkey", "l_linenumber", "l_partkey"], {"price": F.col("l_extendedprice"), "quantity": F.col("l_quantity"), "discount": discount})
    return out.withColumn("number", F.col("number").cast("double"))


@query(
    "J29_inferred_currency",
    """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS cur FROM lineitem), o AS (SELECT l_orderkey, min(cur) AS c FROM f GROUP BY 1 HAVING min(cur) = max(cur))
    SELECT f.l_orderkey, l_linenumber, l_partkey, coalesce(cur, c) AS cur, cur IS NULL AND c IS NOT NULL AS inferred FROM f LEFT JOIN o ON o.l_orderkey = f.l_orderkey""",
)
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("cur"))
    return P.inferred_currency(rows, "l_orderkey", "cur")


@query("J30_narrowed_citations", "SELECT l_orderkey, l_linenumber, l_partkey, kind FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_discount > 0.05 THEN 2 ELSE 3 END AS kind FROM lineitem) QUALIFY kind = min(kind) OVER (PARTITION BY l_orderkey)")
def _(t):
    kind = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_discount") > 0.05, 2).otherwise(3)
    return P.narrowed_citations(t.lineitem, t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", kind.alias("kind")), "l_orderkey")


@query("J31_units", "SELECT p_brand, min(p_type) AS identity_text, array_to_string(list_sort(list_distinct(list(p_name))), '; ') AS detail_text FROM part GROUP BY 1")
def _(t):
    return P.profile_units(t.part, "p_brand", "p_type", "p_name")


@query("J32_review_tasks", "SELECT DISTINCT user_id, event_type, substr(sha256(user_id || ':' || event_type), 1, 32) AS task_id FROM events WHERE event_type IN ('error', 'view')")
def _(t):
    return P.review_tasks(t.events.where("event_type in ('error', 'view')"), "user_id", "event_type")


@query("A07_catalog", "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def _(t):
    return t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", "s_name", "n_name")


@query("A08_decode_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("A09_explode_json", "SELECT event_id, v FROM (SELECT event_id, unnest([event_type, 'k' || json_extract_string(props, '$.k')]) AS v FROM events WHERE event_id % 2 = 0) UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 2 = 1")
def _(t):
    # an array on even rows, no array on odd ones: those keep one row without a value
    k = F.concat(F.lit("k"), F.get_json_object("props", "$.k"))
    payload = F.when(F.col("event_id") % 2 == 0, F.to_json(F.array("event_type", k))).otherwise(F.col("props"))
    parsed = F.when(F.startswith(payload, F.lit("[")), F.from_json(payload, "array<string>"))
    return t.events.select("event_id", F.explode_outer(parsed).alias("v"))
