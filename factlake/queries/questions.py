"""M: typed questions over the stand-in facts (lineitem by supplier)."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlake.plans import questions as Q
from factlake.queries import query
from factlake.queries.joins import MENTIONS, catalog_names, twice

CENTS = "CAST(l_extendedprice AS DECIMAL(18, 2))"


def facts(t):
    return t.lineitem.select(
        F.col("l_suppkey").alias("entity"), F.col("l_returnflag").alias("field"), F.col("l_extendedprice").cast("decimal(18,2)").alias("number"), F.lit("money").alias("unit"),
        F.when(F.col("l_linestatus") == "O", "USD").otherwise("EUR").alias("currency"), F.col("l_linestatus").alias("basis"), F.lit(None).cast("string").alias("scope"), "l_orderkey", "l_linenumber",
    )


def scope(t):
    return t.supplier.select(F.col("s_suppkey").alias("entity"))


RANK = f"""WITH b AS (SELECT l_linestatus AS basis, n_name AS nation, l_suppkey AS entity, max({CENTS}) AS best FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE l_returnflag = 'R' GROUP BY ALL),
    r AS (SELECT *, rank() OVER (PARTITION BY basis, nation ORDER BY best DESC) AS rk, count(*) OVER (PARTITION BY basis, nation) AS n FROM b),
    w AS (SELECT *, row_number() OVER (PARTITION BY basis, nation ORDER BY rk, entity) = 1 AND n > 1 AS win FROM r)
    SELECT s_suppkey AS entity, basis, nation, CAST(best AS DOUBLE) AS best, CASE WHEN n > 1 THEN rk END AS rank, coalesce(win, false) AS winner, CASE WHEN best IS NULL THEN 'no_value' WHEN n > 1 THEN 'ranked' ELSE 'not_comparable' END AS coverage FROM supplier LEFT JOIN w ON entity = s_suppkey"""


@query("M05_rank", RANK)
def rank(t):
    named = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("entity"), F.col("n_name").alias("nation"))
    rows = facts(t).where("field = 'R'").join(named, "entity")
    return Q.rank(rows, scope(t), "highest", ["basis", "nation"]).withColumn("best", F.col("best").cast("double"))


@query("M01_single", f"SELECT l_orderkey, l_linenumber, l_returnflag AS field, CAST({CENTS} AS DOUBLE) AS number FROM lineitem WHERE l_suppkey = 7 AND l_returnflag IN ('R', 'A')")
def _(t):
    return Q.single(facts(t), 7, ["R", "A"]).select("l_orderkey", "l_linenumber", "field", F.col("number").cast("double").alias("number"))


@query("M02_overview", "SELECT s_suppkey AS entity, field, least(coalesce(n, 0), 6) AS shown, coalesce(n, 0) > 6 AS truncated, coalesce(n, 0) > 0 AS has_fact FROM supplier CROSS JOIN (VALUES ('R'), ('X')) f(field) LEFT JOIN (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) ON l_suppkey = s_suppkey AND l_returnflag = field")
def _(t):
    return Q.overview(facts(t), scope(t), ["R", "X"])


@query(
    "M02_overview_facts",
    f"""WITH f AS (SELECT l_suppkey AS entity, l_returnflag AS field, {CENTS} AS number, l_linestatus AS basis, l_orderkey, l_linenumber, row_number() OVER w AS place, count(*) OVER (PARTITION BY l_suppkey, l_returnflag) AS n
        FROM lineitem WHERE l_returnflag IN ('R', 'X') WINDOW w AS (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber))
    SELECT s_suppkey AS entity, field, place, number, basis, l_orderkey, l_linenumber, coalesce(n > 6, false) AS truncated FROM supplier LEFT JOIN f ON entity = s_suppkey AND place <= 6""",
)
def _(t):
    order = [F.desc("number"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    return Q.overview_facts(facts(t), scope(t), ["R", "X"], order, ["number", "basis", "l_orderkey", "l_linenumber"])


@query(
    "M05_best_variants",
    """WITH f AS (SELECT l_suppkey AS entity, l_returnflag AS field, l_discount AS number, l_linestatus AS basis, l_tax FROM lineitem),
    b AS (SELECT DISTINCT entity, field, number, basis, l_tax FROM f QUALIFY rank() OVER (PARTITION BY entity, field ORDER BY number DESC) = 1)
    SELECT entity, field, any_value(number) AS best, string_agg(basis || ' ' || CAST(CAST(round(l_tax * 100) AS BIGINT) AS VARCHAR), ';' ORDER BY basis, l_tax) AS variants, count(*) > 1 AS tied FROM b GROUP BY ALL""",
)
def _(t):
    offers = t.lineitem.select(F.col("l_suppkey").alias("entity"), F.col("l_returnflag").alias("field"), F.col("l_discount").alias("number"), F.col("l_linestatus").alias("basis"), F.round(F.col("l_tax") * 100).cast("long").alias("tax"))
    found = Q.best_variants(offers, ["field"], ["basis", "tax"], "highest")
    return found.withColumn("variants", F.array_join(F.transform("variants", lambda v: F.concat_ws(" ", v["basis"], v["tax"].cast("string"))), ";"))


@query("M03_compare", "SELECT 'A' AS field, true AS comparable, NULL::VARCHAR AS reason UNION ALL SELECT 'N', true, NULL UNION ALL SELECT 'R', true, NULL UNION ALL SELECT 'Z', false, 'missing_side'")
def _(t):
    extra = facts(t).where("entity = 3").limit(1).withColumn("field", F.lit("Z"))
    return Q.compare(facts(t).unionByName(extra), 3, 4)


@query("M04_comparison_issue", f"WITH k AS (SELECT l_suppkey AS e, l_returnflag AS f, l_linestatus AS b, count(*) AS n FROM lineitem WHERE l_suppkey IN (1, 2) GROUP BY ALL) SELECT l.f AS field, l.b AS lb, r.b AS rb, CASE WHEN l.b <> r.b THEN 'currency_differs' END AS issue FROM k l JOIN k r ON l.f = r.f WHERE l.e = 1 AND r.e = 2")
def _(t):
    keys = facts(t).where("entity in (1, 2)").groupBy("entity", "field", "unit", "currency", "basis", "scope").agg(F.max("number").alias("number"))
    both = keys.where("entity = 1").alias("l").join(keys.where("entity = 2").alias("r"), F.col("l.field") == F.col("r.field"))
    return both.select(F.col("l.field").alias("field"), F.col("l.basis").alias("lb"), F.col("r.basis").alias("rb"), Q.comparison_issue("l", "r").alias("issue"))


@query("M07_current", "SELECT c_custkey, o_orderkey, o_orderstatus, CASE WHEN o_orderdate IS NULL THEN 'missing' WHEN o_orderdate >= TIMESTAMP '1999-01-01' THEN 'fresh' ELSE 'stale' END AS status FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) ON o_custkey = c_custkey AND rn = 1")
def _(t):
    from factlake.operators.reads import latest_per_key

    last = latest_per_key(t.orders.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderstatus"])
    status = F.when(F.col("o_orderdate").isNull(), "missing").when(F.col("o_orderdate") >= "1999-01-01", "fresh").otherwise("stale")
    return t.customer.select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", "o_orderkey", "o_orderstatus", status.alias("status"))


K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
CHANGED = f"(SELECT user_id, ts, k, lag(k) OVER w AS pk, row_number() OVER w AS n FROM (SELECT *, {K} AS k FROM events WHERE event_type = 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query("M06_history", f"SELECT user_id AS entity, epoch_us(ts) AS ts_us, CAST(pk AS VARCHAR) AS previous, CAST(k AS VARCHAR) AS current FROM {CHANGED} WHERE n > 1 AND pk IS DISTINCT FROM k AND ts >= TIMESTAMP '2024-01-10'")
def _(t):
    return changes(t).where("ts >= timestamp_ntz '2024-01-10'").select("entity", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "previous", "current")


def versions(t):
    return t.events.where("event_type = 'purchase'").select(F.col("user_id").alias("entity"), "ts", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def changes(t):
    from factlake.operators.versions import change_set

    return change_set(versions(t), "entity", ["ts", "event_id"], ["k"])


@query(
    "M08_change_history",
    f"""WITH c AS (SELECT user_id, count(*) AS m FROM {CHANGED} WHERE n > 1 AND pk IS DISTINCT FROM k AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11' GROUP BY 1),
    v AS (SELECT user_id, count(*) FILTER (ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11') AS i, count(*) FILTER (ts < TIMESTAMP '2024-01-10') AS b FROM events WHERE event_type = 'purchase' GROUP BY 1)
    SELECT c_custkey AS entity, coalesce(m, 0) AS n_changes, CASE WHEN coalesce(m, 0) > 0 THEN 'changes_found' WHEN coalesce(i, 0) > 0 AND b = 0 THEN 'first_observation' WHEN coalesce(i, 0) > 0 THEN 'unchanged_in_window' WHEN coalesce(b, 0) > 0 THEN 'history_found' ELSE 'unavailable' END AS status
    FROM customer LEFT JOIN c ON c.user_id = c_custkey LEFT JOIN v ON v.user_id = c_custkey""",
)
def _(t):
    start, end = F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-11").cast("timestamp_ntz")
    return Q.change_status(t.customer.select(F.col("c_custkey").alias("entity")), versions(t), changes(t), start, end)


@query("M09_not_found", "SELECT s_suppkey AS entity, CASE WHEN s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50) THEN 'not_stated_in_source' ELSE 'field_not_extracted' END AS reason FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49 AND l_discount > 0.09)")
def _(t):
    found = t.lineitem.where("l_returnflag = 'R' and l_quantity > 49 and l_discount > 0.09").select(F.col("l_suppkey").alias("entity"), F.lit("x").alias("field"))
    return Q.not_found_reason(scope(t), found, t.lineitem.where("l_quantity = 50").select(F.col("l_suppkey").alias("entity")), "x")


@query("M10_coverage", "SELECT c_custkey AS entity, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') THEN 'published' WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'awaiting' ELSE 'never' END AS state FROM customer")
def _(t):
    by = lambda s: t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("entity"))
    return Q.coverage(t.customer.select(F.col("c_custkey").alias("entity")), by("O"), by("P"))


@query(
    "M11_plan_requests",
    """SELECT event_id AS request_id, CASE WHEN event_type IN ('click', 'view') THEN CASE WHEN event_id % 3 = 1 THEN 'single' ELSE 'overview' END WHEN event_type = 'purchase' THEN 'rank' ELSE 'compare' END AS operation,
    CASE WHEN ts < TIMESTAMP '2024-01-05' THEN 'expired' WHEN event_id % 3 < 1 THEN 'no_entities' WHEN event_type = 'purchase' AND (user_id % 2 = 1 OR event_id % 3 < 2) THEN 'rank_not_possible' WHEN event_type NOT IN ('click', 'view', 'purchase') AND event_id % 3 <> 2 THEN 'compare_needs_two' END AS reject FROM events""",
)
def _(t):
    kind = F.when(F.col("event_type").isin("click", "view"), "single").when(F.col("event_type") == "purchase", "rank").otherwise("compare")
    field = F.when(F.col("user_id") % 2 == 0, "rate").otherwise("note")
    n = (F.col("event_id") % 3).cast("int")
    requests = t.events.select(F.col("event_id").alias("request_id"), kind.alias("operation"), F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), n).alias("entities"), F.array(field).alias("fields"), F.lit("highest").alias("direction"), F.col("ts").alias("expires_at"))
    return Q.plan_requests(requests, ["rate"], "2024-01-05")


#: a name of several words is a member of the family that its first word names
@query("M12_resolved_mentions", f"WITH RECURSIVE {MENTIONS}, m AS (SELECT a.entity AS member, b.entity AS family FROM names a JOIN names b ON len(a.nw) > 1 AND len(b.nw) = 1 AND b.nw[1] = a.nw[1] AND a.entity <> b.entity), kept AS (SELECT f.* FROM found f WHERE NOT EXISTS (SELECT 1 FROM found g JOIN m ON m.member = g.entity WHERE g.p_partkey = f.p_partkey AND m.family = f.entity)) SELECT p_partkey, count(DISTINCT entity) AS entities, count(DISTINCT entity) > 1 AS clarify FROM kept GROUP BY 1")
def _(t):
    from factlake.operators.joins import mentions, without_families

    names = catalog_names(t)
    first = F.split("name", " ")[0]
    members = names.where(F.contains("name", F.lit(" "))).select(F.col("entity").alias("member"), first.alias("w")).join(names.where(~F.contains("name", F.lit(" "))).select(F.col("entity").alias("family"), F.col("name").alias("w")), "w").where("member <> family").select("member", "family")
    found = without_families(mentions(twice(t), names, "p_partkey", "line"), members, "p_partkey")
    return found.groupBy("p_partkey").agg(F.count_distinct("entity").alias("entities"), (F.count_distinct("entity") > 1).alias("clarify"))
