"""C: filters, predicates and keyed reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlake.operators import reads as R
from factlake.queries import query

ACCEPTED = "event_type = 'purchase'"


def micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


@query("C01_scope_filter", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (1, 5, 7, 11, 42, 77) AND o_orderpriority = '1-URGENT'")
def _(t):
    return R.family_scope(t.orders, "o_custkey", [1, 5, 7, 11, 42, 77], "o_orderpriority", "1-URGENT").select("o_orderkey", "o_custkey")


@query("C02_time_filter", "SELECT event_id, epoch_us(ts) AS ts_us FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def _(t):
    return R.time_filter(t.events, "ts", "2024-01-05", "2024-01-12").select("event_id", micros("ts").alias("ts_us"))


@query("C03_active_accepted", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'O' AND o_orderstatus = 'O' AND l_returnflag = 'N'")
def _(t):
    lines = t.lineitem.where("l_linestatus = 'O' and l_returnflag = 'N'")
    orders = t.orders.where("o_orderstatus = 'O'")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey")


LATEST = "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"


@query("C04_latest_per_key", LATEST)
def _(t):
    return R.latest_per_key(t.events, ["user_id"], ["ts", "event_id"], ["event_type", "value"]).drop("ts")


@query(
    "C05_latest_before",
    """SELECT event_id, prev_event_id, prev_value FROM (
      SELECT e.event_id, p.event_id AS prev_event_id, p.value AS prev_value,
             row_number() OVER (PARTITION BY e.event_id ORDER BY p.ts DESC NULLS LAST, p.event_id DESC NULLS LAST) AS rn
      FROM (SELECT * FROM events WHERE event_type = 'error') e
      LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON p.user_id = e.user_id AND p.ts < e.ts) WHERE rn = 1""",
)
def _(t):
    runs = t.events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    accepted = t.events.where(ACCEPTED).select(F.col("event_id").alias("aid"), "user_id", F.col("ts").alias("ats"), "value")
    out = R.latest_before(runs, accepted, "user_id", "ts", "ats", "aid", ["value"])
    return out.select("event_id", F.col("prev_aid").alias("prev_event_id"), "prev_value")


@query("C06_accepted_history", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(t):
    return R.history(t.events.where(ACCEPTED), "ts", "event_id", "2024-01-03", "2024-01-20", 50).select("event_id", "user_id", "value")


@query("C07_latest_change_before", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type = 'purchase' AND ts < TIMESTAMP '2024-01-15') WHERE rn = 1")
def _(t):
    before = R.time_filter(t.events.where(ACCEPTED), "ts", None, "2024-01-15")
    return R.latest_per_key(before, ["user_id"], ["ts", "event_id"], ["value"]).drop("ts")


@query(
    "C08_has_newer_pending",
    """SELECT a.user_id, a.event_id, EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'view' AND p.user_id = a.user_id AND p.ts > a.ts) AS has_newer
    FROM events a WHERE a.event_type = 'purchase'""",
)
def _(t):
    return R.has_newer(t.events.where(ACCEPTED).select("user_id", "event_id", "ts"), t.events.where("event_type = 'view'"), "user_id", "ts", "ts").drop("ts")


@query(
    "C09_entity_states",
    """WITH p AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
    l AS (SELECT o_custkey AS k, o_orderstatus AS s FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1),
    a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
    SELECT c_custkey, coalesce(n, 0) AS pending, CASE WHEN coalesce(n, 0) > 0 THEN 'awaiting_review' WHEN a.k IS NOT NULL THEN 'accepted'
      WHEN s IS NULL THEN 'never_monitored' WHEN s = 'F' THEN 'run_failed' ELSE 'no_accepted_data' END AS state
    FROM customer LEFT JOIN p ON p.k = c_custkey LEFT JOIN l ON l.k = c_custkey LEFT JOIN a ON a.k = c_custkey""",
)
def _(t):
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    latest = R.latest_per_key(orders, ["c_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderstatus"])
    latest = latest.select("c_custkey", F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done").alias("last_status"))
    return R.entity_states(t.customer, "c_custkey", orders.where("o_orderstatus = 'P'"), latest, orders.where("o_orderstatus = 'O'"))


FRESH = """SELECT c_custkey, CASE WHEN last IS NULL THEN 'missing' WHEN greatest(0, epoch(TIMESTAMP '2000-01-01') - epoch(last)) <= 365 * 86400 THEN 'fresh' ELSE 'stale' END AS status,
    CASE WHEN last IS NOT NULL THEN CAST(greatest(0, epoch(TIMESTAMP '2000-01-01') - epoch(last)) AS BIGINT) END AS age_seconds
    FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey"""


@query("C10_freshness", FRESH)
def _(t):
    return R.freshness(t.customer, t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_orderdate", "2000-01-01", 365)


@query("C11_reusable", "SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' AND ts >= TIMESTAMP '2024-01-14 12:00:00' AND NOT (event_type = 'error')")
def _(t):
    return R.reusable(t.events, "ts", "2024-01-15 12:00:00", 24, F.col("event_type") == "error").select("event_id")


@query(
    "C12_condition_match",
    """SELECT l_orderkey, l_linenumber FROM lineitem WHERE (CASE WHEN l_discount = 0 THEN NULL WHEN l_discount < 0.05 THEN 'AMD' ELSE 'USD' END IS NULL
    OR CASE WHEN l_discount = 0 THEN NULL WHEN l_discount < 0.05 THEN 'AMD' ELSE 'USD' END = 'AMD') AND l_returnflag = 'A' AND l_linestatus = 'F'""",
)
def _(t):
    currency = F.when(F.col("l_discount") == 0, None).when(F.col("l_discount") < 0.05, "AMD").otherwise("USD")
    facts = t.lineitem.select("l_orderkey", "l_linenumber", currency.alias("currency"), F.col("l_returnflag").alias("basis"), F.col("l_linestatus").alias("scope"))
    return R.condition_match(facts, currency="AMD", basis="A", scope="F").select("l_orderkey", "l_linenumber")


@query("C13_differs", "SELECT vec_id, label FROM embeddings WHERE label IS DISTINCT FROM 3")
def _(t):
    return R.differs(t.embeddings, "label", 3).select("vec_id", "label")


@query("C14_listing", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus ASC NULLS LAST, o_orderdate DESC, o_orderkey LIMIT 40 OFFSET 20")
def _(t):
    return R.listing(t.orders, [F.asc_nulls_last("o_orderstatus"), F.desc("o_orderdate"), F.asc("o_orderkey")], 40, 20).select("o_orderkey", "o_orderstatus")


@query(
    "C15_stale_leases",
    """WITH s AS (SELECT o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS beat FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
      WHERE o_orderstatus = 'P' AND coalesce(beat, o_orderdate) < TIMESTAMP '1998-01-01')
    SELECT s.o_orderkey, count(l_orderkey) AS children FROM s LEFT JOIN lineitem ON l_orderkey = s.o_orderkey GROUP BY 1""",
)
def _(t):
    beat = t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("beat"), F.count("*").alias("children"))
    runs = t.orders.where("o_orderstatus = 'P'").join(beat, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return R.stale_leases(runs, "beat", "o_orderdate", "1998-01-01").select("o_orderkey", F.coalesce("children", F.lit(0)).alias("children"))


@query("C16_prefix_match", "SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def _(t):
    return R.prefix_match(t.customer, "c_name", "Customer#00000001").select("c_custkey", "c_name")


@query(
    "C17_submit_dedup",
    """SELECT user_id, k, event_id, event_type, n - 1 AS repeats FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id, event_type,
      row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id, json_extract_string(props, '$.k')) AS n FROM events) WHERE rn = 1""",
)
def _(t):
    rows = t.events.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return R.first_submission(rows, ["user_id", "k"], ["event_id"], ["event_type"])


@query(
    "C18_reader_projection",
    """SELECT l_orderkey, array_to_string(list_slice(list(p ORDER BY m, p), 1, 3), ',') AS cited FROM (SELECT l_orderkey, l_partkey AS p, min(l_linenumber) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1""",
)
def _(t):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"].cast("string"))
    facts = t.lineitem.groupBy("l_orderkey").agg(lines.alias("cited")).withColumn("quote", F.lit("q"))
    return R.reader_projection(facts, "cited", "quote").select("l_orderkey", F.array_join("cited", ",").alias("cited"))


@query(
    "C19_citations",
    """SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS position, substr(p_name, 1, 20) AS excerpt
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'P'""",
)
def _(t):
    evidence = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("evidence_order"), F.substring("p_name", 1, 20).alias("excerpt"))
    facts = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.citation_list(facts, evidence, "l_orderkey").select("l_orderkey", F.col("position").cast("long").alias("position"), "excerpt")


@query("C20_fact_line", "SELECT l_orderkey, l_linenumber, concat_ws(' | ', l_returnflag, CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS VARCHAR), CASE WHEN l_discount > 0.05 THEN 'discounted' END) AS line FROM lineitem")
def _(t):
    line = R.fact_line(F.col("l_returnflag"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.when(F.col("l_discount") > 0.05, "discounted"))
    return t.lineitem.select("l_orderkey", "l_linenumber", line.alias("line"))


@query(
    "G01_top_sorted", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20"
)
def _(t):
    return R.listing(t.events, [F.desc("value"), F.asc("event_id")], 20).select("event_id", "value")


@query("G02_directed_order", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice ASC, p_partkey LIMIT 10")
def _(t):
    from factlake.operators.ranking import directed

    return directed(t.part, "p_retailprice", "lowest", "p_partkey").limit(10).select("p_partkey", "p_retailprice")


@query(
    "G03_merged_top",
    "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5 ORDER BY ts DESC, event_id DESC LIMIT 12",
)
def _(t):
    from factlake.operators.ranking import merged_top

    return merged_top(t.events, ["event_type"], [F.desc("ts"), F.desc("event_id")], 5, 12).select("event_type", "event_id")


@query("G04_priority_sort", "SELECT o_orderkey FROM orders ORDER BY CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, o_orderkey LIMIT 30")
def _(t):
    from factlake.operators.ranking import priority

    return t.orders.orderBy(priority(F.col("o_orderpriority"), ["3-MEDIUM", "1-URGENT"]), "o_orderkey").limit(30).select("o_orderkey")


@query(
    "G05_precedence",
    """SELECT source, min(CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END) AS rank, arg_min(doc_id, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END * 1000000000::BIGINT + doc_id) AS doc_id FROM documents GROUP BY 1""",
)
def _(t):
    from factlake.operators.ranking import lowest_rank, priority

    return lowest_rank(t.documents.withColumn("rank", priority(F.col("lang"), ["en", "de", "fr"])), ["source"], "rank", "doc_id")
