"""F and H: ordered rows and versions; A10-A13 on the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlake.operators import ranking as R
from factlake.operators import versions as V
from factlake.queries import query
from factlake.queries.tables import RULES, shaped_cells

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def events(t):
    return t.events.withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def accepted(t):
    return events(t).where("event_type = 'purchase'")


@query("F01_ranked_versions", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC, event_id DESC) AS rank FROM events")
def _(t):
    return V.ranked_versions(t.events, "user_id", [F.desc("ts"), F.desc("value"), F.desc("event_id")]).select("event_id", F.col("rank").cast("long").alias("rank"))


LINES = "(SELECT doc_id, line, pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents))"


def lines(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query("F02_occurrence", f"SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) - 1 AS occurrence FROM {LINES}")
def _(t):
    return V.occurrence(lines(t), ["doc_id", "line"], ["pos"]).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("occurrence").cast("long").alias("occurrence"))


@query("F05_rowspan_carry", f"WITH {RULES} SELECT t AS table_id, row, CAST(col AS BIGINT) AS col, text AS v FROM grid")
def _(t):
    from factlake.operators.grids import fill_spans

    return fill_spans(shaped_cells(t)).select("table_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("text").alias("v"))


@query("F06_in_force", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS in_force FROM events")
def _(t):
    rows = t.events.withColumn("mark", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return V.carried(rows, "user_id", ["ts", "event_id"], "mark", "in_force").select("event_id", "in_force")


@query("F07_without_repeats", "SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR b IS DISTINCT FROM event_type")
def _(t):
    return V.without_repeats(t.events, "user_id", ["ts", "event_id"], ["event_type"]).select("event_id", "event_type")


@query("F10_capped", "SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber, l_partkey, truncated FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn, count(*) OVER (PARTITION BY l_suppkey, l_returnflag) > 6 AS truncated FROM lineitem) WHERE rn <= 6 ORDER BY l_suppkey, l_returnflag, l_orderkey, l_linenumber, l_partkey LIMIT 240")
def _(t):
    out = R.capped(t.lineitem, ["l_suppkey", "l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey"], 6, 240)
    return out.select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "truncated")


@query("F11_neighbours", "SELECT DISTINCT a.l_orderkey, a.l_linenumber FROM lineitem a JOIN lineitem s ON s.l_orderkey = a.l_orderkey AND abs(a.l_linenumber - s.l_linenumber) <= 1 WHERE s.l_quantity = 50")
def _(t):
    from factlake.operators.grids import neighbours

    return neighbours(t.lineitem.select("l_orderkey", "l_linenumber"), t.lineitem.where("l_quantity = 50"), "l_orderkey", "l_linenumber", 1).distinct()


FUSE = """SELECT id, round(sum(w / (60 + n)), 12) AS score FROM (SELECT doc_id AS id, 1.0 AS w, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS n FROM documents
    UNION ALL SELECT vec_id, 0.7, row_number() OVER (ORDER BY embedding[1] DESC, vec_id) FROM embeddings) GROUP BY 1"""


@query("F12_rank_fusion", FUSE)
def _(t):
    a = t.documents.select("doc_id", "n_chars")
    b = t.embeddings.select("vec_id", F.col("embedding")[0].alias("s"))
    return R.reciprocal_ranks([(a, "doc_id", "n_chars", 1.0), (b, "vec_id", "s", 0.7)]).withColumn("score", F.round("score", 12))


@query("F13_version_lag", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_event_id FROM events WHERE event_type = 'purchase'")
def _(t):
    return V.with_previous(accepted(t), "user_id", ["ts", "event_id"], ["event_id"]).select("event_id", "prev_event_id")


@query("F15_best_of_group", "WITH b AS (SELECT l_linestatus, l_suppkey, max(CAST(l_extendedprice AS DECIMAL(18, 2))) AS m FROM lineitem GROUP BY ALL) SELECT l_linestatus, l_suppkey, CAST(m AS DOUBLE) AS best, rank() OVER (PARTITION BY l_linestatus ORDER BY m DESC) AS rank FROM b")
def _(t):
    from factlake.plans.questions import best_in_group

    out = best_in_group(t.lineitem.withColumn("number", F.col("l_extendedprice").cast("decimal(18,2)")), ["l_linestatus"], "l_suppkey", "number", "highest")
    return out.select("l_linestatus", "l_suppkey", F.col("best").cast("double").alias("best"), F.col("rank").cast("long").alias("rank"))


CHANGES = f"""WITH a AS (SELECT user_id, ts, event_id, {K} AS k, CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) AS v FROM events WHERE event_type = 'purchase'),
    l AS (SELECT *, lag(k) OVER w AS pk, lag(v) OVER w AS pv, row_number() OVER w AS n FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    u AS (SELECT user_id, event_id, 'k' AS field, CAST(pk AS VARCHAR) AS previous, CAST(k AS VARCHAR) AS current FROM l WHERE n > 1 UNION ALL SELECT user_id, event_id, 'v', pv, v FROM l WHERE n > 1)"""


def changes(t):
    rows = accepted(t).withColumn("v", F.col("value").cast("decimal(18,2)"))
    return V.change_set(rows, "user_id", ["ts", "event_id"], ["k", "v"])


@query("H01_change_set", CHANGES + " SELECT * FROM u WHERE previous IS DISTINCT FROM current")
def _(t):
    return changes(t).drop("ts")


@query("H02_provenance_only", f"SELECT event_id FROM (SELECT *, lag({K}) OVER w AS pk, lag(value) OVER w AS pv FROM events WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE {K} % 10 = pk % 10 AND value <> pv")
def _(t):
    rows = accepted(t).withColumn("digit", F.col("k") % 10)
    return V.provenance_only(rows, "user_id", ["ts", "event_id"], "digit", "value").select("event_id")


@query("H03_lost", "SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-10' EXCEPT SELECT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-25'")
def _(t):
    return V.lost(t.events.where("ts < timestamp_ntz '2024-01-10'"), t.events.where("ts >= timestamp_ntz '2024-01-25'"), ["user_id", "event_type"])


@query("H04_replacement", "SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN a.k IS NULL THEN 'activate' WHEN b.k IS NULL THEN 'retire' ELSE 'keep' END AS action FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P') a FULL JOIN (SELECT o_orderkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') b ON a.k = b.k")
def _(t):
    return V.replacement(t.orders.where("o_orderstatus <> 'P'"), t.orders.where("o_orderpriority = '1-URGENT'"), "o_orderkey")


@query("H05_discardable", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.08)")
def _(t):
    keyed = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    return V.discardable(t.orders.select("o_orderkey"), keyed.where("l_returnflag = 'R'"), keyed.where("l_discount > 0.08"), "o_orderkey")


@query("H06_supersede", f"WITH p AS (SELECT event_id, {K} AS parent, (ts, event_id) < max((ts, event_id)) OVER (PARTITION BY user_id) AS superseded FROM events WHERE event_type = 'view') SELECT parent AS k FROM p GROUP BY 1 HAVING bool_and(superseded)")
def _(t):
    return V.supersede(events(t).where("event_type = 'view'"), "user_id", "k", ["ts", "event_id"])[1]


@query("H07_active_versions", "SELECT event_id, (ts, event_id) = max((ts, event_id)) OVER (PARTITION BY user_id) AS is_active FROM events WHERE event_type = 'purchase'")
def _(t):
    return V.active_versions(accepted(t), "user_id", ["ts", "event_id"]).select("event_id", "is_active")


@query("H08_backfill", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_active, CASE WHEN l_orderkey IS NULL THEN 'no_facts' END AS issue FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey")
def _(t):
    from factlake.operators.joins import with_existence

    rows = with_existence(V.active_versions(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"]), t.lineitem, "o_orderkey", "l_orderkey", "has")
    return rows.select("o_orderkey", "is_active", F.when(~F.col("has"), "no_facts").alias("issue"))


@query("H09_with_history", "SELECT 'current' AS part, l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O' UNION ALL SELECT 'history', l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F'")
def _(t):
    part = lambda s, name: t.lineitem.where(F.col("l_linestatus") == s).select(F.lit(name).alias("part"), "l_orderkey", "l_linenumber")
    return part("O", "current").unionByName(part("F", "history"))


@query("H10_distinct_in_order", f"SELECT doc_id, min(pos) AS pos FROM {LINES} GROUP BY doc_id, line")
def _(t):
    return V.distinct_in_order(lines(t), ["doc_id", "line"], "pos").select("doc_id", F.col("pos").cast("long").alias("pos"))


@query("H11_distinct_normalized", f"SELECT doc_id, min(pos) AS pos FROM {LINES} GROUP BY doc_id, lower(trim(regexp_replace(line, '[\\s]+', ' ', 'g')))")
def _(t):
    from factlake.functions.text import collapsed

    return V.distinct_in_order(lines(t), ["doc_id"], "pos", collapsed(F.col("line"))).select("doc_id", F.col("pos").cast("long").alias("pos"))


@query("H12_scope_overlap", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag IN ('R')) AND count(*) > 0")
def _(t):
    flags = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("paths"))
    return flags.where(F.arrays_overlap("paths", F.array(F.lit("R"), F.lit("X")))).select("l_orderkey")


@query("H13_change_evidence", CHANGES + """, e AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1)
    SELECT u.user_id, event_id, field, CASE WHEN n > 60 THEN 'kept' ELSE 'omitted' END AS part FROM u LEFT JOIN e ON e.user_id = u.user_id WHERE previous IS DISTINCT FROM current""")
def _(t):
    views = t.events.where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("n"))
    rows = changes(t).join(views, "user_id", "left")
    return rows.select("user_id", "event_id", "field", F.when(F.col("n") > 60, "kept").otherwise("omitted").alias("part"))


@query("H14_remembered", f"SELECT event_id, m AS decision FROM events e LEFT JOIN (SELECT user_id, {K} AS k, max(event_id) AS m FROM events WHERE event_type = 'purchase' GROUP BY ALL) d ON d.user_id = e.user_id AND d.k = {K.replace('props', 'e.props')} WHERE e.event_type = 'view'")
def _(t):
    decisions = accepted(t).groupBy("user_id", "k").agg(F.max("event_id").alias("decision"))
    return events(t).where("event_type = 'view'").join(decisions, ["user_id", "k"], "left").select("event_id", "decision")


@query("A10_upsert", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def _(t):
    cols = ["user_id", "event_type", "event_id", "ts"]
    old, new = t.events.where("event_id % 2 = 0").select(*cols), t.events.where("event_id % 2 = 1").select(*cols)
    return V.upsert(old, new, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("A11_insert_if_absent", "SELECT DISTINCT md5(text) AS digest FROM documents WHERE NOT coalesce(lang = 'en', false) AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE lang = 'en')")
def _(t):
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    rows = t.documents.select("doc_id", F.md5("text").alias("digest"), english.alias("english"))
    return V.insert_if_absent(rows.where("english").drop("english"), rows.where("not english").drop("english"), ["digest"]).select("digest")


@query("A12_audit_rows", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, '{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' AS payload FROM events")
def _(t):
    from factlake.sources.sinks import audit_rows

    return audit_rows(t.events, "event_id", "ts", ["event_type", "user_id"])


@query("A13_published", "SELECT l_suppkey, count(*) AS n FROM lineitem JOIN (SELECT l_suppkey AS s, max(l_orderkey) AS v FROM lineitem GROUP BY 1) ON s = l_suppkey AND v = l_orderkey GROUP BY 1")
def _(t):
    from factlake.sources.sinks import published

    versions = t.lineitem.select("l_suppkey", F.col("l_orderkey").alias("version"), "l_linenumber")
    return published(versions, "l_suppkey", "version").groupBy("l_suppkey").agg(F.count("*").alias("n"))
