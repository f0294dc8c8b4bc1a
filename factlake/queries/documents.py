"""J, K and L: document structuring, retrieval and checks on documents and cells."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factlake.functions import text as T
from factlake.operators import checks as C
from factlake.operators import grids as G
from factlake.operators import packing as P
from factlake.operators import retrieval as R
from factlake.queries import query

#: lines of orders that a task takes: some three cells are made from each
_LINES_OF_TASK = 500_000


def lines_by_order(t, *columns):
    """The lines with their order as ``table_id``, all of an order in one task; tasks grow in number, not in size, with the table."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("table_id"), *columns)
    tasks = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), t.lineitem.count() // _LINES_OF_TASK + 1)
    return lines.repartition(tasks, "table_id")


def cells(t):
    """A table for each order: stacked headers, a full-width section row, a row per line; lines in a row with one label share its cell."""
    by_table = Window.partitionBy("table_id")
    w = by_table.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    label = F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")).otherwise(F.concat("l_returnflag", F.col("l_linenumber").cast("string")))
    number = lambda c: c.cast("long").cast("string")
    lines = lines_by_order(t, "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    lines = lines.select("table_id", (2 + F.row_number().over(w)).alias("row"), label.alias("label"), number(F.col("l_quantity")).alias("q"), F.concat(number(F.round(F.col("l_discount") * 100)), F.lit("%")).alias("d"), F.max("l_linestatus").over(by_table).alias("s"))
    by_row = by_table.orderBy("row")
    lines = lines.withColumn("opens", F.coalesce(F.col("label") != F.lag("label").over(by_row), F.lit(True))).withColumn("run", F.sum(F.col("opens").cast("int")).over(by_row.rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumn("n", F.count("*").over(Window.partitionBy("table_id", "run")))
    cell = lambda row, col, rows, cols, text, header: F.struct(row.alias("row"), F.lit(col).alias("col"), rows.cast("int").alias("rowspan"), F.lit(cols).alias("colspan"), text.alias("text"), F.lit(header).alias("is_header"), F.lit(False).alias("bold"))
    at, one, r = F.lit, F.lit(1), F.col("row")
    # an order's first line brings the table's head, a run's first line its label
    heads = [cell(at(0), 0, one, 1, at("Flag"), True), cell(at(0), 1, one, 2, F.concat(at("Amount "), "s"), True), cell(at(1), 1, one, 1, at("Quantity"), True), cell(at(1), 2, one, 1, at("Discount"), True), cell(at(2), 0, one, 3, F.concat(at("Lines "), "s"), False), cell(at(3), 3, one, 1, at(""), False)]
    made = [*(F.when(r == 3, c) for c in heads), F.when(F.col("opens"), cell(r, 0, F.col("n"), 1, F.col("label"), False)), cell(r, 1, one, 1, F.col("q"), False), cell(r, 2, one, 1, F.col("d"), False)]
    return lines.select("table_id", F.explode(F.array_compact(F.array(*made))).alias("c")).select("table_id", "c.*")


LINES = """(SELECT l_orderkey AS table_id, 2 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS row, CASE WHEN l_linestatus = 'O' THEN l_returnflag ELSE l_returnflag || CAST(l_linenumber AS VARCHAR) END AS label,
    CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q, CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) || '%' AS d FROM lineitem)"""
ORDERS = "(SELECT l_orderkey AS table_id, max(l_linestatus) AS s FROM lineitem GROUP BY 1)"
GRID = f"""(SELECT table_id, row, 0 AS col, label AS text FROM {LINES} UNION ALL SELECT table_id, row, 1, q FROM {LINES} UNION ALL SELECT table_id, row, 2, d FROM {LINES} UNION ALL SELECT table_id, 0, 0, 'Flag' FROM {ORDERS}
    UNION ALL SELECT table_id, 0, c, 'Amount ' || s FROM {ORDERS}, (VALUES (1), (2)) v(c) UNION ALL SELECT table_id, 1, c, x FROM {ORDERS}, (VALUES (1, 'Quantity'), (2, 'Discount')) v(c, x) UNION ALL SELECT table_id, 2, c, 'Lines ' || s FROM {ORDERS}, (VALUES (0), (1), (2)) v(c))"""
RECORDS = f"""(SELECT table_id, row, 'Flag: ' || label || ' | Amount ' || s || ' / Quantity: ' || q || ' | Amount ' || s || ' / Discount: ' || d AS record FROM {LINES} JOIN {ORDERS} USING (table_id)
    UNION ALL SELECT table_id, 2, 'Flag: Lines ' || s || ' | Amount ' || s || ' / Quantity: Lines ' || s || ' | Amount ' || s || ' / Discount: Lines ' || s FROM {ORDERS})"""


@query("J01_grid", f"SELECT table_id, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, text FROM {GRID}")
def _(t):
    return G.trimmed(G.fill_spans(cells(t))).select("table_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "text")


@query("J02_column_headers", f"SELECT table_id, CAST(c AS BIGINT) AS col, CASE c WHEN 0 THEN 'Flag' WHEN 1 THEN 'Amount ' || s || ' / Quantity' ELSE 'Amount ' || s || ' / Discount' END AS path FROM {ORDERS}, (VALUES (0), (1), (2)) v(c)")
def _(t):
    return G.column_headers(G.fill_spans(cells(t))).select("table_id", F.col("col").cast("long").alias("col"), "path")


@query("J04_cell_paths", f"""WITH l AS (SELECT *, label IS DISTINCT FROM lag(label) OVER (PARTITION BY table_id ORDER BY row) AS opens, bool_or(regexp_matches(label, '[0-9]')) OVER (PARTITION BY table_id) AS headed FROM {LINES})
    SELECT table_id, row, col, CASE col WHEN 0 THEN 'Flag' WHEN 1 THEN 'Amount ' || s || ' / Quantity' ELSE 'Amount ' || s || ' / Discount' END AS path FROM l JOIN {ORDERS} USING (table_id), (VALUES (0::BIGINT), (1), (2)) v(col) WHERE col > 0 OR (opens AND headed)""")
def _(t):
    return G.cell_paths(cells(t)).select("table_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "path")


@query("F04_carried_sections", """WITH e AS (SELECT user_id, event_id, ts, CAST(ts AS DATE) AS d, CASE WHEN event_type = 'purchase' THEN props END AS section, CASE WHEN event_type = 'error' THEN 'error ' || event_id END AS sub FROM events),
    n AS (SELECT *, count(section) OVER w AS k, last_value(section IGNORE NULLS) OVER w AS s, last_value(CASE WHEN sub IS NOT NULL THEN event_id END IGNORE NULLS) OVER w AS u FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT n.user_id, n.event_id, nullif(concat_ws(' > ', n.s, CASE WHEN o.k = n.k AND o.d = n.d THEN o.sub END), '') AS path FROM n LEFT JOIN n o ON o.event_id = n.u AND o.user_id = n.user_id WHERE n.section IS NULL AND n.sub IS NULL""")
def _(t):
    kind = F.col("event_type")
    ts = F.col("ts").cast("timestamp")
    rows = t.events.select("user_id", "event_id", ts.alias("ts"), ts.cast("date").alias("day"), F.when(kind == "purchase", F.col("props")).alias("section"), F.when(kind == "error", F.concat(F.lit("error "), F.col("event_id").cast("string"))).alias("sub"))
    out = G.carried_sections(rows, "user_id", ["ts", "event_id"], "section", "sub", "day")
    return out.where("section is null and sub is null").select("user_id", "event_id", "path")


@query("J05_stub_width", "SELECT l_orderkey AS table_id, CAST(CASE WHEN bool_and(l_linestatus = 'O') THEN 1 ELSE 0 END AS BIGINT) AS width FROM lineitem GROUP BY 1")
def _(t):
    return G.stub_width(G.trimmed(G.fill_spans(cells(t))))


@query("J06_continuations")
def _(t):
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return G.merge_continuations(rows.withColumn("continues", F.regexp_like("line", F.lit("^[a-z]"))), "doc_id", "ord", "line", "continues")


@query("J13_context", "SELECT doc_id FROM (SELECT doc_id, source, sum(greatest(n_chars, 1)) OVER (PARTITION BY source ORDER BY (length(text) - length(replace(text, 'the ', ''))) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM documents) WHERE used <= 12000")
def _(t):
    score = F.char_length("text") - F.char_length(F.replace("text", F.lit("the "), F.lit("")))
    return P.within_budget(t.documents.withColumn("s", score), ["source"], [F.desc("s"), F.asc("doc_id")], "n_chars", 12000, parts=16).select("doc_id")


@query("J16_admission", "SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'legal' WHEN n_chars < 200 THEN 'thin' WHEN lang <> 'en' THEN 'foreign' ELSE 'relevant' END AS label FROM documents")
def _(t):
    return C.first_rule(t.documents, [("legal", F.contains(F.lower("text"), F.lit("license"))), ("thin", F.col("n_chars") < 200), ("foreign", F.col("lang") != "en")], "relevant").select("doc_id", "label")


@query("J17_selected_links", "SELECT min(doc_id) AS doc_id FROM documents WHERE n_chars >= 200 GROUP BY sha256(text)")
def _(t):
    return t.documents.where("n_chars >= 200").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("J19_inherited", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'own' ELSE o_orderstatus END AS label FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def _(t):
    rows = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "R", "own").otherwise(F.col("o_orderstatus")).alias("label"))


@query("J20_source_selection", "SELECT source, arg_min(doc_id, (CASE WHEN quality = 1 THEN 0 WHEN quality IS NULL THEN 1 ELSE 2 END) * 1000000000::BIGINT + doc_id) AS doc_id FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def _(t):
    from factlake.operators.ranking import lowest_rank

    rows = t.documents.join(t.labels, "doc_id", "left").withColumn("r", F.when(F.col("quality") == 1, 0).when(F.col("quality").isNull(), 1).otherwise(2))
    return lowest_rank(rows, ["source"], "r", "doc_id").drop("r")


@query("J21_evidence_catalog", "SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) WHERE trim(line) <> ''")
def _(t):
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line") != "")
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


@query("J23_units", "SELECT source, lang, doc_id // 1000 AS part, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS members FROM documents GROUP BY ALL")
def _(t):
    members = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    return t.documents.groupBy("source", "lang", F.floor(F.col("doc_id") / 1000).alias("part")).agg(members.alias("members"))


@query("J25_packet_ceiling", "SELECT source, CAST(sum(n_chars) AS BIGINT) AS chars, sum(n_chars) > 150000 AS over FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy("source").agg(F.sum("n_chars").alias("chars"), (F.sum("n_chars") > 150000).alias("over"))


@query("J33_manifest", "SELECT doc_id, CASE WHEN quality = 1 THEN 'selected' WHEN quality = 0 THEN 'excluded' ELSE 'unlabelled' END AS part FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    q = F.col("quality")
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.when(q == 1, "selected").when(q == 0, "excluded").otherwise("unlabelled").alias("part"))


@query("F08_packed_chunks")
def _(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return P.pack(lines, ["doc_id"], "ord", "line", 1200)


@query("F09_packed_batches")
def _(t):
    # a batch never crosses a run of 1,000 ids, so runs of a large source are packed side by side
    rows = t.documents.select("source", F.floor(F.col("doc_id") / 1000).alias("run"), F.col("doc_id").alias("ord"), F.col("text").alias("line"))
    return P.pack(rows, ["source", "run"], "ord", "line", 20_000, most_items=8)


@query("J24_budgeted_evidence")
def _(t):
    scored = t.documents.select("source", "doc_id", "n_chars", F.col("lang").alias("field"), F.regexp_count("text", F.lit("the ")).alias("score"))
    return P.fair_share(scored, "source", "field", "doc_id", "score", "n_chars", 12_000)


@query("J27_chunks")
def _(t):
    return P.chunks(t.documents, "doc_id", "text", 1500)


# ---------------------------------------------------------------- retrieval

INDEX = "SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) > 1)) AS term FROM documents) GROUP BY ALL"


def index(t):
    return R.lexical_index(t.documents, "doc_id", {"text": 1.0})


@query("K01_lexical_index", f"SELECT doc_id, term, CAST(n AS DOUBLE) AS weight FROM ({INDEX})")
def _(t):
    return index(t)


@query("K02_lexical_search", f"WITH i AS ({INDEX}), q(p, pre) AS (VALUES ('license', false), ('ver', true), ('apache', false)), h AS (SELECT doc_id, p FROM i JOIN q ON CASE WHEN pre THEN starts_with(term, p) ELSE term = p END GROUP BY ALL) SELECT doc_id, round(count(*) / 3, 9) AS score FROM h GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 20")
def _(t):
    return R.lexical_search(index(t), "doc_id", [("license", False), ("ver", True), ("apache", False)], 20)


#: postings in DuckDB: the first line weighs 10, language and source 4, the text 2
_FIELDS = {"split_part(text, chr(10), 1)": 10, "lang": 4, "source": 4, "text": 2}
_TERMS = " UNION ALL ".join(f"SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 1)) AS term, {w} AS w FROM documents" for c, w in _FIELDS.items())
POSTINGS = f"(SELECT doc_id, term, count(*) AS count, CAST(sum(w) AS BIGINT) AS weight FROM ({_TERMS}) GROUP BY ALL)"
WANTED = [("license", False), ("ver", True), ("über", False), ("éc", True), ("apache", False)]


def stored_index(t):
    from factlake.sources.shared import written_once

    docs = t.documents.select("doc_id", F.split("text", "\n")[0].alias("head"), "lang", "source", "text")
    return written_once(t.spark, "lexical-index", t.sf_dir, lambda: R.postings(docs, "doc_id", {"head": 10, "lang": 4, "source": 4, "text": 2}), "bucket")


@query("K01_stored_index", f"SELECT doc_id, term, count, weight FROM {POSTINGS}")
def _(t):
    return stored_index(t).select("doc_id", "term", "count", "weight")


@query("K02_weighted_search", f"SELECT doc_id, CAST(sum(weight) AS BIGINT) AS score, count(*) AS terms FROM {POSTINGS} WHERE {' OR '.join(f"starts_with(term, '{w}')" if prefix else f"term = '{w}'" for w, prefix in WANTED)} GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 50")
def _(t):
    return R.search_postings(stored_index(t), "doc_id", WANTED, 50)


COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"


@query("K03_vector_search", f"SELECT vec_id, round({COS}, 6) AS score FROM embeddings WHERE vec_id <> 0 ORDER BY {COS} DESC, vec_id LIMIT 10")
def _(t):
    q = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return R.vector_search(t.embeddings.where("vec_id <> 0"), q, "vec_id", "embedding", 10).withColumn("score", F.round("score", 6))


@query("K06_query_terms", "SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda x: x NOT IN ('red', 'blue')), ' ') AS terms FROM part")
def _(t):
    return t.part.select("p_partkey", F.array_join(F.array_except(F.split("p_name", " "), F.array(F.lit("red"), F.lit("blue"))), " ").alias("terms"))


@query("K07_backlog", "SELECT min(doc_id) AS doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY sha256(text)")
def _(t):
    return R.embedding_backlog(t.documents, t.embeddings.withColumnRenamed("vec_id", "doc_id"), "doc_id", "text").select("doc_id")


@query("K08_vector_validity", "SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AS valid FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", R.valid_vector(F.col("embedding"), 64).alias("valid"))


#: labels as they might be read off a scan, each with a wrong, a missing or an added letter
LABELS = ["licensed under the apach licence", "the and atttion to thanedbel", "nicht aulich fur schh eruver", "en lalenelle la des ct"]
_ACCENTS = ("äçèéêëíñóöúüß", "aceeeeinoouus")
_FOLDED = "translate(lower({}), '" + "', '".join(_ACCENTS) + "')"


@query(
    "K09_label_location",
    f"""WITH n AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS ord, unnest(p) AS line FROM (SELECT doc_id, string_split({_FOLDED.format("text")}, chr(10)) AS p FROM documents)),
    q AS (SELECT {_FOLDED.format("l")} AS label FROM (VALUES {", ".join(f"('{x}')" for x in LABELS)}) v(l)),
    p AS (SELECT doc_id, ord, line, label, unnest(range(greatest(1, length(line) - length(label) + 1))) AS start FROM n, q WHERE line <> ''),
    s AS (SELECT *, levenshtein(label, substr(line, start + 1, length(label))) AS e FROM p),
    b AS (SELECT * FROM s WHERE 10 * e <= 2 * length(label) QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY e, ord, start) = 1)
    SELECT doc_id, label, CAST(ord AS INT) AS ord, CAST(start AS INT) AS start, round(1 - e / length(label), 9) AS similarity, substr(line, start + length(label) + 1) AS rest FROM b""",
)
def _(t):
    folded = lambda c: F.translate(F.lower(c), *_ACCENTS)
    labels = t.spark.createDataFrame([(x,) for x in LABELS], "label string").select(folded("label").alias("label"))
    lines = t.documents.select("doc_id", F.posexplode(F.split(folded("text"), "\n")).alias("ord", "line"))
    return R.locate_labels(labels, lines, ["doc_id", "ord"], "label", "line", 0.8, ["doc_id"]).withColumn("similarity", F.round("similarity", 9))


# ---------------------------------------------------------------- checks


@query("L01_expectations", "SELECT 'orders' AS tbl, 'status' AS rule, CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_orderstatus NOT IN ('O', 'F') UNION ALL SELECT 'orders', 'positive', CAST(o_orderkey AS VARCHAR) FROM orders WHERE NOT o_totalprice > 1000")
def _(t):
    return C.violations("orders", t.orders, "o_orderkey", {"status": F.col("o_orderstatus").isin("O", "F"), "positive": F.col("o_totalprice") > 1000})


@query("L02_tri_state", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_returnflag = 'N' AND l_discount = 0) OR (l_returnflag = 'A' AND l_discount > 0)")
def _(t):
    status = F.when(F.col("l_returnflag") == "N", "found").when(F.col("l_returnflag") == "A", "not_stated").otherwise("ambiguous")
    bad = C.tri_state(status, F.when(F.col("l_discount") > 0, F.col("l_discount")), F.when(F.col("l_returnflag") == "A", F.when(F.col("l_discount") > 0, 1).otherwise(0)).otherwise(1))
    return t.lineitem.where(~bad).select("l_orderkey", "l_linenumber", "l_partkey")


@query("L03_citation_boundary", "SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(t):
    cited = t.benchmark.select("item_id")
    return cited.join(t.labels.where("quality = 1").select(F.col("doc_id").alias("item_id")), "item_id", "left_anti")


@query("L04_cardinality", "SELECT o_orderkey, coalesce(n, 0) AS received, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'ok' ELSE 'duplicate' END AS verdict FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey")
def _(t):
    got = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return C.cardinality(t.orders.select("o_orderkey"), got, "o_orderkey")


@query("L05_grounding", "SELECT doc_id FROM (SELECT doc_id, text, split_part(text, chr(10), 1) AS claim FROM documents) WHERE len(list_filter(regexp_extract_all(claim, '\\d+'), lambda x: NOT list_contains(regexp_extract_all(substr(text, length(claim) + 1), '\\d+'), x))) > 0")
def _(t):
    # the first line is the claim, the rest of the text its evidence
    claim = F.split("text", "\n")[0]
    evidence = F.substring(F.col("text"), F.char_length(claim) + 1, F.char_length("text"))
    return t.documents.where(C.ungrounded(F.regexp_extract_all(claim, F.lit(r"(\d+)"), 1), evidence)).select("doc_id")


@query("L06_alternatives", "SELECT l_orderkey, l_returnflag FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) > 1")
def _(t):
    return C.alternatives(t.lineitem, ["l_orderkey", "l_returnflag"], "l_suppkey").select("l_orderkey", "l_returnflag")


@query("L07_related_only", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_linestatus = 'F')")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.bool_and(F.col("l_linestatus") == "F").alias("b")).where("b").select("l_orderkey")


@query("L10_wording", "SELECT doc_id, regexp_matches(text, '(?i)licensed under') AS stated FROM documents")
def _(t):
    return t.documents.select("doc_id", F.regexp_like("text", F.lit("(?i)licensed under")).alias("stated"))


@query("L11_category", "SELECT p_partkey FROM part WHERE NOT starts_with(p_type, split_part(p_type, ' ', 1)) OR p_brand <> 'Brand#11'")
def _(t):
    family = t.spark.createDataFrame([("Brand#11",)], "p_brand string")
    return t.part.join(family, "p_brand", "left_anti").select("p_partkey")


@query("L12_acceptability", "SELECT o_orderkey, coalesce(ok, false) AS acceptable FROM orders LEFT JOIN (SELECT l_orderkey, bool_and(l_returnflag <> 'R') AND bool_or(l_linestatus = 'O') AS ok FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def _(t):
    ok = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.bool_and(F.col("l_returnflag") != "R") & F.bool_or(F.col("l_linestatus") == "O")).alias("ok"))
    return t.orders.select("o_orderkey").join(ok, "o_orderkey", "left").select("o_orderkey", F.coalesce("ok", F.lit(False)).alias("acceptable"))


@query("L13_signals", "SELECT DISTINCT user_id, CASE WHEN event_type = 'error' THEN 'conflict' WHEN value > 95 THEN 'large' ELSE 'missing' END AS reason FROM events WHERE event_type = 'error' OR value > 95 OR value < 1")
def _(t):
    return C.signals(t.events, ["user_id"], [("conflict", F.col("event_type") == "error"), ("large", F.col("value") > 95), ("missing", F.col("value") < 1)])


@query("L14_large_change", "SELECT event_id FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE event_type = 'purchase') WHERE abs(value - p) >= 60")
def _(t):
    from factlake.operators.versions import with_previous

    rows = with_previous(t.events.where("event_type = 'purchase'"), "user_id", ["ts", "event_id"], ["value"])
    return rows.where(F.abs(F.col("value") - F.col("prev_value")) >= 60).select("event_id")


@query("L15_single_percentage", "SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '\\d+(?:\\.\\d+)?')) = 1")
def _(t):
    return t.documents.where(F.size(F.regexp_extract_all("text", F.lit(r"(\d+(?:\.\d+)?)"), 1)) == 1).select("doc_id")


@query("L16_completeness", "SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars < 300 THEN 'short' END, CASE WHEN NOT contains(text, chr(10)) THEN 'flat' END], lambda x: x IS NOT NULL), ',') AS reasons FROM documents WHERE n_chars < 300 OR NOT contains(text, chr(10))")
def _(t):
    return C.reasons(t.documents, {"short": F.col("n_chars") < 300, "flat": ~F.contains("text", F.lit("\n"))}).select("doc_id", "reasons")


@query("L17_regression", "SELECT event_id FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE event_type = 'purchase') WHERE p > 0 AND value <= p * 0.5")
def _(t):
    from factlake.operators.versions import with_previous

    rows = with_previous(t.events.where("event_type = 'purchase'"), "user_id", ["ts", "event_id"], ["value"])
    return rows.where((F.col("prev_value") > 0) & (F.col("value") <= F.col("prev_value") * 0.5)).select("event_id")


@query("L17_cascading_baseline", """WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    f AS (SELECT user_id, event_id, n, value AS base, TRUE AS passed, NULL::DOUBLE AS baseline FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN NOT f.base > 0 OR e.value > f.base * 0.5 THEN e.value ELSE f.base END, NOT f.base > 0 OR e.value > f.base * 0.5, f.base FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
    SELECT user_id, event_id, passed, baseline FROM f""")
def _(t):
    return P.baseline_gate(t.events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value"), "user_id", "event_id", "value", 0.5)


@query("L20_integrity", "SELECT o_orderkey FROM orders JOIN (SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_discount > 0 THEN 1 ELSE 0 END) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE n IS DISTINCT FROM m")
def _(t):
    per = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0).alias("m"))
    return t.orders.join(per, "o_orderkey").where(~F.col("n").eqNullSafe(F.col("m"))).select("o_orderkey")


@query("L22_term_collisions", "SELECT lower(split_part(p_name, ' ', 1)) AS term, count(DISTINCT p_brand) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def _(t):
    return t.part.groupBy(T.term_key(F.split("p_name", " ")[0]).alias("term")).agg(F.count_distinct("p_brand").alias("n")).where("n > 1")


@query("L23_activation", "SELECT o_orderkey FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) JOIN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag <> 'R')) ON l_orderkey = o_orderkey WHERE rn = 1")
def _(t):
    from factlake.operators.versions import active_versions

    approved = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_and(F.col("l_returnflag") != "R").alias("ok")).where("ok")
    return active_versions(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"]).where("is_active").join(approved, "o_orderkey", "left_semi").select("o_orderkey")


@query("L25_orphans", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_linestatus = 'O'")
def _(t):
    closed = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.where("l_linestatus = 'O'").join(closed, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")
