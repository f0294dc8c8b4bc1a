"""Further I, D, J, K, L and N queries on evidence, tables and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlake.functions import readings as R
from factlake.functions import tables as SQL
from factlake.functions import text as T
from factlake.functions import values as V
from factlake.operators import grids as G
from factlake.operators import joins as J
from factlake.operators import versions as W
from factlake.queries import query
from factlake.queries.derived import spread_rows, supplier_pages
from factlake.queries.documents import COS, GRID, INDEX, LINES, RECORDS, cells, index
from factlake.queries.pages import BLOCKS
from factlake.queries.streams import SILENT, folder


@query("I05_scalars")
def _(t):
    return t.documents.select("doc_id", F.explode(R.extract_scalars(F.col("text"))).alias("s")).select("doc_id", "s.*")


#: a line for each order that states a date, a range, a comparison and an amount
TERMS = "o_orderkey, CAST(o_orderdate AS DATE) AS day, 1 + o_orderkey % 9 AS a, 10 + o_orderkey % 50 AS b, CAST(floor(o_totalprice) AS BIGINT) AS p"


def stated_terms(t):
    number = lambda c: F.col(c).cast("string")
    rows = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), (1 + F.col("o_orderkey") % 9).alias("a"), (10 + F.col("o_orderkey") % 50).alias("b"), F.floor("o_totalprice").cast("long").alias("p"))
    return rows.withColumn("line", F.concat(F.lit("Since "), F.date_format("day", "dd.MM.yyyy"), F.lit(": "), number("a"), F.lit(" - "), number("b"), F.lit(" months at no more than "), number("b"), F.lit(",5%, paid "), F.format_number("p", 0), F.lit(" euros, note "), number("a")))


TYPED = f"""SELECT o_orderkey, v.* FROM (SELECT {TERMS} FROM orders), LATERAL (VALUES ('date', NULL, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL, CAST(day AS VARCHAR)), ('range', NULL, NULL, a, b, 'month', NULL), ('number', '<=', b + 0.5, NULL, NULL, 'percent', NULL), ('number', NULL, p, NULL, NULL, 'EUR', NULL)) v(kind, operator, value, low, high, unit, day)"""


@query("I05_typed_scalars", TYPED)
def _(t):
    return stated_terms(t).select("o_orderkey", F.explode(R.extract_scalars(F.col("line"))).alias("s")).select("o_orderkey", "s.kind", "s.operator", *(F.col(f"s.{c}").cast("double").alias(c) for c in ("value", "low", "high")), "s.unit", F.col("s.day").cast("string").alias("day"))


#: every reading of every number in DuckDB
READ = r"""list_distinct(list_filter(flatten(list_transform(regexp_extract_all({c}, '\d+(?:[.,\x{{00a0}} ]\d{{3}})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?'), lambda r: list_transform([replace(r, ',', ''), replace(r, ',', '.'), replace(replace(r, '.', ''), ',', '.'), translate(r, '.,', '')], lambda x: TRY_CAST(regexp_replace(x, '[\x{{00a0}} ]', '', 'g') AS DECIMAL(38, 6))))), lambda x: x IS NOT NULL))"""


#: multiplier words of each factor, as a pattern and a number
_TIMES = {1_000: "thousand|thsd", 1_000_000: "million|mln|mn|mio", 1_000_000_000: "billion|bln|bn"}
_SCALED = ", ".join(rf"CASE WHEN regexp_matches(lower(text), '\b({words})\b') THEN list_transform(r, lambda x: TRY_CAST(x * {factor} AS DECIMAL(38, 6))) ELSE [] END" for factor, words in _TIMES.items())


@query("I13_readings", f"SELECT doc_id, array_to_string(list_transform(list_sort(list_distinct(list_concat(r, {_SCALED}))), lambda x: CAST(x AS VARCHAR)), ' ') AS readings FROM (SELECT doc_id, text, {READ.format(c='text')} AS r FROM documents)")
def _(t):
    return t.documents.select("doc_id", F.array_join(F.transform(F.array_sort(R.number_readings(F.col("text"))), lambda x: x.cast("string")), " ").alias("readings"))


@query("I13_scaled_readings", "SELECT p_partkey, array_to_string(list_transform(list_sort(list_distinct([v, v * 12, v + 1, v * 1000000, f, f * 12, f + 1, f * 1000000])), lambda x: CAST(CAST(x AS DECIMAL(38, 6)) AS VARCHAR)), ' ') AS readings FROM (SELECT p_partkey, (p_size * 1000 + 234)::DECIMAL(38, 6) AS v, (p_size + 0.234)::DECIMAL(38, 6) AS f FROM part)")
def _(t):
    # 7.234 million is 7234 or a decimal, each also in millions, in months, and a month later
    line = F.concat(F.col("p_size").cast("string"), F.lit(".234 million years"))
    return t.part.select("p_partkey", F.array_join(F.transform(F.array_sort(R.number_readings(line, months=True)), lambda x: x.cast("string")), " ").alias("readings"))


@query("L05_reading_grounding", f"""SELECT doc_id, array_to_string(list_transform(list_sort(missing), lambda x: CAST(x AS VARCHAR)), ' ') AS missing FROM (SELECT doc_id, list_filter(claimed, lambda x: x <> 0 AND NOT list_contains(readings, x)) AS missing FROM (SELECT doc_id, {READ.format(c="split_part(text, chr(10), 1)")} AS claimed, {READ.format(c="substr(text, length(split_part(text, chr(10), 1)) + 1)")} AS readings FROM documents)) WHERE len(missing) > 0""")
def _(t):
    claim = F.split("text", "\n")[0]
    evidence = F.substring(F.col("text"), F.char_length(claim) + 1, F.char_length("text"))
    missing = R.ungrounded_numbers(R.number_readings(claim), evidence)
    return t.documents.select("doc_id", F.array_join(F.transform(F.array_sort(missing), lambda x: x.cast("string")), " ").alias("missing")).where("missing <> ''")


@query("I15_money_ranges", """SELECT p_partkey, CAST(CASE k WHEN 0 THEN a * 1000000 WHEN 1 THEN NULL WHEN 2 THEN a * 1000 ELSE a END AS DOUBLE) AS low, CAST(CASE k WHEN 0 THEN (a + 5) * 1000000 WHEN 1 THEN a * 1000 WHEN 2 THEN NULL ELSE a END AS DOUBLE) AS high, ['USD', 'EUR', 'AMD', NULL][k + 1] AS currency FROM (SELECT p_partkey, p_size AS a, p_partkey % 4 AS k FROM part)""")
def _(t):
    a, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    line = F.when(k == 0, F.concat(F.lit("USD "), a, F.lit("-"), (F.col("p_size") + 5).cast("string"), F.lit(" million"))).when(k == 1, F.concat(F.lit("Up to "), a, F.lit(",000 euros"))).when(k == 2, F.concat(F.lit("from "), a, F.lit(" thousand ֏"))).otherwise(a)
    return t.part.select("p_partkey", R.money_range(line).alias("m")).select("p_partkey", F.col("m.low").cast("double").alias("low"), F.col("m.high").cast("double").alias("high"), "m.currency")


@query("I15_lines", """SELECT p_partkey, CAST(a + 0.5 AS DOUBLE) AS rate_low, CASE WHEN p_partkey % 2 = 0 THEN 'fixed' ELSE 'unknown' END AS rate_type, CASE WHEN p_partkey % 3 > 0 THEN a * CASE WHEN p_partkey % 3 = 1 THEN 12 ELSE 1 END END AS high_months, p_partkey % 3 = 0 AS indefinite, CAST(a / 10 AS DOUBLE) AS fee_percent, CAST(a * 1000 AS DOUBLE) AS fee_low, a + 18 AS age_high, p_partkey % 2 = 1 AS allowed
    FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS a FROM part)""")
def _(t):
    k, a = F.col("p_partkey"), F.col("p_size").cast("string")
    rate = R.rate(F.concat(F.lit("from "), a, F.lit(".5%"), F.when(k % 2 == 0, ", fixed").otherwise("")))
    term = R.term(F.when(k % 3 == 0, F.lit("Indefinite term (until requested back)")).otherwise(F.concat(F.lit("at most "), a, F.when(k % 3 == 1, " years").otherwise(" months"))))
    fee = R.fee_line(F.concat((F.col("p_size") / 10).cast("decimal(10,1)").cast("string"), F.lit("% of the sum, minimum "), F.format_number(F.col("p_size") * 1000, 0), F.lit(" AMD")))
    age = R.age_range(F.concat(F.lit("aged 18 - "), (F.col("p_size") + 18).cast("string")))
    allowed = R.yes_no(F.when(k % 2 == 1, "It is available").otherwise("Not for all"))
    parts = spread_rows(t, t.part.select("p_partkey", "p_size"), "p_partkey", 20_000)
    return parts.select("p_partkey", rate["low"].cast("double").alias("rate_low"), rate["rate_type"].alias("rate_type"), term["high_months"].alias("high_months"), term["indefinite"].alias("indefinite"), fee["percent"].cast("double").alias("fee_percent"), fee["low"].cast("double").alias("fee_low"), age["high"].alias("age_high"), allowed.alias("allowed"))


@query("I12_effective_range", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS starts, CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_orderdate AS DATE) + 90 AS VARCHAR) END AS ends FROM orders")
def _(t):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    line = F.concat(F.lit("Valid from "), day, F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" until "), F.date_format(F.date_add("o_orderdate", 90), "yyyy-MM-dd"))).otherwise(""))
    r = t.orders.select("o_orderkey", V.effective_range(line).alias("r"))
    return r.select("o_orderkey", F.col("r.starts").cast("string").alias("starts"), F.col("r.ends").cast("string").alias("ends"))


@query("I15_rate_and_term", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS percent, CAST(CASE WHEN p_size % 2 = 0 THEN p_size * 12 ELSE p_size END AS BIGINT) AS months FROM part")
def _(t):
    line = F.concat(F.col("p_size").cast("string"), F.lit("% for "), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, " years").otherwise(" months"))
    return t.part.select("p_partkey", V.rate_and_term(line).alias("r")).select("p_partkey", "r.percent", "r.months")


@query("I18_renamed_keys", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS rate FROM events")
def _(t):
    renamed = V.renamed_keys(F.from_json("props", "map<string,string>"), {"k": "rate"})
    return t.events.select("event_id", renamed["rate"].alias("rate"))


@query("I22_stitched_quote", "SELECT doc_id, true AS holds FROM documents WHERE n_chars > 100")
def _(t):
    quote = F.concat(F.substring("text", 11, 10), F.lit(" … "), F.substring("text", 51, 20))
    return t.documents.where("n_chars > 100").select("doc_id", T.quote_holds(quote, F.col("text")).alias("holds"))


@query(
    "I47_line_diff",
    """WITH a AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
    b AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS n FROM (SELECT doc_id, unnest(string_split(t2, chr(10))) AS line, generate_subscripts(string_split(t2, chr(10)), 1) AS pos FROM (SELECT doc_id, text || CASE WHEN lang = 'en' THEN chr(10) || 'new' ELSE '' END AS t2 FROM documents)))
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, count(*) FILTER (a.n IS NULL) AS added, count(*) FILTER (b.n IS NULL) AS removed, count(*) FILTER (a.n IS NOT NULL AND b.n IS NOT NULL) AS kept FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.line = b.line AND a.n = b.n GROUP BY 1""",
)
def _(t):
    after = t.documents.withColumn("text", F.concat("text", F.when(F.col("lang") == "en", "\nnew").otherwise("")))
    return W.line_diff(t.documents, after, "doc_id", "text")


WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> ''))"


@query(
    "D14_near_pairs",
    f"""WITH s AS (SELECT item_id, list_sort({WORDS}) AS w FROM (SELECT item_id, text FROM benchmark UNION ALL SELECT item_id + 1000, text || ' extra' FROM benchmark))
    SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS score FROM s a JOIN s b ON a.item_id < b.item_id WHERE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.8""",
)
def _(t):
    rows = t.benchmark.select("item_id", "text").unionByName(t.benchmark.select((F.col("item_id") + 1000).alias("item_id"), F.concat("text", F.lit(" extra")).alias("text")))
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")
    return J.near_pairs(rows.select("item_id", words.alias("w")), "item_id", "w")


@query("J03_sections", f"SELECT table_id, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, text, CASE WHEN row < 2 THEN '' ELSE max(CASE WHEN row = 2 THEN text END) OVER (PARTITION BY table_id) END AS section FROM {GRID}")
def _(t):
    out = G.sections(G.trimmed(G.fill_spans(cells(t))))
    return out.select("table_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "text", "section")


@query("J22_row_records", f"SELECT table_id, CAST(row AS BIGINT) AS row, record FROM {RECORDS}")
def _(t):
    return G.row_records(G.trimmed(G.fill_spans(cells(t)))).withColumn("row", F.col("row").cast("long"))


@query("F14_continuations", f"SELECT table_id, CAST(row AS BIGINT) AS row, coalesce(lag(text) OVER (PARTITION BY table_id ORDER BY row) = text, false) AS completes FROM {GRID} WHERE col = 0")
def _(t):
    return G.continuation_links(G.fill_spans(cells(t))).withColumn("row", F.col("row").cast("long"))


@query("J08_ambiguities", f"SELECT table_id, 'repeated_row' AS issue, CAST(sum(n - 1) AS BIGINT) AS n FROM (SELECT table_id, count(*) AS n FROM {LINES} GROUP BY table_id, label, q, d, row = 3 HAVING count(*) > 1) GROUP BY 1 UNION ALL SELECT DISTINCT l_orderkey, 'no_header', CAST(1 AS BIGINT) FROM lineitem")
def _(t):
    return G.ambiguities(G.fill_spans(cells(t)))


@query("J18_temporal", "SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) + 90 < DATE '1996-01-01' THEN 'historical' WHEN CAST(o_orderdate AS DATE) > DATE '1996-01-01' THEN 'future' ELSE 'current' END AS temporal FROM orders")
def _(t):
    day = F.col("o_orderdate").cast("date")
    periods = F.array(F.struct(day.alias("starts"), F.date_add(day, 90).alias("ends")))
    return t.orders.select("o_orderkey", V.period_status(periods, F.lit("1996-01-01").cast("date")).alias("temporal"))


@query("K05_field_finder", "WITH h AS (SELECT p_brand AS field, min(CASE WHEN contains(p_name, 'red') THEN p_partkey END) AS best FROM part GROUP BY 1) SELECT field FROM h WHERE best IS NOT NULL ORDER BY best LIMIT 3")
def _(t):
    return t.part.where(F.contains("p_name", F.lit("red"))).groupBy(F.col("p_brand").alias("field")).agg(F.min("p_partkey").alias("best")).orderBy("best").limit(3).select("field")


@query(
    "K04_hybrid",
    f"""WITH i AS ({INDEX}), q(p) AS (VALUES ('license'), ('apache'), ('version')), h AS (SELECT doc_id AS id, round(count(*) / 3, 9) AS s FROM (SELECT DISTINCT doc_id, p FROM i JOIN q ON term = p) GROUP BY 1),
    v AS (SELECT vec_id AS id, {COS} AS s FROM embeddings WHERE vec_id <> 0), r AS (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY s DESC, id)) AS p FROM h UNION ALL SELECT id, 0.7 / (60 + row_number() OVER (ORDER BY s DESC, id)) FROM v)
    SELECT id, round(sum(p), 12) AS score FROM r GROUP BY 1 ORDER BY score DESC, id LIMIT 10""",
)
def _(t):
    from factlake.operators.ranking import reciprocal_ranks
    from factlake.operators.retrieval import lexical_search, vector_search

    words = lexical_search(index(t), "doc_id", [("license", False), ("apache", False), ("version", False)], None)
    q = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))
    near = vector_search(t.embeddings.where("vec_id <> 0"), q, "vec_id", "embedding", None)
    fused = reciprocal_ranks([(words, "doc_id", "score", 1.0), (near, "vec_id", "score", 0.7)]).withColumn("score", F.round("score", 12))
    return fused.orderBy(F.desc("score"), "id").limit(10)


@query("L09_thresholds")
def _(t):
    above = F.regexp_extract_all(F.lower("text"), F.lit(r"above (\d+) months"), 1)
    return t.documents.select("doc_id", F.transform(above, lambda x: x.cast("long") + 1).alias("starts"))


@query("L18_lost_field_gate", "SELECT DISTINCT a.user_id, a.event_type FROM events a WHERE a.ts < TIMESTAMP '2024-01-10' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = a.event_type AND b.ts >= TIMESTAMP '2024-01-25') AND EXISTS (SELECT 1 FROM events e WHERE e.user_id = a.user_id AND e.event_type = 'error')")
def _(t):
    gone = W.lost(t.events.where("ts < timestamp_ntz '2024-01-10'"), t.events.where("ts >= timestamp_ntz '2024-01-25'"), ["user_id", "event_type"])
    return gone.join(t.events.where("event_type = 'error'").select("user_id"), "user_id", "left_semi")


@query("L21_projection_check", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE p_partkey IS NULL OR p_size <= 0 OR l_quantity > 49")
def _(t):
    out = t.lineitem.join(t.part.select("p_partkey", "p_size"), F.col("p_partkey") == F.col("l_partkey"), "left")
    return out.where("p_partkey is null or p_size <= 0 or l_quantity > 49").select("l_orderkey", "l_linenumber", "l_partkey")


@query("L24_review_evidence", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY (length(text) - length(replace(text, 'the ', ''))) DESC, doc_id) AS rn FROM documents) WHERE rn <= 2")
def _(t):
    from factlake.operators.ranking import top_per_group

    seeds = F.char_length("text") - F.char_length(F.replace("text", F.lit("the "), F.lit("")))
    return top_per_group(t.documents.withColumn("seeds", seeds), ["source"], [F.desc("seeds"), F.asc("doc_id")], 2).select("source", "doc_id")


@query(
    "L24_evidence_set",
    """WITH c AS (SELECT p_partkey AS e, p_partkey // 2 AS unit, p_size % 3 AS p, p_name FROM part WHERE p_size <= 45),
    u AS (SELECT unit, min(p) AS p, list_distinct(list_filter(flatten(list(regexp_split_to_array(lower(p_name), '[^\\p{L}\\p{N}]+'))), lambda x: x <> '')) AS w FROM c GROUP BY 1),
    d AS (SELECT DISTINCT l_orderkey AS review, l_partkey AS e FROM lineitem),
    n AS (SELECT review, unit, count(*) AS n, string_agg(CAST(e AS VARCHAR), ',' ORDER BY e) AS seeds FROM d JOIN c USING (e) GROUP BY ALL),
    r AS (SELECT review, unit, seeds, w, row_number() OVER (PARTITION BY review ORDER BY n DESC, p, unit) AS k FROM n JOIN u USING (unit)),
    a AS (SELECT review, unit, seeds, w FROM r WHERE k = 1),
    b AS (SELECT r.review, arg_min(r.unit, k) AS unit, arg_min(r.seeds, k) AS seeds FROM r JOIN a ON a.review = r.review AND k > 1
        WHERE 10 * len(list_intersect(r.w, a.w)) < 8 * (len(r.w) + len(a.w) - len(list_intersect(r.w, a.w))) GROUP BY 1),
    x AS (SELECT review, string_agg(CAST(e AS VARCHAR), ',' ORDER BY e) AS unknown_ids FROM d ANTI JOIN c USING (e) GROUP BY 1)
    SELECT review, concat_ws(';', a.unit || ':' || a.seeds, b.unit || ':' || b.seeds) AS units, coalesce(unknown_ids, '') AS unknown_ids
    FROM (SELECT DISTINCT review FROM d) LEFT JOIN a USING (review) LEFT JOIN b USING (review) LEFT JOIN x USING (review)""",
)
def _(t):
    from factlake.operators.review import review_evidence

    key = F.col("p_partkey")
    unit = F.floor(key / 2).cast("long")
    catalog = t.part.where("p_size <= 45").select(key.alias("evidence_id"), unit.alias("unit"), (F.col("p_size") % 3).alias("precedence"), unit.alias("at"), F.col("p_name").alias("content"))
    found = review_evidence(t.lineitem.select(F.col("l_orderkey").alias("review"), F.col("l_partkey").alias("evidence_id")), catalog)
    shown = F.transform("units", lambda u: F.concat_ws(":", u["unit"].cast("string"), F.array_join(u["seeds"].cast("array<string>"), ",")))
    return found.select("review", F.coalesce(F.array_join(shown, ";"), F.lit("")).alias("units"), F.coalesce(F.array_join(F.col("unknown_ids").cast("array<string>"), ","), F.lit("")).alias("unknown_ids"))


@query("A14_report", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    from factlake.sources.sinks import write_report

    at = folder(t, "report")
    write_report({"runs": t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")), "other": t.orders.limit(1)}, at, "runs")
    return t.spark.read.schema("o_orderstatus string, n long").json(f"{at}/runs")


@query("O01_registries", "SELECT p_partkey, label FROM part JOIN (VALUES ('red', 'warm'), ('blue', 'cold')) v(term, label) ON contains(' ' || p_name || ' ', ' ' || term || ' ')")
def _(t):
    terms = t.spark.createDataFrame([("red", "warm"), ("blue", "cold")], "term string, label string")
    return J.term_matches(t.part, terms, "p_partkey", "p_name").select("p_partkey", "label")


@query("O02_sql_functions", "SELECT p_partkey, lower(p_name) AS key FROM part")
def _(t):
    SQL.register_functions(t.spark)
    return t.part.select("p_partkey", F.expr("collapsed(concat('  ', upper(p_name), '  '))").alias("key"))


@query("C21_trace", "SELECT 'loaded' AS stage, count(*) AS n FROM lineitem UNION ALL SELECT 'returned', count(*) FILTER (l_returnflag = 'R') FROM lineitem UNION ALL SELECT 'priced', count(*) FILTER (l_returnflag = 'R' AND l_extendedprice > 50000) FROM lineitem")
def _(t):
    from factlake.operators.reads import traced

    steps = [("loaded", F.lit(True)), ("returned", F.col("l_returnflag") == "R"), ("priced", F.col("l_extendedprice") > 50000)]
    return traced(t.lineitem, steps)


@query("J12_oversize_parts")  # texts above 2,000 characters are the feature
def _(t):
    from factlake.operators.packing import pack

    lines = t.documents.where("n_chars > 2000").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return pack(lines, ["doc_id"], "ord", "line", 2000)


@query("J14_compact_tables", f"SELECT table_id, CAST(row AS BIGINT) AS row, record FROM (SELECT *, sum(length(record)) OVER (PARTITION BY table_id ORDER BY row) AS used FROM {RECORDS}) WHERE used <= 160")
def _(t):
    from factlake.operators.packing import within_budget

    records = G.row_records(G.trimmed(G.fill_spans(cells(t)))).withColumn("size", F.char_length("record"))
    return within_budget(records, ["table_id"], [F.asc("row")], "size", 160).select("table_id", F.col("row").cast("long").alias("row"), "record")


@query(
    "J26_packets",
    """WITH r AS (SELECT source, doc_id // 50 AS packet_no, doc_id, lang, text, row_number() OVER w AS n, lag(lang) OVER w AS p FROM documents WINDOW w AS (PARTITION BY source, doc_id // 50 ORDER BY doc_id))
    SELECT source, packet_no, string_agg(CASE WHEN n = 1 OR lang IS DISTINCT FROM p THEN '## ' || lang || chr(10) || text ELSE text END, chr(10) ORDER BY doc_id) AS packet FROM r GROUP BY ALL""",
)
def _(t):
    from factlake.operators.grids import render_packets

    rows = t.documents.select("source", "doc_id", F.col("lang").alias("header"), F.col("text").alias("content"))
    return render_packets(rows, "source", "doc_id", "header", "content", 50)


@query("L08_canonical_citation")
def _(t):
    from factlake.queries.derived import parsed_pages
    from factlake.sources.pages import parse_blocks

    heads = parse_blocks(parsed_pages(t)).where("type = 'heading'").groupBy("page_id").agg(F.min("text").alias("name"))
    return heads.join(t.pages.select("page_id", "url"), "page_id").where(~F.contains(F.lower("url"), F.lower("name"))).select("page_id", "name")


@query(
    "L08_anchored_names",
    """WITH e AS (SELECT l_orderkey AS batch, concat_ws('-', l_orderkey, l_linenumber, l_suppkey) AS evidence_id, l_suppkey, l_discount >= 0.05 AS cited FROM lineitem),
    c AS (SELECT l_orderkey AS batch, arg_min(l_suppkey, l_linenumber * 1000000000000 + l_suppkey) AS home FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
    h AS (SELECT e.batch, count(DISTINCT evidence_id) AS candidates, count(DISTINCT evidence_id) FILTER (cited) AS cited FROM e JOIN c ON e.batch = c.batch AND l_suppkey = home GROUP BY 1)
    SELECT o_orderkey AS batch, coalesce(candidates, 0) AS candidates, coalesce(cited, 0) AS cited, coalesce(candidates, 0) = 0 OR cited > 0 AS anchored FROM orders LEFT JOIN h ON batch = o_orderkey WHERE o_orderstatus = 'O'""",
)
def _(t):
    from factlake.operators.checks import canonical_citations

    page = F.concat(F.lit("https://Shop.example/Supplier/"), F.col("l_suppkey").cast("string"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("batch"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("evidence_id"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.upper(page), F.lit("/"))).otherwise(page).alias("url"), "l_suppkey", "l_linenumber", "l_returnflag", "l_discount")
    home = lines.where("l_returnflag <> 'R'").groupBy("batch").agg(F.min_by("url", F.struct("l_linenumber", "l_suppkey")).alias("url"))
    cited = lines.where("l_discount >= 0.05").select(F.col("batch").alias("result"), "evidence_id")
    named = t.orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("result"), F.col("o_orderkey").alias("batch"))
    return canonical_citations(named, cited, lines, home).drop("result")


@query("N09_freshness_alerts", SILENT.format(hours=6))
def _(t):
    from factlake.queries.streams import ended, events
    from factlake.streaming.jobs import silent_keys

    return ended(t, silent_keys(events(t), 0.25), "update")


@query("O03_chunk_function")
def _(t):
    SQL.register_functions(t.spark)
    t.documents.select("doc_id", "text").createOrReplaceTempView("factlake_documents")
    return t.spark.sql("select doc_id, c.ordinal, c.content from factlake_documents, lateral chunks(text, 1500) c")


@query("O03_scalar_function", TYPED)
def _(t):
    SQL.register_functions(t.spark)
    stated_terms(t).createOrReplaceTempView("factlake_terms")
    return t.spark.sql("select o_orderkey, s.kind, s.operator, cast(s.value as double) as value, cast(s.low as double) as low, cast(s.high as double) as high, s.unit, cast(s.day as string) as day from factlake_terms, lateral scalar_spans(line) s")


@query("O03_block_function", f"SELECT page_id, ord, type, text, heading_path, chrome FROM {BLOCKS}")
def _(t):
    SQL.register_functions(t.spark)
    supplier_pages(t).createOrReplaceTempView("factlake_supplier_pages")
    return t.spark.sql("select page_id, ord, type, text, heading_path, chrome from factlake_supplier_pages, lateral html_blocks(html)")


@query("O02_text_functions", f"SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[''’`]', '', 'g'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 1 AND x NOT IN ({', '.join(repr(w) for w in T.STOPWORDS)}))) AS tokens, instr(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'the') AS place, array_to_string(list_transform(list_sort({READ.format(c='text')}), lambda x: CAST(x AS VARCHAR)), ' ') AS readings FROM documents")
def _(t):
    SQL.register_functions(t.spark)
    t.documents.select("doc_id", "text").createOrReplaceTempView("factlake_documents")
    # one registered function calls another: a quote is found whatever its case and spacing
    return t.spark.sql("select doc_id, cast(size(search_tokens(text)) as bigint) as tokens, cast(quote_position(text, 'THE ') as bigint) as place, array_join(transform(array_sort(number_readings(text)), x -> cast(x as string)), ' ') as readings from factlake_documents")
