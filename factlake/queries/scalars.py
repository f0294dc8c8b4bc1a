"""I: scalar functions, each projected with the row key."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlake.functions import text as T
from factlake.functions import values as V
from factlake.queries import query

line = "split_part(text, chr(10), 1)"


def first_line(t):
    return t.documents.select("doc_id", F.split("text", "\n")[0].alias("line"))


def scalar(name, table, key, expression, sql):
    """A query of one expression over one table."""

    @query(name, sql)
    def _(t):
        return getattr(t, table).select(key, expression().alias("value"))


scalar("I01_normalize_text", "documents", "doc_id", lambda: T.normalize_text(F.col("text")), "SELECT doc_id, trim(regexp_replace(text, '[\\s ]+', ' ', 'g')) AS value FROM documents")
scalar("I02_normalize_lines", "documents", "doc_id", lambda: T.normalize_lines(F.col("text")), "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\\s ]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS value FROM documents")
scalar("I03_normalize_money", "orders", "o_orderkey", lambda: T.normalize_money(F.concat(F.format_number("o_totalprice", 0), F.lit(" usd"))), "SELECT o_orderkey, CAST(CAST(round_even(o_totalprice, 0) AS BIGINT) AS VARCHAR) || ' USD' AS value FROM orders")
scalar("I04_normalize_percentage", "lineitem", "l_orderkey", lambda: T.normalize_percentage(F.concat(F.format_string("%.2f", "l_discount"), F.lit(" %"))), "SELECT l_orderkey, CASE WHEN l_discount = 0 THEN '0' ELSE regexp_replace(printf('%.2f', l_discount), '0+$', '') END || '%' AS value FROM lineitem")
scalar("I06_number_range", "part", "p_partkey", lambda: V.number_range(F.concat(F.col("p_size").cast("string"), F.lit("-25 months")))["low"].cast("double"), "SELECT p_partkey, CASE WHEN p_size <= 25 THEN CAST(p_size AS DOUBLE) END AS value FROM part")
scalar("I07_comparison", "documents", "doc_id", lambda: V.comparison(F.col("text")), "SELECT doc_id, CASE regexp_extract(lower(text), '(?:^|[^\\p{L}])(not more than|not less than|no more than|no less than|more than|less than|at least|at most|up to|under|from|over)(?:[^\\p{L}]|$)', 1) WHEN 'not more than' THEN '<=' WHEN 'no more than' THEN '<=' WHEN 'not less than' THEN '>=' WHEN 'no less than' THEN '>=' WHEN 'up to' THEN '<=' WHEN 'at most' THEN '<=' WHEN 'at least' THEN '>=' WHEN 'from' THEN '>=' WHEN 'over' THEN '>' WHEN 'more than' THEN '>' WHEN 'under' THEN '<' WHEN 'less than' THEN '<' END AS value FROM documents")
scalar("I08_locale_decimal", "part", "p_partkey", lambda: T.locale_decimal(F.concat_ws(",", (F.col("p_size") % 4).cast("string"), F.format_string("%03d", "p_size"))).cast("double"), "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_size / 1000.0 ELSE (p_size % 4) * 1000.0 + p_size END AS value FROM part")
scalar("I09_unit", "events", "event_id", lambda: V.unit(F.element_at(F.array(*[F.lit(x) for x in ("%", "usd", "Years", "EUR", "px", "Drams", "dollar", " euros")]), (F.col("event_id") % 8 + 1).cast("int"))), "SELECT event_id, ['percent', 'USD', 'year', 'EUR', 'PX', 'AMD', 'USD', 'EUR'][event_id % 8 + 1] AS value FROM events")
scalar(
    "I10_parse_date",
    "orders",
    "o_orderkey",
    lambda: V.parse_date(F.concat(F.lit("from "), F.element_at(F.array(*[F.date_format("o_orderdate", f) for f in ("dd.MM.yyyy", "MMMM d, yyyy", "yyyy-MM-dd", "d/M/yyyy", "yyyy/MM/dd", "yyyy.MM.dd", "d MMMM yyyy")]), (F.col("o_orderkey") % 7 + 1).cast("int")), F.lit(" on"))).cast("string"),
    "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS value FROM orders",
)
scalar(
    "I11_period_status",
    "orders",
    "o_orderkey",
    lambda: V.period_status(F.array(F.struct(F.col("o_orderdate").cast("date").alias("starts"), F.when(F.col("o_orderkey") % 2 == 0, F.date_add(F.col("o_orderdate").cast("date"), 365)).alias("ends"))), F.lit("1996-06-01").cast("date")),
    "SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) > DATE '1996-06-01' THEN 'future' WHEN o_orderkey % 2 = 0 AND CAST(o_orderdate AS DATE) + 365 < DATE '1996-06-01' THEN 'historical' ELSE 'current' END AS value FROM orders",
)
scalar("I13_numbers", "documents", "doc_id", lambda: F.array_join(F.transform(V.numbers(F.col("text")), lambda x: x.cast("decimal(38,2)").cast("string")), ","), "SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '(\\d+(?:\\.\\d+)?)', 1), lambda x: CAST(CAST(TRY_CAST(x AS DECIMAL(38, 6)) AS DECIMAL(38, 2)) AS VARCHAR)), ',') AS value FROM documents")
scalar("I14_suffixed_amount", "part", "p_partkey", lambda: V.suffixed_amount(F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, " thousand").otherwise(" units"))).cast("double"), "SELECT p_partkey, CAST(p_size AS DOUBLE) * CASE WHEN p_size % 2 = 0 THEN 1000 ELSE 1 END AS value FROM part")
scalar("I16_percentage_points", "lineitem", "l_orderkey", lambda: F.round(V.percentage_points(F.col("l_discount")), 6), "SELECT l_orderkey, round(CASE WHEN l_discount > 0 AND l_discount < 1 THEN l_discount * 100 ELSE l_discount END, 6) AS value FROM lineitem")
scalar("I17_whole_months", "part", "p_partkey", lambda: V.whole_months(F.col("p_size") / F.lit(2), F.when(F.col("p_size") % 3 == 0, "year").otherwise("month")), "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size * 6 WHEN p_size % 2 = 0 THEN p_size // 2 END::BIGINT AS value FROM part")
scalar("I19_condition_dimension", "orders", "o_orderkey", lambda: V.condition_dimension(F.element_at(F.array(*[F.lit(x) for x in ("Ccy", " maturity", "colour")]), (F.col("o_orderkey") % 3 + 1).cast("int"))), "SELECT o_orderkey, ['currency', 'term', 'other'][o_orderkey % 3 + 1] AS value FROM orders")
scalar("I20_slug", "part", "p_partkey", lambda: T.slug(F.concat_ws(" ", "p_brand", "p_name")), "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS value FROM part")
scalar("I21_quote_position", "documents", "doc_id", lambda: F.instr(T.collapsed(F.col("text")), F.lit("the ")).cast("long"), "SELECT doc_id, instr(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'the ') AS value FROM documents")
scalar("I23_tokens", "documents", "doc_id", lambda: F.size(T.tokens(F.col("text"))).cast("long"), f"SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[''’`]', '', 'g'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 1 AND x NOT IN ({', '.join(repr(w) for w in T.STOPWORDS)}))) AS value FROM documents")
scalar("I24_stem", "part", "p_partkey", lambda: T.stem(F.concat(F.split("p_name", " ")[0], F.lit("ings"))), "SELECT p_partkey, split_part(p_name, ' ', 1) AS value FROM part")
scalar("I25_search_query", "benchmark", "item_id", lambda: F.char_length(F.regexp_replace(T.search_query(F.col("text")), r"[^|]", "")).cast("long"), f"SELECT item_id, least(12, len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 1 AND x NOT IN ({', '.join(repr(w) for w in T.STOPWORDS)}))))) - 1 AS value FROM benchmark")
scalar("I26_script", "documents", "doc_id", lambda: T.script(F.col("text")), "SELECT doc_id, CASE WHEN regexp_matches(text, '[A-Za-z]') AND regexp_matches(text, '[^\\x00-\\x7F]') THEN 'mixed' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 'other' END AS value FROM documents")
scalar("I27_term_key", "part", "p_partkey", lambda: T.term_key(F.concat_ws("--", "p_name", "p_brand")), "SELECT p_partkey, trim(regexp_replace(lower(p_name || '--' || p_brand), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS value FROM part")
scalar("I28_whole_term", "documents", "doc_id", lambda: T.whole_term(F.col("text"), "thing", "s|ly"), "SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9])thing(s|ly)?([^a-z0-9]|$)') AS value FROM documents")
scalar("I29_path_key", "pages", "page_id", lambda: F.concat_ws(" ", V.host(F.col("url")), V.path_key(F.col("url")), V.allowed(F.col("url"), ["example.com"]).cast("string")), "SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) || ' ' || regexp_replace(lower(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)), '/+$', '') || ' ' || CASE WHEN regexp_extract(url, '^https?://([^/?#]+)', 1) LIKE '%.example.com' THEN 'true' ELSE 'false' END AS value FROM pages")
scalar("I30_document_name", "pages", "page_id", lambda: V.document_name(F.lit(" "), F.col("url")), "SELECT page_id, list_last(string_split(regexp_replace(lower(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)), '/+$', ''), '/')) AS value FROM pages")
scalar("I31_plain_text", "pages", "page_id", lambda: F.md5(T.plain_text(F.col("html"))), "SELECT page_id, md5(regexp_replace(regexp_replace(html, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '<[^>]+>', '', 'g')) AS value FROM pages")
scalar("I32_escape_cell", "documents", "doc_id", lambda: T.escape_cell(F.col("text")), "SELECT doc_id, replace(replace(text, '|', '\\|'), chr(10), '<br>') AS value FROM documents")
scalar("I33_list_items", "documents", "doc_id", lambda: F.array_join(T.list_items(F.concat(F.lit("- one\n"), "text")), ";"), "SELECT doc_id, 'one' || coalesce(';' || nullif(array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s*([-*•]|\\d+[.)])\\s+')), lambda x: regexp_replace(x, '^\\s*([-*•]|\\d+[.)])\\s+', '')), ';'), ''), '') AS value FROM documents")
scalar("I34_footnote_marker", "part", "p_partkey", lambda: T.footnote_marker(F.concat(F.col("p_size").cast("string"), F.lit(") "), "p_name")), "SELECT p_partkey, p_size || ')' AS value FROM part")
scalar("I35_is_label", "part", "p_partkey", lambda: T.is_label(F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(F.col("p_name"))), "SELECT p_partkey, NOT regexp_matches(CASE WHEN p_size > 25 THEN p_brand ELSE p_name END, '[.!?;]|\\d') AND length(CASE WHEN p_size > 25 THEN p_brand ELSE p_name END) <= 60 AS value FROM part")
scalar("I36_key_value", "part", "p_partkey", lambda: F.concat_ws("=", *T.key_value(F.concat_ws(" : ", "p_brand", "p_name"))), "SELECT p_partkey, p_brand || '=' || p_name AS value FROM part")
scalar("I37_measured_label", "part", "p_partkey", lambda: T.is_measured_label(F.concat(F.col("p_name"), F.when(F.col("p_size") > 25, ": 5 months").otherwise(": none"))), "SELECT p_partkey, p_size > 25 AS value FROM part")
scalar("I38_one_category", "part", "p_partkey", lambda: T.one_category(F.col("p_name"), {"RED": "red", "BLUE": "blue", "ANVIL": "anvil"}), "SELECT p_partkey, CASE WHEN contains(p_name, 'red')::INT + contains(p_name, 'blue')::INT + contains(p_name, 'anvil')::INT <> 1 THEN 'OTHER' WHEN contains(p_name, 'red') THEN 'RED' WHEN contains(p_name, 'blue') THEN 'BLUE' ELSE 'ANVIL' END AS value FROM part")
scalar("I39_superscripts", "part", "p_partkey", lambda: T.superscripts_to_digits(F.concat(F.col("p_name"), F.lit("²³"))), "SELECT p_partkey, p_name || '23' AS value FROM part")
scalar("I40_display_json", "orders", "o_orderkey", lambda: V.display_json(F.struct("o_orderkey", "o_orderstatus"), 30), "SELECT o_orderkey, substr('{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}', 1, 30) AS value FROM orders")
scalar("I41_numeric_leaf", "events", "event_id", lambda: F.from_json("props", "map<string,string>")["k"].try_cast("decimal(18,2)").cast("double"), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value FROM events")
scalar("I42_drop_nulls", "orders", "o_orderkey", lambda: F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("s"))), "SELECT o_orderkey, '{\"k\":' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN ',\"s\":\"' || o_orderstatus || '\"' ELSE '' END || '}' AS value FROM orders")
scalar("I43_wall_clock", "events", "event_id", lambda: F.date_format(V.wall_clock(F.col("ts").cast("timestamp"), "Asia/Yerevan"), "yyyy-MM-dd HH:mm"), "SELECT event_id, strftime(ts + INTERVAL 4 HOUR, '%Y-%m-%d %H:%M') AS value FROM events")
scalar("I44_age", "events", "event_id", lambda: V.age_seconds(F.lit("2024-01-15").cast("timestamp"), F.col("ts").cast("timestamp")), "SELECT event_id, CAST(greatest(0, epoch(TIMESTAMP '2024-01-15') - floor(epoch(ts))) AS BIGINT) AS value FROM events")
scalar("I45_error_code", "events", "event_id", lambda: V.error_code(F.element_at(F.array(*[F.lit(x) for x in ("Timeout after 5 s", "HTTP 503 returned", "parse error", "odd")]), (F.col("event_id") % 4 + 1).cast("int"))), "SELECT event_id, ['source_timeout', 'http_503', 'source_invalid', 'unexpected'][event_id % 4 + 1] AS value FROM events")
scalar("I46_number_key", "part", "p_partkey", lambda: V.number_key(F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, ".00").otherwise(",00"))), "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_size || ',00' END AS value FROM part")
