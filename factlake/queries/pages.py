"""A: page scans, E16 and J over blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlake.queries import query
from factlake.queries.derived import PAGE_IDS, parsed_all, parsed_pages, parsed_suppliers
from factlake.sources import pages as P

#: a supplier's page in SQL: its keys, and the rows of its table
_S = f"(SELECT s_suppkey + {PAGE_IDS} AS page_id, s_suppkey AS k, s_name, n_name, n_regionkey, CAST(floor(s_acctbal) AS BIGINT) AS bal, coalesce(lines, 0) AS lines FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT l_suppkey, count(*) AS lines FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey)"
_R = f"(SELECT l_suppkey + {PAGE_IDS} AS page_id, l_returnflag || ' ' || l_linestatus AS flag, CAST(sum(CAST(l_quantity AS BIGINT)) AS VARCHAR) AS q, CAST(count(*) AS VARCHAR) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_returnflag, l_linestatus) AS i FROM lineitem GROUP BY l_suppkey, l_returnflag, l_linestatus)"
BLOCKS = f"""(SELECT page_id, v.* FROM {_S}, LATERAL (VALUES (0, 'list', 'Home', '', NULL, 'l1', NULL, NULL, TRUE), (1, 'heading', s_name, '', NULL, '', NULL, NULL, FALSE), (2, 'key_value', 'Nation: ' || n_name, s_name, NULL, '', 'Nation', n_name, FALSE),
    (3, 'key_value', 'Region key: ' || n_regionkey, s_name, NULL, '', 'Region key', n_regionkey::VARCHAR, FALSE), (4, 'key_value', 'Account balance: ' || bal || ' USD', s_name, NULL, '', 'Account balance', bal || ' USD', FALSE), (5, 'card', 'Offer ' || k || chr(10) || 'See the next supplier', s_name, NULL, 'l2', NULL, NULL, FALSE),
    (6, 'accordion', 'What is sold?', s_name, NULL, '', NULL, NULL, FALSE), (7, 'paragraph', lines || ' lines', s_name || ' > What is sold?', 'b7', '', NULL, NULL, FALSE), (8, 'paragraph', 'Details in the file', s_name || ' > What is sold?', 'b7', 'l3', NULL, NULL, FALSE),
    (9, 'heading', 'Lines', s_name, NULL, '', NULL, NULL, FALSE), (11, 'paragraph', 'Shop', s_name, NULL, '', NULL, NULL, TRUE)) v(ord, type, text, heading_path, parent_id, link_ids, key, value, chrome)
    UNION ALL SELECT s.page_id, 10, 'table', 'By flag' || chr(10) || 'Flag | Sums' || chr(10) || 'Quantity | Count' || coalesce(chr(10) || r.rows, ''), s_name || ' > Lines', NULL, '', NULL, NULL, FALSE FROM {_S} s LEFT JOIN (SELECT page_id, string_agg(flag || ' | ' || q || ' | ' || n, chr(10) ORDER BY i) AS rows FROM {_R} GROUP BY 1) r USING (page_id))"""


@query("A01_read_pages", "SELECT page_id, url, length(html) AS chars FROM pages")
def _(t):
    return P.read_pages(t.spark, f"{t.sf_dir}/pages.parquet").select("page_id", "url", F.char_length("html").cast("long").alias("chars"))


@query("A02_blocks")
def _(t):
    return P.parse_blocks(parsed_pages(t)).drop("link_ids")


@query("A02_typed_blocks", f"SELECT page_id, ord, type, text, heading_path, parent_id, link_ids, key, value, chrome FROM {BLOCKS}")
def _(t):
    out = P.parse_blocks(parsed_suppliers(t)).withColumn("link_ids", F.array_join("link_ids", ","))
    return out.select("page_id", "ord", "type", "text", "heading_path", "parent_id", "link_ids", "key", "value", "chrome")


@query("A03_cells", f"""SELECT page_id, v.* FROM {_S}, (VALUES (0, 0, 2, 1, TRUE, FALSE, 'Flag'), (0, 1, 1, 2, TRUE, FALSE, 'Sums'), (1, 1, 1, 1, TRUE, FALSE, 'Quantity'), (1, 2, 1, 1, TRUE, FALSE, 'Count')) v(row, col, rowspan, colspan, is_header, bold, text)
    UNION ALL SELECT page_id, 1 + i, c, 1, 1, FALSE, c = 0, CASE c WHEN 0 THEN flag WHEN 1 THEN q ELSE n END FROM {_R}, (VALUES (0), (1), (2)) v(c)""")
def _(t):
    cells = P.parse_cells(parsed_all(t)).select("page_id", "row", "col", "rowspan", "colspan", "is_header", "bold", "text")
    return cells.withColumns({c: F.col(c).cast("long") for c in ("row",)})


ANCHORS = "SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 2)) AS text, generate_subscripts(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1), 1) - 1 AS ord FROM pages"


@query("A04_links", ANCHORS)
def _(t):
    return P.anchors(t.pages).withColumn("ord", F.col("ord").cast("long"))


@query("A04_parsed_links")
def _(t):
    return P.parse_links(parsed_pages(t)).drop("rel")


@query("A04_absolute_links", f"""SELECT page_id, v.* FROM {_S}, LATERAL (VALUES ('l1', 'https://shop.example.com/', 'Home', FALSE, TRUE, 'Home', 'b1'), ('l2', 'https://shop.example.com/suppliers/' || (k + 1), 'the next supplier', FALSE, FALSE, 'See the next supplier', 'b6'),
    ('l3', 'https://shop.example.com/suppliers/files/' || k || '.pdf', 'the file', TRUE, FALSE, 'Details in the file', 'b9')) v(link_id, url, text, downloadable, chrome, context, block_id)""")
def _(t):
    return P.parse_links(parsed_suppliers(t)).where("same_source").select("page_id", "link_id", "url", "text", "downloadable", "chrome", "context", "block_id")


@query("A05_media", f"SELECT page_id, v.* FROM {_S}, LATERAL (VALUES (0, 'img', 'https://shop.example.com/img/' || k || '.png', '', TRUE, FALSE), (1, 'button', '', 'Order', FALSE, FALSE)) v(ord, tag, source, label, decorative, chrome)")
def _(t):
    return P.parse_media(parsed_all(t))


@query("J10_pairs", f"SELECT page_id, 'b' || (ord + 1) AS block_id, key, value FROM {BLOCKS} WHERE key IS NOT NULL")
def _(t):
    return P.definition_pairs(parsed_suppliers(t))


@query("A06_titles", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def _(t):
    return P.titles(t.pages)


@query("A06_page_text")
def _(t):
    return P.page_text(parsed_pages(t))


@query("A15_markdown")
def _(t):
    return P.render_markdown(parsed_pages(t))


@query("A15_table_markdown", f"""WITH r AS (SELECT page_id, string_agg(chr(10) || '| ' || flag || ' | ' || q || ' | ' || n || ' |', '' ORDER BY i) AS rows FROM {_R} GROUP BY 1)
    SELECT page_id, '- Home' || chr(10) || chr(10) || '# ' || s_name || chr(10) || chr(10) || 'Nation: ' || n_name || chr(10) || chr(10) || 'Region key: ' || n_regionkey || chr(10) || chr(10) || 'Account balance: ' || bal || ' USD' || chr(10) || chr(10) || 'Offer ' || k || chr(10) || 'See the next supplier' || chr(10) || chr(10)
    || 'What is sold?' || chr(10) || chr(10) || lines || ' lines' || chr(10) || chr(10) || 'Details in the file' || chr(10) || chr(10) || '## Lines' || chr(10) || chr(10) || '| Flag | Sums |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || '|  | Quantity | Count |' || coalesce(rows, '') || chr(10) || chr(10) || 'Shop' AS markdown FROM {_S} LEFT JOIN r USING (page_id)""")
def _(t):
    return P.render_markdown(parsed_suppliers(t))


@query("B05_page_hash")
def _(t):
    return P.content_hash(parsed_pages(t))


@query("B15_link_fingerprint")
def _(t):
    return P.parse_links(parsed_pages(t)).select("page_id", "ord", F.sha2(F.to_json(F.struct("href", "text")), 256).alias("fp"))


@query("E16_page_inventory")
def _(t):
    return P.inventory(parsed_pages(t))


@query("E16_shop_inventory", f"SELECT page_id, CAST(sum(length(text)) FILTER (NOT chrome) AS BIGINT) AS main_chars, count(*) FILTER (NOT chrome) AS blocks, CAST(1 AS BIGINT) AS tables, CAST(3 AS BIGINT) AS links, CAST(1 AS BIGINT) AS pdf_links FROM {BLOCKS} GROUP BY 1")
def _(t):
    return P.inventory(parsed_suppliers(t))


@query("F03_heading_path")
def _(t):
    return P.parse_blocks(parsed_pages(t)).where("heading_path <> ''").select("page_id", "ord", "heading_path")


@query("F03_scoped_headings", f"SELECT page_id, ord, heading_path FROM {BLOCKS} WHERE heading_path <> ''")
def _(t):
    return P.parse_blocks(parsed_suppliers(t)).where("heading_path <> ''").select("page_id", "ord", "heading_path")


@query("D17_cross_sell", f"SELECT s_suppkey + {PAGE_IDS} AS page_id, s_suppkey + {PAGE_IDS} + 1 AS target FROM supplier WHERE s_suppkey + 1 IN (SELECT s_suppkey FROM supplier)")
def _(t):
    from factlake.functions.values import path_key

    parsed = parsed_all(t)
    return P.cross_links(parsed, parsed.select(path_key(F.col("url")).alias("path"), F.col("page_id").alias("target")).distinct())


@query("J11_sections")
def _(t):
    b = P.parse_blocks(parsed_pages(t))
    section = F.when(F.col("chrome"), "chrome").when(F.col("heading_path") == "", "page_header").otherwise(F.col("heading_path"))
    return b.groupBy("page_id", section.alias("section")).agg(F.count("*").alias("blocks"), F.min("ord").alias("first"))


@query("J15_rule_classes")
def _(t):
    from factlake.operators.checks import first_rule

    b = P.parse_blocks(parsed_pages(t))
    rules = [("chrome", F.col("chrome")), ("no_content", F.char_length("text") < 3), ("header", F.col("type") == "heading")]
    return first_rule(b, rules, "page").groupBy("page_id", "label").agg(F.count("*").alias("n"))


@query("J09_block_fields", f"SELECT page_id, ord, key, value FROM {BLOCKS} WHERE key IS NOT NULL")
def _(t):
    from factlake.functions.text import key_value

    key, value = key_value(F.col("text"))
    named = F.col("key").isNotNull()
    fields = P.parse_blocks(parsed_suppliers(t)).where("type not in ('heading', 'table', 'card')")
    return fields.select("page_id", "ord", F.when(named, F.col("key")).otherwise(key).alias("key"), F.when(named, F.col("value")).otherwise(value).alias("value")).where("key is not null")


@query("L19_page_score")
def _(t):
    b = P.parse_blocks(parsed_pages(t)).where("not chrome").groupBy("page_id").agg(F.count_if(F.col("type") == "heading").alias("h"), F.count("*").alias("n"), F.sum(F.char_length("text")).alias("c"))
    passed = sum((x.cast("int") for x in (F.col("h") > 0, F.col("n") > 1, F.col("c") > 200)), F.lit(0))
    return b.select("page_id", F.round(passed / 3, 4).alias("score"))
