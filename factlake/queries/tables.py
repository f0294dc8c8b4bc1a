"""J and F over tables of six shapes, one made from the lines of every order: what the rows are and what their values stand under."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factlake.operators import packing as P
from factlake.operators import tables as T
from factlake.queries import query
from factlake.queries.derived import spread_rows

#: the lines of an order, numbered; the order's number picks the shape of its table
_LINES = """(SELECT l_orderkey AS t, l_orderkey % 6 AS shape, l_returnflag AS f, l_linestatus AS s, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q, CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) || '%' AS d, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_orderkey) AS n,
    lag(l_returnflag) OVER w AS pf FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice))"""

#: (shape, which lines give the row: first, each, changed or last; row, col, rowspan, colspan, head, bold, text), rows and texts as SQL of both engines
SHAPES = [
    (0, "first", "0", 0, "1", 2, False, False, "'Lines of an order'"), (0, "first", "1", 0, "1", 1, True, False, "'Status'"), (0, "first", "1", 1, "1", 1, True, False, "'Quantity'"),
    (0, "changed", "2 * i", 0, "1", 2, False, False, "concat('Flag ', f)"), (0, "each", "2 * i + 1", 0, "1", 1, False, False, "s"), (0, "each", "2 * i + 1", 1, "1", 1, False, False, "q"),
    (1, "first", "0", 0, "2", 1, True, False, "'Item'"), (1, "first", "0", 1, "1", 2, True, False, "'Amount'"), (1, "first", "1", 1, "1", 1, True, False, "'Quantity'"), (1, "first", "1", 2, "1", 1, True, False, "'Discount'"),
    (1, "first", "2", 0, "1", 1, False, False, "'1. Kind'"), (1, "first", "2", 1, "1", 1, False, False, "'exact'"), (1, "first", "2", 2, "1", 1, False, False, "'rounded'"),
    (1, "each", "2 + i", 0, "1", 1, False, False, "concat(f, i)"), (1, "each", "2 + i", 1, "1", 1, False, False, "q"), (1, "each", "2 + i", 2, "1", 1, False, False, "d"),
    (2, "first", "0", 0, "n + 2", 1, False, False, "'3. Terms'"), (2, "first", "0", 1, "1", 1, False, False, "'3.1. Currency'"), (2, "first", "0", 2, "1", 1, False, False, "'AMD'"), (2, "first", "1", 1, "1", 2, False, False, "'Term and rate'"),
    (2, "each", "1 + i", 1, "1", 1, False, False, "concat('Flag ', f, i)"), (2, "each", "1 + i", 2, "1", 1, False, False, "q"),
    (2, "last", "2 + i", 0, "1", 1, False, False, "'4. Repayment'"), (2, "last", "2 + i", 1, "1", 1, False, False, "'4.1. Method'"), (2, "last", "2 + i", 2, "1", 1, False, False, "'Annuity'"),
    (3, "first", "0", 0, "1", 1, True, False, "'Item'"), (3, "first", "0", 1, "1", 1, True, False, "'Value'"), (3, "each", "i", 0, "1", 1, False, False, "concat(f, i)"), (3, "each", "i", 1, "1", 1, False, False, "q"),
    (3, "last", "i + 1", 0, "1", 2, False, False, "'¹ Fixed for the first year'"), (3, "last", "i + 2", 0, "1", 2, False, False, "'5 000 000 is the most, see the sheet'"), (3, "last", "i + 3", 0, "1", 2, False, False, "'Subject to change'"),
    (4, "first", "0", 0, "1", 1, False, True, "'Flag'"), (4, "first", "0", 1, "1", 1, False, True, "'Status'"), (4, "each", "i", 0, "1", 1, False, False, "f"), (4, "each", "i", 1, "1", 1, False, False, "concat(s, '1')"),
    (5, "first", "0", 0, "1", 1, True, False, "'Item'"), (5, "first", "0", 1, "1", 1, True, False, "'Value'"), (5, "each", "2 * i", 0, "2", 1, False, False, "concat('Rate ', i)"), (5, "each", "2 * i", 1, "1", 1, False, False, "concat('fixed ', f)"), (5, "each", "2 * i + 1", 1, "1", 1, False, False, "q"),
]
_WHEN = {"first": "i = 1", "each": "TRUE", "changed": "(pf IS NULL OR pf <> f)", "last": "i = n"}

_CELLS = " UNION ALL ".join(f"SELECT t, {row} AS row, {col} AS col, {rows} AS rs, {cols} AS cs, {head} AS head, {bold} AS bold, {text} AS text FROM l WHERE shape = {shape} AND {_WHEN[when]}" for shape, when, row, col, rows, cols, head, bold, text in SHAPES)

#: the rules on rows, for tables without lists, in windows over rows
RULES = rf"""l AS {_LINES}, c AS ({_CELLS}), facts AS (SELECT t, max(col + cs) AS width, bool_or(head) AS html, max(rs) > 1 AS spans FROM c GROUP BY 1),
  r AS (SELECT t, row, width, html, spans, count(*) AS k, min(col) AS col, max(col + cs) AS reach, any_value(text) AS text, bool_and(head) AS heads, bool_and(bold AND NOT regexp_matches(text, '[0-9]')) AS bolds FROM c JOIN facts USING (t) GROUP BY ALL),
  grid AS (SELECT t, row + a AS row, col + b AS col, row AS at, c.col AS own, a > 0 AS carried, b > 0 AS spread, text FROM c, generate_series(0, rs - 1) x(a), generate_series(0, cs - 1) y(b)),
  lab AS (SELECT r.*, g.at AS anchor, k = 1 AND width >= 2 AND reach >= width AND (r.col = 0 OR (r.col = 1 AND width > 2 AND g.at IS NOT NULL)) AS alone, NOT regexp_matches(r.text, '[.;:!?,](\s|$)') AND NOT regexp_matches(regexp_replace(r.text, '^\d+(\.\d+)*\.?\s+', ''), '[0-9]') AND NOT regexp_matches(r.text, '^([⁰¹²³⁴⁵⁶⁷⁸⁹]|[*†‡])') AS phrase
    FROM r LEFT JOIN grid g ON g.t = r.t AND g.row = r.row AND g.col = 0 AND g.carried),
  first AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY row) = 1 AND alone AND col = 0 AS title, alone AND (phrase OR col = 0) AS label, CASE WHEN html THEN heads ELSE bolds END AND (k > 1 OR width = 1) AS headish FROM lab),
  kinds AS (SELECT *, CASE WHEN title THEN 'title' WHEN label AND phrase AND col = 0 THEN 'section' WHEN label AND phrase THEN 'sub_section' WHEN label THEN 'note' WHEN headish AND count(*) FILTER (NOT label AND NOT headish) OVER (PARTITION BY t ORDER BY row ROWS UNBOUNDED PRECEDING) = 0 THEN 'header' ELSE 'data' END AS kind FROM first),
  opened AS (SELECT *, count(*) FILTER (kind = 'section') OVER w AS sn, max(CASE WHEN kind = 'section' THEN row END) OVER w AS sr, max(CASE WHEN kind = 'sub_section' THEN row END) OVER w AS ur FROM kinds WINDOW w AS (PARTITION BY t ORDER BY row)),
  placed AS (SELECT o.*, count(*) FILTER (o.kind = 'data') OVER (PARTITION BY o.t, o.sn) AS under, s.text AS st, CASE WHEN u.row > coalesce(o.sr, -1) AND u.anchor = o.anchor THEN u.text END AS ut FROM opened o LEFT JOIN kinds s ON s.t = o.t AND s.row = o.sr LEFT JOIN kinds u ON u.t = o.t AND u.row = o.ur),
  texts AS (SELECT t, row, string_agg(CASE WHEN spread THEN '' ELSE text END, chr(31) ORDER BY col) AS sig FROM grid GROUP BY ALL),
  named AS (SELECT t, row, nullif(concat_ws(' > ', st, ut), '') AS section, sig, kind, CASE WHEN kind = 'section' AND under = 0 THEN 'note' ELSE kind END AS shown, text, anchor, width, spans, row_number() OVER (PARTITION BY t, kind = 'data' ORDER BY row) AS o FROM placed JOIN texts USING (t, row)),
  d AS (SELECT *, lag(row) OVER w AS above, lag(sig) OVER w IS NOT DISTINCT FROM sig AND lag(section) OVER w IS NOT DISTINCT FROM section AND o > 1 AS again, lag(anchor) OVER w AS pa FROM named WHERE kind = 'data' WINDOW w AS (PARTITION BY t ORDER BY row)),
  heads AS (SELECT t, col, list(text ORDER BY row) AS path FROM (SELECT g.t, g.col, g.text, min(g.row) AS row FROM grid g JOIN named n ON n.t = g.t AND n.row = g.row AND n.kind = 'header' WHERE g.text <> '' GROUP BY ALL) GROUP BY ALL),
  stubs AS (SELECT t, CASE WHEN EXISTS (SELECT 1 FROM named h WHERE h.t = f.t AND h.kind = 'header') THEN 1 WHEN width >= 3 AND spans THEN 2 ELSE 1 END AS stub FROM facts f),
  v AS (SELECT d.t, d.row, g.col, g.text, regexp_replace(g.text, '^\d+(\.\d+)*\.?\s+', '') AS name FROM d JOIN grid g ON g.t = d.t AND g.row = d.row AND NOT g.carried AND NOT g.spread JOIN stubs st ON st.t = d.t WHERE NOT again AND g.col >= stub),
  cand AS (SELECT t, row FROM v GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT name) >= 2 AND bool_and(length(name) <= 40 AND NOT regexp_matches(name, '[0-9]'))),
  following AS (SELECT t, row, lead(row) OVER (PARTITION BY t ORDER BY row) AS nx FROM r),
  quals AS (SELECT cand.t, cand.row FROM cand JOIN following f ON f.t = cand.t AND f.row = cand.row JOIN v a ON a.t = cand.t AND a.row = cand.row JOIN v b ON b.t = cand.t AND b.row = f.nx AND b.col = a.col GROUP BY ALL HAVING count(*) >= 2)"""


#: lines that a task holds, some five cells each
_LINES_OF_TASK = 150_000


def dealt_lines(t, *columns: str):
    """These columns of the lines, dealt once by order over tasks of a bounded number of lines; what follows stays with its order."""
    return spread_rows(t, t.lineitem.select(*columns), "l_orderkey", _LINES_OF_TASK)


def shaped_cells(t):
    """The cells of all tables, from the lines of their orders."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    number = lambda c: c.cast("long").cast("string")
    lines = dealt_lines(t, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus").select(
        F.col("l_orderkey").alias("t"), (F.col("l_orderkey") % 6).alias("shape"), F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"), number(F.col("l_quantity")).alias("q"), F.concat(number(F.round(F.col("l_discount") * 100)), F.lit("%")).alias("d"),
        F.row_number().over(w).alias("i"), F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"), F.lag("l_returnflag").over(w).alias("pf"),
    )
    cell = lambda row, col, rows, cols, head, bold, text: F.struct(F.expr(row).cast("long").alias("row"), F.lit(col).alias("col"), F.expr(rows).cast("int").alias("rowspan"), F.lit(cols).alias("colspan"), F.lit(head).alias("is_header"), F.lit(bold).alias("bold"), F.expr(text).cast("string").alias("text"))
    # a line makes the cells of its own shape only
    made = None
    for shape in sorted({x[0] for x in SHAPES}):
        cells = F.array_compact(F.array(*(F.when(F.expr(_WHEN[when]), cell(*x)) for of, when, *x in SHAPES if of == shape)))
        made = (F if made is None else made).when(F.col("shape") == shape, cells)
    return lines.select(F.col("t").alias("table_id"), F.explode(made).alias("c")).select("table_id", "c.*")


@query("J03_row_kinds", f"""WITH {RULES} SELECT n.t AS table_id, n.row, CASE WHEN d.again THEN 'repeated' WHEN q.row IS NOT NULL THEN 'qualifier' ELSE n.shown END AS kind, CASE WHEN n.kind = 'data' THEN n.section WHEN n.kind = 'sub_section' THEN split_part(n.section, ' > ', 2) END AS section,
    CASE WHEN n.kind IN ('data', 'header') THEN NULL ELSE ltrim(n.text, '¹ ') END AS text, CASE WHEN n.text LIKE '¹%' THEN '1' END AS marker FROM named n LEFT JOIN d ON d.t = n.t AND d.row = n.row LEFT JOIN quals q ON q.t = n.t AND q.row = n.row""")
def _(t):
    out = T.structure_tables(shaped_cells(t), columns=("row", "kind", "section", "text", "marker")).where("row >= 0")
    # a sub-section's own section is the one it stands in
    return out.select("table_id", "row", "kind", F.when(F.col("kind") == "sub_section", F.coalesce("section", F.lit(""))).otherwise(F.col("section")).alias("section"), "text", "marker")


@query("J04_value_paths", f"""WITH {RULES}, inforce AS (SELECT d.t, d.row, max(q.row) AS qr FROM d LEFT JOIN quals q ON q.t = d.t AND q.row < d.row GROUP BY ALL),
    qn AS (SELECT v.t, v.row, v.col, regexp_replace(g.text, '^\\d+(\\.\\d+)*\\.?\\s+', '') || ': ' || v.name AS name FROM v JOIN quals USING (t, row) JOIN grid g ON g.t = v.t AND g.row = v.row AND g.col = 0)
    SELECT v.t AS table_id, v.row, v.col, v.text, coalesce(array_to_string(list_concat(h.path, CASE WHEN qn.name IS NULL THEN [] ELSE [qn.name] END), ' / '), '') AS path FROM v JOIN inforce f USING (t, row) LEFT JOIN heads h ON h.t = v.t AND h.col = v.col LEFT JOIN qn ON qn.t = v.t AND qn.row = f.qr AND qn.col = v.col""")
def _(t):
    rows = T.structure_tables(shaped_cells(t), columns=("row", "labels", "cells"), kinds=("data", "qualifier"))
    values = rows.select("table_id", "row", "labels", F.explode("cells").alias("c")).select("table_id", "row", "labels", "c.*")
    # label columns have no path of their own
    return values.where(~F.array_contains("labels", F.col("text")) | (F.col("col") > 1) | (F.size("path") > 0)).select("table_id", "row", F.col("col").cast("long").alias("col"), "text", F.array_join("path", " / ").alias("path"))


@query("F04_table_sections", f"WITH {RULES} SELECT t AS table_id, section, count(*) AS rows FROM d WHERE NOT again GROUP BY ALL")
def _(t):
    return T.structure_tables(shaped_cells(t), columns=("section",), kinds=("data", "qualifier")).groupBy("table_id", "section").agg(F.count("*").alias("rows"))


@query("J06_completed_rows", f"WITH {RULES} SELECT d.t AS table_id, d.row, d.above AS completes FROM d JOIN l ON l.t = d.t AND l.shape = 5 AND d.row = 2 * l.i + 1 WHERE d.pa IS NULL AND d.anchor IS NOT NULL AND regexp_matches(split_part(d.sig, chr(31), 2), '[0-9]')")
def _(t):
    return T.structure_tables(shaped_cells(t), columns=("row", "continues"), kinds=("data", "qualifier")).where("continues is not null").select("table_id", "row", F.col("continues").alias("completes"))


@query("J08_invented_headers", f"WITH {RULES} SELECT f.t AS table_id, CASE WHEN width >= 3 AND spans THEN 'Section | Item' || CASE WHEN width = 3 THEN ' | Terms' ELSE '' END ELSE 'Column 1 | Column 2' END AS headers FROM facts f WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.t = f.t AND n.kind = 'header')")
def _(t):
    return T.structure_tables(shaped_cells(t), columns=("text",), kinds=("invented_header",)).select("table_id", F.col("text").alias("headers"))


@query("J22_structured_records", f"""WITH {RULES}, inforce AS (SELECT d.t, d.row, max(q.row) AS qr FROM d LEFT JOIN quals q ON q.t = d.t AND q.row < d.row GROUP BY ALL),
    qn AS (SELECT v.t, v.row, v.col, regexp_replace(g.text, '^\\d+(\\.\\d+)*\\.?\\s+', '') || ': ' || v.name AS name FROM v JOIN quals USING (t, row) JOIN grid g ON g.t = v.t AND g.row = v.row AND g.col = 0),
    shown AS (SELECT v.t, v.row, string_agg(concat_ws(': ', nullif(array_to_string(list_concat(h.path, CASE WHEN qn.name IS NULL THEN [] ELSE [qn.name] END), ' / '), ''), v.text), ' | ' ORDER BY v.col) AS line FROM v JOIN inforce f USING (t, row) LEFT JOIN heads h ON h.t = v.t AND h.col = v.col LEFT JOIN qn ON qn.t = v.t AND qn.row = f.qr AND qn.col = v.col GROUP BY ALL),
    lbl AS (SELECT d.t, d.row, string_agg(g.text, ' > ' ORDER BY g.col) AS label FROM d JOIN grid g ON g.t = d.t AND g.row = d.row AND NOT g.spread JOIN stubs st ON st.t = d.t WHERE NOT again AND g.col < stub GROUP BY ALL)
    SELECT d.t AS table_id, d.row, concat_ws(' :: ', nullif(d.section, ''), lbl.label, shown.line) AS record FROM d JOIN lbl ON lbl.t = d.t AND lbl.row = d.row LEFT JOIN shown ON shown.t = d.t AND shown.row = d.row WHERE NOT again""")
def _(t):
    return T.row_records(T.structure_tables(shaped_cells(t), columns=("row", "kind", "section", "labels", "cells", "marker", "text"), kinds=("data", "qualifier", "note"))).select("table_id", "row", "record")


#: a text table for each order: a header row that names columns, one without digits that qualifies them, and a row for each line
@query(
    "J07_text_tables",
    """WITH l AS (SELECT l_orderkey AS t, l_returnflag AS f, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q, CAST(CAST(round(l_tax * 100) AS BIGINT) AS VARCHAR) AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem)
    SELECT t AS table_id, 1 + i AS row, 'data' AS kind, f || ' > ' || 'L' || i AS labels, 'Sum / Kind: whole' AS first_path, q AS first, 'Tax / Kind: rate' AS second_path, x AS second FROM l UNION ALL SELECT DISTINCT t, 1, 'qualifier', 'All > Kind', 'Sum', 'whole', 'Tax', 'rate' FROM l""",
)
def _(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_returnflag", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    number = lambda c: F.col(c).cast("long").cast("string")
    made = lambda row, header, *texts: F.struct(row.cast("long").alias("row"), F.lit(header).alias("header"), F.array(*texts).alias("texts"))
    fixed = lambda row, header, *texts: F.when(F.col("i") == 1, made(F.lit(row), header, *map(F.lit, texts)))
    line = made(1 + F.col("i"), False, F.col("l_returnflag"), F.concat(F.lit("L"), F.col("i").cast("string")), number("l_quantity"), F.round(F.col("l_tax") * 100).cast("long").cast("string"))
    lines = dealt_lines(t, "l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax").withColumn("i", F.row_number().over(w))
    of_order = F.array_compact(F.array(fixed(0, True, "Item", "Item", "Sum", "Tax"), fixed(1, False, "All", "Kind", "whole", "rate"), line))
    rows = lines.select(F.col("l_orderkey").alias("table_id"), F.explode(of_order).alias("r")).select("table_id", "r.*")
    out = T.structure_tables(T.text_cells(rows), columns=("row", "kind", "labels", "cells"), kinds=("data", "qualifier"))
    value = lambda k: F.element_at("cells", k)
    return out.select("table_id", "row", "kind", F.array_join("labels", " > ").alias("labels"), F.array_join(value(3)["path"], " / ").alias("first_path"), value(3)["text"].alias("first"), F.array_join(value(4)["path"], " / ").alias("second_path"), value(4)["text"].alias("second"))


#: lines of an order by status and flag; each chunk of at most so many characters repeats where it stands and the head of its columns
_CHUNK = 70
_UNITS = "(SELECT l_orderkey AS t, 'Order ' || l_orderkey || ' > ' || l_returnflag AS crumb, 'Line | Quantity | Price' AS head, l_linenumber || ' | ' || CAST(floor(l_quantity) AS BIGINT) || ' | ' || CAST(floor(l_extendedprice) AS BIGINT) AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem)"


@query(
    "J27_table_chunks",
    f"""WITH RECURSIVE u AS MATERIALIZED {_UNITS}, walk AS (SELECT t, i, crumb, line, CAST(0 AS BIGINT) AS ordinal, length(crumb) + length(head) + length(line) + 2 AS size FROM u WHERE i = 1
    UNION ALL SELECT u.t, u.i, u.crumb, u.line, w.ordinal + CASE WHEN u.crumb = w.crumb AND w.size + 1 + length(u.line) <= {_CHUNK} THEN 0 ELSE 1 END, CASE WHEN u.crumb = w.crumb AND w.size + 1 + length(u.line) <= {_CHUNK} THEN w.size + 1 + length(u.line) ELSE length(u.crumb) + length(u.head) + length(u.line) + 2 END FROM walk w JOIN u ON u.t = w.t AND u.i = w.i + 1)
    SELECT t AS table_id, ordinal, any_value(crumb) || chr(10) || 'Line | Quantity | Price' || chr(10) || string_agg(line, chr(10) ORDER BY i) AS content FROM walk GROUP BY t, ordinal""",
)
def _(t):
    number = lambda c: F.floor(c).cast("long").cast("string")
    w = Window.partitionBy("l_orderkey").orderBy("l_returnflag", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    line = F.concat_ws(" | ", F.col("l_linenumber").cast("string"), number("l_quantity"), number("l_extendedprice"))
    units = t.lineitem.select(F.col("l_orderkey").alias("table_id"), F.row_number().over(w).alias("i"), F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"), F.lit(" > "), "l_returnflag").alias("breadcrumb"), F.lit("Line | Quantity | Price").alias("head"), line.alias("line"))
    return P.chunk_units(units, "table_id", "i", _CHUNK)


@query("J27_page_chunks")
def _(t):
    from factlake.queries.derived import parsed_all
    from factlake.sources.pages import parse_cells

    parsed = parsed_all(t)
    return P.chunk_units(P.page_units(parsed, parse_cells(parsed)), "page_id", "ord", 600)
