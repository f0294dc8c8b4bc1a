"""Small tables of every shape against their expected rows."""

import pytest
from pyspark.sql import functions as F

from factlake.operators import tables as tables_of_rows
from factlake.operators.tables import Cell, Machine, is_label, row_records, split_note, structure_tables, text_cells
from factlake.sources.pages import parse_cells


def tables(spark, *pages):
    df = spark.createDataFrame([(k, "http://h/", f"<table>{p}</table>") for k, p in enumerate(pages)], "page_id long, url string, html string")
    out = structure_tables(parse_cells(df).withColumn("key", F.col("page_id")).drop("table_id"), "key").collect()
    return [sorted((r for r in out if r["key"] == k), key=lambda r: r["row"]) for k in range(len(pages))]


def data(rows):
    return [(r["section"], [(c["text"], " / ".join(c["path"])) for c in r["cells"]]) for r in rows if r["kind"] in ("data", "qualifier")]


def kinds(rows):
    return [(r["row"], r["kind"], r["text"]) for r in rows if r["kind"] not in ("data", "header")]


STACKED = '<tr><th rowspan="2">Term</th><th colspan="2">Rate</th></tr><tr><th>AMD</th><th>USD</th></tr><tr><td>12 months</td><td>12%</td><td>8%</td></tr><tr><td>24</td><td colspan="2">9%</td></tr>'
SECTIONS = '<tr><th>Item</th><th>Value</th></tr><tr><td colspan="2">Local loans</td></tr><tr><td>Fee</td><td>0%</td></tr><tr><td>Fee</td><td>0%</td></tr><tr><td colspan="2">Foreign loans</td></tr><tr><td>Fee</td><td>0%</td></tr><tr><td colspan="2">Subject to change</td></tr>'
NOTES = '<tr><td colspan="2">Consumer tariffs</td></tr><tr><th>Item</th><th>Value</th></tr><tr><td>Rate</td><td>12%</td></tr><tr><td colspan="2">5 000 000 is the most that is lent, see the sheet</td></tr><tr><td colspan="2">¹ Fixed for the first year</td></tr>'
SUBS = '<tr><td rowspan="4">3. Terms</td><td>3.1. Currency</td><td>AMD</td></tr><tr><td colspan="2">Term and rate</td></tr><tr><td>3.4. Rate</td><td>13.5%</td></tr><tr><td>3.5. APR</td><td>14%</td></tr><tr><td>4. Repayment</td><td>4.1. Method</td><td>Annuity</td></tr>'
VALUES = '<tr><td rowspan="3">3. Terms</td><td rowspan="2">3.4. Rate</td><td>Adjustable</td></tr><tr><td>Fixed part 5%</td></tr><tr><td>3.5. APR</td><td>14%</td></tr>'
QUALIFIED = "<tr><th>Item</th><th>A</th><th>B</th></tr><tr><td>1. Currency</td><td>AMD</td><td>USD</td></tr><tr><td>Rate</td><td>12%</td><td>8%</td></tr><tr><td>Way</td><td>annuity</td><td></td></tr>"
BOLD = "<tr><td><b>Item</b></td><td><b>Price</b></td></tr><tr><td>a</td><td>1</td></tr>"
LISTS = "<tr><td rowspan='2'>Needed</td><td>1. passport</td></tr><tr><td>2. card</td></tr><tr><td>Fee</td><td>3</td></tr>"
ONE = "<tr><th>Conditions</th></tr><tr><td>Rate 12%</td></tr><tr><td>Up to 60 months</td></tr>"


def test_shapes(spark):
    stacked, sections, notes, subs, values, qualified, bold, lists, one, empty = tables(spark, STACKED, SECTIONS, NOTES, SUBS, VALUES, QUALIFIED, BOLD, LISTS, ONE, "<tr><td> </td></tr>")
    assert data(stacked) == [(None, [("12 months", ""), ("12%", "Rate / AMD"), ("8%", "Rate / USD")]), (None, [("24", ""), ("9%", "Rate")])]
    assert [x for x, _ in data(sections)] == ["Local loans", "Foreign loans"]
    assert kinds(sections) == [(1, "section", "Local loans"), (3, "repeated", None), (4, "section", "Foreign loans"), (6, "note", "Subject to change")]
    assert [(r["kind"], r["marker"], r["text"]) for r in notes if r["text"]] == [("title", None, "Consumer tariffs"), ("note", None, "5 000 000 is the most that is lent, see the sheet"), ("note", "1", "Fixed for the first year")]
    assert {r["cells"][1]["text"]: r["section"] for r in subs if r["kind"] == "data"} == {"3.1. Currency": None, "3.4. Rate": "Term and rate", "3.5. APR": "Term and rate", "4.1. Method": None}
    assert kinds(subs)[0] == (-1, "invented_header", "Section | Item | Terms")
    assert all(s is None for s, _ in data(values)) and [r["continues"] for r in values if r["kind"] == "data"] == [None, 0, None]
    assert data(qualified)[1:] == [(None, [("Rate", ""), ("12%", "A / Currency: AMD"), ("8%", "B / Currency: USD")]), (None, [("Way", ""), ("annuity", "A / Currency: AMD")])]
    assert [r["kind"] for r in qualified] == ["header", "qualifier", "data", "data"]
    assert data(bold) == [(None, [("a", ""), ("1", "Price")])]
    assert data(lists) == [(None, [("Needed", ""), ("1. passport\n2. card", "")]), (None, [("Fee", ""), ("3", "")])]
    assert data(one) == [(None, [("Rate 12%", "")]), (None, [("Up to 60 months", "")])]
    assert empty == []


@pytest.mark.parametrize(("text", "marker", "body"), [("1These apply", "1", "These apply"), ("²Depending on it", "2", "Depending on it"), ("* Known as", "*", "Known as"), ("5 000 000 is the most", None, "5 000 000 is the most"), ("12 months at most", None, "12 months at most"), ("1. Express Loan", None, "1. Express Loan")])
def test_footnote_markers(text, marker, body):
    assert split_note(text) == (marker, body)


def test_labels():
    assert [is_label(x) for x in ("Local loans", "3. Loan terms", "Rate, see below", "Up to 5", "", "* note", "- item", "x" * 101)] == [True, True, False, False, False, False, False, False]


def test_a_long_table_holds_one_row():
    machine = Machine(2, False, False)
    for k in range(50_000):
        machine.read(k, [Cell(k, 0, 1, 1, False, False, f"a{k}"), Cell(k, 1, 1, 1, False, False, "1")])
        assert len(machine.out) <= 1
        machine.out.clear()
    assert [r[0] for r in machine.end()] == [49_999, -1]


def test_text_tables(spark):
    rows = [(1, 0, True, ["Item", "Item", "AMD", "USD"]), (1, 1, False, ["Loan", "Rate", "12%", "8%"]), (1, 2, False, ["Loan", "Fee", "1%", None]), (1, 3, False, ["Card", "Kind", "gold", "plain"]), (1, 4, False, ["Card", "Price", "5", "6"]), (None, 0, False, ["x", "1"])]
    out = structure_tables(text_cells(spark.createDataFrame(rows, "table_id long, row long, header boolean, texts array<string>"))).where("table_id = 1").orderBy("row").collect()
    assert [(r["kind"], r["labels"], [(c["text"], c["path"]) for c in r["cells"]][2:], r["continues"]) for r in out if r["kind"] != "header"] == [
        ("data", ["Loan", "Rate"], [("12%", ["AMD"]), ("8%", ["USD"])], None),
        ("data", ["Loan", "Fee"], [("1%", ["AMD"])], None),
        ("qualifier", ["Card", "Kind"], [("gold", ["AMD"]), ("plain", ["USD"])], None),
        ("data", ["Card", "Price"], [("5", ["AMD", "Kind: gold"]), ("6", ["USD", "Kind: plain"])], None),
    ]


def test_records_cite_their_notes(spark):
    page = "<table><tr><th>Item</th><th>Value</th></tr><tr><td>Rate</td><td>12%¹</td></tr><tr><td>Fee</td><td>1%</td></tr><tr><td colspan='2'>¹ Fixed for a year</td></tr></table>"
    df = spark.createDataFrame([(1, "http://h/", page)], "page_id long, url string, html string")
    assert [r["record"] for r in row_records(structure_tables(parse_cells(df))).orderBy("row").collect()] == ["Rate :: Value: 12%¹ [Fixed for a year]", "Fee :: Value: 1%"]


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_cells_that_lie_together_by_table_move_no_more(spark):
    cells = spark.range(20).selectExpr("id % 5 as table_id", "id as row", "0 as col", "1 as rowspan", "1 as colspan", "false as is_header", "false as bold", "'1' as text")
    assert shuffles(structure_tables(cells)) == 1
    assert shuffles(structure_tables(cells.repartition(3, "table_id"))) == 1


def test_text_tables_move_once(spark):
    rows = spark.createDataFrame([(1, 0, True, ["Item", "AMD"]), (1, 1, False, ["Loan", "1"])], "table_id long, row long, header boolean, texts array<string>")
    assert shuffles(structure_tables(text_cells(rows))) == 1


def test_records_read_their_tables_once(spark):
    cells = spark.range(20).selectExpr("id % 5 as table_id", "id as row", "0 as col", "1 as rowspan", "1 as colspan", "false as is_header", "false as bold", "'1' as text")
    assert row_records(structure_tables(cells))._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_named_columns_only(spark):
    df = spark.createDataFrame([(1, "http://h/", f"<table>{SECTIONS}</table>")], "page_id long, url string, html string")
    some = structure_tables(parse_cells(df), columns=("kind", "row"))
    assert some.columns == ["table_id", "kind", "row"]
    assert sorted(map(tuple, some.select("row", "kind").collect())) == sorted(map(tuple, structure_tables(parse_cells(df)).select("row", "kind").collect()))


def test_rows_of_one_layout_share_a_plan_and_plans_stay_few():
    for width in range(2, 400):
        machine = Machine(width, False, False)
        for k in range(3):
            machine.read(k, [Cell(k, c, 1, 1, False, False, f"{k}{c}") for c in range(width)])
        assert len(machine.end()) == 4
    assert sum(at[0] + len(at[2]) for at in tables_of_rows._PLANS) <= tables_of_rows._MOST_KEPT


def test_a_row_of_more_cells_than_a_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        cells = spark.range(40).selectExpr("id div 20 as table_id", "id div 10 % 2 as row", "id % 10 as col", "1 as rowspan", "1 as colspan", "false as is_header", "false as bold", "string(id) as text")
        out = structure_tables(cells).where("row >= 0").orderBy("table_id", "row").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r["table_id"], r["row"], [c["text"] for c in r["cells"]]) for r in out] == [(t, k, [str(20 * t + 10 * k + c) for c in range(10)]) for t in range(2) for k in range(2)]


def test_named_kinds_only_and_paths_under_shared_names(spark):
    df = spark.createDataFrame([(k, "http://h/", f"<table>{QUALIFIED if k % 2 else STACKED}</table>") for k in range(4)], "page_id long, url string, html string")
    whole = structure_tables(parse_cells(df))
    some = structure_tables(parse_cells(df), columns=("row", "cells"), kinds=("data", "qualifier"))
    show = lambda out: sorted(repr((r["row"], r["cells"])) for r in out.collect())
    assert show(some) == show(whole.where("kind in ('data', 'qualifier')"))
    assert structure_tables(parse_cells(df), columns=("text",), kinds=("note",)).collect() == []


def test_orders_are_dealt_over_tasks_however_small_their_file(spark):
    from factlake import queries as library

    library.load()
    assert library.QUERIES["F05_rowspan_carry"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4
