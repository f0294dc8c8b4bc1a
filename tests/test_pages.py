"""Hand-written pages against expected rows of the page parse."""

import time

import pytest

from factlake.sources import pages as P
from factlake.sources.tree import scan

PAGE = """<!DOCTYPE html><html lang="en"><head><title> My  page</title><style>x</style></head><body>
<header><nav><ul><li><a href="/">Home</a><li><a href="x.pdf">P</a></ul></nav></header>
<main>Lead <b>text</b><h1>Loan</h1><p>Intro <a href="../b?x#f" rel="nofollow me">B</a> more<p>Second
<dl><dt>Rate:</dt><dd>12%</dd><dd>13%</dd><dt>Term</dt><dd>60 <i>months</i></dd><dd></dd></dl>
<div class="card"><h3>Card head</h3><p>Card body <a href="mailto:a@b">mail</a></p></div>
<div><h6>AMD 3-150 million</h6><p>Loan amount:</p></div>
<div class="faq"><div class="faq-title">Question?</div><div class="faq-panel"><h2>In</h2><p>Answer</p><ul><li>a<ul><li>b</li></ul></li></ul></div></div>
<div style="display: none"><p>secret</p></div><p aria-hidden="true">secret</p>
<section><header>Own header</header><h2>Tables</h2><table><caption>Cap</caption><thead><tr><th rowspan=2>Term<th colspan=2>Rate<tr><th>AMD<th>USD</thead>
<tr><td><b>12 months</b><td>12%<td>8% <table><tr><td>inner</table> tail<tr><th scope="row">24<td colspan=2>9%</table></section>
<details><summary>More</summary><p>detail</p></details>after<img src="a.png" alt=""><img data-src="b.png" alt="B"><button>Go</button></main><footer>foot</footer></body></html>"""


def test_blocks_of_every_kind():
    blocks = scan(PAGE, "https://h.com/a/b/c")["blocks"]
    assert [(b["type"], b["text"], " > ".join(b["heading_path"]), b["parent_id"], ",".join(b["link_ids"]), b["chrome"]) for b in blocks] == [
        ("list", "Home", "", None, "l1", True),
        ("list", "P", "", None, "l2", True),
        ("paragraph", "Lead text", "", None, "", False),
        ("heading", "Loan", "", None, "", False),
        ("paragraph", "Intro B more", "Loan", None, "l3", False),
        ("paragraph", "Second", "Loan", None, "", False),
        ("key_value", "Rate: 12%\n13%", "Loan", None, "", False),
        ("key_value", "Term: 60 months", "Loan", None, "", False),
        ("card", "Card head\nCard body mail", "Loan", None, "", False),
        ("key_value", "Loan amount: AMD 3-150 million", "Loan", None, "", False),
        ("accordion", "Question?", "Loan", None, "", False),
        ("heading", "In", "Loan > Question?", "b11", "", False),
        ("paragraph", "Answer", "Loan > Question? > In", "b11", "", False),
        ("list", "a\nb", "Loan > Question? > In", "b11", "", False),
        ("paragraph", "Own header", "Loan", None, "", False),
        ("heading", "Tables", "Loan", None, "", False),
        ("table", "Cap\nTerm | Rate\nAMD | USD\n12 months | 12% | 8% tail\n24 | 9%", "Loan > Tables", None, "", False),
        ("table", "inner", "Loan > Tables", "b17", "", False),
        ("accordion", "More\ndetail", "Loan", None, "", False),
        ("paragraph", "after", "Loan", None, "", False),
        ("paragraph", "foot", "Loan", None, "", True),
    ]
    assert blocks[16]["markdown"].split("\n")[:3] == ["| Term | Rate |  |", "| --- | --- | --- |", "|  | AMD | USD |"]


def test_cells_links_and_media():
    page = scan(PAGE, "https://h.com/a/b/c")
    assert (page["title"], page["lang"]) == ("My page", "en")
    assert [(c["table_id"], c["row"], c["col"], c["thead"], c["is_header"], c["row_header"], c["bold"], c["text"]) for c in page["cells"]] == [
        ("t1", 0, 0, True, True, False, False, "Term"), ("t1", 0, 1, True, True, False, False, "Rate"), ("t1", 1, 1, True, True, False, False, "AMD"), ("t1", 1, 2, True, True, False, False, "USD"),
        ("t1", 2, 0, False, False, False, True, "12 months"), ("t1", 2, 1, False, False, False, False, "12%"), ("t1", 2, 2, False, False, False, False, "8% tail"),
        ("t1", 3, 0, False, False, True, False, "24"), ("t1", 3, 1, False, False, False, False, "9%"), ("t2", 0, 0, False, False, False, False, "inner"),
    ]
    assert [(x["url"], x["fragment"], x["rel"], x["downloadable"], x["context"], x["block_id"]) for x in page["links"]] == [
        ("https://h.com/", None, [], False, "Home", "b1"), ("https://h.com/a/b/x.pdf", None, [], True, "P", "b2"), ("https://h.com/a/b?x", "f", ["nofollow", "me"], False, "Intro B more", "b5"),
    ]
    assert [(m["tag"], m["source"], m["label"], m["decorative"]) for m in page["media"]] == [("img", "https://h.com/a/b/a.png", "", True), ("img", "https://h.com/a/b/b.png", "B", False), ("button", "", "Go", False)]


def test_text_after_a_nested_table_stays_in_its_cell():
    cells = scan("<table><tr><td>before<table><tr><td>in<td>ner</table>after</td><td>next</td></tr></table>", None)["cells"]
    assert [c["text"] for c in cells] == ["beforeafter", "next", "in", "ner"]


@pytest.mark.parametrize("piece", ["<div>", "<li>", "<a ", "<p><b>", "<table><tr><td>", "<ul><li><a href=x>", "</p>", "<!--", "<a x='", "&#"])
def test_hostile_pages_take_time_by_their_length(piece):
    began = time.process_time()
    scan(piece * (300_000 // len(piece)) + "</p>" * 1000, "http://a/")
    assert time.process_time() - began < 20


def test_allowed_hosts_and_one_row_for_each_page(spark):
    df = spark.createDataFrame([(1, "http://a.com/", '<a href="http://b.com/x">b</a><a href="/y">y</a>'), (2, None, None), (None, "x", "")], "page_id long, url string, html string")
    parsed = P.parse_pages(df, ("b.com",))
    assert parsed.count() == 3
    assert [(r["url"], r["same_source"]) for r in P.parse_links(parsed).orderBy("ord").collect()] == [("http://b.com/x", True), ("http://a.com/y", False)]
    assert {r["page_id"]: r["links"] for r in P.inventory(parsed).collect()} == {1: 2, 2: 0, None: 0}


def test_cross_links_leave_out_blocks_that_also_link_home(spark):
    html = '<p><a href="/b">b</a></p><p><a href="/a">a</a> <a href="/c">c</a></p><p>{}<a href="/c">c</a></p>'.format("long " * 100)
    df = spark.createDataFrame([(1, "http://h/a", html), (2, "http://h/b", ""), (3, "http://h/c", "")], "page_id long, url string, html string")
    seeds = spark.createDataFrame([("/a", 1), ("/b", 2), ("/c", 3)], "path string, target long")
    assert [tuple(r) for r in P.cross_links(P.parse_pages(df), seeds).collect()] == [(1, 2)]
