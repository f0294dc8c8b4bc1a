from factlake.operators.packing import chunk_units, page_units
from factlake.sources.pages import parse_cells, parse_pages


def test_chunks_repeat_where_they_stand(spark):
    rows = [(1, 1, "A", "", "one"), (1, 2, "A", "h | i", "a | b"), (1, 3, "A", "h | i", "c | d"), (1, 4, "B", None, "long words that do not fit"), (1, 5, "B", None, ""), (None, 1, None, None, "x" * 30)]
    df = spark.createDataFrame(rows, "k long, i int, breadcrumb string, head string, line string")
    out = sorted((r["k"] or 0, r["ordinal"], r["content"]) for r in chunk_units(df, "k", "i", 18).collect())
    assert out == [(0, 0, "x" * 18), (0, 1, "x" * 12), (1, 0, "A\none\nh | i\na | b"), (1, 1, "A\nh | i\nc | d"), (1, 2, "B\nlong words that"), (1, 3, "B\ndo not fit")]


def test_every_cell_is_in_one_chunk_with_its_header(spark):
    body = "".join(f"<tr><td>label {k}</td><td>value {k}</td></tr>" for k in range(200))
    html = f"<nav>menu</nav><h1>Title</h1><p>Intro</p><section><h2>Part</h2><table><tr><th>Item</th><th>Value</th></tr>{body}</table></section><p>Outro</p>"
    parsed = parse_pages(spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string"))
    chunks = [r["content"] for r in chunk_units(page_units(parsed, parse_cells(parsed)), "page_id", "ord", 300).orderBy("ordinal").collect()]
    assert all(len(c) <= 300 for c in chunks) and "menu" not in "".join(chunks)
    assert all(c.startswith("Title > Part\nItem | Value\n") for c in chunks if "label" in c)
    assert [x for c in chunks for x in c.split("\n") if x.startswith("label")] == [f"label {k} | value {k}" for k in range(200)]
