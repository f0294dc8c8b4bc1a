"""Pages derived from the given tables: one for each supplier, with the parts that the given pages lack."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlake.sources.pages import parse_pages
from factlake.sources.shared import written_once

#: added to a supplier's key for the id of its page
PAGE_IDS = 1_000_000_000
HOST = "https://shop.example.com"


def spread_rows(t, df, key: str, each: int):
    """The rows dealt by key over tasks of some ``each`` rows: a table that is small on disk is read by few tasks, however much is made from a row."""
    tasks = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), df.count() // each + 1)
    return df.repartition(tasks, key)


def supplier_pages(t):
    """(page_id, url, html): definition list, headline card, card, accordion, hidden part, table with spans, links and media."""
    sums = t.lineitem.groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count("*").alias("n"))
    # six groups of lines for each supplier at most
    rows = sums.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("l_returnflag", "l_linestatus", "q", "n"))).alias("rows"), F.sum("n").alias("lines"))
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(rows, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    key, text = F.col("s_suppkey"), lambda c: F.col(c).cast("string")
    line = lambda r: F.concat(F.lit("<tr><td><b>"), r["l_returnflag"], F.lit(" "), r["l_linestatus"], F.lit("</b></td><td>"), r["q"].cast("string"), F.lit("</td><td>"), r["n"].cast("string"), F.lit("</td></tr>"))
    body = F.coalesce(F.array_join(F.transform("rows", line), ""), F.lit(""))
    html = F.format_string(
        '<!DOCTYPE html><html lang="en"><head><title>%s</title></head><body><header><nav><ul><li><a href="/">Home</a></li></ul></nav></header><main><h1>%s</h1>'
        "<dl><dt>Nation:</dt><dd>%s</dd><dt>Region key</dt><dd>%s</dd></dl><div><h6>%s USD</h6><p>Account balance</p></div>"
        '<div class="card"><h3>Offer %s</h3><p>See <a href="/suppliers/%s">the next supplier</a></p></div>'
        '<div class="faq"><div class="faq-title">What is sold?</div><div class="faq-panel"><p>%s lines</p><p>Details in <a href="files/%s.pdf" type="application/pdf">the file</a></p></div></div>'
        '<div hidden><p>Not shown</p></div><section><h2>Lines</h2><table><caption>By flag</caption><thead><tr><th rowspan="2">Flag</th><th colspan="2">Sums</th></tr><tr><th>Quantity</th><th>Count</th></tr></thead>%s</table></section>'
        '<img src="/img/%s.png" alt=""><button>Order</button></main><footer><p>Shop</p></footer></body></html>',
        F.col("s_name"), F.col("s_name"), F.col("n_name"), text("n_regionkey"), F.floor("s_acctbal").cast("string"), text("s_suppkey"), (key + 1).cast("string"), F.coalesce(text("lines"), F.lit("0")), text("s_suppkey"), body, text("s_suppkey"),
    )
    return s.select((key + PAGE_IDS).alias("page_id"), F.concat(F.lit(f"{HOST}/suppliers/"), text("s_suppkey")).alias("url"), html.alias("html"))


#: pages that a task parses at most, some few milliseconds each
_PAGES_OF_TASK = 2_000


def parsed_pages(t):
    """The given pages parsed, once in an application."""
    return written_once(t.spark, "parsed-pages", t.sf_dir, lambda: parse_pages(spread_rows(t, t.pages, "page_id", _PAGES_OF_TASK)))


def parsed_suppliers(t):
    """The derived pages parsed, once in an application; the given ones are not asked for."""

    def build():
        pages = supplier_pages(t)
        tasks = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), t.supplier.count() // _PAGES_OF_TASK + 1)
        return parse_pages(pages.repartition(tasks, "page_id"))

    return written_once(t.spark, "parsed-suppliers", t.sf_dir, build)


def parsed_all(t):
    """The given pages and the derived ones, parsed, each once."""
    return parsed_pages(t).unionByName(parsed_suppliers(t))
