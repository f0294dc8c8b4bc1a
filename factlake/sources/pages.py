"""Page scans: one pass turns raw HTML into blocks, cells, links and media; everything else reads that table."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.sources.tree import scan

_BLOCK = "block_id:string,ord:int,type:string,text:string,markdown:string,heading_path:array<string>,parent_id:string,link_ids:array<string>,table_id:string,level:int,key:string,value:string,chrome:boolean"
_CELL = "table_id:string,row:int,col:int,rowspan:int,colspan:int,is_header:boolean,row_header:boolean,thead:boolean,bold:boolean,text:string"
_LINK = "link_id:string,ord:int,url:string,href:string,fragment:string,text:string,title:string,rel:array<string>,kind:string,downloadable:boolean,same_source:boolean,chrome:boolean,context:string,block_id:string"
_MEDIUM = "ord:int,tag:string,source:string,label:string,decorative:boolean,chrome:boolean"
#: pages of one Arrow batch
_BATCH = 64


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _arrow(fields: str) -> pa.DataType:
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    return pa.list_(pa.struct([(name, kinds[kind]) for name, kind in (f.split(":") for f in fields.split(","))]))


def parse_pages(pages: DataFrame, allowed_hosts: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, url, title, lang, blocks, cells, links, media), one row for each page and one parse.

    Null pages have no parts. Links are absolute, resolved against the page's URL, and marked as of the
    same source where their host is allowed (left out: the page's own host). Hidden elements, scripts
    and controls give no text.
    """
    allowed = frozenset(allowed_hosts)
    names = ("blocks", "cells", "links", "media")
    kinds = [_arrow(x) for x in (_BLOCK, _CELL, _LINK, _MEDIUM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, _BATCH):
                batch = whole.slice(k, _BATCH)
                found = [scan(page, url, allowed) for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                parts = [pa.array([f[n] for f in found], kind) for n, kind in zip(names, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([f[n] for f in found], pa.string()) for n in ("title", "lang")), *parts], ["page_id", "url", "title", "lang", *names])

    schema = f"page_id long, url string, title string, lang string, blocks array<struct<{_BLOCK}>>, cells array<struct<{_CELL}>>, links array<struct<{_LINK}>>, media array<struct<{_MEDIUM}>>"
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, schema)


def _parts(pages: DataFrame, name: str) -> DataFrame:
    """The parts of parsed pages, or of raw ones, one row each."""
    parsed = pages if name in pages.columns else parse_pages(pages)
    return parsed.select("page_id", F.explode(name).alias("p")).select("page_id", "p.*")


def parse_blocks(pages: DataFrame) -> DataFrame:
    """Blocks in reading order with type, text, heading path, parent, links, table, key and value; ``pages`` raw or parsed."""
    return _parts(pages, "blocks").withColumn("heading_path", F.array_join("heading_path", " > "))


def parse_cells(pages: DataFrame) -> DataFrame:
    """Table cells with their places on the grid, spans and header flags."""
    return _parts(pages, "cells")


def parse_links(pages: DataFrame) -> DataFrame:
    """Links with absolute URL, fragment, type, source, context and the block that holds them."""
    return _parts(pages, "links")


def parse_media(pages: DataFrame) -> DataFrame:
    """Images and controls."""
    return _parts(pages, "media")


def definition_pairs(pages: DataFrame) -> DataFrame:
    """(page_id, block_id, key, value) of definition lists and headline cards."""
    return _parts(pages, "blocks").where("key is not null").select("page_id", "block_id", "key", "value")


def inventory(pages: DataFrame) -> DataFrame:
    """(page_id, main_chars, blocks, tables, links, pdf_links) of parsed pages; no shuffle, as a page is one row."""
    main = F.filter("blocks", lambda b: ~b["chrome"])
    chars = F.aggregate(main, F.lit(0).cast("long"), lambda n, b: n + F.char_length(b["text"]))
    count = lambda c: F.size(c).cast("long")
    tables = F.size(F.filter("blocks", lambda b: b["table_id"].isNotNull()))
    return pages.select("page_id", chars.alias("main_chars"), count(main).alias("blocks"), tables.cast("long").alias("tables"), count("links").alias("links"), count(F.filter("links", lambda x: x["downloadable"])).alias("pdf_links"))


def cross_links(parsed: DataFrame, seeds: DataFrame, most_chars: int = 300) -> DataFrame:
    """(page_id, target): pages that link, in a small block, to another entity's seed path and not to their own.

    ``seeds`` are (path, target), paths as ``path_key`` gives them. Links to nowhere known go in the join.
    """
    from factlake.functions.values import path_key

    blocks = _parts(parsed, "blocks").where(F.char_length("text") <= most_chars).select("page_id", "block_id")
    links = _parts(parsed, "links").where("same_source and not chrome").join(blocks, ["page_id", "block_id"], "left_semi")
    met = links.select("page_id", "block_id", path_key(F.col("url")).alias("path")).join(seeds, "path")
    own = met.where(F.col("page_id") == F.col("target")).select("page_id", "block_id")
    return met.where(F.col("page_id") != F.col("target")).join(own, ["page_id", "block_id"], "left_anti").select("page_id", "target").distinct()


def page_text(pages: DataFrame) -> DataFrame:
    """(page_id, title, lang, main_text): the text of the blocks outside site chrome, a line each."""
    parsed = pages if "blocks" in pages.columns else parse_pages(pages)
    main = F.array_join(F.transform(F.filter("blocks", lambda b: ~b["chrome"]), lambda b: b["text"]), "\n")
    return parsed.select("page_id", "title", "lang", F.nullif(main, F.lit("")).alias("main_text"))


def titles(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", r'<html lang="([^"]*)"', 1).alias("lang"))


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, ord, href, text) of plain anchors, by pattern alone."""
    hrefs, texts = (F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">([^<]*)</a>'), k) for k in (1, 2))
    return pages.select("page_id", F.posexplode(F.arrays_zip(hrefs.alias("href"), texts.alias("text"))).alias("ord", "a")).select("page_id", "ord", "a.href", "a.text")


def render_markdown(parsed: DataFrame) -> DataFrame:
    """(page_id, markdown) of parsed pages: headings with marks, list items with dashes, tables as grids, blocks apart."""
    return parsed.where(F.size("blocks") > 0).select("page_id", F.array_join(F.transform("blocks", lambda b: b["markdown"]), "\n\n").alias("markdown"))


def content_hash(parsed: DataFrame) -> DataFrame:
    """(page_id, sha): identity of a parsed page without its chrome."""
    main = F.filter("blocks", lambda b: ~b["chrome"])
    lines = F.transform(main, lambda b: F.concat_ws("\x1f", b["type"], b["text"]))
    return parsed.where(F.size(main) > 0).select("page_id", F.sha2(F.array_join(lines, "\n"), 256).alias("sha"))


def decode_references(text: str) -> str:
    return html.unescape(re.sub(r"\s+", " ", text)).strip()
