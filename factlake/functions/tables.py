"""Functions for use in SQL: scalar ones, and table functions that give rows."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from factlake.functions.readings import NUMBER, SCALAR, extract_scalars_udf, scan_scalars
from factlake.functions.text import STOPWORDS, SUFFIXES
from factlake.operators.packing import split_text
from factlake.sources.tree import scan


@udtf(returnType="ordinal: int, content: string")
class Chunks:
    """chunks(text, most): pieces of a text of at most that many characters, in order."""

    def eval(self, text: str, most: int):
        yield from enumerate(split_text(text or "", most))


@udtf(returnType=SCALAR.removeprefix("array<struct<").removesuffix(">>"))
class Scalars:
    """scalar_spans(text): typed spans of a text, in order."""

    def eval(self, text: str):
        for s in scan_scalars(text or ""):
            yield tuple(s[k] for k in ("kind", "operator", "value", "low", "high", "unit", "day", "raw", "start", "end"))


@udtf(returnType="ord: int, type: string, text: string, heading_path: string, chrome: boolean")
class HtmlBlocks:
    """html_blocks(html): the blocks of a page in reading order."""

    def eval(self, html: str):
        for b in scan(html, None)["blocks"]:
            yield b["ord"], b["type"], b["text"], " > ".join(b["heading_path"]), b["chrome"]


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_functions() -> dict[str, str]:
    """Signature to body of the scalar functions that SQL itself can express."""
    stop = ", ".join(map(_literal, STOPWORDS))
    cut = " ".join(f"when s like '%{x}' and length(s) >= {len(x) + 3} then substr(s, 1, length(s) - {len(x)})" for x in SUFFIXES)
    cast = ", ".join(f"try_cast({r} as decimal(38, 6))" for r in ("translate(x, ',', '')", "translate(x, ',', '.')", "translate(translate(x, '.', ''), ',', '.')", "translate(x, '.,', '')"))
    return {
        "collapsed(s string) returns string": f"lower(trim(regexp_replace(s, {_literal(chr(92) + 's+')}, ' ')))",
        "term_key(s string) returns string": f"trim(regexp_replace(lower(s), {_literal('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+')}, ' '))",
        "quote_position(s string, quote string) returns int": "instr(collapsed(s), collapsed(quote))",
        "search_tokens(s string) returns array<string>": f"filter(split(regexp_replace(lower(s), {_literal('[' + chr(39) + '’`]')}, ''), {_literal('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+')}), x -> length(x) > 1 and x not in ({stop}))",
        "stem_word(s string) returns string": f"case {cut} else s end",
        "search_terms(s string) returns string": "array_join(transform(slice(array_distinct(search_tokens(s)), 1, 12), x -> case when length(x) >= 4 then concat(x, ':*') else x end), ' | ')",
        "number_readings(s string) returns array<decimal(38, 6)>": f"array_distinct(array_compact(flatten(transform(transform(regexp_extract_all(s, {_literal('(' + NUMBER + ')')}, 1), x -> translate(x, '  ', '')), x -> array({cast})))))",
    }


def register_functions(spark: SparkSession) -> None:
    """Registers all functions in the session: the scalar ones above, extract_scalars(text), and the table functions chunks, scalar_spans and html_blocks."""
    for signature, body in sql_functions().items():
        spark.sql(f"create or replace temporary function {signature} return {body}")
    spark.udf.register("extract_scalars", extract_scalars_udf())
    for name, fn in (("chunks", Chunks), ("scalar_spans", Scalars), ("html_blocks", HtmlBlocks)):
        spark.udtf.register(name, fn)
