"""Table cells: spans, headers, neighbours and continuation rows, over cells(table_id, row, col, rowspan, colspan, text, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _placed(cells: DataFrame) -> DataFrame:
    """One row per grid place a cell covers, with the cell's own row and column and ``_wins``: a cell's own place wins over a spanned one."""
    rows, cols = F.greatest("rowspan", F.lit(1)), F.greatest("colspan", F.lit(1))
    spread = cells.withColumn("_i", F.explode(F.sequence(F.lit(0), rows * cols - 1))).withColumns({"_r": F.floor(F.col("_i") / cols).cast("int"), "_c": F.col("_i") % cols})
    placed = spread.withColumns({"_row": F.col("row"), "_col": F.col("col"), "row": F.col("row") + F.col("_r"), "col": F.col("col") + F.col("_c"), "_own": F.col("_r") + F.col("_c")})
    w = Window.partitionBy("table_id", "row", "col").orderBy("_own", F.desc("text"))
    return placed.withColumn("_wins", F.row_number().over(w) == 1).drop("_i", "_c", "_own")


def fill_spans(cells: DataFrame) -> DataFrame:
    """One row per grid place a cell covers; a cell's own place wins over a spanned one."""
    return _placed(cells).where("_wins").drop("_wins", "_r", "_row", "_col")


def trimmed(grid: DataFrame) -> DataFrame:
    """Without columns right of the last one that has text."""
    last = F.max(F.when(F.trim("text") != "", F.col("col"))).over(Window.partitionBy("table_id"))
    return grid.withColumn("_last", last).where("col <= _last").drop("_last")


def _with_header(cells: DataFrame, counts: Column | None = None) -> DataFrame:
    """Adds header: whether the row's cells, those where ``counts`` holds, are header cells, or all bold without a digit, before the first other row.

    Windows of a table by row, so cells that lie together by table and in the order of their rows move no more.
    """
    flag = F.col("is_header") | (F.col("bold") & ~F.regexp_like("text", F.lit(r"\d")))
    rows = cells.withColumn("_h", F.bool_and(flag if counts is None else F.when(counts, flag)).over(Window.partitionBy("table_id", "row")))
    before = F.min(F.col("_h").cast("int")).over(Window.partitionBy("table_id").orderBy("row"))
    return rows.withColumn("header", before == 1).drop("_h")


def header_rows(cells: DataFrame) -> DataFrame:
    """(table_id, row, header): rows of header cells, or all bold without a digit, before the first other row."""
    return _with_header(cells).groupBy("table_id", "row").agg(F.bool_and("header").alias("header"))


def _stacked(heads: Column) -> Column:
    """The texts of (row, text) in order, repeats once."""
    return F.array_distinct(F.sort_array(heads).getField("text"))


def _column() -> WindowSpec:
    """A column from its first row to its last, whatever the row that asks."""
    return Window.partitionBy("table_id", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _header_lists(cells: DataFrame) -> DataFrame:
    """(table_id, col, heads): stacked headers of a column, repeats once."""
    return _with_header(cells).where("header").groupBy("table_id", "col").agg(_stacked(F.collect_list(F.struct("row", "text"))).alias("heads"))


def column_headers(cells: DataFrame) -> DataFrame:
    """(table_id, col, path): stacked headers of a column joined by ' / ', repeats once."""
    return _header_lists(cells).select("table_id", "col", F.array_join("heads", " / ").alias("path"))


def _common_start(a: Column, b: Column) -> Column:
    shorter = F.least(F.size(a), F.size(b))
    places = F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>"))
    return F.slice(a, 1, F.size(F.filter(places, lambda i: F.slice(a, 1, i) == F.slice(b, 1, i))))


def cell_paths(cells: DataFrame) -> DataFrame:
    """(table_id, row, col, path) of body cells with text: the headers that all columns it covers begin with, joined by ' / '.

    Label columns have no headers of their own; cells with nothing in common to their columns go. The
    grid and the cells stay one table: what wins a place makes the headers, what a cell covers in its
    own row is named by them, so nothing is joined and cells move once, to their table.
    """
    named = _with_header(_placed(_with_header(cells).withColumnRenamed("header", "_head")), F.col("_wins"))
    body = F.col("_wins") & ~F.col("header")
    by_column = named.withColumns({
        "_heads": F.array_distinct(F.collect_list(F.when(F.col("_wins") & F.col("header"), F.col("text"))).over(_column())),
        "_l": F.bool_and(F.when(body, ~F.regexp_like("text", F.lit(r"\d")))).over(_column()),
        "_one": F.row_number().over(Window.partitionBy("table_id", "col").orderBy("row")),
    })
    run = F.min(F.col("_l").cast("int")).over(Window.partitionBy("table_id").orderBy("col"))
    wide = F.sum(F.when((F.col("_one") == 1) & F.col("_l").isNotNull(), F.col("_run"))).over(Window.partitionBy("table_id"))
    covered = by_column.withColumn("_run", run).withColumn("_width", wide).where((F.col("_r") == 0) & ~F.col("_head") & (F.trim("text") != ""))
    heads = F.when(F.col("col") >= F.coalesce("_width", F.lit(0)), F.col("_heads")).otherwise(F.array().cast("array<string>"))
    # one list for each of a cell's columns; most cells have one
    lists = covered.groupBy("table_id", F.col("_row").alias("row"), F.col("_col").alias("col")).agg(F.collect_list(heads).alias("_l"))
    path = F.array_join(F.when(F.size("_l") == 1, F.col("_l")[0]).otherwise(F.aggregate("_l", F.col("_l")[0], _common_start)), " / ")
    return lists.select("table_id", "row", "col", path.alias("path")).where("path <> ''")


def stub_width(cells: DataFrame) -> DataFrame:
    """(table_id, width): leading columns whose body cells hold no digit."""
    labels = _with_header(cells).where("not header").groupBy("table_id", "col").agg(F.bool_and(~F.regexp_like("text", F.lit(r"\d"))).alias("_l"))
    run = F.min(F.col("_l").cast("int")).over(Window.partitionBy("table_id").orderBy("col").rowsBetween(Window.unboundedPreceding, 0))
    return labels.withColumn("_run", run).groupBy("table_id").agg(F.sum("_run").cast("long").alias("width"))


def neighbours(rows: DataFrame, seeds: DataFrame, key: str, ordinal: str, reach: int) -> DataFrame:
    """Rows within ``reach`` of a seed; each seed is spread to its ordinals, so the join stays an equi join."""
    near = seeds.select(key, F.explode(F.sequence(F.col(ordinal) - reach, F.col(ordinal) + reach)).alias(ordinal)).distinct()
    return rows.join(near, [key, ordinal], "left_semi")


def merge_continuations(rows: DataFrame, key: str, ordinal: str, text: str, continues: str) -> DataFrame:
    """Rows that continue the one before are joined to it by a space."""
    w = Window.partitionBy(key).orderBy(ordinal)
    group = F.sum((~F.col(continues)).cast("int")).over(w)
    rows = rows.withColumn("_g", group)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ordinal, text))), lambda s: s[text]), " ")
    return rows.groupBy(key, "_g").agg(F.min(ordinal).alias(ordinal), joined.alias(text)).drop("_g")


def sections(grid: DataFrame) -> DataFrame:
    """Adds section: the text of the last full-width row above, empty before the first."""
    row = Window.partitionBy("table_id", "row")
    alike = (F.min("text").over(row) == F.max("text").over(row)) & (F.count("*").over(row) > 1)
    marked = grid.withColumn("_s", F.when(alike, F.max("text").over(row)))
    opened = F.last("_s", ignorenulls=True).over(Window.partitionBy("table_id").orderBy("row"))
    return marked.withColumn("section", F.coalesce(opened, F.lit(""))).drop("_s")


def carried_sections(rows: DataFrame, table: str, order: list[str], section: str, sub: str, anchor: str) -> DataFrame:
    """Adds path: the last section above, and the last sub-section since then while the row stands beside the same anchor cell.

    ``section`` and ``sub`` hold a text in the rows that open one, else null; null where neither is open.
    """
    w = Window.partitionBy(table).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    opened = rows.withColumn("_n", F.count(section).over(w)).withColumn("_s", F.last(section, ignorenulls=True).over(w))
    below = F.last(F.when(F.col(sub).isNotNull(), F.struct(F.col(sub).alias("t"), F.col(anchor).alias("a"), F.col("_n").alias("n"))), ignorenulls=True).over(w)
    part = F.when((F.col("_u.n") == F.col("_n")) & F.col("_u.a").eqNullSafe(F.col(anchor)), F.col("_u.t"))
    return opened.withColumn("_u", below).withColumn("path", F.nullif(F.concat_ws(" > ", "_s", part), F.lit(""))).drop("_n", "_s", "_u")


def row_records(grid: DataFrame) -> DataFrame:
    """(table_id, row, record): 'column path: value' of the body cells, in column order."""
    heads = F.when(F.bool_or("header").over(_column()), F.array_distinct(F.collect_list(F.when(F.col("header"), F.col("text"))).over(_column())))
    body = _with_header(grid).withColumn("_heads", heads).where(~F.col("header") & (F.trim("text") != ""))
    cell = F.concat_ws(": ", F.array_join("_heads", " / "), "text")
    ordered = F.sort_array(F.collect_list(F.struct("col", cell.alias("cell")))).getField("cell")
    return body.groupBy("table_id", "row").agg(F.array_join(ordered, " | ").alias("record"))


def continuation_links(grid: DataFrame) -> DataFrame:
    """(table_id, row, completes): whether the row has the label of the row above it."""
    labels = grid.where("col = 0").select("table_id", "row", "text")
    w = Window.partitionBy("table_id").orderBy("row")
    return labels.select("table_id", "row", (F.lag("text").over(w) == F.col("text")).alias("completes")).withColumn("completes", F.coalesce("completes", F.lit(False)))


def ambiguities(grid: DataFrame) -> DataFrame:
    """(table_id, issue, n): repeated rows, and columns without a header."""
    rows = grid.groupBy("table_id", "row").agg(F.array_join(F.sort_array(F.collect_list(F.struct("col", "text"))).getField("text"), "\x1f").alias("r"))
    repeated = rows.groupBy("table_id", "r").count().where("count > 1").groupBy("table_id").agg(F.sum(F.col("count") - 1).alias("n")).withColumn("issue", F.lit("repeated_row"))
    headed = _with_header(grid).groupBy("table_id", "col").agg(F.bool_or("header").alias("_h"))
    bare = headed.where("not _h").groupBy("table_id").agg(F.count("*").alias("n")).withColumn("issue", F.lit("no_header"))
    return repeated.unionByName(bare).select("table_id", "issue", "n")


def render_packets(rows: DataFrame, key: str, order: str, header: str, content: str, width: int) -> DataFrame:
    """(key, packet_no, packet): contents in order, each header once where it changes; a packet holds the rows of ``width`` places of the order."""
    rows = rows.withColumn("packet_no", F.floor(F.col(order) / width))
    w = Window.partitionBy(key, "packet_no").orderBy(order)
    changed = ~F.col(header).eqNullSafe(F.lag(header).over(w)) | (F.row_number().over(w) == 1)
    line = F.when(changed, F.concat(F.lit("## "), header, F.lit("\n"), content)).otherwise(F.col(content))
    lines = rows.select(key, "packet_no", order, line.alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda s: s["line"])
    return lines.groupBy(key, "packet_no").agg(F.array_join(ordered, "\n").alias("packet"))
