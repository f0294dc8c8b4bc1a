"""Order-dependent packing: greedy folds over sorted keys, budgets in windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within_budget(df: DataFrame, keys: list[str], order: list[Column], cost: str, budget: int, parts: int = 0) -> DataFrame:
    """Rows of a key in order while their costs fit the budget; a cost counts as 1 at least.

    So no more than ``budget`` rows of a key can fit. For keys with very many rows, ``parts``
    of each are cut to their first so many rows beforehand, which tasks do before the shuffle.
    """
    if parts:
        part = F.pmod(F.xxhash64(*df.columns), F.lit(parts))
        first = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = df.withColumn("_part", part).withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= budget).drop("_rn", "_part")
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_used", F.sum(F.greatest(F.col(cost), F.lit(1))).over(w)).where(F.col("_used") <= budget).drop("_used")


def fold_in_order(df: DataFrame, keys: list[str], order: list[Column], step: Callable, end: Callable | None, schema: str) -> DataFrame:
    """Rows of a key are handed in order to ``step(state, row)``, which gives (state, rows out); ``end(state)`` gives a key's last rows.

    For folds that no window expresses. Keys are sorted outside Python and streamed through it,
    so a key may have any number of rows: only its state is held.
    """
    places = [df.columns.index(k) for k in keys]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                now = tuple(row[k] for k in places)
                if now != key:
                    out += end(state) if end and key is not None else []
                    key, state = now, None
                state, made = step(state, row)
                out += made
            yield pd.DataFrame(out, columns=names)
        if end and key is not None:
            yield pd.DataFrame(end(state), columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def pack(df: DataFrame, keys: list[str], order: str, text: str, most_chars: int, most_items: int = 1 << 30) -> DataFrame:
    """(keys, ordinal, first, items, chars): rows in order put together until the next would not fit."""
    kind = dict(df.dtypes)

    def step(held, row):
        done = []
        if held is None:
            held = (tuple(row[: len(keys)]), 0, row.o, 0, 0)
        elif held[4] + row.n > most_chars or held[3] >= most_items:
            done, held = flush(held), (held[0], held[1] + 1, row.o, 0, 0)
        return (*held[:3], held[3] + 1, held[4] + row.n), done

    def flush(held):
        return [(*held[0], *held[1:])]

    sizes = df.select(*keys, F.col(order).cast("long").alias("o"), F.char_length(text).cast("long").alias("n"))
    schema = ", ".join([*(f"{k} {kind[k]}" for k in keys), "ordinal long, first long, items long, chars long"])
    return fold_in_order(sizes, keys, [F.asc("o")], step, flush, schema)


def fair_share(df: DataFrame, key: str, field: str, unit: str, score: str, cost: str, budget: int) -> DataFrame:
    """(key, field, unit): whole units by turns of the fields, best scores first, while they fit the key's budget."""
    kind = dict(df.dtypes)
    turn = F.row_number().over(Window.partitionBy(key, field).orderBy(F.desc(score), F.asc(unit)))
    # units above the budget never fit
    rows = df.select(key, field, unit, score, F.col(cost).alias("_cost"), turn.alias("_turn")).where(F.col("_cost") <= budget).drop(score)

    def step(used, row):
        used = used or 0
        fits = used + row[3] <= budget
        return (used + row[3] if fits else used), ([tuple(row[:3])] if fits else [])

    return fold_in_order(rows, [key], [F.asc("_turn"), F.asc(field)], step, None, f"{key} {kind[key]}, {field} {kind[field]}, {unit} {kind[unit]}")


def split_text(text: str, most: int) -> list[str]:
    """Lines put together up to ``most`` characters; a longer line is cut at spaces, a longer word anywhere."""
    pieces = []
    for line in text.split("\n"):
        while len(line) > most:
            at = line.rfind(" ", 0, most + 1)
            at = at if at > 0 else most
            pieces.append(line[:at].rstrip())
            line = line[at:].lstrip()
        if line.strip():
            pieces.append(line)
    out: list[str] = []
    for piece in pieces:
        if out and len(out[-1]) + 1 + len(piece) <= most:
            out[-1] += "\n" + piece
        else:
            out.append(piece)
    return out


def chunks(df: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """(key, ordinal, content, content_sha256): each text is one row, so nothing is shuffled."""
    kind = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, c) for k, t in zip(batch[key], batch[text], strict=True) for i, c in enumerate(split_text(t or "", most))]
            yield pd.DataFrame(rows, columns=[key, "ordinal", "content"])

    out = df.select(key, text).mapInPandas(run, f"{key} {kind[key]}, ordinal int, content string")
    return out.withColumn("content_sha256", F.sha2("content", 256))


def chunk_units(units: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """(key, ordinal, content): lines of units in order, put together up to ``most`` characters.

    ``units`` are (key, order, breadcrumb, head, line): each chunk begins with its breadcrumb, and with the
    head of the table it continues; a new breadcrumb starts a chunk, a new head is written before its
    lines. A line that does not fit behind its beginning is cut at spaces. Null texts are empty; keys of
    any number of lines are streams that hold one chunk.
    """
    kind = dict(units.dtypes)

    def prefix(crumb: str, head: str) -> list[str]:
        return [x for x in (crumb, head) if x]

    def step(held, row):
        k, _, crumb, head, line = row
        done = []
        first = prefix(crumb, head)
        room = max(1, most - sum(len(x) + 1 for x in first))
        for piece in split_text(line, room) if len(line) > room else [line]:
            if held is not None and held[2] == crumb:
                more = ([head] if head and head != held[3] else []) + [piece]
                if held[5] + sum(len(x) + 1 for x in more) <= most:
                    held = (k, held[1], crumb, head, held[4] + more, held[5] + sum(len(x) + 1 for x in more))
                    continue
            number = 0
            if held is not None:
                done += close(held)
                number = held[1] + 1
            lines = [*first, piece]
            held = (k, number, crumb, head, lines, sum(map(len, lines)) + len(lines) - 1)
        return held, done

    def close(held):
        return [(held[0], held[1], "\n".join(held[4]))]

    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = units.select(key, order, text("breadcrumb"), text("head"), text("line")).where("line <> ''")
    return fold_in_order(rows, [key], [F.asc(order)], step, close, f"{key} {kind[key]}, ordinal long, content string")


def page_units(parsed: DataFrame, cells: DataFrame) -> DataFrame:
    """(page_id, ord, breadcrumb, head, line) of parsed pages: the blocks outside chrome in reading order, tables row by row.

    ``cells`` are the pages' cells; a table's head is its header rows, each row's cells are joined by bars.
    """
    from factlake.sources.pages import parse_blocks

    blocks = parse_blocks(parsed).where("not chrome").select("page_id", "ord", "type", "table_id", F.col("heading_path").alias("breadcrumb"), "text")
    texts = blocks.where("table_id is null").select("page_id", F.struct("ord", F.lit(0).alias("row")).alias("ord"), "breadcrumb", F.lit("").alias("head"), F.regexp_replace("text", "\n", " ").alias("line"))
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda c: c["text"]), " | ")
    rows = cells.groupBy("page_id", "table_id", "row").agg(row.alias("line"), F.bool_and("is_header").alias("is_head"))
    w = Window.partitionBy("page_id", "table_id").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    heads = F.array_join(F.collect_list(F.when(F.col("is_head"), F.col("line"))).over(w), " / ")
    tables = rows.withColumn("head", heads).where("not is_head").join(blocks.select("page_id", "table_id", F.col("ord").alias("_o"), "breadcrumb"), ["page_id", "table_id"])
    return texts.unionByName(tables.select("page_id", F.struct(F.col("_o").alias("ord"), (F.col("row") + 1).alias("row")).alias("ord"), "breadcrumb", "head", F.regexp_replace("line", "\n", " ").alias("line")))


def baseline_gate(df: DataFrame, key: str, order: str, value: str, drop: float) -> DataFrame:
    """(key, order, passed, baseline): a row passes if it is not below the drop from the last row that passed."""
    kind = dict(df.dtypes)

    def step(base, row):
        ok = base is None or not base > 0 or row[2] > base * (1 - drop)
        return (row[2] if ok else base), [(row[0], row[1], ok, base)]

    return fold_in_order(df.select(key, order, value), [key], [F.asc(order)], step, None, f"{key} {kind[key]}, {order} {kind[order]}, passed boolean, baseline double")
