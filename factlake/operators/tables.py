"""What the rows of a table are: title, header, section, sub-section, note, qualifier or data, and what each value's place means.

A machine reads a table's rows in order and holds only its state: running spans, the open section
and sub-section, the qualifiers in force and one row that the next may still change. Tables of any
length stream through it, sorted by Spark; text tables become cells first and take the same way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: longest label, longest value of a qualifier row
LABEL_CHARS, QUALIFIER_CHARS = 100, 40

# fixed values: list items, footnote markers, numbering before a label, punctuation of sentences
_ITEM = re.compile(r"(?:[•▪◦]\s*|-\s+|\d{1,2}[.)]\s+)\S")
_MARKER = re.compile(r"([⁰¹²³⁴⁵⁶⁷⁸⁹]+|[*†‡]+|\d{1,2}\)|\d{1,2}(?=\s?[A-Z«\"“]))\s*(.+)", re.S)
_NUMBERING = re.compile(r"\d+(?:\.\d+)*\.?\s+")
_DIGIT = re.compile("[0-9]")
_SENTENCE = re.compile(r"[.;:!?,](?:\s|$)")
_SUPERSCRIPTS = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")


class Cell(NamedTuple):
    row: int
    col: int
    rowspan: int
    colspan: int
    head: bool
    bold: bool
    text: str


#: flags of a cell's layout (column, colspan, flags)
HEAD, BOLD, FILLED, TALL = 1, 2, 4, 8


class Carried(NamedTuple):
    """A cell that still stands in later rows."""

    end: int
    text: str
    place: tuple[int, int]
    colspan: int


def bare(text: str) -> str:
    """A text without numbering in front."""
    return _NUMBERING.sub("", text, count=1) if text[:1].isdecimal() else text


def has_digit(text: str) -> bool:
    return _DIGIT.search(text) is not None or not text.isascii() and any(c.isdigit() for c in text)


def is_label(text: str) -> bool:
    """A short phrase that heads rows: no sentence, number, footnote marker or list item."""
    if not text or "\n" in text or _MARKER.match(text):
        return False
    body = bare(text)
    return len(body) <= LABEL_CHARS and not _SENTENCE.search(body) and not _ITEM.match(body) and not has_digit(body)


def split_note(text: str) -> tuple[str | None, str]:
    """Footnote marker and body; a note that starts with an amount has no marker."""
    found = _MARKER.match(text)
    return (found[1].rstrip(")").translate(_SUPERSCRIPTS), " ".join(found[2].split())) if found else (None, text)


def is_list(text: str) -> bool:
    lines = text.split("\n")
    return bool(text) and all(_ITEM.match(x) for x in lines if x)


class Plan:
    """Where the cells of a row stand, which rows of one layout share: ``texts`` and ``all`` have for each column the cell in it, own cells first, then carried ones."""

    def __init__(self, width: int, stub: int, layout: tuple, over: tuple) -> None:
        slots: list[tuple | None] = [None] * width  # (cell, its first column, its end, carried, filled)
        for k, (col, first, colspan, filled) in enumerate(over):
            slots[col] = (len(layout) + k, first, first + colspan, True, filled)
        tall = []
        for k, (first, colspan, flags) in enumerate(layout):
            cols = range(first, min(first + colspan, width))
            for col in cols:
                slots[col] = (k, first, first + colspan, False, bool(flags & FILLED))
            if flags & TALL:
                tall.append((k, cols))
        own = [c for c, s in enumerate(slots) if s is not None and not s[3]]
        starts = [c for c in own if c == slots[c][1]]
        self.tall = tuple(tall)
        self.direct = tuple(k for k, (col, _, flags) in enumerate(layout) if flags & FILLED and col < width)
        self.all = None if None in slots else tuple(s[0] for s in slots)
        self.texts = tuple(-1 if s is None or c > s[1] else s[0] for c, s in enumerate(slots))
        self.reach = tuple(None if s is None or c > s[1] or not s[4] else (c, min(s[2], width)) for c, s in enumerate(slots))
        self.own, self.starts = frozenset(own), len(starts)
        self.values = {c: (slots[c][0], min(slots[c][2], width)) for c in starts if c >= stub and slots[c][4]}
        self.carried_first = bool(width) and slots[0] is not None and slots[0][3]
        self.first_span = slots[0][2] - slots[0][1] if width and slots[0] is not None else 1
        #: for each label column whether its cell is carried, null where it has none
        self.stub = tuple(None if s is None else (s[1], s[3]) for s in slots[:stub])
        self.below = bool(self.stub) and all(s is not None and s[1] for s in self.stub)
        alone = layout[self.direct[0]] if len(self.direct) == 1 and width >= 2 else None
        beside = alone is not None and alone[0] == 1 and width > 2 and self.carried_first
        #: the row's only cell where it reaches the right edge from the left one, or from beside a carried first cell
        self.label = self.direct[0] if alone is not None and alone[0] + alone[1] >= width and (alone[0] == 0 or beside) else None
        full = self.all is not None and (len(self.direct) >= 2 or width <= 1)
        self.heads, self.bolds = (full and all(layout[k][2] & flag for k in self.direct) for flag in (HEAD, BOLD))


_PLANS: dict[tuple, Plan] = {}
#: columns and cells of the plans that are kept
_KEPT = [0]
_MOST_KEPT = 50_000


def plan_of(*at) -> Plan:
    plan = _PLANS.get(at)
    if plan is None:
        plan = Plan(*at)
        _KEPT[0] += at[0] + len(at[2]) + 1
        if _KEPT[0] > _MOST_KEPT:
            _PLANS.clear()
            _KEPT[0] = at[0] + len(at[2]) + 1
        _PLANS[at] = plan
    return plan


_PATHS: dict[tuple, dict[Plan, list[tuple[str, ...]]]] = {}


def paths_under(width: int, stub: int, heads: list[list[str]], qualifier: dict[int, str]) -> dict[Plan, list[tuple[str, ...]]]:
    """Paths that tables with the same short names above few columns share, else none yet."""
    names = (width, stub, *map(tuple, heads), tuple(qualifier.items()))
    if width > 20 or len(heads) > 4 or sum(len(x) for h in (*heads, qualifier.values()) for x in h) > 1_000:
        return {}
    found = _PATHS.get(names)
    if found is None:
        if len(_PATHS) >= 500:
            _PATHS.clear()
        found = _PATHS[names] = {}
    return found


class Row:
    """A data row that is not given out yet; ``names`` has the column, end and name of its values where it may name columns."""

    __slots__ = ("continues", "labels", "names", "paths", "places", "qualifies", "row", "section", "texts")

    def __init__(self, row: int, section: str | None, labels: list[str], texts: list[str], paths: list[tuple[str, ...]] | None, places: list | None, continues: int | None, names: list[tuple[int, int, str]] | None) -> None:
        self.row, self.section, self.labels, self.texts, self.paths, self.places, self.continues, self.names = row, section, labels, texts, paths, places, continues, names
        self.qualifies = False

    def cells(self) -> list[tuple]:
        return [(c, t, p) for c, (t, p) in enumerate(zip(self.texts, self.paths, strict=True)) if t]


@dataclass(slots=True)
class Machine:
    """Rows of one table in order; ``out`` takes (row, kind, section, labels, row or cells, continues, marker, text)."""

    width: int
    html_heads: bool
    spans: bool
    #: whether values get the paths of their columns
    named: bool = True
    out: list[tuple] = field(default_factory=list)
    active: dict[int, Carried] = field(default_factory=dict)
    heads: list[list[str]] = field(default_factory=list)
    head_span: int = 1
    title: str | None = None
    section: tuple[int, str] | None = None
    under: int = 0
    sub: tuple[str, tuple[int, int]] | None = None
    stub: int = 0
    rows: int = 0
    qualifier: dict[int, str] = field(default_factory=dict)
    held: Row | None = None
    #: paths of a plan's columns under the present names
    known: dict[Plan, list[tuple[str, ...]]] = field(default_factory=dict)

    def note(self, row: int, text: str) -> None:
        marker, body = split_note(text)
        self.out.append((row, "note", None, None, None, None, marker, body))

    def close_section(self) -> None:
        if self.section is not None and not self.under:
            self.note(*self.section)  # a label without rows was a remark
        self.section = None

    def release(self) -> None:
        held = self.held
        if held is not None:
            self.out.append((held.row, "qualifier" if held.qualifies else "data", held.section, held.labels, held, held.continues, None, None))

    def settle(self, following: Plan) -> None:
        """The held row names columns if the row behind it has separate values in two of them."""
        held = self.held
        names, held.names = held.names, None
        if sum(col in following.values for col, _, _ in names) < 2:
            return
        held.qualifies = True
        label = bare(held.labels[-1]) if held.labels else ""
        self.qualifier = {}
        for col, end, value in names:
            self.qualifier |= dict.fromkeys(range(col, end), f"{label}: {value}" if label else value)
        if self.named:
            self.known = paths_under(self.width, self.stub, self.heads, self.qualifier)

    def column_path(self, col: int) -> tuple[str, ...]:
        if col < self.stub:
            return ()
        names = tuple(dict.fromkeys(h[col] for h in self.heads if h[col]))
        return (*names, self.qualifier[col]) if col in self.qualifier else names

    def path(self, reach: tuple[int, int]) -> tuple[str, ...]:
        """What the names of all columns that a cell covers begin with."""
        out = []
        for parts in zip(*map(self.column_path, range(*reach)), strict=False):
            if len(set(parts)) > 1:
                break
            out.append(parts[0])
        return tuple(out)

    def paths(self, plan: Plan) -> list[tuple[str, ...]]:
        found = self.known.get(plan)
        if found is None:
            if len(self.known) > 60:
                self.known.clear()
            found = self.known[plan] = [() if reach is None else self.path(reach) for reach in plan.reach]
        return found

    def start(self) -> None:
        if self.heads:
            self.stub = self.head_span if self.head_span < self.width else 1
        else:
            self.stub = 2 if self.width >= 3 and self.spans else 1
        self.stub = min(self.stub, max(self.width - 1, 1))
        if self.named:
            self.known = paths_under(self.width, self.stub, self.heads, self.qualifier)

    def read(self, row: int, cells: list[Cell]) -> None:
        layout = tuple((c.col, c.colspan, HEAD * c.head + BOLD * c.bold + FILLED * (c.text != "") + TALL * (c.rowspan > 1)) for c in cells)
        self.step(row, layout, [c.text for c in cells], [c.rowspan for c in cells])

    def step(self, row: int, layout: tuple, texts: list[str], rowspans: list[int]) -> None:
        """Reads a row: the layout, text and rowspan of each of its cells in order."""
        active, over = self.active, ()
        if active:
            for col in [c for c, a in active.items() if a.end <= row]:
                del active[col]
            over = tuple((c, a.place[1], a.colspan, a.text != "") for c, a in active.items())
        plan = plan_of(self.width, self.stub, layout, over)
        cells = [*texts, *(a.text for a in active.values()), ""] if over else [*texts, ""]  # no cell: -1
        for k, cols in plan.tall:
            active.update(dict.fromkeys(cols, Carried(row + rowspans[k], texts[k], (row, layout[k][0]), layout[k][1])))
        if not plan.direct:
            return
        if self.held is not None and self.held.names is not None:
            self.settle(plan)
        if self.sub is not None and not (plan.carried_first and active[0].place == self.sub[1]):
            self.sub = None
        if plan.label is not None:
            text, left = texts[plan.label], layout[plan.label][0] == 0
            if left and not self.rows and not self.heads and self.title is None and self.section is None:
                self.title = text
                self.out.append((row, "title", None, None, None, None, None, text))
                return
            if is_label(text):
                if left:
                    self.close_section()
                    self.section, self.under, self.sub = (row, text), 0, None
                else:
                    self.sub = (text, active[0].place)
                    self.out.append((row, "sub_section", self.section[1] if self.section else None, None, None, None, None, text))
                return
            if left:
                self.note(row, text)
                return
        if not self.rows:
            if plan.heads if self.html_heads else plan.bolds and not any(has_digit(texts[k]) for k in plan.direct):
                if not self.heads:
                    self.head_span = plan.first_span
                self.heads.append([cells[k] for k in plan.all])
                self.out.append((row, "header", None, None, [(layout[k][0], texts[k], ()) for k in plan.direct], None, None, None))
                return
            self.start()
            plan = plan_of(self.width, self.stub, layout, over)
        self.data(row, plan, cells)

    def data(self, row: int, plan: Plan, cells: list[str]) -> None:
        texts = [cells[k] for k in plan.texts]
        section = self.section[1] if self.section else None
        if self.sub is not None:
            section = f"{section} > {self.sub[0]}" if section else self.sub[0]
        if self.section and not self.under:
            self.out.append((self.section[0], "section", None, None, None, None, None, self.section[1]))
        self.under += 1
        held = self.held
        if held is not None and held.section == section:
            if plan.starts == 1 and len(plan.direct) == 1:
                column = min(plan.own)
                others = all(a == b for c, (a, b) in enumerate(zip(held.texts, texts, strict=True)) if c not in plan.own)
                if others and is_list(texts[column]) and is_list(held.texts[column]):
                    held.texts[column] += "\n" + texts[column]
                    return
            if held.texts == texts:
                self.out.append((row, "repeated", section, None, None, None, None, None))
                return
        names = self.names(plan, cells) if len(plan.values) >= 2 else None
        labels = list(dict.fromkeys(t for t in texts[: self.stub] if t)) if self.stub > 1 else [texts[0]] if texts[0] else []
        # a cell can be carried only from a row that left one behind
        places = [s and (self.active[c].place if s[1] else (row, s[0])) for c, s in enumerate(plan.stub)] if self.active else None
        new = Row(row, section, labels, texts, self.paths(plan) if self.named else None, places, self.completes(plan, places, texts) if plan.below else None, names)
        self.release()
        self.held = new
        self.rows += 1

    def names(self, plan: Plan, cells: list[str]) -> list[tuple[int, int, str]] | None:
        """The values of a row that may name columns: at least two, short, without digits, not all the same."""
        out = []
        for col, (k, end) in plan.values.items():
            name = bare(cells[k])
            if not name or len(name) > QUALIFIER_CHARS or has_digit(name):
                return None
            out.append((col, end, name))
        return out if any(x[2] != out[0][2] for x in out) else None

    def completes(self, plan: Plan, places: list, texts: list[str]) -> int | None:
        """The row above, where this one adds its numbers to the words of that one under the same carried labels."""
        held, values = self.held, [t for t in texts[self.stub :] if t]
        if held is None or held.places != places or not values or not all(map(has_digit, values)):
            return None
        before = [bare(t) for t in held.texts[self.stub :] if t]
        return held.row if before and all(len(t) <= QUALIFIER_CHARS and not has_digit(t) for t in before) else None

    def end(self) -> list[tuple]:
        self.release()
        self.held = None
        self.close_section()
        if self.rows and not self.heads:
            names = ["Section", "Item", *(["Terms"] if self.width == 3 else [f"Terms {k}" for k in range(1, self.width - 1)])] if self.width >= 3 and self.spans else [f"Column {k + 1}" for k in range(self.width)]
            self.out.append((-1, "invented_header", None, None, None, None, None, " | ".join(names)))
        return self.out


_CELLS = pa.list_(pa.struct([("col", pa.int32()), ("text", pa.string()), ("path", pa.list_(pa.string()))]))
_COLUMNS = {"row": (pa.int64(), "long"), "kind": (pa.string(), "string"), "section": (pa.string(), "string"), "labels": (pa.list_(pa.string()), "array<string>"), "cells": (_CELLS, "array<struct<col:int,text:string,path:array<string>>>"), "continues": (pa.int64(), "long"), "marker": (pa.string(), "string"), "text": (pa.string(), "string")}


def structure_tables(cells: DataFrame, key: str = "table_id", columns: tuple[str, ...] = tuple(_COLUMNS), kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(key, row, kind, section, labels, cells, continues, marker, text), one row for each meaningful row of a table; of these ``columns`` beside the key, and rows of ``kinds``, all if none are named.

    ``cells`` are (key, row, col, rowspan, colspan, is_header, bold, text); null texts are empty, tables
    without text have no rows, a null key is a table of its own. Kinds: title, header, section,
    sub_section, note, qualifier, data, repeated, and invented_header (row -1) where a table has none.
    Data cells carry the path of their columns: headers, then the qualifier in force. List items below
    a list are added to its row. A table is one stream; what a table needs to know beforehand (width,
    whether it has header cells or spans) comes with its cells. Cells that lie together by table move no more.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    whole = lambda c: F.col(c).cast("int").alias(c)
    plain = cells.select(F.col(key).alias("key"), F.col("row").cast("long").alias("row"), *map(whole, ("col", "rowspan", "colspan")), F.coalesce("is_header", F.lit(False)).alias("head"), F.coalesce("bold", F.lit(False)).alias("bold"), text.alias("text"))
    w = Window.partitionBy("key").orderBy("row", "col")
    table = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    flag = lambda c, n: F.when(c, n).otherwise(0)
    flags = flag(F.col("head"), HEAD) + flag(F.col("bold"), BOLD) + flag(F.col("text") != "", FILLED) + flag(F.col("rowspan") > 1, TALL)
    spoken = F.when(F.col("text") != "", F.col("col") + F.col("colspan"))
    facts = [F.coalesce(F.max(spoken).over(table), F.lit(0)).alias("width"), F.bool_or("head").over(table).alias("html"), (F.max("rowspan").over(table) > 1).alias("spans")]
    # already in this order behind the windows
    ordered = plain.select("key", "row", "col", "colspan", flags.alias("flags"), "rowspan", "text", (F.row_number().over(w) == 1).alias("first"), *facts).sortWithinPartitions("key", "row", "col")
    kind, places, named = dict(cells.dtypes)[key], [list(_COLUMNS).index(c) for c in columns], "cells" in columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, key, out = None, None, []
        # the last row, which the next batch may go on with
        at, line, said, spans = -1, [], [], []
        kind_of_key = None

        def batch() -> pa.RecordBatch:
            rows = [*zip(*out, strict=True)]
            made = [pa.array([x.cells() if isinstance(x, Row) else x for x in rows[k + 1]] if c == "cells" else rows[k + 1], _COLUMNS[c][0]) for k, c in zip(places, columns, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(rows[0], kind_of_key), *made], ["key", *columns])

        def take() -> None:
            out.extend((key, *r) for r in machine.out if kinds is None or r[1] in kinds)
            machine.out.clear()

        for b in batches:
            if not b.num_rows:
                continue
            kind_of_key = b.schema.field(0).type
            rows, firsts = b.column(1).to_numpy(), b.column(7).to_numpy(zero_copy_only=False)
            layouts = [*zip(*(b.column(k).to_numpy().tolist() for k in (2, 3, 4)), strict=True)]
            opened = b.take(pa.array(np.flatnonzero(firsts)))
            tables = zip(opened.column(0).to_pylist(), *(opened.column(k).to_numpy(zero_copy_only=False).tolist() for k in (8, 9, 10)), strict=True)
            texts = b.column(6).to_numpy(zero_copy_only=False).tolist()
            rowspans = b.column(5).to_numpy().tolist()
            starts = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | firsts[1:]]))
            ends = [*starts[1:].tolist(), len(rows)]
            for i, end, row, first in zip(starts.tolist(), ends, rows[starts].tolist(), firsts[starts].tolist(), strict=True):
                if line and (first or row != at):
                    machine.step(at, tuple(line), said, spans)
                    line = []
                if first:
                    if machine is not None:
                        machine.end()
                        take()
                    key, *facts = next(tables)
                    machine = Machine(*facts, named)
                at, line, said, spans = (row, layouts[i:end], texts[i:end], rowspans[i:end]) if not line else (row, line + layouts[i:end], said + texts[i:end], spans + rowspans[i:end])
            take()
            if out:
                yield batch()
                out.clear()
        if machine is not None:
            machine.step(at, tuple(line), said, spans)
            machine.end()
            take()
        if out:
            yield batch()

    return ordered.mapInArrow(run, ", ".join([f"key {kind}", *(f"{c} {_COLUMNS[c][1]}" for c in columns)])).withColumnRenamed("key", key)


def text_cells(rows: DataFrame, key: str = "table_id") -> DataFrame:
    """Cells of text tables (key, row, header, texts): equal neighbours of a header row are one spread cell, equal first texts below each other one carried cell.

    Rows move once, to their table; what lies together by table already moves no more.
    """
    spread = rows.select(key, F.col("row").cast("long").alias("row"), F.col("header").alias("is_header"), F.posexplode("texts").alias("col", "text")).withColumn("text", F.trim(F.coalesce("text", F.lit(""))))
    # windows of a table, so that all that follows is dealt by table
    across = Window.partitionBy(key).orderBy("row", "is_header", "col")
    beside = lambda c: F.lag(c).over(across).eqNullSafe(F.col(c))
    heads = spread.withColumn("_opens", ~(F.col("is_header") & beside("row") & beside("is_header") & beside("text") & (F.col("text") != "")))
    wide = heads.withColumn("_run", F.sum(F.coalesce("_opens", F.lit(True)).cast("int")).over(across)).groupBy(key, "row", "is_header", "_run", "text").agg(F.min("col").alias("col"), F.count("*").cast("int").alias("colspan")).drop("_run")
    down = Window.partitionBy(key, "col", "is_header").orderBy("row")
    carried = ~F.col("is_header") & (F.col("col") == 0) & (F.col("text") != "") & (F.lag("text").over(down) == F.col("text")) & (F.lag("row").over(down) == F.col("row") - 1)
    tall = wide.withColumn("_run", F.sum(F.when(F.coalesce(carried, F.lit(False)), 0).otherwise(1)).over(down))
    ordered = tall.groupBy(key, "col", "is_header", "_run", "text").agg(F.min("row").alias("row"), F.count("*").cast("int").alias("rowspan"), F.max("colspan").alias("colspan"))
    return ordered.select(key, "row", "col", "rowspan", "colspan", "is_header", F.lit(False).alias("bold"), "text")


def row_records(structured: DataFrame, key: str = "table_id") -> DataFrame:
    """(key, row, record) of data rows: section, label path, then each value behind the path of its columns; notes that a value's marker cites follow in brackets."""
    values = F.filter("cells", lambda c: ~F.array_contains("labels", c["text"]) | (F.size(c["path"]) > 0))
    line = F.array_join(F.transform(values, lambda c: F.concat_ws(": ", F.nullif(F.array_join(c["path"], " / "), F.lit("")), c["text"])), " | ")
    record = F.concat_ws(" :: ", "section", F.nullif(F.array_join("labels", " > "), F.lit("")), F.nullif(line, F.lit("")))
    marker = F.translate(F.regexp_extract(F.concat_ws(" ", F.transform(values, lambda c: c["text"])), "([⁰¹²³⁴⁵⁶⁷⁸⁹]+)", 1), "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")
    # rows and notes meet by marker in one window of a table, so the tables are read once
    note = F.col("kind") == "note"
    told = structured.where("kind in ('data', 'qualifier') or kind = 'note' and marker is not null").select(key, "row", note.alias("_is"), F.when(note, F.col("marker")).otherwise(marker).alias("_marker"), F.when(note, F.col("text")).otherwise(record).alias("record"))
    cited = told.withColumn("_note", F.min(F.when(F.col("_is"), F.col("record"))).over(Window.partitionBy(key, "_marker"))).where("not _is")
    return cited.select(key, "row", F.concat("record", F.when(F.col("_note").isNotNull(), F.concat(F.lit(" ["), "_note", F.lit("]"))).otherwise("")).alias("record"))
