"""Operator 11: repair of conversation structure, cheapest edits by the auction algorithm for shortest paths.

A conversation's rows are the layers of a lattice whose nodes are (row, what the kept roles end
with): nothing, a system row, a user row, an assistant row. Arcs keep, rerole, delete or insert.
The auction raises integer node prices and extends or contracts one path until it reaches the end;
on its final prices all arcs of cheapest edits are tight, and the least audit is read off by taking
the first letter, in ASCII order, whose arc is tight and still leads to the end.

Conversations lie sorted over range partitions. One that lies inside a partition is repaired there.
One that touches a partition's edge, or is longer than what a task buffers, is cut into pieces, one
for each partition: each piece gives the least cost from every entry to every exit, these are
chained per conversation (one small row for each partition), and each piece is traced on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.tables import Scratch, map_rows, pieces

# what the kept roles end with
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: the role that an insertion or a new role gives, by what stands before it
_GIVEN = ("user", "user", "assistant", "user")
_GIVES = (USER, USER, ASSISTANT, USER)
#: what ends a conversation in each state: insertions still needed, and their cost
_TAIL, END = ("", "ua", "a", ""), (0, 10, 5, 0)
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}

# costs of edits
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
# a row's first fault; VOID marks a conversation of which a row was dropped
SOUND, BLANK, DUPLICATE, CUT, VOID = range(5)

#: rows of a lattice that one auction takes, and rows and characters of a conversation that a task holds before it is cut into pieces
SPAN, BUFFER_ROWS, BUFFER_CHARS = 64, 4096, 4_000_000

_SPACE = " \t\n\x0b\x0c\r"
_REPAIR = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def first_fault(text: str) -> int:
    """The fault that a row has by its text alone."""
    end = text.rstrip(_SPACE)
    return BLANK if not end else SOUND if end[-1] in ".!?" else CUT


@lru_cache(maxsize=4096)
def row_arcs(initial: str, fault: int, n: int) -> tuple[tuple[tuple[int, str, int], ...], ...]:
    """For each state the arcs over a row that stands n times: cost, letter, state behind it. Repeats of the row are deleted."""
    if fault == VOID:
        return tuple(((0, "", q),) for q in range(4))
    more, out = DELETE * (n - 1), []
    for q in range(4):
        arcs = [(DELETE + more, "D", q)]
        if fault in (SOUND, CUT):
            extra = more + TRUNCATED * (fault == CUT)
            if initial in _AFTER[q]:
                arcs.append((extra, "K", _AFTER[q][initial]))
            arcs.append((extra + REROLE, "R", _GIVES[q]))
        out.append(tuple(arcs))
    return tuple(out)


def auction(rows: list[tuple], end: list[int | None]) -> list[list[int | None]]:
    """Prices of the nodes before each row and at the end: at the first layer the least cost to the end, elsewhere feasible lower bounds.

    ``end`` holds the price of each last node, None where it is no goal. Nodes that reach no goal have None.
    """
    layers: list[list[int | None]] = [None] * len(rows) + [list(end)]
    floor = min(x for x in end if x is not None)
    for i in range(len(rows) - 1, -1, -1):
        arcs, behind = row_arcs(*rows[i]), layers[i + 1]
        floor += min(cost for each in arcs for cost, _, _ in each)
        live = [any(behind[to] is not None for _, _, to in arcs[q]) for q in range(4)]
        for _ in range(2):
            live = [live[q] or live[_GIVES[q]] for q in range(4)]
        layers[i] = [floor if x else None for x in live]
    for origin in range(4):
        if not rows or layers[0][origin] is None:
            continue
        path = [(0, origin)]
        while path[-1][0] < len(rows):
            i, q = path[-1]
            here, behind = layers[i], layers[i + 1]
            best, at = (INSERT + here[_GIVES[q]], (i, _GIVES[q])) if here[_GIVES[q]] is not None else (1 << 60, None)
            for cost, _, to in row_arcs(*rows[i])[q]:
                if behind[to] is not None and cost + behind[to] < best:
                    best, at = cost + behind[to], (i + 1, to)
            if here[q] == best:
                path.append(at)  # extension over a tight arc
            else:
                here[q] = best  # the price rises, and the path contracts
                if len(path) > 1:
                    path.pop()
    return layers


def prices(rows: list[tuple], end: list[int | None]) -> list[list[list[int | None]]]:
    """The auctions over spans of rows, from the last to the first; a span's goals are the exact prices of the one behind it."""
    out = []
    for k in range((len(rows) - 1) // SPAN * SPAN, -1, -SPAN):
        out.append(auction(rows[k : k + SPAN], end))
        end = out[-1][0]
    return out[::-1]


def trace(rows: list[tuple], priced: list[list[list[int | None]]], state: int) -> tuple[list[tuple[str, str]], int]:
    """(inserted initials, letter) for each row on the ASCII-least cheapest edits from ``state``, and the state at the end."""
    out = []
    for k, layers in enumerate(priced):
        span = rows[k * SPAN : (k + 1) * SPAN]
        leads = [[False] * 4 for _ in span] + [[x is not None for x in layers[-1]]]
        tight = lambda i, q, cost, j, to: layers[i][q] is not None and leads[j][to] and layers[i][q] == cost + layers[j][to]
        for i in range(len(span) - 1, -1, -1):
            arcs = row_arcs(*span[i])
            for q in range(4):
                leads[i][q] = any(tight(i, q, cost, i + 1, to) for cost, _, to in arcs[q])
            for _ in range(2):
                for q in range(4):
                    leads[i][q] = leads[i][q] or tight(i, q, INSERT, i, _GIVES[q])
        for i in range(len(span)):
            inserted = ""
            while True:
                (cost, letter, to), *rest = row_arcs(*span[i])[state]
                if tight(i, state, cost, i + 1, to):
                    break
                if tight(i, state, INSERT, i, _GIVES[state]):
                    inserted, state = inserted + _GIVEN[state][0], _GIVES[state]
                    continue
                letter, to = next((c, to) for cost, c, to in rest if tight(i, state, cost, i + 1, to))
                break
            out.append((inserted, letter))
            state = to
    return out, state


class Repaired:
    """Measures and repaired lines of one conversation, row by row; holds the audit and the running hash only."""

    def __init__(self) -> None:
        self.turns, self.least, self.turn = 0, None, None
        self.faults, self.illegal, self.cost = [0] * 5, 0, 0
        self.initial, self.audit, self.sha, self.lines, self.state = None, [], hashlib.sha256(), 0, NOTHING

    def line(self, text: bytes) -> None:
        self.sha.update(b"\n" + text if self.lines else text)
        self.lines += 1

    def insert(self, initials: str) -> None:
        for c in initials:
            self.line(b"user:" if c == "u" else b"assistant:")
            self.state = _AFTER[self.state][c]
            self.audit.append("I")
            self.cost += INSERT

    def add(self, turn: int | None, role: str, text: str, fault: int, n: int, inserted: str, letter: str) -> None:
        self.insert(inserted)
        if fault == VOID:
            return
        if turn is not None and turn != self.turn:
            self.turns, self.turn = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        self.faults[fault] += 1
        self.faults[BLANK if fault == BLANK else DUPLICATE] += n - 1
        initial = role[:1]
        self.illegal += n - 1 + (self.initial is not None and (self.initial, initial) not in _LEGAL)
        self.initial = initial
        self.audit.append(letter + "D" * (n - 1))
        if letter == "D":
            self.cost += DELETE * n
            return
        if letter == "R":
            role = _GIVEN[self.state]
        self.cost += REROLE * (letter == "R") + TRUNCATED * (fault == CUT) + DELETE * (n - 1)
        self.state = _AFTER[self.state][role[0]]
        self.line(f"{role}:{text}".encode())

    def result(self) -> tuple:
        self.insert(_TAIL[self.state])
        gaps = 0 if self.least is None else self.turn - self.least + 1 - self.turns
        return gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def repair(rows: list[tuple[int | None, str, str, int, int]]) -> tuple:
    """The result of one conversation held whole: rows of (turn, role, text, fault, n) in order."""
    lattice = [(role[:1], fault, n) for _, role, _, fault, n in rows]
    edits, _ = trace(lattice, prices(lattice, list(END)), NOTHING)
    out = Repaired()
    for row, edit in zip(rows, edits, strict=True):
        out.add(*row, *edit)
    return out.result()


def _sorted_rows(rows: DataFrame, buffer_rows: int, buffer_chars: int) -> DataFrame:
    """Rows (conv_id, turn, role, text, n) to (done, conv_id, a result) or (done, conv_id, part, start, seq, a row), in order of conversation."""
    spread = rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), F.substring("role", 1, 16), F.substring("text", 1, 64))
    ordered = spread.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    names = ["done", "conv_id", "part", "start", "seq", "turn", "role", "text", "fault", "n", "digest", *(x.split()[0] for x in _REPAIR.split(", "))]
    kinds = [pa.bool_(), pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), *[pa.int64()] * 6, pa.string(), pa.string()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out, chars = [], 0  # finished rows of either kind
        conv, start, seen, held, size, streams, first = None, -1, set(), [], 0, False, True
        seq = -1

        def flush() -> list[tuple]:
            rows = [(False, conv, part, start, at, *row, digest, *[None] * 8) for at, row, digest in held]
            held.clear()
            return rows

        def close(last: bool) -> list[tuple]:
            if start < 0:
                return []
            if streams or first or last:
                return flush()
            result = repair([row for _, row, _ in held])
            held.clear()
            return [(True, conv, *[None] * 9, *result)]

        for batch in pieces(batches):
            for conv_id, turn, role, text, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seq += 1
                if start < 0 or conv_id != conv:
                    new = close(False)
                    first = start < 0
                    out += new
                    conv, start, seen, size, streams = conv_id, seq, set(), 0, False
                fault, digest = (first_fault(text), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]) if n else (VOID, None)
                if fault in (SOUND, CUT):
                    if digest in seen:
                        fault = DUPLICATE
                    seen.add(digest)
                held.append((seq, (turn, role, text, fault, n), digest))
                size += len(text)
                chars += len(text)
                if len(held) >= buffer_rows or size >= buffer_chars:
                    streams, size = True, 0
                    out += flush()
                if len(out) >= 1024 or chars >= buffer_chars and out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out, chars = [], 0
        out += close(True)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    assert schema.names == names
    return map_rows(ordered, run, f"done boolean, conv_id long, part int, start long, seq long, turn long, role string, text string, fault int, n long, digest binary, {_REPAIR}")


def _lattice(table: pa.Table) -> tuple[pa.Table, list[tuple]]:
    table = table.sort_by("seq")
    return table, list(zip(table["initial"].to_pylist(), table["fault"].to_pylist(), table["n"].to_pylist(), strict=True))


def _piece_costs(table: pa.Table) -> pa.Table:
    """For a piece the least cost from each entry (row) to each exit (column), None where there is none."""
    table, rows = _lattice(table)
    columns = []
    for exit_ in range(4):
        end: list[int | None] = [None] * 4
        end[exit_] = 0
        columns.append(prices(rows, end)[0][0])
    costs = [columns[e][q] for q in range(4) for e in range(4)]
    return pa.table({**{c: table[c].slice(0, 1) for c in ("conv_id", "part", "start")}, "costs": pa.array([costs], pa.list_(pa.int64()))})


def _ends(table: pa.Table) -> pa.Table:
    """For the pieces of one conversation the prices at each one's end."""
    table = table.sort_by("part")
    end, out = list(END), []
    for costs in table["costs"].to_pylist()[::-1]:
        out.append(end)
        end = [min(c + e for c, e in zip(costs[4 * q : 4 * q + 4], end, strict=True) if c is not None) for q in range(4)]
    return pa.table({"part": table["part"], "start": table["start"], "ends": pa.array(out[::-1], pa.list_(pa.int64()))})


def _traces(table: pa.Table) -> pa.Table:
    """The edits of a piece from every entry."""
    table, rows = _lattice(table)
    priced = prices(rows, table["ends"][0].as_py())
    out: dict[str, list] = {"entry": [], "exit": [], "seq": [], "inserted": [], "letter": []}
    for entry in range(4):
        edits, exit_ = trace(rows, priced, entry)
        for seq, (inserted, letter) in zip(table["seq"].to_pylist(), edits, strict=True):
            for name, value in zip(out, (entry, exit_, seq, inserted, letter), strict=True):
                out[name].append(value)
    n = len(out["entry"])
    same = {c: pa.repeat(table[c][0], n) for c in ("conv_id", "part", "start")}
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string())
    return pa.table({**same, **{c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds, strict=True)}})


def _entries(table: pa.Table) -> pa.Table:
    """For the pieces of one conversation the entry that the edits before it lead to."""
    exits: dict[int, dict[int, int]] = {}
    starts = {}
    for part, start, entry, exit_ in zip(*(table[c].to_pylist() for c in ("part", "start", "entry", "exit")), strict=True):
        exits.setdefault(part, {})[entry] = exit_
        starts[part] = start
    state, out = NOTHING, []
    for part in sorted(exits):
        out.append((part, starts[part], state))
        state = exits[part][state]
    parts, first, entries = zip(*out, strict=True)
    return pa.table({"part": pa.array(parts, pa.int32()), "start": pa.array(first, pa.int64()), "entry": pa.array(entries, pa.int32())})


def _joined(opened: DataFrame, scratch: Scratch) -> DataFrame:
    """Results of the conversations that lie in several pieces."""
    heads = opened.where(F.col("fault").isin(SOUND, CUT))
    spots = heads.groupBy("conv_id", "digest").agg(F.min("part").alias("at"), F.collect_list(F.struct("part", "seq")).alias("spots"))  # one for each partition at most
    later = spots.where(F.size("spots") > 1).select("at", F.explode("spots").alias("s")).where("s.part > at").select("s.part", "s.seq", F.lit(DUPLICATE).alias("later"))
    light = opened.select("conv_id", "part", "start", "seq", F.substring("role", 1, 1).alias("initial"), "fault", "n")
    light = scratch.save(light.join(later, ["part", "seq"], "left").withColumn("fault", F.coalesce("later", "fault")).drop("later"), "light")
    costs = light.groupBy("part", "start").applyInArrow(_piece_costs, "conv_id long, part int, start long, costs array<long>")
    ends = costs.groupBy("conv_id").applyInArrow(_ends, "part int, start long, ends array<long>")
    traces = light.join(ends, ["part", "start"]).groupBy("part", "start").applyInArrow(_traces, "conv_id long, part int, start long, entry int, exit int, seq long, inserted string, letter string")
    traces = scratch.save(traces, "traces")
    entries = traces.where("seq = start").groupBy("conv_id").applyInArrow(_entries, "part int, start long, entry int")
    edits = traces.join(entries, ["part", "start", "entry"]).select("part", "seq", "inserted", "letter")
    rows = opened.select("conv_id", "part", "seq", "turn", "role", "text", "n").join(light.select("part", "seq", "fault"), ["part", "seq"]).join(edits, ["part", "seq"])
    rows = rows.withColumn("text", F.when(F.col("letter") == "D", "").otherwise(F.col("text")))
    ordered = rows.select("conv_id", "part", "seq", "turn", "role", "text", "fault", "n", "inserted", "letter").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    names = ["conv_id", *(x.split()[0] for x in _REPAIR.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now = None, None
        for batch in pieces(batches):
            out = []
            for conv_id, _, _, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv_id != conv:
                    if now is not None:
                        out.append((conv, *now.result()))
                    conv, now = conv_id, Repaired()
                now.add(*row)
            if out:
                yield _results(out, names)
        if now is not None:
            yield _results([(conv, *now.result())], names)

    return map_rows(ordered, run, f"conv_id long, {_REPAIR}")


def _results(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def repair_conversations(rows: DataFrame, *, buffer_rows: int = BUFFER_ROWS, buffer_chars: int = BUFFER_CHARS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of rows (conv_id, turn, role, text, n).

    ``n`` says how often a row stands there; 0 marks a conversation of which nothing may be left.
    Nulls: a null conv_id is a conversation of its own, null turns come first and count for no gap;
    role and text must not be null. Ties: rows of one turn are taken by role, then by text. Repeated
    rows count as often as they stand. Empty texts are blank. Very long texts pass row by row. An
    empty table gives an empty result; other columns are ignored. Equal rows are added up before
    they move. What a task buffers (``buffer_rows``, ``buffer_chars``) decides where a conversation is
    repaired, never how. A conversation may be of any length: it is spread over range partitions, and only its
    audit and its hash, which the result names, go through one task as a stream.
    """
    scratch = Scratch(rows.sparkSession, "conversations")
    counted = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", F.col("n").cast("long")).groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    solved = scratch.save(_sorted_rows(counted, buffer_rows, buffer_chars), "rows")
    names = [x.split()[0] for x in _REPAIR.split(", ")]
    return solved.where("done").select("conv_id", *names).unionByName(_joined(solved.where("not done"), scratch))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, n) after damage by crc32(conv_id:turn) mod 20; nulls in the key, the role and the text are one space."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind, role, text = F.crc32(key.cast("binary")) % 20, F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    dropped = kind == 0
    return conversations.select(
        F.col("conv_id").cast("long"),
        F.when(~dropped, F.col("turn").cast("long")).alias("turn"),
        F.when(dropped, "").when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(dropped | (kind == 1), "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(dropped, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
