import hashlib
import random
import zlib

import pytest

from factlake.llm.conversations import CUT, DUPLICATE, END, SOUND, auction, damaged, first_fault, prices, repair, repair_conversations, row_arcs, trace

WORDS = ["", " ", "Hi.", "Hi", "Why?", "So!", "so\t\n", "Yes.", "No. "]
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def plain(rows):
    """The contract read plainly: a table of the best (cost, audit) for each kept ending, row after row. Rows are (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    table = {"": (0, "", ())}

    def put(out, key, value):
        if key not in out or value[:2] < out[key][:2]:
            out[key] = value

    def filled(table):
        out = dict(table)
        for _ in range(3):
            for q, (c, a, lines) in list(out.items()):
                new = "a" if q == "u" else "u"
                put(out, new, (c + 5, a + "I", (*lines, "user:" if new == "u" else "assistant:")))
        return out

    for (_, role, text), fault in zip(rows, faults, strict=True):
        out = {}
        for q, (c, a, lines) in filled(table).items():
            put(out, q, (c + 2, a + "D", lines))
            if fault in ("", "truncated"):
                late = 5 * (fault == "truncated")
                if role[:1] in NEXT[q]:
                    put(out, role[:1], (c + late, a + "K", (*lines, f"{role}:{text}")))
                new = "a" if q == "u" else "u"
                put(out, new, (c + late + 1, a + "R", (*lines, ("user:" if new == "u" else "assistant:") + text)))
        table = out
    cost, audit, lines = min(v for q, v in filled(table).items() if q in ("", "a"))
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs),
        cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def drawn(rnd, n):
    return [(rnd.choice([None, *range(n)]), rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), rnd.choice(WORDS)) for _ in range(n)]


def counted(rows):
    """Rows as the operator takes them: equal rows once, with their number and fault."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    out, seen = [], set()
    for turn, role, text in rows:
        if out and out[-1][:3] == [turn, role, text]:
            out[-1][4] += 1
            continue
        fault = first_fault(text)
        if fault in (SOUND, CUT):
            fault = DUPLICATE if (role, text) in seen else fault
            seen.add((role, text))
        out.append([turn, role, text, fault, 1])
    return [tuple(r) for r in out]


def test_cheapest_edits_with_least_audit():
    rnd = random.Random(4)
    for k in range(400):
        rows = drawn(rnd, rnd.randrange(1, 9) if k % 8 else rnd.randrange(60, 200))
        assert repair(counted(rows)) == plain(rows), rows


def test_prices_are_feasible_and_the_path_is_tight():
    rnd = random.Random(5)
    for _ in range(60):
        rows = [(r[1][:1], r[3], r[4]) for r in counted(drawn(rnd, 30))]
        layers = auction(rows, list(END))
        for i, row in enumerate(rows):
            for q, arcs in enumerate(row_arcs(*row)):
                assert all(layers[i][q] <= cost + layers[i + 1][to] for cost, _, to in arcs)
        _, state = trace(rows, prices(rows, list(END)), 0)
        assert state in range(4)


@pytest.mark.parametrize("buffer_rows", [2, 4096])
def test_conversations_cut_anywhere(spark, buffer_rows):
    """Conversations of any length, null ids and turns, repeats, ties, extra columns; cut at every second row and held whole."""
    rnd = random.Random(6)
    rows = {c: drawn(rnd, n) for c, n in {None: 7, 1: 400, 2: 1, 3: 5, 4: 60, 5: 900, 6: 3, 7: 12}.items()}
    flat = [(c, *r, 1, "x") for c, x in rows.items() for r in x] + [(8, None, "", "", 0, "x"), (3, None, "", "", 0, "x")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(flat, "conv_id long, turn long, role string, text string, n long, audit string")
        out = {r[0]: tuple(r[1:]) for r in repair_conversations(df, buffer_rows=buffer_rows).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out == {c: plain(x) for c, x in rows.items()} | {8: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_long_texts_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "user", "a" * 3_000_000 + ".", 1), (1, 1, "assistant", "b" * 3_000_000 + ".", 1)], "conv_id long, turn long, role string, text string, n long")
    (row,) = repair_conversations(df).collect()
    assert row["audit"] == "KK" and row["repaired_sha256"] == hashlib.sha256(f"user:{'a' * 3_000_000}.\nassistant:{'b' * 3_000_000}.".encode()).hexdigest()
    assert repair_conversations(df.limit(0)).count() == 0


def test_damage(spark):
    rows = [(c, t, "system" if t == 0 else "user", f"One. Two? {t}!") for c in (*range(40), None) for t in (0, 1, 2, None)] + [(1, 1, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    expected = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text
        expected.append((c, None, "", "", 0) if kind == 0 else (c, t, role, text, 1 + (kind == 3)))
    assert sorted(map(repr, map(tuple, damaged(df).collect()))) == sorted(map(repr, expected))
