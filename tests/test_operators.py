"""Edge cases of operators on small frames: ties, nulls, first versions, open periods, spans, folds."""

import datetime

from pyspark.sql import functions as F

from factlake.functions import text as T
from factlake.functions import values as V
from factlake.operators import checks, grids, joins, packing, reads, versions
from factlake.plans import questions
from factlake.sources import pages, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_currency_keeps_unknown(spark):
    df = spark.createDataFrame([(1, None), (2, "AMD"), (3, "USD")], "id int, currency string")
    assert rows(reads.condition_match(df, currency="AMD").select("id")) == [(1,), (2,)]


def test_latest_before_is_strict_and_breaks_ties_by_id(spark):
    left = spark.createDataFrame([(1, 10), (1, 5), (2, 5)], "k int, t int")
    right = spark.createDataFrame([(1, 5, 7), (1, 5, 8), (1, 10, 9)], "k int, rt int, id long")
    assert rows(reads.latest_before(left, right, "k", "t", "rt", "id", []).select("k", "t", F.coalesce("prev_id", F.lit(-1)))) == [(1, 5, -1), (1, 10, 8), (2, 5, -1)]


def test_first_version_is_no_change_and_reversal_is(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 3, "x"), ("b", 1, None), ("b", 2, "z")], "e string, o int, v string")
    assert versions.change_set(df, "e", ["o"], ["v"]).count() == 3


def test_mutual_best_takes_lowest_index_on_ties(spark):
    left = spark.createDataFrame([("g", 1, ["a", "b"]), ("g", 2, ["a", "b"])], "g string, id int, w array<string>")
    right = spark.createDataFrame([("g", 5, ["a", "b"]), ("g", 6, ["a", "b"])], "g string, id int, w array<string>")
    assert rows(joins.mutual_best(left, right, "g", "w")) == [("g", 1, 5, 1.0)]


def test_open_period_joins_and_status(spark):
    d = datetime.date
    df = spark.createDataFrame([("m", d(2024, 5, 1))], "k string, day date")
    prices = spark.createDataFrame([("m", d(2024, 1, 1), None, 3.0)], "k string, a date, b date, rate double")
    assert joins.valid_on(df, prices, "k", "day", "a", "b").first()["rate"] == 3.0
    periods = spark.createDataFrame([([(None, d(2023, 1, 1))],), ([(d(2025, 1, 1), None)],), ([(None, None)],), ([],), (None,)], "p array<struct<starts:date,ends:date>>")
    got = [r[0] for r in periods.select(V.period_status(F.col("p"), F.lit(d(2024, 1, 1)))).collect()]
    assert got == ["historical", "future", "current", None, None]


def test_dates_and_numbers(spark):
    df = spark.createDataFrame([("on 31.02.2024",), ("1.2.24",), ("March 5, 2023",), ("5 march 2023",), ("2024-13-01",)], "s string")
    got = [r[0] for r in df.select(V.parse_date(F.col("s")).cast("string")).collect()]
    assert got == [None, "2024-02-01", "2023-03-05", "2023-03-05", None]
    n = spark.createDataFrame([("1,500",), ("0,500",), ("1,50",), ("1,500,000",), ("x",)], "s string")
    assert [r[0] and float(r[0]) for r in n.select(T.locale_decimal(F.col("s"))).collect()] == [1500.0, 0.5, 1.5, 1500000.0, None]


def test_spans_cross_and_own_cell_wins(spark):
    cells = spark.createDataFrame([(1, 0, 0, 2, 1, "a"), (1, 0, 1, 1, 2, "b"), (1, 1, 1, 1, 1, "c")], "table_id int, row int, col int, rowspan int, colspan int, text string")
    assert rows(grids.fill_spans(cells).select("row", "col", "text")) == [(0, 0, "a"), (0, 1, "b"), (0, 2, "b"), (1, 0, "a"), (1, 1, "c")]


def test_baseline_moves_only_on_pass(spark):
    df = spark.createDataFrame([("k", 1, 100.0), ("k", 2, 40.0), ("k", 3, 45.0), ("k", 4, 60.0)], "k string, o int, v double")
    assert rows(packing.baseline_gate(df, "k", "o", "v", 0.5).select("o", "passed")) == [(1, True), (2, False), (3, False), (4, True)]


def test_split_text_loses_no_word():
    text = "one two three\n" + "x" * 50 + " tail\n\nend"
    parts = packing.split_text(text, 12)
    assert all(len(p) <= 12 for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())


def test_violations_count_unknown_as_broken(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    assert rows(checks.violations("t", df, "id", {"known": F.col("s") == "a"})) == [("t", "known", "2")]


def test_rank_says_why_for_every_entity(spark):
    facts = spark.createDataFrame([(1, "x", 5), (2, "x", 5), (3, "y", 9)], "entity int, g string, number int")
    scope = spark.createDataFrame([(1,), (2,), (3,), (4,)], "entity int")
    got = {r["entity"]: (r["coverage"], r["winner"]) for r in questions.rank(facts, scope, "lowest", ["g"]).collect()}
    assert got == {1: ("ranked", True), 2: ("ranked", False), 3: ("not_comparable", False), 4: ("no_value", False)}


def test_page_scan_handles_spans_nesting_and_chrome(spark):
    url = "http://h/"
    page = "<nav>menu</nav><h1>A</h1><p>one<b>two<p>three<table><tr><th colspan=2>h<tr><td>1<td>2</table><script>x</script><img alt='' data-src='i.png'>"
    df = spark.createDataFrame([(1, url, page), (2, None, None), (3, url, "")], "page_id long, url string, html string")
    blocks = pages.parse_blocks(df).collect()
    assert [(b["type"], b["text"], b["heading_path"], b["chrome"]) for b in blocks][:4] == [("paragraph", "menu", "", True), ("heading", "A", "", False), ("paragraph", "onetwo", "A", False), ("paragraph", "three", "A", False)]
    assert rows(pages.parse_cells(df).select("row", "col", "colspan", "is_header", "text")) == [(0, 0, 2, True, "h"), (1, 0, 1, False, "1"), (1, 1, 1, False, "2")]
    assert rows(pages.parse_media(df).select("source", "decorative")) == [("http://h/i.png", True)]


def test_published_version_flips_and_upserts(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    a = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, o int, v string")
    sinks.publish(spark, a, path, "v1")
    sinks.upsert_table(spark, spark.createDataFrame([(2, 2, "c"), (1, 0, "old")], "k int, o int, v string"), path, ["k"], ["o"], "v2")
    assert rows(sinks.read_published(spark, path).select("k", "v")) == [(1, "a"), (2, "c")]


def test_order_and_partitions_do_not_matter(spark):
    df = spark.createDataFrame([(k % 3, k, k * 7 % 5) for k in range(60)], "k int, o int, v int")
    a = rows(versions.change_set(df, "k", ["o"], ["v"]))
    assert a == rows(versions.change_set(df.orderBy(F.rand(1)).repartition(7), "k", ["o"], ["v"]))


def test_mentions_of_long_names(spark):
    from factlake.operators.joins import mentions

    texts = spark.createDataFrame([(1, "The Bank of New York Mellon paid; New York did not"), (2, "bank of new york"), (3, None)], "id long, text string")
    names = spark.createDataFrame([("Bank of New York Mellon", 1), ("bank of new york", 2), ("New York", 3)], "name string, entity int")
    assert sorted((r["id"], r["entity"]) for r in mentions(texts, names, "id", "text").collect()) == [(1, 1), (1, 3), (2, 2)]
    assert mentions(texts, names.limit(0), "id", "text").count() == 0


def test_comparison_phrases(spark):
    from factlake.functions.values import comparison

    given = [("not more than 5", "<="), ("not less than 5", ">="), ("more than 5", ">"), ("overdraft of 5", None), ("up to 5", "<=")]
    got = spark.createDataFrame(given, "t string, want string").select("want", comparison(F.col("t")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_cell_paths_take_what_all_covered_columns_share(spark):
    from factlake.operators import grids as G

    rows = [
        ("t", 0, 0, 2, 1, "Name", True), ("t", 0, 1, 1, 2, "Rate", True), ("t", 0, 3, 2, 1, "Fee", True), ("t", 1, 1, 1, 1, "From", True), ("t", 1, 2, 1, 1, "To", True),
        ("t", 2, 0, 1, 1, "Basic", False), ("t", 2, 1, 1, 2, "5%", False), ("t", 2, 3, 1, 1, "10", False),
        ("t", 3, 0, 1, 1, "Plus", False), ("t", 3, 1, 1, 1, "4%", False), ("t", 3, 2, 1, 2, "free 1", False), ("u", 0, 0, 1, 1, "no header 1", False),
    ]
    cells = spark.createDataFrame([(*r, False) for r in rows], "table_id string, row int, col int, rowspan int, colspan int, text string, is_header boolean, bold boolean")
    got = {(r["table_id"], r["row"], r["col"]): r["path"] for r in G.cell_paths(cells).collect()}
    assert got == {("t", 2, 1): "Rate", ("t", 2, 3): "Fee", ("t", 3, 1): "Rate / From"}
    assert G.cell_paths(cells.limit(0)).count() == 0


def test_sections_are_carried_until_the_anchor_changes(spark):
    from factlake.operators import grids as G

    rows = [(0, None, None, "a"), (1, "S", None, "a"), (2, None, None, "a"), (3, None, "sub", "b"), (4, None, None, "b"), (5, None, None, "c"), (6, None, "x", "c"), (7, "T", None, "c"), (8, None, None, "c")]
    df = spark.createDataFrame([("t", *r) for r in rows], "t string, n int, section string, sub string, anchor string")
    got = {r["n"]: r["path"] for r in G.carried_sections(df, "t", ["n"], "section", "sub", "anchor").collect()}
    assert [got[n] for n in (0, 2, 4, 5, 8)] == [None, "S", "S > sub", "S", "T"]


def test_leftmost_longest_mentions(spark):
    from factlake.operators.joins import mentions, without_families

    texts = spark.createDataFrame([(1, "The blue anvil's price"), (2, "old blue anvil blue"), (3, "Blues, ANVILS; синяя наковальня"), (4, None), (5, "anvil blue anvil")], "id long, text string")
    names = spark.createDataFrame([("blue anvil", 1), ("anvil", 2), ("Blue", 3), ("old blue", 4), ("синяя наковальня", 5), ("anvil", 6), ("", 7)], "name string, entity long")
    found = mentions(texts, names, "id", "text")
    assert sorted((r["id"], r["entity"]) for r in found.collect()) == [(1, 1), (2, 2), (2, 3), (2, 4), (2, 6), (3, 2), (3, 3), (3, 5), (3, 6), (5, 1), (5, 2), (5, 6)]
    members = spark.createDataFrame([(1, 2), (1, 6)], "member long, family long")
    assert sorted((r["id"], r["entity"]) for r in without_families(found, members, "id").collect() if r["id"] == 5) == [(5, 1)]


def test_ordered_hash_depends_on_members_and_order_alone(spark):
    from factlake.functions.identity import ordered_hash

    def hashes(rows, width=3):
        return {r["k"]: r["fp"] for r in ordered_hash(spark.createDataFrame(rows, "k string, o long, m string"), "k", "o", "m", "fp", width).collect()}

    rows = [(k, o, f"m{o}") for k in ("a", None) for o in range(40)]
    shifted = [(k, o * 7 + 5000, m) for k, o, m in rows]
    assert hashes(rows) == hashes(shifted[::-1]) and hashes(rows)["a"] == hashes(rows)[None]
    assert hashes(rows)["a"] != hashes([(k, -o, m) for k, o, m in rows])["a"]


def test_numbered_over_ranges(spark):
    from factlake.operators.ranking import numbered

    rows = [(k, k % 3) for k in range(500)] + [(k, 7) for k in range(500, 900)]
    df = spark.createDataFrame(rows, "id long, s long").repartition(7)
    got = [(r["s"], r["id"]) for r in numbered(df, [F.desc("s"), F.asc("id")]).orderBy("rank").collect()]
    assert got == sorted(((s, k) for k, s in rows), key=lambda x: (-x[0], x[1]))
    assert sorted(r["rank"] for r in numbered(df, [F.desc("s"), F.asc("id")]).collect()) == list(range(1, 901))


def test_dates_in_every_form(spark):
    from factlake.functions.values import parse_date

    given = ["2024-03-01", "on 2024/03/01.", "2024.03.01", "1.3.2024", "1/3/24", "March 1, 2024", "1 March 2024", "2024-13-01", "31.02.2024", "12345-01-01", None]
    got = [r["d"] for r in spark.createDataFrame([(k, t) for k, t in enumerate(given)], "k int, t string").select("k", parse_date(F.col("t")).alias("d")).orderBy("k").collect()]
    assert [str(d) for d in got] == ["2024-03-01"] * 7 + ["None"] * 4


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_no_place_of_a_label_is_missed(spark):
    import random

    from factlake.operators.retrieval import label_places, locate_labels

    rng = random.Random(5)
    scripts = ["ab cé", "данет ", "利率表年", "a😀b 1"]
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    labels, lines = set(), [(0, 0, ""), (0, 1, None), (1, 0, "a")]
    for k in range(40):
        letters = scripts[k % 4]
        label = word(rng.randint(1, 23), letters)
        labels.add(label)
        damaged = list(label)
        for _ in range(rng.randint(0, len(label) // 4)):
            at = rng.randrange(len(damaged) + 1)
            damaged[at : at + rng.randint(0, 1)] = word(rng.randint(0, 1), letters)
        lines.append((2 + k % 5, k, word(rng.randint(0, 9), letters) + "".join(damaged) + word(rng.randint(0, 9), letters)))
    table = spark.createDataFrame(lines, "doc int, ord int, line string")
    wanted = spark.createDataFrame([(x,) for x in [*labels, "", None]], "label string")
    every = {}
    for doc, ord_, line in lines:
        for label in labels:
            for start in range(max(1, len(line) - len(label) + 1)) if line else ():
                e = _edits(label, line[start : start + len(label)])
                if 10 * e <= 2 * len(label):
                    every[doc, ord_, label, start] = e
    tried = {tuple(r) for r in label_places(wanted, table, ["doc", "ord"], "label", "line", 0.8).select("doc", "ord", "label", "start").collect()}
    assert every.keys() <= tried
    assert len(tried) < sum(len(x[2] or "") for x in lines) * len(labels) / 4
    best = {}
    for (doc, ord_, label, start), e in every.items():
        best[doc, label] = min(best.get((doc, label), (99, 0, 0)), (e, ord_, start))
    text = {(d, o): x for d, o, x in lines}
    expected = {(d, x, o, s, round(1 - e / len(x), 9), text[d, o][s + len(x) :]) for (d, x), (e, o, s) in best.items()}
    found = locate_labels(wanted, table, ["doc", "ord"], "label", "line", 0.8, ["doc"]).collect()
    assert {(r["doc"], r["label"], r["ord"], r["start"], round(r["similarity"], 9), r["rest"]) for r in found} == expected
    assert len(found) == len(expected)


def test_mutual_best_equals_all_pairs_without_making_them(spark):
    import random

    rng = random.Random(11)
    side = lambda first: [(rng.choice("xy"), first + k, ["hot", *{f"w{rng.randint(0, 12)}" for _ in range(rng.randint(0, 9))}]) for k in range(60)] + [(None, first + 900, ["hot"]), ("x", first + 901, []), ("x", first + 902, None)]
    left, right = side(0), side(1000)
    table = lambda data: spark.createDataFrame(data, "g string, id long, w array<string>")
    for least in (0.3, 0.5):
        score = {}
        for g, a, x in left:
            for h, b, y in right:
                if g == h and g and x and y:
                    s = len(set(x) & set(y)) / len(set(x) | set(y))
                    if s >= least:
                        score[g, a, b] = s
        best_a, best_b = {}, {}
        for (g, a, b), s in score.items():
            best_a[a] = min(best_a.get(a, (1, 0)), (-s, b))
            best_b[b] = min(best_b.get(b, (1, 0)), (-s, a))
        expected = sorted((g, a, b, s) for (g, a, b), s in score.items() if best_a[a][1] == b and best_b[b][1] == a)
        assert rows(joins.mutual_best(table(left), table(right), "g", "w", least)) == expected


def test_a_hot_word_of_small_sets_makes_no_square(spark):
    hot = lambda first: spark.range(3000).select(F.lit("g").alias("g"), (F.col("id") + first).alias("id"), F.array(F.lit("hot"), F.concat(F.lit(f"w{first}-"), "id")).alias("w"))
    met = joins._best_parts(joins._sets(hot(0), "g", "w"), joins._sets(hot(5000), "g", "w"))
    assert met.count() == 3000
    assert rows(joins.mutual_best(hot(0), hot(5000), "g", "w")) == [("g", 0, 5000, 1 / 3)]


def test_sets_of_texts_meet_only_where_they_may_be_alike(spark):
    # sets of 40 words: 20 of a common stock, four that ten sets of a side share, and 16 of their own; every 50th has a near copy beside
    def of(side, k):
        own = [f"{'c' if k % 50 == 0 else side}{k}x{i}" for i in range(16)]
        return [f"a{i}" for i in range(20)] + [f"b{k % 20}x{i}" for i in range(4)] + own

    rows = lambda side, at: [(("g"), at + k, of(side, k)) for k in range(200)]
    left, right = (spark.createDataFrame(rows(s, at), "g string, id long, words array<string>") for s, at in (("l", 0), ("r", 1000)))
    met = joins._meetings({"left": joins._sets(left, "g", "words"), "right": joins._sets(right, "g", "words")}, 0.6).collect()
    found = joins.mutual_best(left, right, "g", "words", 0.6).collect()
    assert sorted((r.left_id, r.right_id, r.score) for r in found) == [(k, 1000 + k, 1.0) for k in range(0, 200, 50)]
    # 2,000 pairs share a word of their prefixes
    assert len(met) < 40


def test_words_of_large_sets_do_not_move_one_by_one(spark):
    side = lambda first: spark.range(200).select(F.lit("g").alias("g"), (F.col("id") + first).alias("id"), F.expr(f"transform(sequence(1, 300), i -> concat('w', (id * 7 + i * 13 + {first}) % 4001))").alias("words"))
    met = joins._meetings({"left": joins._sets(side(0), "g", "words"), "right": joins._sets(side(1000), "g", "words")}, 0.6)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    # a set moves to a few buckets, its words are put in order where it lies
    assert "Generate" not in plan and "Window" not in plan and "MapInArrow" in plan, plan


def test_equal_large_sets_meet_once_and_every_character_counts(spark):
    words = [f"w{i}" for i in range(9)]
    odd = ["a\x00b", "a\x01b", "a\x01\x02b", "", " ", "c d", "é", "x", None]
    many = [("g", k, words) for k in range(400)] + [("h", 700, words)]
    left = spark.createDataFrame([*many, ("g", 900, [*odd, "y"]), ("g", 900, [*odd, "y"]), ("g", None, words), (None, 5, words), ("g", 6, [])], "g string, id long, w array<string>")
    right = spark.createDataFrame([("g", k + 1000, x) for _, k, x in many] + [("g", 1900, odd), ("g", 1901, [*odd[:5], "a", "b", "z"])], "g string, id long, w array<string>")
    sides = {k: joins._word_sets(df, "g", "w").where(joins._WHOLE) for k, df in (("left", left), ("right", right))}
    assert joins._meetings(sides, 0.6).where("left_id < 900").count() == 1
    assert rows(joins.mutual_best(left, right, "g", "w", 0.6)) == [("g", 0, 1000, 1.0), ("g", 900, 1900, 8 / 9)]


def test_mutual_best_of_large_sets_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    make = lambda k, at: [("g", at + i, sorted({f"w{min(int(rng.expovariate(0.04)), 90)}" for _ in range(rng.randint(3, 45))})) for i in range(k)]
    a, b = make(60, 0), make(60, 1000)
    frames = [spark.createDataFrame(x, "g string, id long, words array<string>") for x in (a, b)]
    score = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    for least in (0.3, 0.5):
        pairs = [(score(x, y), i, j) for _, i, x in a for _, j, y in b if score(x, y) >= least]
        best = lambda of: {k: min((-s, j if of == 1 else i) for s, i, j in pairs if (i, j)[of - 1] == k)[1] for k in {(i, j)[of - 1] for _, i, j in pairs}}
        mine, theirs = best(1), best(2)
        assert {(r.left_id, r.right_id) for r in joins.mutual_best(*frames, "g", "words", least).collect()} == {(i, j) for i, j in mine.items() if theirs[j] == i}


def test_words_of_texts_are_not_broadcast(spark):
    texts = spark.range(2000).select("id", F.lit("red bolt and blue ring").alias("text"))
    names = spark.createDataFrame([("red bolt", 1), ("ring", 2), ("red", 3)], "name string, entity long").groupBy("name").agg(F.min("entity").alias("entity"))
    members = spark.createDataFrame([(1, 3)], "member long, family long")
    found = joins.without_families(joins.mentions(texts, names, "id", "text"), members, "id")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # the catalogs go to the texts; what is found in texts meets itself in a shuffle
    assert plan.count("rightHint=(strategy=broadcast)") >= 2, plan
    assert "strategy=merge" in plan, plan
    assert found.count() == 4000
