from datetime import date

from pyspark.sql import functions as F

from factlake.operators import labels as L

ITEM = "item int, scope string, authority string, role string, relevance string, temporal string, evidence string, title string, periods array<struct<raw:string,starts:date,ends:date>>"


def item(k, temporal, evidence, periods=None, title="T"):
    return (k, "section", "official_product_content", "terms", "relevant", temporal, evidence, title, periods)


def test_statuses_are_settled_by_quotes_dates_and_periods(spark):
    items = [
        item(1, "possibly_stale", "valid until 01.02.2025"),  # quoted, dated before
        item(2, "possibly_stale", "not in the text"),
        item(3, "future", "from 01.02.2025"),  # dated before today
        item(4, "future", "from 1.2.2027"),
        item(5, "current", None, [("until 01.02.2025", None, date(2025, 2, 1))]),
        item(6, "future", None, [("from 2020", date(2020, 1, 1), None)]),
        item(7, "possibly_stale", "old edition 2020"),  # one of three members
        item(8, "possibly_stale", "in the title", title="It is In  the Title"),
        item(9, "unknown", None),
    ]
    texts = {1: ["Valid  UNTIL 01.02.2025"], 2: ["text"], 3: ["from 01.02.2025"], 4: ["from 1.2.2027"], 5: ["x"], 7: ["old edition 2020", "new", "newer"], 6: [None]}
    members = spark.createDataFrame([(k, f"m{n}", x) for k, xs in texts.items() for n, x in enumerate(xs, 1)], "item int, member string, text string")
    settled, exceptions = L.settle_temporal(spark.createDataFrame(items, ITEM), members, F.lit("2026-01-01").cast("date"))
    got = {r["item"]: (r["temporal"], r["moved"]) for r in settled.collect()}
    assert got == {1: ("possibly_stale", False), 2: ("unknown", False), 3: ("unknown", False), 4: ("future", False), 5: ("possibly_stale", False), 6: ("current", False), 7: ("unknown", True), 8: ("possibly_stale", False), 9: ("unknown", False)}
    assert [tuple(r) for r in exceptions.collect()] == [(7, "m1", "historical_version", "irrelevant")]
    handed = {r["member"]: (r["relevance"], r["decision"]) for r in L.inherited(settled, members, exceptions).where("item = 7").collect()}
    assert handed == {"m1": ("irrelevant", "own"), "m2": ("relevant", "inherited"), "m3": ("relevant", "inherited")}


def test_own_labels_beat_containers(spark):
    rows = [("a", 1, "section", "official_terms", "x", "relevant", "current"), ("a", 2, "block", "other", "x", "irrelevant", "current"), ("b", 3, "section", "other", "x", "relevant", None), ("b", 4, "document", "official_terms", "x", "relevant", "current"), ("c", 5, "table", "other", "pricing", "relevant", "current"), ("c", 6, "block", "other", "x", "relevant", "current"), ("d", 7, "block", "other", "x", "relevant", "future")]
    df = spark.createDataFrame(rows, "source string, item int, scope string, authority string, role string, relevance string, temporal string")
    assert sorted(tuple(r) for r in L.selected_sources(df).collect()) == [("b", 4, 1), ("c", 5, 2)]
