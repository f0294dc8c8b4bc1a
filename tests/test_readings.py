"""Number texts against hand-written readings, spans and parsed lines."""

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from factlake.functions import readings as R


def values(spark, make, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r["v"] for r in df.select("k", make(F.col("t")).alias("v")).orderBy("k").collect()]


def numbers(found):
    return None if found is None else sorted(float(x) for x in found)


def test_every_reading(spark):
    got = values(spark, R.number_readings, "1.234", "12,5", "3,000,000", "5 000", "AMD 3-150 million", "none", None, "9" * 40)
    assert [numbers(x) for x in got] == [[1.234, 1234.0], [12.5, 125.0], [3000000.0], [5000.0], [3.0, 150.0, 3e6, 150e6], [], None, []]
    (years,) = values(spark, lambda c: R.number_readings(c, months=True), "2 years")
    assert numbers(years) == [2.0, 3.0, 24.0]


def test_grounding_is_by_number_not_by_substring(spark):
    rows = [("5", "15 in 2021"), ("5", "5% and 15"), ("1500", "1.5 thousand"), ("1500", "1,500"), ("0", "nothing"), ("12", None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, n string, q string")
    missing = df.select("k", R.ungrounded_numbers(F.array(F.col("n").cast("decimal(38,6)")), F.col("q")).alias("m")).orderBy("k").collect()
    assert [numbers(r["m"]) for r in missing] == [[5.0], [], [], [], [], [12.0]]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("01.03.2024 - 31.12.2024", [("date", date(2024, 3, 1)), ("date", date(2024, 12, 31))]),
        ("on March 5, 2023 or 6 April 2023, not 31.02.2023 %", [("date", date(2023, 3, 5)), ("date", date(2023, 4, 6))]),
        ("10.5-12% a year", [("range", D("10.5"), D(12), "percent")]),
        ("10 - 5%", [("number", None, D(5), "percent")]),
        ("USD 1,000 to 5,000", [("range", D(1000), D(5000), "USD")]),
        ("up to 60 months, at least $5", [("number", "<=", D(60), "month"), ("number", ">=", D(5), "USD")]),
        ("0,125% and 1,000 drams and 7 apples", [("number", None, D("0.125"), "percent"), ("number", None, D(1000), "AMD")]),
        ("", []),
    ],
)
def test_spans_by_kind(text, expected):
    got = []
    for s in R.scan_scalars(text):
        got.append(("date", s["day"]) if s["kind"] == "date" else ("range", s["low"].normalize(), s["high"].normalize(), s["unit"]) if s["kind"] == "range" else ("number", s["operator"], s["value"].normalize(), s["unit"]))
        assert text[s["start"] : s["end"]] == s["raw"]
    assert got == [tuple(x.normalize() if isinstance(x, D) else x for x in e) for e in expected]


def test_spans_of_a_long_text_take_time_by_its_length():
    assert len(R.scan_scalars("up to 5% and 1-2 months, " * 20_000)) == 40_000


def test_lines(spark):
    money = values(spark, R.money_range, "USD 3-150 million", "up to 5,000,000 AMD", "from 10 thousand euros", "7", "nothing", "5 thousand to 2 million")
    assert [m and (numbers([x for x in (m["low"], m["high"]) if x is not None]), m["low"] is None, m["currency"]) for m in money] == [([3e6, 150e6], False, "USD"), ([5e6], True, "AMD"), ([10000.0], False, "EUR"), ([7.0, 7.0], False, None), None, ([5000.0, 2e6], False, None)]
    terms = values(spark, R.term, "12-60 months", "up to 2 years", "Indefinite term (until requested back)", "5%")
    assert [x and tuple(x) for x in terms] == [(12, 60, False), (None, 24, False), (None, None, True), None]
    rates = values(spark, R.rate, "12.5% fixed", "from 9%", "9")
    assert [x and (x["low"], x["high"], x["rate_type"]) for x in rates] == [(D("12.5"), D("12.5"), "fixed"), (D(9), None, "unknown"), None]
    fees = values(spark, R.fee_line, "0.5%, minimum 1,000 AMD", "free of charge")
    assert [(f["percent"], f["low"], f["high"], f["currency"], f["free"]) for f in fees] == [(D("0.5"), D(1000), None, "AMD", False), (None, None, None, None, True)]
    assert [a and tuple(a) for a in values(spark, R.age_range, "aged 21 - 65", "from 18 years", "12")] == [(21, 65), (18, None), None]
    assert values(spark, R.yes_no, "Yes", "not available", "maybe") == [True, False, None]
