"""A nested payload against its facts by hand."""

import json
from decimal import Decimal as D

from pyspark.sql import functions as F

from factlake.plans import projection as P


def facts(spark, payload):
    df = spark.createDataFrame([(1, payload if payload is None or isinstance(payload, str) else json.dumps({"fields": payload}))], "id int, payload string")
    return P.project_facts(df, P.registry(spark), ["id"]).collect()


def test_registry_names_each_path_once():
    paths = [r[3] for r in P.path_rules()]
    assert len(paths) == len(set(paths)) == 58 and "fee.other" not in P.rankable_paths() and "amount.minimum" in P.rankable_paths()


def test_ranges_tags_conditions_and_lost_fields(spark):
    condition = [{"dimension": "currency", "operator": "=", "value": "eur"}]
    got = facts(spark, {
        "loan_amount": {"status": "found", "value": [{"value": {"type": "absolute", "range": {"min": 1.5, "currency": "USD"}}, "conditions": []}, {"value": {"type": "unknown", "range": {"min": 3}}}]},
        "interest_rate": {"status": "found", "value": [{"value": {"min": 1, "max": 2, "basis": "annual"}, "conditions": condition}]},
        "term": {"status": "ambiguous", "value": None},
        "not_a_field": {"status": "found", "value": 1},
        "grace_period_days": {"status": "found", "value": 30},
        "purpose": {"status": "found", "value": [None, "x"]},
    })
    rows = sorted((r["path"], r["status"], r["number"], r["unit"], r["currency"], r["basis"], r["conditions"]) for r in got if r["status"] == "found")
    assert rows == [
        ("amount.minimum", "found", D("1.5"), "money", "USD", None, ""),
        ("identity.purpose", "found", None, None, None, None, ""),
        ("rate.nominal.maximum", "found", D(2), "percent", "EUR", "annual", "currency = eur"),
        ("rate.nominal.minimum", "found", D(1), "percent", "EUR", "annual", "currency = eur"),
        ("revolving.grace_period_days", "found", D(30), "days", None, None, ""),
    ]
    assert sorted(r["path"] for r in got if r["status"] == "ambiguous") == ["term.end_condition", "term.indefinite", "term.maximum_months", "term.minimum_months"]
    assert len({r["variant_key"] for r in got if r["path"].startswith("rate")}) == 1


def test_payloads_that_are_none(spark):
    assert facts(spark, None) == [] and facts(spark, "no json") == [] and facts(spark, {}) == []


def test_nine_reasons_in_order(spark):
    base = ("amount.minimum", 5.0, "money", "USD", "annual", "general", ["a", "b"])
    changes = [(0, "amount.maximum", "different_field"), (1, None, "missing_number"), (2, "percent", "different_unit"), (3, None, "different_currency"), (4, "monthly", "different_rate_basis"), (5, "other", "different_fee_scope"), (6, ["a"], "different_conditions"), (6, ["b", "a", "a"], None)]
    pairs = [(base, (*base[:k], v, *base[k + 1 :]), want) for k, v, want in changes]
    pairs += [(("fee.other", *base[1:]), ("fee.other", *base[1:]), "unclassified_fee"), (("term.indefinite", *base[1:]), ("term.indefinite", *base[1:]), "unsupported_field")]
    side = "struct<path:string,number:double,unit:string,currency:string,basis:string,scope:string,conditions:array<string>>"
    df = spark.createDataFrame(pairs, f"l {side}, r {side}, want string")
    out = df.select("want", P.comparison_reason("l", "r", F.col("l.path").isin(*P.rankable_paths())).alias("got")).collect()
    assert [r["got"] for r in out] == [r["want"] for r in out]
