from pyspark.sql import functions as F

from factlake.plans import questions


def test_overview_names_entities_without_facts_and_says_what_is_cut(spark):
    facts = spark.createDataFrame([(1, "fee", k) for k in range(8)] + [(1, "rate", 3), (2, "other", 1), (3, "fee", None), (9, "fee", 1)], "entity int, field string, number int")
    scope = spark.createDataFrame([(1,), (2,), (3,), (3,)], "entity int")
    found = questions.overview_facts(facts, scope, ["fee", "rate"], [F.asc("number")], ["number"])
    seen = [tuple(r) for r in found.orderBy("entity", "field", "place").collect()]
    assert seen == [(1, "fee", k + 1, k, True) for k in range(6)] + [(1, "rate", 1, 3, False), (2, None, None, None, False), (3, "fee", 1, None, False)]


def test_best_variants_keep_conditions_and_ties(spark):
    facts = spark.createDataFrame(
        [("rate", 1, 5, "a", 12), ("rate", 1, 5, "b", 12), ("rate", 1, 5, "b", 12), ("rate", 1, 7, "c", 12), ("rate", 2, 4, None, 6), (None, 2, 4, "x", None), ("rate", 3, None, "a", 1)],
        "field string, entity int, number int, basis string, term int",
    )
    found = {(r["field"], r["entity"]): (r["best"], [tuple(v) for v in r["variants"]], r["tied"]) for r in questions.best_variants(facts, ["field"], ["basis", "term"], "lowest").collect()}
    assert found == {("rate", 1): (5, [("a", 12), ("b", 12)], True), ("rate", 2): (4, [(None, 6)], False), (None, 2): (4, [("x", None)], False)}
    assert questions.best_variants(facts, ["field"], ["basis"], "highest").where("entity = 1").first()["variants"][0]["basis"] == "c"
