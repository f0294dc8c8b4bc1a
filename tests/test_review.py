from pyspark.sql import functions as F

from factlake.operators.review import review_evidence


def test_units_by_seeds_precedence_and_order_without_copies(spark):
    catalog = spark.createDataFrame(
        [("a1", "page", 2, 10, "Rate 12% a year"), ("a2", "page", 2, 11, "Fee 1,000"), ("b1", "copy", 1, 5, "rate 12% A YEAR fee 1,000"), ("c1", "faq", 1, 20, "Тарифы банка"), ("d1", "foot", 1, 30, None), ("d1", "foot", 1, 30, None), ("e1", None, 1, 40, "x")],
        "evidence_id string, unit string, precedence int, at int, content string",
    )
    seeds = spark.createDataFrame(
        [(1, "a1"), (1, "a2"), (1, "a1"), (1, "b1"), (1, "c1"), (1, "zz"), (1, "yy"), (2, "a1"), (2, "b1"), (2, "d1"), (3, "zz"), (4, "e1"), (5, None), (None, "a1"), (6, "d1"), (6, "c1")],
        "review int, evidence_id string",
    )
    found = {r["review"]: ([(u["unit"], list(u["seeds"])) for u in r["units"] or []], r["unknown_ids"]) for r in review_evidence(seeds, catalog).collect()}
    assert found == {
        1: ([("page", ["a1", "a2"]), ("faq", ["c1"])], ["yy", "zz"]),
        2: ([("copy", ["b1"]), ("foot", ["d1"])], None),
        3: ([], ["zz"]),
        4: ([], ["e1"]),
        6: ([("faq", ["c1"]), ("foot", ["d1"])], None),
    }
    assert [len(r["units"]) for r in review_evidence(seeds, catalog, most=1).where("units is not null").collect()] == [1] * 3
    assert review_evidence(seeds.limit(0), catalog).isEmpty() and review_evidence(seeds, catalog.limit(0)).where(F.col("units").isNotNull()).isEmpty()


def test_names_are_anchored_to_the_canonical_page(spark):
    from factlake.operators.checks import canonical_citations

    results = spark.createDataFrame([("r1", 1), ("r2", 1), ("r3", 2), ("r4", 3), ("r4", 3), ("r5", 1)], "result string, batch int")
    evidence = spark.createDataFrame([(1, "a", "https://X.example/p/"), (1, "a", "https://x.example/p"), (1, "b", "https://x.example/p.pdf"), (2, "a", "https://y.example/"), (3, "c", "https://z.example"), (1, None, "https://x.example/p")], "batch int, evidence_id string, url string")
    canonical = spark.createDataFrame([(1, "https://x.example/P"), (2, None), (3, "https://other.example")], "batch int, url string")
    citations = spark.createDataFrame([("r1", "a"), ("r1", "a"), ("r1", "b"), ("r2", "b"), ("r3", "a"), ("r4", "c")], "result string, evidence_id string")
    found = sorted(tuple(r) for r in canonical_citations(results, citations, evidence, canonical).collect())
    assert found == [("r1", 1, 1, 1, True), ("r2", 1, 1, 0, False), ("r3", 2, 0, 0, True), ("r4", 3, 0, 0, True), ("r5", 1, 1, 0, False)]
    assert canonical_citations(results.limit(0), citations, evidence, canonical).isEmpty()
