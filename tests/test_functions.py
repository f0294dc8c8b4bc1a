from factlake.functions.tables import register_functions


def test_functions_in_sql(spark):
    register_functions(spark)
    one = lambda e: spark.sql(f"select {e} as v").first()["v"]
    assert one("search_tokens('The bank''s BIG rates, a 12')") == ["banks", "big", "rates", "12"]
    assert one("stem_word('payments')") == "pay" and one("stem_word('is')") == "is"
    assert one("search_terms('The rate of the loan')") == "rate:* | loan:*"
    assert one("quote_position('A  Quote\\n here', 'quote HERE')") == 3
    assert sorted(float(x) for x in one("number_readings('1.234 or 5')")) == [1.234, 5.0, 1234.0]
    assert [(s["kind"], s["unit"]) for s in one("extract_scalars('up to 5% on 01.02.2024')")] == [("number", "percent"), ("date", None)]
    assert [tuple(r) for r in spark.sql("select s.kind, s.unit, s.start from (select '3-5 months' as t) x, lateral scalar_spans(t) s").collect()] == [("range", "month", 0)]
    assert [tuple(r) for r in spark.sql("select type, text, heading_path from html_blocks('<h1>A</h1><p>b')").collect()] == [("heading", "A", ""), ("paragraph", "b", "A")]
