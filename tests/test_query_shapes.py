"""Queries on small tables whose shapes the given small ones lack, against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from factlake import queries as library
from factlake.streaming import jobs

library.load()


@pytest.fixture
def agree(spark, tmp_path):
    """Runs a query on tables written as folders of several files and compares its rows with those of its SQL."""

    def go(name, **tables):
        db = duckdb.connect()
        for table, df in tables.items():
            df.repartition(2).write.parquet(f"file://{tmp_path}/{table}.parquet")
            db.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
        df = library.QUERIES[name](spark, str(tmp_path))
        found = db.sql(f"select {', '.join(df.columns)} from ({library.ORACLES[name]})").fetchall()
        show = lambda rows: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)
        mine = show(df.collect())
        assert mine == show(found)
        return mine

    return go


def numbered(spark, n, name, *columns):
    return spark.range(n).select(F.col("id").alias(name), *columns)


def words(k="id"):
    return F.concat(F.lit("same word "), F.when(F.col(k) % 2 == 0, "even").otherwise("odd")).alias("text")


def test_backlog_of_a_table_that_is_a_folder(spark, agree):
    label = F.lit(1).alias("quality")
    assert len(agree("N07_backlog_sweep", embeddings=numbered(spark, 6, "vec_id", F.array(F.lit(1.0)).alias("embedding")), labels=numbered(spark, 2, "doc_id", label))) == 4


def test_backlog_without_arriving_rows(spark, tmp_path):
    empty = spark.readStream.schema("vec_id long").parquet(f"file://{(tmp_path / 'in').mkdir() or tmp_path / 'in'}")
    done = spark.createDataFrame([(1,)], "vec_id long")
    assert jobs.backlog_sweep(empty, done, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint").collect() == []


def test_word_scores_read_the_first_forty_documents_only(spark, agree):
    assert len(agree("E22_word_scores", benchmark=numbered(spark, 45, "item_id", words()), documents=numbered(spark, 45, "doc_id", words()))) == 45


def test_word_scores_read_every_document(spark, agree):
    # documents 40 to 59 count too, items 0 to 44 only have their words met
    text = F.when(F.col("id") != 50, words()).alias("text")
    found = agree("E22_word_scores", benchmark=numbered(spark, 45, "item_id", words()), documents=numbered(spark, 60, "doc_id", text))
    assert found == sorted([repr([k, 1.0, 1.0, 1.0]) for k in range(45)] + [repr([k, 0.0, None, 0.0]) for k in range(45, 60) if k != 50])


def test_word_scores_of_rows_without_a_key_and_of_repeated_keys(spark, agree):
    key = lambda name: F.when(F.col("id") % 10 < 8, F.col("id") % 7).alias(name)
    table = lambda name, n: spark.range(n).select(key(name), F.concat(F.lit("a b "), F.when(F.col("id") % 3 == 0, "b c").otherwise("a x")).alias("text"))
    agree("E22_word_scores", benchmark=table("item_id", 50), documents=table("doc_id", 90))


def test_quotes_of_items_without_documents_have_no_row(spark, agree):
    missing = F.when(F.col("id") != 3, words()).alias("text")
    assert len(agree("D15_contained_quotes", benchmark=numbered(spark, 45, "item_id", words()), documents=numbered(spark, 60, "doc_id", missing))) == 60


def test_hybrid_ranks_beyond_the_first_thousand_count(spark, agree):
    # the nearest vectors are those of the documents that come last of 1,300 equal ones
    near = F.array(F.lit(1.0), (F.col("id") / 1000).cast("double")).alias("embedding")
    far = F.when(F.col("id") == 0, F.array(F.lit(0.0), F.lit(1.0))).otherwise(near).alias("embedding")
    agree("K04_hybrid", documents=numbered(spark, 1300, "doc_id", F.lit("apache license").alias("text")), embeddings=numbered(spark, 1300, "vec_id", far))


GRIDS = ["J01_grid", "J02_column_headers", "J03_sections", "J04_cell_paths", "J05_stub_width", "J14_compact_tables", "J22_row_records", "F14_continuations"]


@pytest.mark.parametrize("name", GRIDS)
def test_cells_of_a_table_move_once(spark, name):
    plan = library.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_labels_meet_the_text_where_it_lies(spark):
    plan = library.QUERIES["K09_label_location"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # no run of characters is shuffled to the pieces
    assert "strategy=broadcast" in plan, plan


def test_payloads_of_a_small_file_are_read_by_many_tasks(spark, tmp_path):
    part = spark.range(12_000).select(F.col("id").alias("p_partkey"), F.lit(3).alias("p_size"), F.lit(2.5).alias("p_retailprice"))
    part.coalesce(1).write.parquet(f"file://{tmp_path}/part.parquet")
    from factlake.queries.projection import payloads

    sizes = payloads(library.Tables(spark, str(tmp_path))).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 5_000


def test_lines_of_terms_are_read_by_many_tasks(spark, tmp_path):
    part = spark.range(8_000).select(F.col("id").alias("p_partkey"), F.lit(3).alias("p_size"))
    part.coalesce(1).write.parquet(f"file://{tmp_path}/part.parquet")
    assert library.QUERIES["I15_lines"](spark, str(tmp_path)).rdd.getNumPartitions() == 4


def test_supplier_pages_do_not_ask_for_the_given_ones(spark, tmp_path):
    for table in ("supplier", "nation", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").write.parquet(f"file://{tmp_path}/{table}.parquet")
    # there is no table of pages
    assert library.QUERIES["J10_pairs"](spark, str(tmp_path)).count() == 3 * spark.read.parquet(f"file://{tmp_path}/supplier.parquet").count()


def test_pages_of_a_small_file_are_parsed_by_many_tasks(spark, tmp_path):
    from factlake.queries.derived import parsed_pages

    html = F.lit("<html><body><h1>Title</h1><p>Text</p></body></html>").alias("html")
    numbered(spark, 400, "page_id", F.lit("https://example.com/").alias("url"), html).coalesce(1).write.parquet(f"file://{tmp_path}/pages.parquet")
    assert len(parsed_pages(library.Tables(spark, str(tmp_path))).inputFiles()) == 4
