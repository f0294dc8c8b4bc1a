"""Streams over several micro-batches, with late, out-of-order and replayed rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factlake.sources.sinks import BucketedTable
from factlake.streaming import jobs

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event(i, hours, user=1, kind="purchase", k=0, value=1.0):
    return (i, START + timedelta(hours=hours), user, kind, value, f'{{"k": {k}}}')


@pytest.fixture
def run(spark, tmp_path):
    """Runs a job over batches of rows, one file and one trigger each, all with the same state."""

    def go(make, mode, batches):
        for n, batch in enumerate(batches):
            spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
            df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
            out = jobs.run_to_end(make(df), mode, f"file://{tmp_path}/run", "job")
        return out

    return go


def test_changes_over_batches_with_a_late_row(run):
    batches = [[event(1, 1, k=1)], [event(3, 3, k=2), event(2, 2, k=1)], [event(9, 0.5, k=7)], [event(4, 4, k=2)], [event(5, 5, k=3), event(6, 5, user=2, k=1)]]
    out = run(jobs.changes, "update", batches).collect()
    assert sorted((r["user_id"], r["event_id"], r["previous"], r["current"]) for r in out) == [(1, 3, 1, 2), (1, 5, 2, 3)]


def test_first_of_key_over_batches(run):
    out = run(lambda df: jobs.first_of_key(df.withColumn("k", F.get_json_object("props", "$.k").cast("long")), ["user_id", "k"]).select("user_id", "k"), "append", [[event(1, 1, k=1), event(2, 1, k=1)], [event(3, 2, k=1), event(4, 2, k=2)], [event(5, 3, k=2)]])
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1), (1, 2)]


def test_daily_totals_take_late_rows_within_the_delay_and_close_days_once(run):
    batches = [[event(1, 1)], [event(2, 30)], [event(3, 2)], [event(4, 24 * 10)], [event(5, 3), event(6, 24 * 20)]]
    out = {r["day"]: r["n"] for r in run(jobs.daily_totals, "append", batches).collect()}
    # row 3 is late but within two days; row 5 comes after its day was closed
    assert out == {"2024-01-01": 2, "2024-01-02": 1, "2024-01-11": 1}


def test_sessions_over_batches(run):
    batches = [[event(1, 1)], [event(2, 5)], [event(3, 3)], [event(4, 24 * 9)], [event(5, 24 * 20)]]
    out = run(jobs.progress_sessions, "append", batches).collect()
    assert [r["events"] for r in sorted(out, key=lambda r: r["begun"])] == [3, 1]


def test_silent_keys_fire_once_and_again_after_new_rows(run):
    batches = [[event(1, 1, user=1), event(2, 1, user=2)], [event(3, 24 * 5, user=2)], [event(4, 24 * 6, user=1)], [event(5, 24 * 30, user=3)], [event(6, 24 * 31, user=3)]]
    out = run(lambda df: jobs.silent_keys(df, 2), "update", batches).collect()
    assert sorted((r["user_id"], (r["last"] - int(START.timestamp() * 1e6)) // 3_600_000_000) for r in out if r["user_id"] == 1) == [(1, 1), (1, 144)]


def test_baseline_over_batches(run):
    out = run(jobs.gated_baseline, "update", [[event(1, 1, value=10.0)], [event(2, 2, value=4.0)], [event(3, 3, value=6.0)], [event(4, 4, value=3.5)]]).collect()
    assert {r["event_id"]: r["passed"] for r in out} == {1: True, 2: False, 3: True, 4: True}


def test_no_rows(spark, run):
    assert run(jobs.changes, "update", [[event(1, 1, kind="view")]]).count() == 0


def test_upserts_rewrite_only_their_buckets_and_replays_change_nothing(spark, tmp_path):
    table = BucketedTable(spark, f"file://{tmp_path}/t", ["k"], ["o"], buckets=16)
    frame = lambda rows: spark.createDataFrame(rows, "k long, o long, v string")
    assert table.read(frame([]).schema).count() == 0
    first = table.upsert(frame([(k, 1, "a") for k in range(200)]), 0)
    assert len(first) == 16
    second = table.upsert(frame([(7, 2, "b"), (7, 0, "late"), (500, 1, "new")]), 1)
    assert len(second) <= 2
    assert table.upsert(frame([(7, 9, "replayed otherwise")]), 1) == []
    table.upsert(frame([(3, 0, "late")]), 2)
    got = {r["k"]: r["v"] for r in table.read(frame([]).schema).collect()}
    assert got == {k: "a" for k in range(200)} | {7: "b", 500: "new"}
    # a batch that failed before its manifest is written over
    frame([(7, 5, "torn")]).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"file://{tmp_path}/t/data/000000000003")
    table.upsert(frame([(None, 1, "null key")]), 3)
    assert {r["k"]: r["v"] for r in table.read(frame([]).schema).collect()} == got | {None: "null key"}
    table.vacuum(keep=1)
    assert table.batches() == [3] and {r["k"]: r["v"] for r in table.read(frame([]).schema).collect()} == got | {None: "null key"}
