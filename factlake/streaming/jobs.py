"""Structured Streaming jobs over event rows (event_id, ts, user_id, event_type, value, props)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factlake.sources.sinks import BucketedTable, exists, is_folder


def stream(spark: SparkSession, path: str) -> DataFrame:
    """A table folder or file as a stream with its batch schema; ts becomes a timestamp."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema)
    # the filter is on names of files, so it is for a table that is one file
    rows = reader.parquet(path) if is_folder(spark, path) else reader.option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def run_to_end(df: DataFrame, mode: str, folder: str, name: str) -> DataFrame:
    """Runs all that is there (availableNow) and returns its rows; batches, state and offsets go to ``folder``.

    Each micro-batch is one Parquet folder named by its number, so a replayed batch replaces itself and
    nothing passes through the driver. In complete mode the last batch holds the whole result.
    """
    spark, out = df.sparkSession, f"{folder}/{name}/out"
    batches: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number:08d}")
        batches.append(number)

    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/{name}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    reader = spark.read.schema(df.schema).option("recursiveFileLookup", "true")
    if mode == "complete" and batches:
        return reader.parquet(f"{out}/{max(batches):08d}")
    return reader.parquet(out) if exists(spark, out) else spark.createDataFrame([], df.schema)


def first_of_key(df: DataFrame, keys: list[str], delay: str = "40 days") -> DataFrame:
    """Idempotent ingest: one row per key; keys are forgotten after the delay."""
    return df.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def daily_totals(df: DataFrame, delay: str = "2 days") -> DataFrame:
    """(day, stage, n, tokens): tumbling days, late rows within the delay count."""
    k = F.get_json_object("props", "$.k").cast("long")
    out = df.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum(k).alias("tokens"))
    return out.select(F.col("window.start").cast("date").cast("string").alias("day"), F.col("event_type").alias("stage"), "n", "tokens")


def progress_sessions(df: DataFrame, gap: str = "6 hours", delay: str = "2 days") -> DataFrame:
    """(user_id, begun, events): sessions of events with no longer gap."""
    out = df.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))
    return out.select("user_id", F.unix_micros(F.col("session_window.start")).alias("begun"), "events")


def _keyed(df: DataFrame, fn: Callable, output: str, state: str, timeout: str = GroupStateTimeout.NoTimeout) -> DataFrame:
    return df.groupBy("user_id").applyInPandasWithState(fn, output, state, "update", timeout)


def changes(df: DataFrame) -> DataFrame:
    """(user_id, event_id, previous, current) for each accepted version that differs from the last; late versions are never current."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = []
        for r in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            at = (int(r.ts.value // 1000), int(r.event_id))
            if last and at <= (last[0], last[1]):
                continue
            if last and last[2] != r.k:
                rows.append((key[0], int(r.event_id), int(last[2]), int(r.k)))
            last = (*at, int(r.k))
        if last:
            state.update(last)
        yield pd.DataFrame(rows, columns=["user_id", "event_id", "previous", "current"])

    rows = df.where("event_type = 'purchase'").select("user_id", "ts", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return _keyed(rows, run, "user_id long, event_id long, previous long, current long", "at long, id long, k long")


def gated_baseline(df: DataFrame, drop: float = 0.5) -> DataFrame:
    """(user_id, event_id, passed): a value passes if it is not below the drop from the last that passed."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        base = state.get[0] if state.exists else None
        rows = []
        for r in pd.concat(list(batches)).sort_values("event_id").itertuples():
            ok = base is None or not base > 0 or r.value > base * (1 - drop)
            base = r.value if ok else base
            rows.append((key[0], int(r.event_id), bool(ok)))
        state.update((float(base),))
        yield pd.DataFrame(rows, columns=["user_id", "event_id", "passed"])

    return _keyed(df.select("user_id", "event_id", "value"), run, "user_id long, event_id long, passed boolean", "base double")


def silent_keys(df: DataFrame, days: float, delay: str = "1 day") -> DataFrame:
    """(user_id, last): keys whose newest event is older than ``days`` at the watermark; an event-time timer fires them."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            yield pd.DataFrame([(key[0], state.get[0])], columns=["user_id", "last"])
            state.remove()
            return
        newest = max([state.get[0] if state.exists else 0, *(int(b["ts"].max().value // 1000) for b in batches)])
        state.update((newest,))
        state.setTimeoutTimestamp(max(newest // 1000 + int(days * 86_400_000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": pd.Series(dtype="int64"), "last": pd.Series(dtype="int64")})

    return _keyed(df.withWatermark("ts", delay).select("user_id", "ts"), run, "user_id long, last long", "last long", GroupStateTimeout.EventTimeTimeout)


def priced(df: DataFrame, prices: DataFrame) -> DataFrame:
    """Each event with the dated price in force: a stream joined with a static table."""
    p = prices.withColumnRenamed("event_type", "_pk")
    within = (F.col("event_type") == F.col("_pk")) & F.col("ts").cast("date").between(F.col("starts_on"), F.coalesce("ends_on", F.lit("9999-12-31").cast("date")))
    return df.join(p, within, "left").select("event_id", "event_type", "rate")


def latest_state(df: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str, buckets: int = 64) -> DataFrame:
    """Upserts each micro-batch into a table of the newest row per key; only buckets with arriving keys are written anew, a replayed batch changes nothing."""
    table = BucketedTable(df.sparkSession, path, keys, order, buckets)
    df.writeStream.foreachBatch(lambda batch, number: table.upsert(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return table.read(df.schema)


def backlog_sweep(df: DataFrame, done: DataFrame, path: str, checkpoint: str, key: str = "vec_id") -> DataFrame:
    """Appends the keys of each micro-batch that are not done yet; files per trigger bound a batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.select(key).distinct().join(done.select(key), key, "left_anti").write.mode("overwrite").parquet(f"{path}/batch={number}")

    df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = df.sparkSession
    return spark.read.parquet(path).select(key) if exists(spark, path) else spark.createDataFrame([], df.select(key).schema)
