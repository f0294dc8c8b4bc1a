"""N: streaming jobs run to the end of the given events, compared with batch SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from factlake.queries import query
from factlake.streaming import jobs as J

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def folder(t, kind: str = "streams") -> str:
    """A folder of its own in the cluster's shared one; a temporary one only on a single machine that names none."""
    shared = t.spark.conf.get("spark.checkpoint.dir", None)
    if not shared and t.spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (shared or "file://" + tempfile.mkdtemp(prefix="factlake-")) + f"/{kind}-" + uuid.uuid4().hex


def events(t):
    return J.stream(t.spark, f"{t.sf_dir}/events.parquet")


def ended(t, df, mode):
    return J.run_to_end(df, mode, folder(t), "stream_" + uuid.uuid4().hex)


@query("N01_changes", f"SELECT user_id, event_id, pk AS previous, k AS current FROM (SELECT user_id, event_id, k, lag(k) OVER w AS pk, row_number() OVER w AS n FROM (SELECT *, {K} AS k FROM events WHERE event_type = 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n > 1 AND k <> pk")
def _(t):
    return ended(t, J.changes(events(t)), "update")


@query("N02_first_of_key", f"SELECT DISTINCT user_id, {K} AS k FROM events")
def _(t):
    rows = events(t).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return ended(t, J.first_of_key(rows, ["user_id", "k"]).select("user_id", "k"), "append")


#: keys silent for some hours at the watermark, a day behind the newest event
SILENT = "SELECT user_id, epoch_us(max(ts)) AS last FROM events GROUP BY user_id HAVING max(ts) + INTERVAL {hours} HOUR < (SELECT max(ts) FROM events) - INTERVAL 1 DAY"


@query("N03_daily_totals", f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS stage, count(*) AS n, CAST(sum({K}) AS BIGINT) AS tokens FROM events GROUP BY ALL")
def _(t):
    out = ended(t, J.daily_totals(events(t)), "complete")
    return out


@query("N03_closed_days", f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS stage, count(*) AS n, CAST(sum({K}) AS BIGINT) AS tokens FROM events WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY GROUP BY ALL")
def _(t):
    # append mode: a day comes out, and its state goes, once the watermark has passed it
    return ended(t, J.daily_totals(events(t)), "append")


@query("N04_silent_keys", SILENT.format(hours=24))
def _(t):
    return ended(t, J.silent_keys(events(t), 1), "update")


@query("N05_gated_baseline", """WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    f AS (SELECT user_id, event_id, n, value AS base, TRUE AS passed FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN NOT f.base > 0 OR e.value > f.base * 0.5 THEN e.value ELSE f.base END, NOT f.base > 0 OR e.value > f.base * 0.5 FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
    SELECT user_id, event_id, passed FROM f""")
def _(t):
    return ended(t, J.gated_baseline(events(t)), "update")


@query("N06_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM e)
    SELECT user_id, epoch_us(min(ts)) AS begun, count(*) AS events FROM s GROUP BY user_id, s""")
def _(t):
    return ended(t, J.progress_sessions(events(t)), "complete")


@query("N06_closed_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM e)
    SELECT user_id, epoch_us(min(ts)) AS begun, count(*) AS events FROM s GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def _(t):
    return ended(t, J.progress_sessions(events(t)), "append")


@query("N07_backlog_sweep", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    at = folder(t)
    done = t.labels.select(F.col("doc_id").alias("vec_id"))
    return J.backlog_sweep(J.stream(t.spark, f"{t.sf_dir}/embeddings.parquet"), done, f"{at}/out", f"{at}/checkpoint")


@query("N08_latest_state", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type = 'purchase') WHERE rn = 1")
def _(t):
    at = folder(t)
    rows = events(t).where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return J.latest_state(rows, f"{at}/out", ["user_id"], ["ts", "event_id"], f"{at}/checkpoint").select("user_id", "event_id")


@query("N10_priced", "SELECT event_id, event_type, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-16' THEN 1.5::DOUBLE WHEN event_type = 'view' THEN 2.0::DOUBLE END AS rate FROM events")
def _(t):
    prices = t.spark.createDataFrame([("view", "2024-01-01", "2024-01-15", 1.5), ("view", "2024-01-16", None, 2.0)], "event_type string, a string, b string, rate double")
    prices = prices.select("event_type", F.col("a").cast("date").alias("starts_on"), F.col("b").cast("date").alias("ends_on"), "rate")
    return ended(t, J.priced(events(t), prices), "append")
