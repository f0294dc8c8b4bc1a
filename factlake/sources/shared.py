"""Tables that several queries read, written once to the cluster's shared folder."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only on a single machine that names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return shared or "file://" + tempfile.mkdtemp(prefix="factlake-")


def written_once(spark: SparkSession, name: str, key: str, build: Callable[[], DataFrame], *folders: str) -> DataFrame:
    """The table ``build`` gives, written on first use in an application and read from there; a lost executor costs no second build. ``folders`` are columns it is partitioned by."""
    context = spark.sparkContext
    known = context.__dict__.setdefault("_factlake_written", {})
    at = known.get((name, key))
    if at is None:
        at = f"{shared_folder(spark)}/{name}-{context.applicationId}-{hashlib.md5(key.encode()).hexdigest()}"
        build().write.mode("overwrite").partitionBy(*folders).parquet(at)
        known[name, key] = at
    return spark.read.parquet(at)


def written(df: DataFrame, name: str, *folders: str, compression: str = "snappy") -> DataFrame:
    """The rows, written to the shared folder now and read from there, for an operator that needs them several times."""
    at = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*folders).option("compression", compression).parquet(at)
    return df.sparkSession.read.parquet(at)
