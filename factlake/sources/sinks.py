"""Idempotent writers and published versions on plain Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.operators import versions as V


def audit_rows(df: DataFrame, key: str, ts: str, payload: list[str]) -> DataFrame:
    """(key, day, payload JSON) for an append-only log."""
    return df.select(key, F.col(ts).cast("date").cast("string").alias("day"), F.to_json(F.struct(*payload)).alias("payload"))


def append_audit(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("day").parquet(path)


def published(versions: DataFrame, entity: str, version: str) -> DataFrame:
    """Rows of each entity's newest version; the pointer table is one row per entity."""
    current = versions.groupBy(entity).agg(F.max(version).alias(version))
    return versions.join(current, [entity, version])


def publish(spark: SparkSession, rows: DataFrame, path: str, version: str) -> None:
    """Writes a version beside the others, then a pointer of its own; nothing that readers use is replaced.

    The greatest pointer holds, so versions are named in rising order, such as by zero-padded numbers.
    """
    rows.write.mode("overwrite").parquet(f"{path}/versions/{version}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").parquet(f"{path}/pointers")


def read_published(spark: SparkSession, path: str) -> DataFrame:
    version = spark.read.parquet(f"{path}/pointers").agg(F.max("version").alias("version")).first()["version"]
    return spark.read.parquet(f"{path}/versions/{version}")


def upsert_table(spark: SparkSession, arriving: DataFrame, path: str, keys: list[str], order: list[str], version: str) -> None:
    """Upsert as a new published version, so a failed write leaves the old one in place."""
    publish(spark, V.upsert(read_published(spark, path), arriving, keys, order), path, version)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


class BucketedTable:
    """A table of the newest row per key in hash buckets, changed by numbered batches.

    A batch writes only the buckets that its keys fall into, then a manifest that names, for every
    bucket, the batch that wrote it last. The newest whole manifest is the table, so readers never see
    half a batch; a batch whose manifest stands is done and is skipped when it comes again. A manifest
    has one row for each bucket. Files of batches that no kept manifest names go with ``vacuum``.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path, keys, order, buckets

    def _manifest_path(self, number: int) -> str:
        return f"{self.path}/manifests/{number:012d}"

    def _folders(self, kind: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(at)) if fs.exists(at) else []

    def batches(self) -> list[int]:
        """Numbers of the batches whose manifest is whole."""
        return [n for n in self._folders("manifests") if exists(self.spark, f"{self._manifest_path(n)}/_SUCCESS")]

    def manifest(self, number: int | None) -> dict[int, int]:
        """Bucket to the batch that wrote it."""
        if number is None:
            return {}
        return {r["bucket"]: r["batch"] for r in self.spark.read.parquet(self._manifest_path(number)).collect()}  # one row for each bucket

    def _rows(self, manifest: dict[int, int], schema) -> DataFrame:
        places = [f"{self.path}/data/{batch:012d}/bucket={bucket}" for bucket, batch in sorted(manifest.items())]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def read(self, schema) -> DataFrame:
        """The rows of the newest whole manifest."""
        done = self.batches()
        return self._rows(self.manifest(done[-1] if done else None), schema)

    def upsert(self, arriving: DataFrame, number: int) -> list[int]:
        """Takes a batch in, and returns the buckets it wrote; of rows of a key the one last in order stays, late rows change nothing."""
        done = self.batches()
        if number in done:
            return []
        before = self.manifest(max((n for n in done if n < number), default=None))
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = [r["bucket"] for r in arriving.select(bucket.alias("bucket")).distinct().collect()]  # no more than there are buckets
        old = self._rows({b: before[b] for b in touched if b in before}, arriving.schema)
        new = V.upsert(old, arriving, self.keys, self.order).withColumn("bucket", bucket)
        new.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{number:012d}")
        named = before | dict.fromkeys(touched, number)
        self.spark.createDataFrame(list(named.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(self._manifest_path(number))
        return sorted(touched)

    def vacuum(self, keep: int = 2) -> None:
        """Drops all but the newest manifests, and the data that none of those names."""
        done = self.batches()
        used = {batch for n in done[-keep:] for batch in self.manifest(n).values()}
        for kind, gone in (("manifests", done[:-keep]), ("data", [n for n in self._folders("data") if n not in used and n <= max(done, default=-1)])):
            for n in gone:
                at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{n:012d}")
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_report(metrics: dict[str, DataFrame], path: str, section: str | None = None) -> None:
    """Each metric section as JSON lines; one section only if named."""
    for name, df in metrics.items():
        if section in (None, name):
            df.write.mode("overwrite").json(f"{path}/{name}")
