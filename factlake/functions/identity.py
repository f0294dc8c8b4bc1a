"""Content identity: keys that depend on content alone, so every job is idempotent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def content_sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def url_key(c: Column) -> Column:
    """Hash of the URL without fragment and trailing slashes, in lower case."""
    return F.sha2(F.lower(F.regexp_replace(F.split(c, "#", 2)[0], "/+$", "")), 256)


def hash_parts(*parts: Column, length: int = 64, separator: str = SEPARATOR) -> Column:
    """Truncated SHA-256 of parts joined by a separator; nulls are empty."""
    return F.substring(F.sha2(F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, length)


def evidence_id(df: DataFrame, source: str, path: str, content: str, order: str) -> DataFrame:
    """Adds evidence_id: hash of source, path, collapsed text and the number of equal ones before."""
    from factlake.functions.text import collapsed

    key = collapsed(F.col(content))
    n = F.row_number().over(Window.partitionBy(source, path, key).orderBy(order)) - 1
    return df.withColumn("evidence_id", F.concat(F.lit("ev_"), hash_parts(F.col(source), F.col(path), key, n, length=24)))


def set_hash(df: DataFrame, key: str, member: Column, name: str) -> DataFrame:
    """Per key a hash of the sorted distinct members."""
    return df.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(member.cast("string"))), ","), 256).alias(name))


def ordered_hash(df: DataFrame, key: str, order: str, member: str, name: str, width: int = 1000) -> DataFrame:
    """Per key a hash of the members in order, ties by member: of the hashes of blocks of blocks, each of ``width`` members.

    Blocks are cut by place within the key, so the hash depends on the members and their order alone; no
    task gathers a whole key.
    """
    from factlake.operators.ranking import numbered

    def hashed(rows: DataFrame, keys: list[str]) -> DataFrame:
        members = F.transform(F.array_sort(F.collect_list(F.struct("_o", "_m"))), lambda s: s["_m"].cast("string"))
        return rows.groupBy(*keys).agg(F.sha2(F.array_join(members, SEPARATOR), 256).alias("_m"))

    placed = numbered(df.select(F.col(key).alias("_k"), F.col(order).alias("_by"), F.col(member).alias("_m")), [F.asc("_k"), F.asc("_by"), F.asc("_m")], "_rank")
    first = placed.groupBy(F.col("_k").alias("_of")).agg(F.min("_rank").alias("_first"))
    rows = placed.join(first, F.col("_k").eqNullSafe(F.col("_of"))).select("_k", (F.col("_rank") - F.col("_first")).alias("_o"), "_m")
    rows = hashed(rows.withColumn("_b", F.floor(F.col("_o") / width)), ["_k", "_b"]).select("_k", F.col("_b").alias("_o"), "_m", F.floor(F.col("_b") / width).alias("_c"))
    out = hashed(hashed(rows, ["_k", "_c"]).withColumnRenamed("_c", "_o"), ["_k"])
    return out.select(F.col("_k").alias(key), F.col("_m").alias(name))


def canonical_map(c: Column, dropped: list[str]) -> Column:
    """A map as JSON with sorted keys, without provenance keys."""
    entries = F.array_sort(F.filter(F.map_entries(c), lambda e: ~e["key"].isin(*dropped)))
    return F.to_json(F.map_from_entries(entries))


def table_digest(df: DataFrame) -> DataFrame:
    """(rows, digest): order does not matter; constant memory, one partial aggregate per task."""
    return df.agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*df.columns)).alias("digest"))


def exact_table_digest(df: DataFrame) -> DataFrame:
    """(rows, digest) from the sorted row hashes: for small tables."""
    row = F.md5(F.concat_ws(SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]))
    return df.agg(F.count("*").alias("rows"), F.md5(F.array_join(F.array_sort(F.collect_list(row)), "")).alias("digest"))
