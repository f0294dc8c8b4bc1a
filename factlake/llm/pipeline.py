"""A corpus pipeline of five stages: quality, near duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.bpe import encode_documents
from factlake.llm.decontaminate import decontaminate
from factlake.llm.jaccard import BROADCAST_IDS, jaccard_components
from factlake.llm.pii import redact_documents
from factlake.llm.quality import keep_good
from factlake.llm.tables import Scratch

_KEY = "__pipeline_key"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as bad go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest id stays; rows with a null id, which link with nothing, all stay."""
    places = Scratch(spark, "places").save(jaccard_components(docs), "places")
    counts = places.where("doc_id = component_id").agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids")).first()
    stay = places.where("doc_id = component_id").select(F.col("doc_id").alias(_KEY)).distinct()
    stay = F.broadcast(stay) if counts["ids"] <= BROADCAST_IDS else stay
    kept = docs.join(stay, F.col("doc_id") == F.col(_KEY), "left_semi")
    if counts["rows"] > counts["ids"]:
        # rows of one id are one document only where their words are equal
        words = F.trim(F.regexp_replace(F.translate("text", ascii_uppercase, ascii_lowercase), "[ \\t-\\r]+", " "))
        kept = kept.withColumn(_KEY, words).dropDuplicates(["doc_id", _KEY]).drop(_KEY)
    nulls = places.where("doc_id is null").limit(1).count()
    return kept.unionByName(docs.where("doc_id is null")) if nulls else kept


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    bad = Scratch(spark, "contaminated").save(found.select(F.col("row_key").alias(_KEY)).distinct(), "keys")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_IDS else bad
    return docs.join(bad, F.xxhash64("doc_id", "text") == F.col(_KEY), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    return redact_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, columns=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages), ("personal_data", personal_data), ("tokens", tokens)]

#: SQL cannot express the learned classifier or the tokenizer; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each but the last written before the next reads it."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, name)
    return docs
