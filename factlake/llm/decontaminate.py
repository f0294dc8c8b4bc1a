"""Operator 7: benchmark decontamination by winnowing, in DataFrame functions only.

Of every GUARANTEE consecutive words the smallest hash of its GRAM-word runs is kept, so a
passage of that many words shared by a document and an item has a kept hash in both. Kept hashes
are joined; each hit is extended to the windows around it, compared word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.tables import Scratch

WINDOW = 13
GRAM = 5
#: rows of fingerprints or ids that are broadcast at most (under 32 MB); beyond it the joins shuffle
BROADCAST_ROWS = 1_000_000
#: bytes of item words and hashes that are broadcast at most
BROADCAST_BYTES = 32_000_000

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, not again at every use within a lambda."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text: A-Z in lower case, runs of ASCII letters and digits and of non-ASCII characters; null has none."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _AZ, _az))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _grams(words: Column) -> Column:
    at = F.sequence(F.lit(0), F.size(words) - GRAM)
    return F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(GRAM))))


def _kept(grams: Column, window: int) -> Column:
    """Distinct smallest hashes of all runs of window - GRAM + 1 grams."""
    width = window - GRAM + 1
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(grams) - (width - 1)), lambda i: F.array_min(F.slice(grams, i, width))))


def fingerprints(words: Column, window: int = WINDOW) -> Column:
    """Kept hashes of a word array; none for arrays shorter than the window."""
    kept = _bound(words, lambda w: _bound(_grams(w), lambda g: _kept(g, window)))
    return F.when(F.size(words) >= window, kept).otherwise(F.array().cast("array<bigint>"))


def _if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.count() <= limit else df


def _items_if_small(items: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Item texts are broadcast by the bytes of their words and hashes."""
    held = F.aggregate("item", F.lit(0), lambda n, w: n + F.octet_length(w)) + 24 * F.size("item") + 8 * F.size("kept") + 64
    return F.broadcast(items) if (items.agg(F.sum(held)).first()[0] or 0) <= limit else items


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, percent: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated, row_key) for every row of ``docs``; row_key is xxhash64(id, text).

    A window is ``window`` consecutive words of an item, or all words of a shorter one. ``n_hit``
    counts the document's words inside any occurrence of a window, ``items`` are the ids of items
    with occurring windows, and a document is contaminated when n_hit is not 0 and at least
    ``percent`` of its words. Null texts have no words; items without words or id are ignored;
    repeated items count once; repeated documents each give a row; null doc ids pass through;
    other columns are ignored; empty tables give no rows or no hits.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("row_key", F.xxhash64("doc_id", "text"))
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), words_of(F.col(item_text_col)).alias("item")).where(F.size("item") > 0).distinct()
    items = items.withColumn("anchor", F.array_sort("item", lambda a, b: F.length(b) - F.length(a))[0])
    items = scratch.save(items.withColumn("kept", fingerprints(F.col("item"), window)), "items")
    short = items.where(F.size("item") < window)

    worded = source.select("row_key", "doc_id", words_of(F.col("text")).alias("words"))
    described = scratch.save(worded.select("row_key", "doc_id", F.size("words").cast("long").alias("n_words"), fingerprints(F.col("words"), window).alias("kept")), "described")

    keys = _if_small(items.where(F.size("item") >= window).select("item_id", F.explode("kept").alias("h")).distinct())
    pairs = described.select("row_key", F.explode("kept").alias("h")).join(keys, "h").select("row_key", "item_id")
    if not short.isEmpty():
        anchors = _if_small(short.select("item_id", F.col("anchor").alias("word")).distinct())
        pairs = pairs.unionByName(worded.select("row_key", F.explode(F.array_distinct("words")).alias("word")).join(anchors, "word").select("row_key", "item_id"))
    pairs = scratch.save(pairs.distinct(), "pairs")

    touched = source.join(_if_small(pairs.select("row_key").distinct()), "row_key", "left_semi").distinct()
    near = touched.select("row_key", words_of(F.col("text")).alias("words")).join(pairs, "row_key").join(_items_if_small(items), "item_id")
    near = near.select("row_key", "item_id", "words", "item", "anchor", "kept", F.least(F.size("item"), F.lit(window)).alias("span"))

    def starts(words: Column, item: Column, span: Column, at: Column, q: Column, reach: Column) -> Column:
        """Starts of windows that hold item word q at document word ``at``, equal on both sides."""
        low = F.greatest(F.lit(0), q + reach - span, q - at)
        high = F.least(q, F.size(item) - span, F.size(words) - span - at + q)
        fits = F.filter(F.sequence(low, high), lambda j: F.slice(words, at - q + j + 1, span) == F.slice(item, j + 1, span))
        return F.when(low <= high, F.transform(fits, lambda j: at - q + j)).otherwise(F.array().cast("array<int>"))

    def by_grams(words: Column, item: Column, kept: Column, span: Column) -> Column:
        def seeds(own: Column, theirs: Column) -> Column:
            at = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda p: F.array_contains(kept, F.get(own, p)))
            match = lambda p: F.filter(F.sequence(F.lit(0), F.size(theirs) - 1), lambda q: F.get(theirs, q) == F.get(own, p))
            return F.flatten(F.transform(at, lambda p: F.flatten(F.transform(match(p), lambda q: starts(words, item, span, p, q, F.lit(GRAM))))))

        return _bound(_grams(words), lambda own: _bound(_grams(item), lambda theirs: seeds(own, theirs)))

    def by_anchor(words: Column, item: Column, anchor: Column, span: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda p: F.get(words, p) == anchor)
        q = F.array_position(item, anchor).cast("int") - 1
        return F.flatten(F.transform(at, lambda p: starts(words, item, span, p, q, F.lit(1))))

    columns = F.struct("words", "item", "anchor", "kept", "span")
    found = _bound(
        columns,
        lambda r: F.when((F.size(r["item"]) >= window) & (F.size(r["words"]) >= window), by_grams(r["words"], r["item"], r["kept"], r["span"]))
        .when((F.size(r["item"]) < window) & (F.size(r["words"]) >= F.size(r["item"])), by_anchor(r["words"], r["item"], r["anchor"], r["span"]))
        .otherwise(F.array().cast("array<int>")),
    )
    hits = near.select("row_key", "item_id", "span", found.alias("starts")).where(F.size("starts") > 0)
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("span") - 1))))
    per_item = hits.select("row_key", "item_id", covered.alias("covered"))
    per_doc = per_item.groupBy("row_key").agg(F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).cast("long").alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))

    out = described.select("row_key", "doc_id", "n_words").join(per_doc, "row_key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))).alias("contaminated"), "row_key")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
