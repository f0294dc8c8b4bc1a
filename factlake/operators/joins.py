"""Joins that say what is matched and what is missing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType


def with_total(parents: DataFrame, children: DataFrame, key: str, child_key: str, amount: Column, name: str) -> DataFrame:
    """Left join with a child total; children are summed before the join."""
    total = children.groupBy(F.col(child_key).alias(key)).agg(F.sum(amount).alias(name))
    return parents.join(total, key, "left")


def with_existence(parents: DataFrame, children: DataFrame, key: str, child_key: str, name: str) -> DataFrame:
    keys = children.select(F.col(child_key).alias(key)).distinct().withColumn(name, F.lit(True))
    return parents.join(keys, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def top_child(parents: DataFrame, children: DataFrame, key: str, order: list[str], payload: list[str]) -> DataFrame:
    """Each parent with its largest child by ``order``; parents without children go."""
    best = children.groupBy(key).agg(F.max(F.struct(*order, *payload)).alias("_b"))
    return parents.join(best, key).select(*parents.columns, *[F.col(f"_b.{c}").alias(c) for c in (*order, *payload)])


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Each row with a one-row relation."""
    return df.crossJoin(F.broadcast(one_row.limit(1)))


def superseded(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows older than the newest of their key, by a total order; one window instead of a join of all pairs."""
    w = Window.partitionBy(key)
    return df.withColumn("_new", F.max(F.struct(*order)).over(w)).where(F.struct(*order) < F.col("_new")).drop("_new")


def valid_on(df: DataFrame, prices: DataFrame, key: str, date: str, starts: str, ends: str, how: str = "left") -> DataFrame:
    """Rows with the dated row in force: starts on or before the date, ends on or after it or never."""
    within = (F.col(date) >= F.col(starts)) & (F.col(date) <= F.coalesce(F.col(ends), F.lit("9999-12-31").cast("date")))
    return df.join(prices.withColumnRenamed(key, "_pk"), (F.col(key) == F.col("_pk")) & within, how).drop("_pk")


def field_difference(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, previous, current) where a value was added, removed or changed."""
    out = before.withColumnRenamed(value, "previous").join(after.withColumnRenamed(value, "current"), keys, "full_outer")
    return out.where(~F.col("previous").eqNullSafe(F.col("current")))


def audit(expected: DataFrame, stored: DataFrame, key: str, digest: str) -> DataFrame:
    """One row: how many ids are missing, extra and altered."""
    e = expected.select(key, F.col(digest).alias("_e"))
    s = stored.select(key, F.col(digest).alias("_s"))
    out = e.join(s, key, "full_outer")
    return out.agg(F.count_if(F.col("_s").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("extra"), F.count_if(F.col("_e") != F.col("_s")).alias("altered"))


#: Sets of at most this many words are compared through their subsets.
SUBSET_WORDS = 6


def _word_sets(df: DataFrame, group: str, words: str) -> DataFrame:
    """(g, s, id, n): the word set of each row; those without a group, an id or words are still there."""
    return df.select(F.col(group).alias("g"), F.array_sort(F.array_distinct(F.array_compact(words))).alias("s"), "id").withColumn("n", F.size("s"))


_WHOLE = "g is not null and id is not null and n > 0"


def _lowest(sets: DataFrame) -> DataFrame:
    """Each distinct set of a group with its lowest id; the others of the set can be no one's best."""
    return sets.groupBy("g", "s").agg(F.min("id").alias("id")).withColumn("n", F.size("s"))


def _sets(df: DataFrame, group: str, words: str) -> DataFrame:
    """(g, s, id, n): each distinct word set of a group with its lowest id."""
    return _lowest(_word_sets(df, group, words).where(_WHOLE))


def _parts(sets: DataFrame) -> DataFrame:
    """(g, id, n, part): every subset of each small set."""
    masks = F.explode(F.expr("sequence(1, int(power(2, n)) - 1)"))
    return sets.where(F.col("n") <= SUBSET_WORDS).select("g", "id", "n", "s", masks.alias("m")).select("g", "id", "n", F.expr("filter(s, (x, i) -> getbit(m, i) = 1)").alias("part"))


def _best_parts(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(g, id, other, score): the best partner of each small set among small ones.

    A subset stands for the words in common. Of the sets of one size that hold it the lowest id is
    enough: they all score at least what the subset gives, and the highest score is the one that
    the words really in common give. So a part meets one row for each size, however hot its words are.
    """
    offers = _parts(theirs).groupBy("g", "part", F.col("n").alias("m")).agg(F.min("id").alias("other"))
    met = _parts(mine).join(offers.hint("merge"), ["g", "part"])
    return met.select("g", "id", "other", (F.size("part") / (F.col("n") + F.col("m") - F.size("part"))).alias("score"))


#: words in more sets than this may be ranked by their number; at most so many are, the others come first, by hash
_SELDOM, _RANKED = 16, 1 << 20
#: places of words that a bucket holds, buckets to make at least, and pairs that are compared at a time
_PLACES, _LEAST_BUCKETS, _PAIRS = 4_500_000, 12, 1 << 20
#: sets whose words are put in order at a time
_ROWS = 1024
#: sets that are asked for by a broadcast
_ASKED = 500_000
#: bits of a signature at least
_BITS = 256


def _digest() -> Column:
    return F.xxhash64("g", "s")


def _lists(values: np.ndarray, first: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(first, len(values)).astype(np.int32)), pa.array(values))


def _started(ranked, buckets: int, least: float):
    """Rows (g, id, l, n, digest, h) to one row for each bucket that holds words of the set's prefix, with their places and the set's signature.

    The signature has two bits and more for each word, a power of two in all; each word turns one over.
    Folded to the same length, two signatures differ in no more bits than their sets in words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, rank_of = ranked.value
        for batch in batches:
            for k in range(0, batch.num_rows, _ROWS):
                part = batch.slice(k, _ROWS)
                n = part.column("n").to_numpy().astype(np.int64)
                h = part.column("h").flatten().to_numpy(zero_copy_only=False)
                first = np.cumsum(n) - n
                doc = np.repeat(np.arange(len(n)), n)
                bits = 1 << np.ceil(np.log2(np.maximum(2 * n, _BITS))).astype(np.int64)
                start = np.cumsum(bits) - bits
                turned = np.bincount(start[doc] + (h & (bits[doc] - 1)), minlength=int(bits.sum()))
                flat = np.packbits((turned & 1).astype(np.uint8), bitorder="little")
                signature = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.append(start // 8, len(flat)).astype(np.int64)), pa.py_buffer(flat)])
                rank = np.zeros(len(h), np.int64)
                if len(listed):
                    at = np.minimum(np.searchsorted(listed, h), len(listed) - 1)
                    rank = np.where(listed[at] == h, rank_of[at], 0)
                # words of a set come in the order of the words, which settles what the key leaves equal
                order = np.argsort(doc << 50 | rank << 29 | (h.view(np.uint64) >> np.uint64(35)).astype(np.int64), kind="stable")
                place = np.arange(len(h)) - first[doc] + 1
                kept = place <= (n - np.ceil(n * least - 1e-9) + 1)[doc]
                h, place, doc = h[order][kept], place[kept].astype(np.int32), doc[kept]
                bucket = (h.view(np.uint64) >> np.uint64(20)).astype(np.int64) % 1_000_003 % buckets
                key = doc * buckets + bucket
                order = np.argsort(key, kind="stable")
                key, begun = np.unique(key[order], return_index=True)
                of = pa.array(key // buckets)
                columns = [part.column(c).take(of) for c in ("g", "id", "l", "n", "digest")]
                yield pa.RecordBatch.from_arrays([pa.array((key % buckets).astype(np.int32)), *columns, signature.cast(pa.binary()).take(of), _lists(h[order], begun), _lists(place[order], begun)], ["bucket", "g", "id", "l", "n", "digest", "signature", "h", "p"])

    return run


def _bits_apart(signature: np.ndarray, first: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The number of bits in which the signatures of the sets i and j differ."""
    out = np.zeros(len(i), np.int64)
    kinds = size[i] << 32 | size[j]
    for kind in np.unique(kinds).tolist():
        a, b = kind >> 32, kind & 0xFFFFFFFF
        some = np.flatnonzero(kinds == kind)
        step, short = max(1, _PAIRS // max(a, b)), min(a, b)
        for k in range(0, len(some), step):
            part = some[k : k + step]
            fold = lambda of, long: np.bitwise_xor.reduce(signature[first[of][:, None] + np.arange(long)].reshape(len(of), long // short, short), axis=1)  # noqa: E731, B023
            out[part] = np.bitwise_count(fold(i[part], a) ^ fold(j[part], b)).sum(1)
    return out


def _meet_in_bucket(least: float):
    """The rows of one bucket to the pairs of their sets that may reach ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks() if (held := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        del held
        column = lambda c: rows.column(c).combine_chunks() if rows.column(c).num_chunks != 1 else rows.column(c).chunk(0)
        left, n, digest = (column(c).to_numpy(zero_copy_only=False) for c in ("l", "n", "digest"))
        n = n.astype(np.int64)
        packed = column("signature")
        ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
        signature = np.frombuffer(packed.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy().view(np.uint64)
        size = pc.binary_length(packed).to_numpy(zero_copy_only=False).astype(np.int64) // 8
        first = np.cumsum(size) - size
        # of equal sets of a side the lowest id is enough
        by_id = np.empty(len(n), np.int64)
        by_id[pc.sort_indices(column("id")).to_numpy()] = np.arange(len(n))
        order = np.lexsort((by_id, digest, n, left))
        again = (left[order][1:] == left[order][:-1]) & (n[order][1:] == n[order][:-1]) & (digest[order][1:] == digest[order][:-1])
        lowest = np.ones(len(n), bool)
        lowest[order[1:][again]] = False

        count = pc.list_value_length(column("h")).to_numpy(zero_copy_only=False)
        h, p = (column(c).flatten().to_numpy(zero_copy_only=False) for c in ("h", "p"))
        doc = np.repeat(np.arange(len(n), dtype=np.int32), count)
        found, apart = np.empty(0, np.int64), np.empty(0, np.int64)
        for slice_ in range(16):
            here = np.flatnonzero(((h >> 8) & 15 == slice_) & lowest[doc])
            mine, theirs = (here[left[doc[here]] == side] for side in (True, False))
            words, word = np.unique(h[theirs], return_inverse=True)
            if not len(words) or not len(mine):
                continue
            key = word.astype(np.int64) << 32 | n[doc[theirs]]
            order = np.argsort(key, kind="stable")
            key, theirs = key[order], theirs[order]
            at = np.minimum(np.searchsorted(words, h[mine]), len(words) - 1)
            mine, at = mine[words[at] == h[mine]], at[words[at] == h[mine]]
            own = n[doc[mine]]
            lo = np.searchsorted(key, at << 32 | np.ceil(least * own - 1e-9).astype(np.int64))
            many = np.searchsorted(key, at << 32 | np.floor(own / least + 1e-9).astype(np.int64), side="right") - lo
            ends = np.cumsum(many)
            pairs, bits = [found], [apart]
            k = 0
            while k < len(mine):
                to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + _PAIRS, side="right")))
                some = many[k:to]
                a = np.repeat(mine[k:to], some)
                b = theirs[np.repeat(lo[k:to] - (np.cumsum(some) - some), some) + np.arange(len(a))]
                k = to
                i, j = doc[a], doc[b]
                ln, rn = n[i], n[j]
                # words that a pair at ``least`` has in common; all of them stand at or behind the first one on either side
                common = np.ceil((ln + rn) * (least / (1 + least)) - 1e-9).astype(np.int64)
                near = (np.minimum(ln - p[a], rn - p[b]) + 1 >= common) & (np.maximum(ln, rn) > SUBSET_WORDS)
                i, j, most = i[near], j[near], (ln + rn - 2 * common)[near]
                between = _bits_apart(signature, first, size, i, j)
                near = between <= most
                pairs.append(i[near].astype(np.int64) << 32 | j[near])
                bits.append(between[near])
            found, at = np.unique(np.concatenate(pairs), return_index=True)
            apart = np.concatenate(bits)[at]
        i, j = found >> 32, found & 0xFFFFFFFF
        together = n[i] + n[j]
        i, j, most = pa.array(i), pa.array(j), pa.array((together - apart) / (together + apart))
        yield pa.RecordBatch.from_arrays([*(column(c).take(x) for c, x in (("g", i), ("id", i), ("id", j), ("digest", i), ("digest", j))), most], ["g", "left_id", "right_id", "left_digest", "right_digest", "most"])

    return run


def _meetings(sides: dict[str, DataFrame], least: float) -> DataFrame:
    """(g, left_id, right_id, left_digest, right_digest, most) of pairs of sets, one of them large, that may reach ``least``, and the score they have at most.

    The prefix of a set is found where the set lies: words in many sets come last, by their number,
    which is broadcast; the others by hash. Any order that all sets share will do; this one makes few
    meetings. A set moves to each bucket of words that holds some of its prefix, as its signature,
    the words and their places; a bucket is compared in one task, whatever the number of its pairs.
    """
    spark = sides["left"].sparkSession
    kept = F.col("n") >= least * (SUBSET_WORDS + 1) - 1e-9
    # a word counts apart in each group
    every, other = (sides[k].where(kept).select("g", "id", F.lit(k == "left").alias("l"), "n", _digest().alias("digest"), F.transform("s", lambda w: F.xxhash64("g", w)).alias("h")) for k in ("left", "right"))
    every = every.unionByName(other)
    types = {f.name: f.dataType for f in every.schema}
    pair = StructType([StructField("g", types["g"]), StructField("left_id", types["id"]), StructField("right_id", types["id"]), StructField("left_digest", LongType()), StructField("right_digest", LongType()), StructField("most", DoubleType())])
    large, places = every.agg(F.count_if(F.col("n") > SUBSET_WORDS), F.sum(F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)).first()
    if not large:
        return spark.createDataFrame([], pair)
    from factlake.sources.shared import written

    often = written(every.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("d")).where(F.col("d") > _SELDOM), "frequent-words")
    least_d, total = _SELDOM + 1, 0
    for d, c in often.groupBy("d").count().orderBy(F.desc("d")).collect():
        total += c
        if total > _RANKED:
            least_d = d + 1
            break
    listed = often.where(F.col("d") >= least_d).toArrow()
    h, d = (listed.column(c).to_numpy() for c in ("h", "d"))
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, d))] = np.arange(1, len(h) + 1)
    order = np.argsort(h)
    ranked = spark.sparkContext.broadcast((h[order], rank[order]))
    buckets = max(_LEAST_BUCKETS, math.ceil(places / _PLACES))
    started = StructType([StructField("bucket", IntegerType()), *(StructField(c, types[c]) for c in ("g", "id", "l", "n", "digest")), StructField("signature", BinaryType()), StructField("h", ArrayType(LongType())), StructField("p", ArrayType(IntegerType()))])
    rows = every.mapInArrow(_started(ranked, buckets, least), started).repartitionById(buckets, "bucket")
    return rows.mapInArrow(_meet_in_bucket(least), pair).distinct()


def _packed(words: Column) -> Column:
    """The words of a set as one text, each of them kept apart."""
    apart = F.transform(words, lambda w: F.replace(F.replace(w, F.lit("\x01"), F.lit("\x01\x01")), F.lit("\x00"), F.lit("\x01\x02")))
    return F.array_join(F.when(F.array_join(words, " ").rlike("[\x00\x01]"), apart).otherwise(words), "\x00")


def mutual_best(left: DataFrame, right: DataFrame, group: str, words: str, least: float = 0.3) -> DataFrame:
    """(group, left_id, right_id, score) of pairs of at least ``least`` that are each other's best by Jaccard of word sets.

    Ties go to the lowest id on either side. Sets of at most SUBSET_WORDS words find their best among
    each other through subsets. Where either set is larger, the two meet on prefixes in rare-first
    order, which hold one word more than a partner at ``least`` can lack. Where they meet, the places
    of the word bound what the sets can have in common, and their signatures what they differ in at
    least: what may still reach ``least`` is compared whole, so few whole sets move. A pair below
    ``least`` is no answer and spoils none, so it need not be found. Null groups, ids and words and
    sets without words are left out. Equal sets are told by a hash of 64 bits, scores by the words.
    """
    from factlake.sources.shared import written

    # the sets are read several times, their texts once; a filter on a set before it is written would make it twice
    sets = written(_word_sets(left, group, words).withColumn("side", F.lit("left")).unionByName(_word_sets(right, group, words).withColumn("side", F.lit("right"))), "word-sets", "side", compression="zstd")
    sides = {k: sets.where(F.col("side") == k).where(_WHOLE).drop("side") for k in ("left", "right")}
    small = {k: _lowest(s.where(F.col("n") <= SUBSET_WORDS)) for k, s in sides.items()}
    pairs = written(_meetings(sides, least), "word-set-pairs")

    def measured(some: DataFrame) -> DataFrame:
        for k, s in sides.items():
            keys = ["g", f"{k}_id", f"{k}_digest"]
            asked = some.select(*keys).distinct()
            texts = s.select("g", F.col("id").alias(keys[1]), _digest().alias(keys[2]), "s", F.col("n").alias(f"{k}_n")).where(F.col(f"{k}_n") >= least * (SUBSET_WORDS + 1) - 1e-9)
            texts = texts.join(F.broadcast(asked) if asked.count() <= _ASKED else asked, keys, "left_semi").withColumn(k, _packed(F.col("s"))).drop("s")
            some = some.join(texts.dropDuplicates(keys), keys)
        both = F.size(F.array_intersect(F.split("left", "\x00", -1), F.split("right", "\x00", -1)))
        scores = some.select("g", "left_id", "right_id", (both / (F.col("left_n") + F.col("right_n") - both)).alias("score"))
        return written(scores.where(F.col("score") >= least), "word-set-scores")

    # first the pair of each set that may score most; then those that may still reach what one of their sets has
    digests = ["left_digest", "right_digest"]
    top = [pairs.groupBy("g", mine).agg(F.max(F.struct("most", other, *digests)).alias("t")).select("g", mine, f"t.{other}", *[f"t.{c}" for c in digests]) for mine, other in (("left_id", "right_id"), ("right_id", "left_id"))]
    first = written(top[0].unionByName(top[1]).distinct(), "word-set-first")
    scored = measured(first)
    rest = pairs.join(first, ["g", "left_id", "right_id", *digests], "left_anti")
    for k in ("left", "right"):
        rest = rest.join(scored.groupBy("g", f"{k}_id").agg(F.max("score").alias(f"{k}_has")), ["g", f"{k}_id"], "left")
    open_ = rest.where(F.col("most") >= F.least(F.coalesce("left_has", F.lit(0.0)), F.coalesce("right_has", F.lit(0.0))) - 1e-9)
    scored = scored.unionByName(measured(written(open_.drop("left_has", "right_has", "most"), "word-set-rest")))

    def best(mine: str, other: str) -> DataFrame:
        large = scored.select("g", F.col(f"{mine}_id").alias("id"), F.col(f"{other}_id").alias("other"), "score")
        every = large.unionByName(_best_parts(small[mine], small[other])).where(F.col("score") >= least)
        top = every.groupBy("g", "id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("other").alias("o"))).alias("t"))
        return top.select("g", F.col("id").alias(f"{mine}_id"), F.col("t.o").alias(f"{other}_id"), (-F.col("t.s")).alias("score"))

    return best("left", "right").join(best("right", "left").drop("score"), ["g", "left_id", "right_id"]).select(F.col("g").alias(group), "left_id", "right_id", "score")


def contained_quotes(quotes: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """(quotes columns, contained): whether the quote is in its evidence, whatever the case and spacing."""
    from factlake.functions.text import collapsed

    out = quotes.join(evidence, key, "left")
    return out.withColumn("contained", F.coalesce(F.instr(collapsed(F.col("content")), collapsed(F.col("quote"))) > 0, F.lit(False))).drop("content")


def term_matches(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, label, hits) of one-word terms in texts; a plural s is tolerated. Tokens meet terms in an equi join."""
    tokens = texts.select(id_col, F.explode(F.split(F.lower(text_col), "[^a-z0-9]+")).alias("token")).where("token <> ''")
    tokens = tokens.withColumn("term", F.regexp_replace("token", "s$", ""))
    keyed = terms.select(F.regexp_replace(F.lower("term"), "s$", "").alias("term"), "label").distinct()
    return tokens.join(keyed, "term").groupBy(id_col, "label").agg(F.count("*").alias("hits"))


def cache_lookup(wanted: DataFrame, cache: DataFrame, keys: list[str], fingerprint: str, order: list[str], payload: str) -> DataFrame:
    """Wanted rows with the newest cached result of the same key and fingerprint; fingerprints that several wanted rows of a key share are ambiguous and miss."""
    w = Window.partitionBy(*keys, fingerprint)
    alone = wanted.withColumn("_n", F.count("*").over(w))
    best = cache.groupBy(*keys, fingerprint).agg(F.max(F.struct(*order, payload)).alias("_c"))
    out = alone.join(best, [*keys, fingerprint], "left")
    return out.withColumn(payload, F.when(F.col("_n") == 1, F.col(f"_c.{payload}"))).drop("_c", "_n")


def name_words(c: Column) -> Column:
    """Lower-case words of a text in any script; a possessive 's goes, and so does the plural s of a longer last word when names are keyed."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), "['’]s\\b", ""), "[^\\p{L}\\p{N}]+"), lambda x: x != "")


def _name_key(words: Column) -> Column:
    """Words joined, the plural s of the last one tolerated."""
    return F.regexp_replace(F.array_join(words, " "), "(?<=\\p{L}{3})s$", "")


#: names that are broadcast to the words of texts
MOST_NAMES = 200_000


def meet(rows: DataFrame, catalog: DataFrame, key: str, n: int) -> DataFrame:
    """Rows with a catalog of ``n`` entries: a small one is broadcast. The rows never are, though Spark takes exploded rows for as small as their table."""
    return rows.join(F.broadcast(catalog), key) if n <= MOST_NAMES else rows.hint("merge").join(catalog, key)


def mentions(texts: DataFrame, names: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, name, entity) of catalog names in texts, leftmost first, of those the longest; a name inside or across another one that counts is none.

    Texts become word n-grams of the lengths that names have, which meet names in one equi join. What
    is found is read in order of place, a text as a stream that holds the end of the last name only.
    Names of the same words all count. Null texts and names without words have none.
    """
    from factlake.operators.packing import fold_in_order

    base = texts.select(F.col(id_col).alias("_id"), name_words(F.col(text_col)).alias("_w")).where("size(_w) > 0")
    keyed = names.select(name_words(F.col("name")).alias("_n"), "name", "entity").where("size(_n) > 0").select(_name_key(F.col("_n")).alias("gram"), F.size("_n").alias("n"), "name", "entity")
    counts = keyed.groupBy("n").count().orderBy("n").collect()  # lengths of names
    sizes = [r["n"] for r in counts]
    places = base.select("_id", "_w", F.explode(F.sequence(F.lit(1), F.size("_w"))).alias("at"))
    grams = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), _name_key(F.slice("_w", F.col("at"), n)).alias("gram")) for n in sizes or [1]]))
    spread = places.select("_id", "at", F.size("_w").alias("_size"), grams.alias("g")).select("_id", "at", "g.*", "_size").where("at + n - 1 <= _size").drop("_size")
    found = meet(spread, keyed.drop("n"), "gram", sum(r["count"] for r in counts)).select("_id", F.col("at").cast("long").alias("at"), F.col("n").cast("long").alias("n"), "name", "entity")
    kinds = dict(found.dtypes)

    def step(last, row):
        key, at, n, name, entity = row
        if last is not None and at < last[1] and (at, n) != (last[0], last[1] - last[0]):
            return last, []
        return (at, at + n), [(key, name, entity)]

    kept = fold_in_order(found, ["_id"], [F.asc("at"), F.desc("n")], step, None, f"_id {kinds['_id']}, name string, entity {kinds['entity']}")
    return kept.withColumnRenamed("_id", id_col).distinct()


def without_families(found: DataFrame, members: DataFrame, id_col: str) -> DataFrame:
    """Mentions without those of a family of which the same text also names a member; ``members`` are (member, family), families may lie in families."""
    named = found.select(F.col(id_col).alias("_id"), F.col("entity").alias("member")).distinct()
    covered = meet(named, members, "member", members.count()).select("_id", F.col("family").alias("_family")).distinct()
    return found.join(covered.hint("merge"), (F.col(id_col) == F.col("_id")) & (F.col("entity") == F.col("_family")), "left_anti")


def near_pairs(df: DataFrame, key: str, words: str, least: float = 0.8) -> DataFrame:
    """(a, b, score) of sets whose Jaccard reaches ``least``.

    Sets meet on prefixes in rare-first order, one less than they may differ in, and are counted
    on the words themselves; texts with equal sets are paired through their smallest key only.
    """
    sets = df.select(key, F.array_sort(F.array_distinct(words)).alias("s")).where(F.size("s") > 0)
    one = sets.groupBy("s").agg(F.min(key).alias("k"))
    copies = sets.join(one, "s").where(F.col(key) > F.col("k")).select(F.col("k").alias("a"), F.col(key).alias("b"), F.lit(1.0).alias("score"))
    exploded = one.select("k", F.size("s").alias("n"), F.explode("s").alias("w"))
    df_ = exploded.groupBy("w").agg(F.count("*").alias("d"))
    place = F.row_number().over(Window.partitionBy("k").orderBy("d", "w"))
    prefix = exploded.join(df_, "w").withColumn("p", place).where(F.col("p") <= F.col("n") - F.ceil(F.col("n") * least) + 1).where("d > 1").select("k", "n", "w")
    left, right = prefix.select(F.col("k").alias("a"), F.col("n").alias("na"), "w"), prefix.select(F.col("k").alias("b"), F.col("n").alias("nb"), "w")
    pairs = left.join(right, "w").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= least * F.greatest("na", "nb"))).select("a", "b").distinct()
    full = pairs.join(one.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a").join(one.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    scored = full.select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("score")).where(F.col("score") >= least)
    return scored.unionByName(copies)
