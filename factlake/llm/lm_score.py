"""Operator 8: language-model scoring by cross-entropy difference.

Two bigram models of one form, over one vocabulary and one set of bigrams: the target model
counts documents labelled good, the background model all documents. Every word and every bigram
is counted. A document's score is the mean over its words of target loss less background loss,
in nats: the lower, the more it is like the target.

The counts stay distributed. Each (document, bigram) goes to one of as many buckets as the corpus
has words for: that of its rare word if it has one, else that of the bigram. All occurrences of
the bigram and of that rare word meet there, so the bucket counts them and sums the losses per
document. Documents that were dealt out together are a lot; a bucket answers a lot with one packed
row, and the answers to a lot meet again in one task. Counts of common words, and of bigrams of very common words, are broadcast; a first
word of a bigram of two rare words gets its count by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.hashing import _U, WORD_SEPARATORS, _mix, hash_words, small_chunks
from factlake.llm.tables import Scratch, map_rows, text_bytes

#: Counts of words from the first share of all words on, and of bigrams of two words from the second
#: on, are broadcast (at most 2^20 each); those of all others are joined. Neither changes a result.
COMMON_SHARE, HOT_SHARE = 2.0**-20, 2.0**-10
#: weight of the bigram estimate, and pseudo-counts of each word, alike in both models
BIGRAM_WEIGHT, PSEUDO = 0.7, 0.5
TARGET_IDS = 1_000_000
#: words of the corpus a bucket, and of the documents that a task deals out at once
BUCKET_WORDS, DEALT_WORDS = 1_500_000, 2_000_000
_ENTRY = (("before", np.int64), ("word", np.int64), ("row", np.int64), ("n", np.int32), ("marks", np.uint8))
_ANSWER = (("row", np.int64), ("target_loss", np.float64), ("background_loss", np.float64))
_RARE = _U(1 << 63)


def _words(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words as negative numbers, which places in the vocabulary are not, and how many each document has."""
    words, counts = hash_words(docs, WORD_SEPARATORS, lower=True)
    return (words | _RARE).view(np.int64), counts


def _summed(columns: list[np.ndarray]) -> pa.RecordBatch:
    u, at = np.unique(columns[0], return_inverse=True)
    sums = [np.bincount(at, c, len(u)).astype(np.int64) for c in columns[1:]]
    return pa.RecordBatch.from_arrays([pa.array(u), *map(pa.array, sums)], ["key", "n", "n_target", "ends", "ends_target"])


def _count(make, flush: int = 3_000_000):
    """Task: (key, n, n_target, ends, ends_target) of what ``make(words, counts)`` gives, summed within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for target, docs in small_chunks(batch.column(0), batch.column(1)):
                k, owner, last = make(*_words(docs))
                mark = np.array(target, bool)[owner]
                held.append((k, np.ones(len(k), bool), mark, last, mark & last))
                n += len(k)
                if n > flush:
                    yield _summed([np.concatenate(c) for c in zip(*held, strict=True)])
                    held, n = [], 0
        if n:
            yield _summed([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _owner_last(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    last = np.zeros(int(counts.sum()), bool)
    last[(np.cumsum(counts) - 1)[counts > 0]] = True
    return np.repeat(np.arange(len(counts)), counts), last


def _each_word(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return words, *_owner_last(counts)


def _grams(before: np.ndarray, words: np.ndarray, more: np.ndarray | int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(_mix(before.view(_U) + _U(1)) + words.view(_U) + more)


class Common:
    """Counts of the common words by place in the sorted vocabulary, then of the start of a document (as a word before)."""

    def __init__(self, vocabulary: np.ndarray, words: list[np.ndarray], befores: list[np.ndarray], totals: list[float], kinds: int, hot: np.ndarray) -> None:
        self.vocabulary, self.words, self.befores, self.totals, self.kinds, self.hot, self.size = vocabulary, words, befores, totals, kinds, hot, len(vocabulary)

    def coded(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word before, word): common ones as places, others as they are."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), max(0, self.size - 1))
        word = np.where(self.vocabulary[at] == words, at, words) if self.size else words
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[(np.cumsum(counts) - counts)[counts > 0]] = self.size
        return before, word

    def hot_pairs(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        return (before >= 0) & (word >= 0) & self.hot[np.maximum(before, 0)] & self.hot[np.maximum(word, 0)]

    def loss(self, model: int, pair, before, word) -> np.ndarray:
        """Of counts. After a word that the model has not seen, the single estimate stands alone."""
        single = (word + PSEUDO) / (self.totals[model] + PSEUDO * self.kinds)
        follows = np.divide(pair, before, out=np.zeros(len(pair)), where=before > 0)
        return -np.log(np.where(before > 0, BIGRAM_WEIGHT * follows + (1 - BIGRAM_WEIGHT) * single, single))


def _pack(columns) -> bytes:
    """Arrays as bytes, plane by plane, which compress well."""
    raw = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes, columns=_ENTRY) -> list[np.ndarray]:
    n, at, out = int.from_bytes(blob[:8], "little"), 0, []
    width = sum(np.dtype(t).itemsize for _, t in columns)
    raw = np.frombuffer(pa.decompress(blob[8:], n * width, codec="zstd", asbytes=True), np.uint8)
    for _, kind in columns:
        k = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * k].reshape(k, n).T).reshape(-1).view(kind))
        at += n * k
    return out


def _deal(common, pairs, buckets: int):
    """Task: every document's row with the losses of hot pairs, and its other bigrams in packed blocks for the buckets."""

    def dealt(held) -> Iterator[pa.RecordBatch]:
        before, word, row, mark = (np.concatenate(c) for c in zip(*held, strict=True))
        with np.errstate(over="ignore"):
            unique = _grams(before, word, row.view(_U) * _U(0x9E3779B97F4A7C15) + (mark & 2).astype(_U))
        _, first, n = np.unique(unique, return_index=True, return_counts=True)
        before, word, row, mark = before[first], word[first], row[first], mark[first]
        route = np.where(word < 0, word, np.where(before < 0, before, _grams(before, word).view(np.int64)))
        bucket = (_mix(route.view(_U)) % _U(buckets)).astype(np.int32)
        order = np.lexsort((word, before, bucket))
        columns = [c[order] for c in (before, word, row, n.astype(np.int32), mark)]
        kinds, starts = np.unique(bucket[order], return_index=True)
        for k, a, b in zip(kinds.tolist(), starts, [*starts[1:], len(order)], strict=True):
            yield k, _pack([c[a:b] for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (keys, *losses) = common.value, pairs.value
        held, size, lot = [], 0, None
        names = ["bucket", "lot", "block", "row", "doc_id", "n_words", "target_loss", "background_loss"]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

        def blocks() -> Iterator[pa.RecordBatch]:
            if size:
                ks, bs = zip(*dealt(held), strict=True) if any(len(h[0]) for h in held) else ((), ())
                for a in range(0, len(ks), 16):
                    m = len(ks[a : a + 16])
                    yield pa.RecordBatch.from_arrays([pa.array(ks[a : a + 16], kinds[0]), pa.array([lot] * m, kinds[1]), pa.array(bs[a : a + 16], kinds[2]), *(pa.nulls(m, t) for t in kinds[3:])], names)

        for batch in batches:
            head = list(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True))
            for chunk, docs in small_chunks(head, batch.column(3).to_pylist()):
                rows, ids, target = zip(*chunk, strict=True)
                words, counts = _words(docs)
                before, word = known.coded(words, counts)
                owner, last = _owner_last(counts)
                hot = known.hot_pairs(before, word)
                at = np.searchsorted(keys, before[hot] * (known.size + 1) + word[hot])
                sums = [np.bincount(owner[hot], x[at], len(counts)).astype(np.float64) for x in losses]
                rows = np.array(rows, np.int64)
                lot = int(rows[0]) if lot is None else lot  # the number of its first row
                yield pa.RecordBatch.from_arrays([pa.array((rows % buckets).astype(np.int32)), pa.array([lot] * len(rows), kinds[1]), pa.nulls(len(rows), kinds[2]), pa.array(rows), pa.array(ids, kinds[4]), pa.array(counts.astype(np.int64)), *map(pa.array, sums)], names)
                rest = ~hot
                marks = np.array(target, bool)[owner].astype(np.uint8) + 2 * last.astype(np.uint8)
                held.append((before[rest], word[rest], rows[owner[rest]], marks[rest]))
                size += len(words)
                if size > DEALT_WORDS:
                    yield from blocks()
                    held, size, lot = [], 0, None
        yield from blocks()

    return run


_SUMS = "lot long, sums binary, row long, doc_id long, n_words long, target_loss double, background_loss double, before long, n long, pair_target long, pair long, word_target long, word long"
_PLAIN = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def _meet(common):
    """Task, of whole buckets: for each lot its rows with the losses of their bigrams summed, packed, and one row for each bigram whose first word's count is elsewhere."""
    schema = pa.schema([(c.split()[0], _PLAIN[c.split()[1]]) for c in _SUMS.split(", ")])

    def filled(**have) -> pa.RecordBatch:
        n = len(next(iter(have.values())))
        return pa.RecordBatch.from_arrays([pa.array(have[f.name]).cast(f.type) if f.name in have else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, lots = common.value, [], []
        for batch in batches:
            own = batch.filter(batch.column("block").is_null())
            if own.num_rows:
                yield filled(**{c: own.column(c) for c in ("lot", "row", "doc_id", "n_words", "target_loss", "background_loss")})
            sent = batch.filter(batch.column("block").is_valid())
            held += [_unpack(b) for b in sent.column("block").to_pylist()]
            lots += sent.column("lot").to_pylist()
        if not held:
            return
        owner = np.repeat(np.array(lots, np.int64), [len(h[0]) for h in held])
        before, word, row, n, marks = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        both = [n * (marks & 1), n]
        _, gram = np.unique(_grams(before, word), return_inverse=True)
        pair = [np.bincount(gram, x)[gram] for x in both]
        rare, last = word < 0, marks >= 2
        names, at = np.unique(word[rare], return_inverse=True)
        words = [np.bincount(at, x[rare], len(names)) for x in both]
        befores = [w - np.bincount(at, (x * last)[rare], len(names)) for w, x in zip(words, both, strict=True)]
        own_word, own_before = (np.minimum(np.searchsorted(names, c), max(0, len(names) - 1)) for c in (word, before))
        away = (before < 0) & ((names[own_before] != before) if len(names) else True)
        look = lambda coded, at, here, there: np.where(coded < 0, here[at] if len(here) else 0.0, there[np.maximum(coded, 0)])
        counts = [look(word, own_word, words[k], known.words[k]) for k in (0, 1)]
        leads = [look(before, own_before, befores[k], known.befores[k]) for k in (0, 1)]
        # rows are numbered upwards from that of their lot, so a lot's rows stand together
        u, first, at = np.unique(row[~away], return_index=True, return_inverse=True)
        sums = [np.bincount(at, (n * known.loss(k, pair[k], leads[k], counts[k]))[~away], len(u)) for k in (0, 1)]
        of = owner[~away][first]
        starts = np.flatnonzero(np.diff(of, prepend=of[0] - 1)) if len(of) else np.empty(0, np.int64)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(of)], strict=True):
            yield filled(lot=[int(of[a])], sums=[_pack((u[a:b], sums[0][a:b], sums[1][a:b]))])
        rest = np.flatnonzero(away)
        for a in range(0, len(rest), 50_000):
            r = rest[a : a + 50_000]
            yield filled(row=row[r], before=before[r], n=n[r], pair_target=pair[0][r], pair=pair[1][r], word_target=counts[0][r], word=counts[1][r])

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task, of whole lots: one row per document with its losses summed over the buckets' answers."""
    heads, answers, size = [], [], 0

    def summed() -> list[np.ndarray]:
        row, *losses = (np.concatenate(c) for c in zip(*answers, strict=True))
        u, at = np.unique(row, return_inverse=True)
        return [u, *(np.bincount(at, x, len(u)) for x in losses)]

    for batch in batches:
        head = batch.filter(batch.column("row").is_valid())
        heads.append(head)
        new = [[head.column(c).to_numpy() for c in ("row", "target_loss", "background_loss")], *(_unpack(b, _ANSWER) for b in batch.column("sums").drop_null().to_pylist())]
        answers += new
        size += sum(len(a[0]) for a in new)
        if size > DEALT_WORDS:
            answers, size = [summed()], 0
    if heads:
        row, target, background = summed()
        for head in heads:
            at = np.searchsorted(row, head.column("row").to_numpy())
            yield pa.RecordBatch.from_arrays([head.column("row"), head.column("doc_id"), head.column("n_words"), pa.array(target[at]), pa.array(background[at])], ["row", "doc_id", "n_words", "target_loss", "background_loss"])


def score_language(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", common_share: float = COMMON_SHARE, hot_share: float = HOT_SHARE, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(doc_id, n_words, target_loss, background_loss, score) for every row of ``docs``.

    Counts are over all words of all documents. Null and empty texts have no words and score 0.
    Without target documents the target model is the same for every word. Null ids are scored and
    belong to the background only; repeated rows count as rows and each give a row; a repeated
    label counts once, null labels never. Other columns are ignored; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "language")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("doc_id"), F.lit(True).alias("target")).where("doc_id is not null").distinct()
    good = F.broadcast(good) if good.count() <= TARGET_IDS else good
    joined = source.join(good, "doc_id", "left").select("doc_id", F.coalesce("target", F.lit(False)).alias("target"), "text")
    marked = joined.select("target", "text")

    sums = [F.sum(c).alias(c) for c in ("n", "n_target", "ends", "ends_target")]
    counted = "key long, n long, n_target long, ends long, ends_target long"
    words = scratch.save(map_rows(marked, _count(_each_word), counted).groupBy("key").agg(*sums), "words")
    total = words.agg(*sums, F.count("*").alias("kinds")).first()
    every = [float(total[c] or 0) for c in ("n_target", "n")]
    ends = [float(total[c] or 0) for c in ("ends_target", "ends")]
    top = words.where(F.col("n") >= common_share * every[1]).toPandas().sort_values("key")
    known = [top[c].to_numpy(np.float64) for c in ("n_target", "n")]
    befores = [np.append(n - top[c].to_numpy(np.float64), e) for n, c, e in zip(known, ("ends_target", "ends"), ends, strict=True)]
    common = Common(top["key"].to_numpy(np.int64), [np.append(n, 0.0) for n in known], befores, every, total["kinds"] + 1, np.append(known[1] >= hot_share * every[1], True))
    shipped = spark.sparkContext.broadcast(common)

    def hot_pairs(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        before, word = shipped.value.coded(words, counts)
        owner, last = _owner_last(counts)
        hot = shipped.value.hot_pairs(before, word)
        return before[hot] * (shipped.value.size + 1) + word[hot], owner[hot], last[hot]

    pairs = map_rows(marked, _count(hot_pairs), counted).groupBy("key").agg(*sums).toPandas().sort_values("key")
    keys = pairs["key"].to_numpy(np.int64)
    before, word = keys // (common.size + 1), keys % (common.size + 1)
    losses = [common.loss(k, pairs[c].to_numpy(np.float64), befores[k][before], common.words[k][word]) for k, c in enumerate(("n_target", "n"))]

    buckets = int(every[1] // bucket_words) + 1
    rows = joined.select(F.monotonically_increasing_id().alias("row"), "doc_id", "target", "text")
    dealt = map_rows(rows, _deal(shipped, spark.sparkContext.broadcast((keys, *losses)), buckets), "bucket int, lot long, block binary, row long, doc_id long, n_words long, target_loss double, background_loss double")
    met = scratch.save(map_rows(dealt.repartitionById(buckets, "bucket"), _meet(shipped), _SUMS), "sums")

    # bigrams of two rare words: the count of the first by a join
    lead = words.select(F.col("key").alias("before"), (F.col("n") - F.col("ends")).alias("lead"), (F.col("n_target") - F.col("ends_target")).alias("lead_target"))
    apart = met.where("before is not null").select("row", "before", "n", "pair_target", "pair", "word_target", "word").join(lead, "before")

    def loss(model: int, pair: str, before: str, word: str):
        single = (F.col(word) + PSEUDO) / (every[model] + PSEUDO * common.kinds)
        p = F.when(F.col(before) > 0, BIGRAM_WEIGHT * F.col(pair) / F.col(before) + (1 - BIGRAM_WEIGHT) * single).otherwise(single)
        return F.col("n") * -F.log(p)

    none = F.lit(None).cast("long")
    apart = apart.select("row", none.alias("doc_id"), none.alias("n_words"), loss(0, "pair_target", "lead_target", "word_target").alias("target_loss"), loss(1, "pair", "lead", "word").alias("background_loss"))
    answered = met.where("lot is not null").select("lot", "sums", "row", "doc_id", "n_words", "target_loss", "background_loss").repartition(buckets, "lot")
    out = map_rows(answered, _gather, "row long, doc_id long, n_words long, target_loss double, background_loss double").unionByName(apart)
    out = out.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *[(F.sum(c) / F.greatest(F.max("n_words"), F.lit(1))).alias(c) for c in ("target_loss", "background_loss")])
    return out.select("doc_id", "n_words", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("score"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_language(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
