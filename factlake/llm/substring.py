"""Operator 5: substring dedup by seed and extend.

Seeds are winnowed anchors: of each window of WINDOW words the smallest hash of its GRAM-word
runs. Places of anchors that several documents share meet by anchor, each with the words of the
windows that have it as their anchor. There every place is extended to the left and right, word
by word, along the place of the smallest document: where they agree on a window or more, that is
a repeat, and the place's windows within it are removed. A window that leaves the smallest
document's words may still be in another one; those few are compared by their whole hashes. So
no two documents are paired, and each repeat is found whole. Very common anchors are dealt to
several groups, each with its own smallest document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.hashing import _U, SPACE_SEPARATORS, _mix, hash_words, ngram_hashes, small_chunks
from factlake.llm.tables import Scratch, map_rows, text_bytes

WINDOW = 50
GRAM = 16
#: bits of the filter of shared anchors at most (32 MB broadcast); a fuller filter costs work, never results
FILTER_BITS = 28
#: anchors with this share of all places are dealt to groups of about so many places (at most 10,000 of them)
HOT_SHARE, HOT_GROUP = 1e-4, 2_000
#: ids are broadcast up to this count; beyond it all texts are shuffled by id
BROADCAST_IDS = 1_000_000


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x, have = np.minimum(x[:-have], x[have:]), have * 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def _places(docs: list[bytes], window: int, gram: int):
    """Places of anchors: (index of the document, place, first and last start of a window that has it as anchor, hash), words and words of each document."""
    words, counts = hash_words(docs, SPACE_SEPARATORS, lower=False)
    none = np.empty(0, np.int64)
    if len(words) < window:
        return (none, none, none, none, np.empty(0, _U)), words, counts
    grams = ngram_hashes(words, gram)
    _, rank = np.unique(grams, return_inverse=True)
    # the leftmost of the smallest: equal windows choose it alike
    least = _sliding_min(rank * len(grams) + np.arange(len(grams)), window - gram + 1) % len(grams)
    owner = np.repeat(np.arange(len(docs)), counts)[: len(least)]
    ends = np.cumsum(counts)
    at = np.flatnonzero(np.arange(len(least)) + window <= ends[owner])
    if not len(at):
        return (none, none, none, none, np.empty(0, _U)), words, counts
    place, owner = least[at], owner[at]
    new = np.flatnonzero(np.diff(place, prepend=-1) | np.diff(owner, prepend=-1))
    last = np.append(new[1:], len(at)) - 1
    begin = (ends - counts)[owner[new]]
    return (owner[new], place[new] - begin, at[new] - begin, at[last] - begin, grams[place[new]]), words, counts


def _lowest(ids: list, keys: list, best: dict) -> list[int]:
    """Rows to work on: of rows with equal words those with a lower id than any before them in the task."""
    rows: dict = {}
    for k, (i, key) in enumerate(zip(ids, keys, strict=True)):
        if i is not None and i < best.get(key, i + 1):
            best[key], rows[key] = i, k
    return sorted(rows.values())


def _sequence_keys(words: np.ndarray, counts: np.ndarray) -> list[int]:
    out, at = [], 0
    for n in counts.tolist():
        out.append(int(ngram_hashes(words[at : at + n], n)[0].view(np.int64)) if n else 0)
        at += n
    return out


def _describe(window: int, gram: int):
    """Task: a row per document (id, words, key of the word sequence) and rows of distinct anchors (anchor, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, best = ["anchor", "doc_id", "n_words", "sequence"], {}
        for batch in batches:
            for ids, docs in small_chunks(batch.column(0), batch.column(1)):
                (owner, _, _, _, anchor), words, counts = _places(docs, window, gram)
                keys = _sequence_keys(words, counts)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(counts.astype(np.int64)), pa.array(keys, pa.int64())], names)
                use = np.isin(owner, _lowest(ids, keys, best))
                owner, anchor = owner[use], anchor[use]
                own = np.array([-1 if i is None else i for i in ids], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(own[owner]), pa.nulls(len(owner), pa.int64()), pa.nulls(len(owner), pa.int64())], names)

    return run


def _filter_bits(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return x & _U((1 << bits) - 1), (x * _U(0x9E3779B97F4A7C15)) >> _U(64 - bits)


def _filter_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.unique(np.concatenate(_filter_bits(batch.column(0).to_numpy().view(_U), bits)))
            yield pa.RecordBatch.from_arrays([pa.array((x >> _U(6)).astype(np.int32)), pa.array((_U(1) << (x & _U(63))).view(np.int64))], ["word", "bits"])

    return run


def _seeds(window: int, gram: int, table, bits: int, hot):
    """Task: places of anchors that may be shared, each with the words of its windows, at fixed distances from the anchor, 0 elsewhere."""
    side = window - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, (common, groups), best = table.value, hot.value, {}
        for batch in batches:
            for ids, docs in small_chunks(batch.column(0), batch.column(1)):
                (owner, place, first, last, anchor), words, counts = _places(docs, window, gram)
                use = np.isin(owner, _lowest(ids, _sequence_keys(words, counts), best))
                for at in _filter_bits(anchor, bits):
                    use &= (held[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) == 1
                owner, place, first, last, anchor = (x[use] for x in (owner, place, first, last, anchor))
                own = np.array([-1 if i is None else i for i in ids], np.int64)[owner]
                key, salt = anchor.view(np.int64), np.zeros(len(anchor), np.int32)
                if len(common):
                    at = np.minimum(np.searchsorted(common, key), len(common) - 1)
                    salt = np.where(common[at] == key, 1 + (_mix(own.view(_U)) % groups[at].astype(_U)).astype(np.int32), 0).astype(np.int32)
                words = np.maximum(words, _U(1))
                begin = (np.cumsum(counts) - counts)[owner]
                for a in range(0, len(owner), 4096):
                    o, p, f, z = (x[a : a + 4096] for x in (begin, place, first, last))
                    at = (p - side)[:, None] + np.arange(window + side)
                    inside = (at >= f[:, None]) & (at < (z + window)[:, None])
                    text = np.where(inside, words[np.where(inside, at + o[:, None], 0)], _U(0))
                    offsets = np.arange(len(o) + 1, dtype=np.int32) * np.int32(8 * (window + side))
                    blob = pa.Array.from_buffers(pa.binary(), len(o), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(text))])
                    yield pa.RecordBatch.from_arrays([*(pa.array(x[a : a + 4096]) for x in (key, salt, own)), *(pa.array(x.astype(np.int32)) for x in (p, f, z)), blob], ["anchor", "salt", "doc_id", "place", "first", "last", "words"])

    return run


def _extend(window: int, gram: int):
    """Task, over whole anchors in order of document and place: repeats as (doc_id, first and last start of their windows), and windows that leave the smallest document's words, with their hash."""
    side, names = window - gram, ["hash", "doc_id", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = None  # (anchor, salt, id, words) of the smallest document's place
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                batch = whole.slice(k, 4096)
                anchor, salt, doc, place, first, last = (batch.column(c).to_numpy().astype(np.int64) for c in range(6))
                text = np.frombuffer(b"".join(batch.column(6).to_pylist()), _U).reshape(len(doc), -1)
                new = (np.diff(anchor, prepend=anchor[0]) != 0) | (np.diff(salt, prepend=salt[0]) != 0)
                new[0] = least is None or (int(anchor[0]), int(salt[0])) != least[:2]
                leaders = np.flatnonzero(new)
                group = np.cumsum(new) - 1  # -1: that of the batch before
                if least is None or not len(leaders):
                    heads, ids = (text[leaders], doc[leaders]) if len(leaders) else (least[3][None], np.array([least[2]]))
                    group = np.maximum(group, 0)
                else:
                    heads, ids = np.concatenate((least[3][None], text[leaders])), np.append(least[2], doc[leaders])
                    group = group + 1
                same = (text == heads[group]) & (text != 0)
                # words in a row that agree to the left and to the right of the anchor
                left = np.logical_and.accumulate(same[:, :side][:, ::-1], axis=1).sum(1)
                right = np.logical_and.accumulate(same[:, side + gram :], axis=1).sum(1)
                agree = same[:, side : side + gram].all(1)
                a, b = np.maximum(first, place - left), np.minimum(last, place + right - side)
                found = agree & (a <= b)
                repeat = found & ~new & (doc > ids[group])
                yield pa.RecordBatch.from_arrays([pa.nulls(int(repeat.sum()), pa.int64()), pa.array(doc[repeat]), pa.array(a[repeat].astype(np.int32)), pa.array(b[repeat].astype(np.int32))], names)
                # the smallest document of a part of a common anchor stands for its part
                a, b = np.where(found & ~(new & (salt > 0)), a, last + 1), np.where(found & ~(new & (salt > 0)), b, last)
                rest = np.flatnonzero(((a > first) | (b < last)) & ~(new & (salt == 0)))
                if len(rest):
                    row = np.repeat(rest, (last - first + 1)[rest])
                    start = np.arange(len(row)) - np.repeat(np.cumsum((last - first + 1)[rest]) - (last - first + 1)[rest], (last - first + 1)[rest]) + first[row]
                    out = (start < a[row]) | (start > b[row])
                    row, start = row[out], start[out]
                    flat = ngram_hashes(text[rest].reshape(-1), window)
                    at = np.searchsorted(rest, row) * (window + side) + start - place[row] + side
                    yield pa.RecordBatch.from_arrays([pa.array(flat[at].view(np.int64)), pa.array(doc[row]), pa.array(start.astype(np.int32)), pa.array(start.astype(np.int32))], names)
                if len(leaders):
                    at = leaders[-1]
                    least = (int(anchor[at]), int(salt[at]), int(doc[at]), text[at].copy())

    return run


def _remove(window: int, digest: bool):
    """Task: (doc_id, n_words, n_removed, kept) from (doc_id, text, runs of removed windows as first and last start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            starts = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * len(texts)
            total, removed, kept = [], [], []
            for text, at in zip(texts, starts, strict=True):
                words = text.split()
                gone = 0
                if at:
                    first, last = (np.array([r[k] for r in at], np.int64) for k in ("first", "last"))
                    edges = np.zeros(max(len(words), int(last.max()) + window) + 1, np.int64)
                    np.add.at(edges, first, 1)
                    np.add.at(edges, last + window, -1)
                    covered = (np.cumsum(edges)[: len(words)] > 0).tolist()
                    gone = sum(covered)
                    words = [w for w, c in zip(words, covered, strict=True) if not c]
                total.append(len(words) + gone)
                removed.append(gone)
                line = b" ".join(words)
                kept.append(hashlib.sha256(line).hexdigest() if digest else line.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of ``docs``; kept is the remaining words joined by one space, or its SHA-256.

    Words are runs of non-space. A word goes when it is in a window whose word sequence also
    starts in a document with a smaller id. Null text has no words. A null id is never earlier or
    later than another: nothing goes and nothing is compared with it. Repeated rows have one id
    and don't remove each other; of documents with equal words all but the smallest id lose every
    word. Rows of one id with different texts share the places of their removed windows. Other
    columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    gram = min(GRAM, window)
    rows = map_rows(source, _describe(window, gram), "anchor long, doc_id long, n_words long, sequence long")
    described = scratch.save(rows, "described")
    one_each = described.where("anchor is null and doc_id is not null").select("doc_id", "n_words", "sequence")
    anchors = described.where("anchor is not null").groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("c"))
    shared = scratch.save(anchors.where("low < high").select("anchor", "c"), "shared")

    bits = min(FILTER_BITS, max(16, (16 * shared.count()).bit_length()))
    words = map_rows(shared.select("anchor"), _filter_words(bits), "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    held = np.zeros(1 << (bits - 6), _U)
    held[words["word"].to_numpy()] = words["bits"].to_numpy(np.int64).view(_U)
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(held)
    total = shared.agg(F.sum("c")).first()[0] or 0
    hot = shared.where(F.col("c") > max(HOT_GROUP, HOT_SHARE * total)).toPandas().sort_values("anchor")
    groups = spark.sparkContext.broadcast((hot["anchor"].to_numpy(np.int64), hot["c"].to_numpy(np.int64) // HOT_GROUP + 1))

    seeds = map_rows(source, _seeds(window, gram, table, bits, groups), "anchor long, salt int, doc_id long, place int, first int, last int, words binary")
    met = seeds.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "doc_id", "place")
    runs = scratch.save(map_rows(met, _extend(window, gram), "hash long, doc_id long, first int, last int"), "runs")
    rest = runs.where("hash is not null")
    low = rest.groupBy("hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("hash", "low")
    later = rest.join(low, "hash").where("doc_id > low").select("doc_id", "first", "last")
    copies = one_each.where(f"n_words >= {window}").groupBy("sequence", "n_words").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    whole = one_each.join(copies, ["sequence", "n_words"]).where("doc_id > low").select("doc_id", F.lit(0).alias("first"), (F.col("n_words") - window).cast("int").alias("last"))
    repeats = whole.unionByName(runs.where("hash is null").select("doc_id", "first", "last")).unionByName(later)
    plan = scratch.save(repeats.groupBy("doc_id").agg(F.collect_set(F.struct("first", "last")).alias("starts")), "plan")

    task = _remove(window, digest)
    schema = "doc_id long, n_words long, n_removed long, kept string"
    if plan.count() > BROADCAST_IDS:
        return map_rows(source.join(plan, "doc_id", "left").select("doc_id", "text", "starts"), task, schema)
    ids = F.broadcast(plan.select("doc_id"))
    plain = map_rows(source.join(ids, "doc_id", "left_anti").select("doc_id", "text"), task, schema)
    touched = source.join(ids, "doc_id", "left_semi").join(plan, "doc_id").select("doc_id", "text", "starts")
    return plain.unionByName(map_rows(touched, task, schema))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
    return found.withColumnRenamed("kept", "kept_sha256")
