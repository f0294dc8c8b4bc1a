"""Operator 13: alignment of two tokenizers by galloping intersection of their token ends.

Each text is encoded twice. The shorter list of byte ends drives an exponential, then binary search
into the longer one; the common ends cut both encodings into groups, and differences of ranks give
how many tokens of either side a group holds. Tokens of a group are linked. How many documents hold
an id pair linked is counted over the whole corpus, and each document's links are weighed by it.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.bpe import TextEncoder
from factlake.llm.hashing import small_chunks
from factlake.llm.tables import Scratch, map_rows, text_bytes

#: bytes of text encoded at once; links of a document written as one row; pairs of at most 1 / 2^18 of all links each are joined by shuffle
CHUNK_BYTES, CHUNK_PAIRS, FREQUENT_SHARE = 300_000, 1_000_000, 1 << 18
#: pieces of text kept encoded per task, and the longest of them
CACHE_PIECES, CACHE_CHARS = 100_000, 32
#: elements of the shorter list between two that are searched first
STRIDE = 32
#: a pair of ids in one integer: ids of the second tokenizer have 15 bits, those of the first 16
_SHIFT = 15


class ByteTokens:
    """A tokenizer of the tokenizers library with byte-level entries; texts get a space in front.

    It encodes each match of its splitting pattern separately, so a piece is encoded once and then known.
    """

    def __init__(self, content: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.encode_special_tokens = True
        # fixed values: bytes that stand for themselves; the others are written as the characters from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.bytes = [bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode() for name in names]

        self.split, self.known = TextEncoder({}, pattern).split, {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.split(" " + t) for t in texts]
        known = self.known
        missing = list(set(chain.from_iterable(split)).difference(known))
        for piece, found in zip(missing, self.tokenizer.encode_batch_fast(missing, add_special_tokens=False), strict=True):
            known[piece] = tuple(found.ids)
        out = [list(chain.from_iterable(map(known.__getitem__, pieces))) for pieces in split]
        for piece in missing if len(known) > CACHE_PIECES else [p for p in missing if len(p) > CACHE_CHARS]:
            del known[piece]
        return out


class PieceTokens:
    """A model of the sentencepiece library, which puts the space in front itself."""

    def __init__(self, content: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        n = self.model.get_piece_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.model.id_to_piece(i)) for i in range(n))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks, in both increasing lists, of the values that both hold.

    Every STRIDE-th value of the shorter list is placed first; the values behind it start from its
    place, double their step until they are passed, and end with a binary search in the last step.
    All values of a level move together.
    """
    place = _places(short, long)
    found = np.flatnonzero(long[np.minimum(place, len(long) - 1)] == short) if len(long) else np.empty(0, np.int64)
    return found, place[found]


def _places(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each value the first rank in ``long`` whose value is not smaller."""
    n, m = len(short), len(long)
    low = np.repeat(_places(short[::STRIDE], long), STRIDE)[:n] if n > STRIDE else np.zeros(n, np.int64)
    # the place is in [low, high]
    high, step, active = low.copy(), 1, np.arange(n)
    while len(active):
        active = active[high[active] < m]
        active = active[long[high[active]] < short[active]]
        low[active] = high[active] + 1
        high[active] = np.minimum(high[active] + step, m)
        step *= 2
    active = np.flatnonzero(low < high)
    while len(active):
        middle = (low[active] + high[active]) // 2
        less = long[middle] < short[active]
        low[active[less]] = middle[less] + 1
        high[active[~less]] = middle[~less]
        active = active[low[active] < high[active]]
    return low


def intersect(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in ``a`` and ``b`` of their common values; the shorter list drives."""
    if len(a) <= len(b):
        return gallop(a, b)
    y, x = gallop(b, a)
    return x, y


class Aligner:
    """Encodes and aligns texts with both tokenizers."""

    def __init__(self, a: ByteTokens, b: PieceTokens) -> None:
        self.sides = (a, b)
        self.lengths = tuple(np.array([len(x) for x in side.bytes], np.int64) for side in self.sides)
        # a token's text in a group: followed by the mark that stands behind it
        self.written = [f"{i}{mark}" for side, marks in zip(self.sides, (",|", ",;"), strict=True) for i in range(len(side.bytes)) for mark in marks]

    def align(self, texts: list[str]) -> list[tuple]:
        """For each text (n_a, n_b, n_groups, n_links, groups, [(pairs, times)]); chunks of pairs of one text share none."""
        out: list[tuple] = [(0, 0, 0, 0, "", [])] * len(texts)
        full = [k for k, t in enumerate(texts) if t]
        if not full:
            return out
        ids = [[], []]
        good = []
        for k, *both in zip(full, *(side.encode([texts[k] for k in full]) for side in self.sides), strict=True):
            if all(b"".join(map(side.bytes.__getitem__, x)) == b" " + texts[k].encode() for side, x in zip(self.sides, both, strict=True)):
                good.append(k)
                for side, x in zip(ids, both, strict=True):
                    side.append(np.array(x, np.int64))
        if not good:
            return out
        flat = [np.concatenate(x) for x in ids]
        # the byte ends of all texts in one growing list; the end of a text is common to both sides, so no group goes beyond it
        common = intersect(*(np.cumsum(n[x]) for n, x in zip(self.lengths, flat, strict=True)))
        counts = [np.diff(c, prepend=-1) for c in common]
        firsts = [c - n + 1 for c, n in zip(common, counts, strict=True)]
        last = np.searchsorted(common[0], np.cumsum([len(x) for x in ids[0]]) - 1)
        links = counts[0] * counts[1]
        before = (0, 0, 0)
        for k, end, *tokens in zip(good, last + 1, *ids, strict=True):
            g, at = slice(before[2], int(end)), [slice(p, p + len(x)) for p, x in zip(before, tokens, strict=False)]
            pairs = self._pairs(flat, firsts, counts, links, g, max(map(len, tokens)))
            out[k] = (len(tokens[0]), len(tokens[1]), g.stop - g.start, int(links[g].sum()), self._groups(flat, counts, g, at), pairs)
            before = (at[0].stop, at[1].stop, g.stop)
        return out

    def _groups(self, flat, counts, g: slice, at: list[slice]) -> str:
        """The groups as text: tokens of both sides take their places in order, each with the mark behind it."""
        n = [c[g] for c in counts]
        total = int(n[0].sum() + n[1].sum())
        words = np.empty(total, np.int64)
        ends = [np.cumsum(x) for x in n]
        shift = [np.repeat(ends[1] - n[1], n[0]), np.repeat(ends[0], n[1])]
        for side in (0, 1):
            mark = np.zeros(len(shift[side]), np.int64)
            mark[ends[side] - 1] = 1
            words[np.arange(len(mark)) + shift[side]] = (flat[side][at[side]] + side * len(self.lengths[0])) * 2 + mark
        return "".join(map(self.written.__getitem__, words.tolist()))[:-1]

    def _pairs(self, flat, firsts, counts, links, g: slice, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Distinct id pairs linked in one text, and how often; in chunks by ranges of first ids where they are many."""
        if int(links[g].sum()) <= CHUNK_PAIRS + n:
            return [_distinct(_spread(flat, firsts, counts, links, np.arange(g.start, g.stop)))]
        # few tokens beyond measure in a group: ids of a group once, with their numbers
        groups = [[np.unique(flat[s][firsts[s][k] : firsts[s][k] + counts[s][k]], return_counts=True) for s in (0, 1)] for k in range(g.start, g.stop)]
        weight = np.zeros(len(self.lengths[0]) + 1, np.int64)
        for (a, _), (b, _) in groups:
            weight[a] += len(b)
        cuts = np.unique(np.searchsorted(np.cumsum(weight), np.arange(CHUNK_PAIRS, int(weight.sum()) + CHUNK_PAIRS, CHUNK_PAIRS)))
        out, low = [], 0
        for high in [*(int(c) + 1 for c in cuts), len(weight)]:
            keys, times = [], []
            for (a, na), (b, nb) in groups:
                x = slice(*np.searchsorted(a, (low, high)))
                if x.start < x.stop:
                    keys.append((a[x, None] << _SHIFT | b).ravel())
                    times.append((na[x, None] * nb).ravel())
            if keys:
                out.append(_distinct(np.concatenate(keys), np.concatenate(times)))
            low = high
        return out


def _spread(flat, firsts, counts, links, groups: np.ndarray) -> np.ndarray:
    """The id pairs of all links of these groups."""
    n = links[groups]
    each = np.repeat(groups, n)
    within = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    up, down = np.divmod(within, counts[1][each])
    return flat[0][firsts[0][each] + up] << _SHIFT | flat[1][firsts[1][each] + down]


def _distinct(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if times is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(times, first)


@lru_cache(maxsize=1)
def _aligner(a: str, pattern: str, b: bytes) -> Aligner:
    return Aligner(ByteTokens(a, pattern), PieceTokens(b))


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A vocabulary file, local to the driver or in a store that Spark reads."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


_HEAD = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def align_documents(docs: DataFrame, byte_tokens: str, pattern: str, piece_tokens: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``, of its whole text.

    ``byte_tokens`` and ``piece_tokens`` are the paths of the two vocabularies, ``pattern`` is what the
    first splits texts by; the second has at most 2^15 ids. Texts that are null or empty, or that a tokenizer does not give back byte by byte, have
    no tokens. Every row is a document, also one whose id is null or stands more than once; ties of
    counts are all best. An empty table gives an empty result, other columns are ignored. Very long
    texts are encoded whole; the links of one are written in chunks.

    Counts of id pairs are summed before they move. Pairs that hold a share of 2^-18 of all links or
    more, so at most 2^18, are broadcast to the links; the others, none of which is hot, are joined.
    """
    spark = docs.sparkSession
    broadcast = spark.sparkContext.broadcast((read_bytes(spark, byte_tokens).decode(), pattern, read_bytes(spark, piece_tokens)))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    names = ["key", "head", "doc_id", *(x.split()[0] for x in _HEAD.split(", ")), "pairs", "times"]
    kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 5, pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*broadcast.value)
        key = TaskContext.get().partitionId() << 36
        for batch in batches:
            for ids, texts in small_chunks(batch.column(0), batch.column(1), CHUNK_BYTES, 64):
                rows = []
                for doc_id, (*sizes, groups, pairs) in zip(ids, aligner.align([t.decode("utf-8", "replace") for t in texts]), strict=True):
                    key += 1
                    digest = hashlib.sha256(groups.encode()).hexdigest() if sizes[0] else ""
                    (first, *more) = pairs or [((), ())]
                    rows.append((key, True, doc_id, *sizes, digest, *first))
                    rows += [(key, False, *[None] * 6, *chunk) for chunk in more]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    scratch = Scratch(spark, "alignment")
    aligned = scratch.save(map_rows(source, run, f"key long, head boolean, doc_id long, {_HEAD}, pairs array<int>, times array<long>"), "aligned")
    counts = scratch.save(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "counts")
    # one row for each id of the first tokenizer at most
    best = counts.groupBy(F.shiftright("pair", _SHIFT).alias("a")).agg(F.max("n").alias("most"))
    weighed = counts.join(F.broadcast(best), F.shiftright("pair", _SHIFT) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    is_frequent = F.col("n") * FREQUENT_SHARE >= total
    links = aligned.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("key", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    met = links.join(F.broadcast(weighed.where(is_frequent)), "pair", "left")
    rare = met.where("n is null").select("key", "pair", "times").join(weighed.where(~is_frequent), "pair")
    weigh = lambda df: df.groupBy("key").agg(F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"))
    sums = weigh(met.where("n is not null")).unionByName(weigh(rare)).groupBy("key").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return aligned.where("head").join(sums, "key", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
