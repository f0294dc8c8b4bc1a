"""Operator 9: n-gram Jaccard join with token-combination prefixes.

Every document is the set of its distinct 5-word shingles. Shingles have one total order, rare
ones first. A set of n shingles and a partner of m share at least ``overlap(n, m)``, so the set
may differ from partners of that size in at most n - overlap(n, m) of its own shingles, and it is
enough to index a prefix of the order that keeps one signature after any so many losses. A rare
shingle is a signature alone. Of frequent ones k together are one, the more frequent the larger
k, within hash groups; each further shingle of a group beyond k - 1 lengthens the prefix by one.
As the prefix depends on the partner's size, signatures of frequent shingles are made for one
class of partners' sizes each: sets of about one size need the shortest prefixes, so that a set
that is far from the text that a large group of edited copies goes back to has rare shingles
enough, and meets none of that group by the frequent ones.

Two sets that share no signature cannot reach the threshold. Candidates are verified first on
counts of cells of the hash space, whose overlap is never too small, then on whole 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlake.llm.graph import components
from factlake.llm.hashing import _U, SPACE_SEPARATORS, _mix, hash_words, ngram_hashes, small_chunks
from factlake.llm.tables import Scratch, map_rows, text_bytes

SHINGLE = 5
PERCENT = 80
#: About this many shingles at most are told apart as frequent (16 bytes each, broadcast): those of
#: the highest counts. Which ones are frequent only decides how much work is
#: done, never which pairs are found.
FREQUENT_MAX = 1_500_000
FREQUENT_LEAST = 3
#: The mark of a set without frequent shingles.
UNUSUAL = 64_000
#: Counts (as powers of two) from which combinations of one more shingle are indexed; two at least.
LARGER_FROM = (6, 10)
#: Sub-buckets of a signature made of frequent shingles.
SALTS = 64
#: Ids of one side are broadcast up to this count (8 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


def shingle_sets(docs: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    words, counts = hash_words(docs, SPACE_SEPARATORS, lower=True)
    grams, out, at = ngram_hashes(words, size), [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(grams[at : at + n - size + 1]))
        elif n:
            out.append(ngram_hashes(words[at : at + n], n))
        else:
            out.append(np.empty(0, _U))
        at += n
    return out


def set_key(x: np.ndarray) -> int:
    """64-bit identity of a set, as a signed number."""
    with np.errstate(over="ignore"):
        total = _mix(x ^ _U(0xA0761D6478BD642F)).sum(dtype=_U) + _U(len(x))
    return int(_mix(np.array([total], _U)).view(np.int64)[0])


def slack(n: int, percent: int) -> int:
    """Shingles of a set of n that a partner at the threshold can lack."""
    return n + -percent * n // 100


def overlap(n: int, m: int, percent: int) -> int:
    """Least number of shingles that sets of n and m have in common at the threshold."""
    return -(-percent * (n + m) // (100 + percent))


def size_classes(up_to: int) -> list[int]:
    """First sizes of the classes of sizes, each a twentieth wider than the one before."""
    out = [1]
    while out[-1] <= up_to:
        out.append(out[-1] * 21 // 20 + 1)
    return out


class Signer:
    """Signatures of sets under one table of frequent shingles (sorted hashes, levels)."""

    def __init__(self, hashes: np.ndarray, levels: np.ndarray, percent: int) -> None:
        self.hashes, self.levels, self.percent, self.classes = hashes, levels, percent, size_classes(1 << 40)

    def level(self, x: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(x), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, x), len(self.hashes) - 1)
        return np.where(self.hashes[at] == x, self.levels[at], 0)

    def size_class(self, n: int) -> int:
        return int(np.searchsorted(self.classes, n, "right")) - 1

    def groups(self, i: int, j: int) -> int:
        """Hash groups for sets of two classes of sizes; 0 where sets are too small for combinations."""
        a, b = self.classes[min(i, j)], self.classes[max(i, j)]
        groups = max(1, (a + b - 2 * overlap(a, b, self.percent)) // 6)
        lost = groups * sum(range(1, 2 + len(LARGER_FROM)))
        return groups if lost + slack(a, self.percent) + 2 <= a else 0

    def combined(self, tokens: list[int], sizes: list[int], need: int, groups: int) -> list[tuple[int, ...]]:
        """Combinations, in the order, of the first frequent shingles such that one remains after any need - 1 losses."""
        held: dict[tuple[int, int], list[int]] = {}
        out, kept = [], 0
        for h, k in zip(tokens, sizes, strict=True):
            if kept >= need:
                break
            if not groups:
                out.append((h,))
                kept += 1
                continue
            own = held.setdefault((k, h // 65536 % groups), [])
            out += [(*c, h) for c in combinations(own, k - 1)]
            kept += len(own) >= k - 1
            own.append(h)
        return out

    def sign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(signatures, side of each, how unusual the set is).

        The side is -1 for a rare shingle alone, else 0 where partners are of the set's own class
        of sizes, 1 where they are of a higher and 2 where of a lower one.
        """
        n = len(x)
        low, high = n - slack(n, self.percent), n * 100 // self.percent
        if low == high:
            return np.empty(0, _U), np.empty(0, np.int8), UNUSUAL  # only an equal set can link
        most = n - low + 1
        head = x[: most + 8]
        rare = head[self.level(head) == 0]
        if len(rare) >= most:
            return rare[:most], np.full(most, -1, np.int8), UNUSUAL
        levels = self.level(x)
        order = np.lexsort((x, levels))
        x, levels = x[order], levels[order]
        rare = int(np.searchsorted(levels, 0, "right"))
        singles = x[: min(rare, most)]
        sigs, sides = [singles], [np.full(len(singles), -1, np.int8)]
        if rare < most:
            tokens, sizes = x[rare:].tolist(), (2 + np.searchsorted(LARGER_FROM, levels[rare:], "right")).tolist()
            own = self.size_class(n)
            for j in range(self.size_class(low), self.size_class(high) + 1):
                need = n - overlap(n, max(low, self.classes[j]), self.percent) + 1 - rare
                if need <= 0:
                    continue
                by_size: dict[int, list] = {}
                for c in self.combined(tokens, sizes, need, self.groups(own, j)):
                    by_size.setdefault(len(c), []).append(c)
                for k, found in by_size.items():
                    p = np.array(found, dtype=_U).reshape(-1, k)
                    with np.errstate(over="ignore"):
                        h = np.full(len(p), 1000 * min(own, j) + max(own, j) + 1, _U)
                        for at in range(k):
                            h = _mix(h * _U(0xE220A8397B1DCDAF) + p[:, at])
                    sigs.append(h)
                    sides.append(np.full(len(h), (j > own) + 2 * (j < own), np.int8))
        return np.concatenate(sigs), np.concatenate(sides), UNUSUAL - int(1000 * levels.mean())


def _cells(x: np.ndarray) -> bytes:
    """How many shingles fall in each cell of the hash space; as many cells as a quarter to half the shingles."""
    n = 1 << max(6, (len(x) // 4).bit_length())
    while True:
        held = np.bincount((x & _U(n - 1)).astype(np.int64), minlength=n)
        if held.max(initial=0) < 256:
            return held.astype(np.uint8).tobytes()
        n *= 2


def _overlap_at_most(a: bytes, b: bytes) -> int:
    """Upper bound of the overlap of two sets: the smaller count of each cell."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    while len(x) != len(y):
        if len(x) > len(y):
            x, y = y, x
        y = y[: len(y) // 2] + y[len(y) // 2 :]
    return int(np.minimum(x, y).sum())


def _overlap(a: bytes, b: bytes) -> int:
    """Overlap of two sets of whole hashes."""
    return len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))


def _describe(percent: int, size: int, flush: int = 2_000_000):
    """Task: a row per document, with the sketch of its set at the first place in the task, and local counts of repeated shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["common", "doc_id", "node", "n", "sketch"]
        seen: set[int] = set()
        held, kept = [], 0

        def counts():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            h, c = h[c > 1].view(np.int64), c[c > 1]
            m = len(h)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(m, bool)), pa.nulls(m, pa.int64()), pa.array(h), pa.array(c.astype(np.int64)), pa.nulls(m, pa.binary())], names)

        for batch in batches:
            for ids, docs in small_chunks(batch.column(0), batch.column(1)):
                rows = []
                for i, x in zip(ids, shingle_sets(docs, size), strict=True):
                    key = set_key(x) if len(x) and i is not None else None
                    new = key is not None and key not in seen
                    if new:
                        seen.add(key)
                        held.append(x)
                        kept += len(x)
                    rows.append((key, len(x), _cells(x) if new else None))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), bool)), pa.array(ids, pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names)
                if kept > flush:
                    yield counts()
                    held, kept = [], 0
        if held:
            yield counts()

    return run


def _sign(table, percent: int, size: int):
    """Task: signature rows of each distinct set of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, seen = Signer(*table.value, percent), set()
        for batch in batches:
            for ids, docs in small_chunks(batch.column(0), batch.column(1)):
                columns = [[] for _ in range(8)]
                for i, x in zip(ids, shingle_sets(docs, size), strict=True):
                    if not len(x) or i is None or (key := set_key(x)) in seen:
                        continue
                    seen.add(key)
                    sigs, sides, unusual = signer.sign(x)
                    same = lambda v, kind: np.full(len(sigs), v, kind)  # noqa: E731, B023
                    frequent = sides >= 0
                    # of shingles that stand alone the place in the order; 0 tells nothing
                    place = np.where(frequent, 0, np.arange(len(sigs))).astype(np.int32)
                    row = (sigs.view(np.int64), np.where(frequent, 1 + key % SALTS, 0).astype(np.int8), sides, same(key, np.int64), same(len(x), np.int32), place, same(int((~frequent).sum()), np.int32), same(unusual, np.int32))
                    for column, values in zip(columns, row, strict=True):
                        column.append(values)
                if columns[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["sig", "salt", "side", "node", "n", "place", "alone", "unusual"])

    return run


def _whole(size: int):
    """Task: the whole sets of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, docs in small_chunks(batch.column(0), batch.column(1)):
                sets = [x for x in shingle_sets(docs, size) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "n", "sketch"])

    return run


def _reaches(percent: int, overlap):
    """Task: keeps the pairs whose overlap reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, a, nb, b = (batch.column(k).to_pylist() for k in range(2, 6))
            keep = []
            for m, x, k, y in zip(na, a, nb, b, strict=True):
                possible = 100 * min(m, k) >= percent * max(m, k)
                both = overlap(x, y) if possible else 0
                keep.append(possible and 100 * both >= percent * (m + k - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, overlap) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "sa", "nb", "sb")
    return map_rows(both, _reaches(percent, overlap), "a long, b long").distinct()


def narrowed(docs: DataFrame, ids: DataFrame, key: str = "doc_id", limit: int = BROADCAST_IDS) -> DataFrame:
    """Rows of ``docs`` whose key is in ``ids``; the ids are broadcast only up to ``limit`` of them."""
    ids = ids.select(key)
    return docs.join(F.broadcast(ids) if ids.count() <= limit else ids, key, "left_semi")


def most_frequent(counts: DataFrame, most: int, exact_below: int = 10_000) -> DataFrame:
    """About the ``most`` (node, c) of the highest counts, however many there are; all of them where they fit.

    Counts fall into tiers: each count up to ``exact_below``, then eighths of a power of two. Whole
    tiers are taken from the top; the one that does not fit gives a share of its nodes by their hash.
    """
    above = exact_below + 1 + F.floor(8 * F.log2(F.col("c") / exact_below)).cast("long")
    tiered = counts.withColumn("tier", F.when(F.col("c") <= exact_below, F.col("c")).otherwise(above))
    room, cut, share = most, None, 0.0
    for tier, n in tiered.groupBy("tier").count().orderBy(F.desc("tier")).toPandas().itertuples(index=False):
        if n > room:
            cut, share = int(tier), room / n
            break
        room -= n
    if cut is None:
        return counts
    drawn = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(share * (1 << 20))
    return tiered.where((F.col("tier") > cut) | ((F.col("tier") == cut) & drawn)).select("node", "c")


def jaccard_components(docs: DataFrame, *, percent: int = PERCENT, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Null or empty text has no shingles and links with nothing; texts of fewer words than
    ``size`` have their whole sequence as one shingle. Rows with equal sets are one node, so
    repeated rows and ties cost nothing and get one component, the smallest id. A null id gets a
    null component and links with nothing. Other columns of ``docs`` are ignored. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    described = scratch.save(map_rows(source, _describe(percent, size), "common boolean, doc_id long, node long, n long, sketch binary"), "described")
    rows = described.where("not common").select("doc_id", "node", "n")
    counts = scratch.save(described.where("common").groupBy("node").agg(F.sum("n").alias("c")).where(F.col("c") >= FREQUENT_LEAST), "counts")
    common = most_frequent(counts, FREQUENT_MAX).toPandas()
    h = common["node"].to_numpy(np.int64).view(_U)
    order = np.argsort(h)
    table = spark.sparkContext.broadcast((h[order], np.floor(np.log2(common["c"].to_numpy(np.float64)))[order].astype(np.int64)))

    signatures = map_rows(source, _sign(table, percent, size), "sig long, salt tinyint, side tinyint, node long, n int, place int, alone int, unusual int")
    bucket = Window.partitionBy("sig", "salt")
    # the hub of a bucket is the set with the most common shingles: of edited copies the least edited
    shared = signatures.withColumns({"hub": F.min(F.struct("unusual", "node")).over(bucket), "low": F.min("node").over(bucket), "high": F.max("node").over(bucket)})
    # of a salted signature the sub-buckets with a single set matter too
    dealt = scratch.save(shared.where("low <> high or salt > 0").drop("low", "high", "unusual"), "dealt")
    # a signature for two classes of sizes needs sets of both; its sub-buckets have one hub
    salted = dealt.where("salt > 0").groupBy("sig").agg(F.min("hub").alias("hub"), *[f(c).alias(f"{n}_{c}") for c in ("node", "side") for f, n in ((F.min, "low"), (F.max, "high"))])
    live = salted.where("low_node <> high_node and (low_side = 0 or low_side <> high_side)").select("sig", "hub")
    buckets = scratch.save(dealt.where("salt = 0").unionByName(dealt.where("salt > 0").drop("hub").join(live, "sig")), "buckets")
    scratch.drop(dealt)
    sketches = described.where("sketch is not null").select("node", "n", "sketch").dropDuplicates(["node"])
    reps = scratch.save(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep")), "reps")
    pair = lambda df, x, y: df.where(f"{x} <> {y}").select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    def links(pairs: DataFrame, name: str) -> DataFrame:
        likely = scratch.save(_verified(pairs, sketches, percent, _overlap_at_most), f"{name}-likely")
        nodes = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
        ids = reps.join(nodes, "node", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
        sets = map_rows(narrowed(source, ids), _whole(size), "node long, n long, sketch binary")
        out = scratch.save(_verified(likely, sets, percent, _overlap), f"{name}-links")
        scratch.drop(likely)
        return out

    # Of the rare shingles that a set is indexed by, those that no other set is indexed by are not in
    # a partner either, if its index reaches as far in the order: of two partners one set's does, and
    # both do where they share a signature of frequent shingles, which come behind all rare ones.
    # So a partner has at most ``can`` shingles in common with the set.
    rows_of = buckets.withColumn("frequent", F.col("salt") > 0).drop("hub", "salt").dropDuplicates(["sig", "node"])
    bound = rows_of.groupBy("node").agg((F.first("n") - F.first("alone") + F.count_if(~F.col("frequent"))).cast("int").alias("can"))
    placed = scratch.save(rows_of.join(bound, "node"), "placed")

    def unjoined(part: DataFrame) -> DataFrame:
        """Rows of signatures whose sets are in several components, with the largest one there."""
        per = part.groupBy("sig", "component").agg(F.count("*").alias("c"))
        mixed = per.groupBy("sig").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
        return scratch.save(part.join(mixed.select("sig", "main"), "sig"), "unjoined")

    # first each set with one hub, of its signatures' hubs that with the most common shingles
    one = buckets.where("hub.node <> node").groupBy("node").agg(F.min("hub").alias("hub")).select("node", F.col("hub.node").alias("hub"))
    tried = scratch.save(pair(one, "hub", "node").distinct(), "one")
    found = links(tried, "one")
    # then all pairs of a signature that are still in different components. A rare shingle at
    # places i and j that is the first the sets share bounds what they share to 1 and the rest behind.
    own = components(found, scratch).withColumnRenamed("id", "node")
    own = F.broadcast(own) if own.count() <= BROADCAST_IDS else own
    now = placed.join(own, "node", "left").withColumn("component", F.coalesce("component", "node"))
    many, few = unjoined(now.where("frequent")), now.where("not frequent")
    columns = ("node", "component", "n", "place", "can", "side")
    renamed = lambda df: df.select("sig", *[F.col(c).alias(f"x_{c}") for c in columns])
    enough = lambda most: f"{100 + percent} * {most} >= {percent} * (n + x_n)"
    apart = f"component <> x_component and 100 * least(n, x_n) >= {percent} * greatest(n, x_n)"
    rest = pair(renamed(many.where("component <> main")).join(many, "sig").where(f"{apart} and (side = 0 or side <> x_side) and {enough('least(can, x_can)')}"), "x_node", "node")
    rare = renamed(few).join(few, "sig").where(f"node < x_node and {apart} and {enough('least(n - place, x_n - x_place)')} and {enough('greatest(can, x_can)')}")
    rest = rest.unionByName(pair(rare, "x_node", "node")).distinct().join(tried, ["a", "b"], "left_anti")
    every = found.unionByName(links(rest, "rest"))

    joined = components(every, scratch).withColumnRenamed("id", "node").join(reps, "node")
    lowest = joined.groupBy("component").agg(F.min("rep").alias("low"))
    named = joined.join(lowest, "component").select("node", "low")
    place = reps.join(named, "node", "left").select("node", F.coalesce("low", "rep").alias("component_id"))
    out = rows.join(place, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op9_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
