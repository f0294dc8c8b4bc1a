"""Operator 6: embedding near-dedup with navigable small-world graphs per shard.

Equal vectors are one representative. Representatives are dealt to shards, each shard builds its
graph in one task, and queries go to every shard, where they stream past the graph in blocks. Beams widen for queries whose beam is
full of links, and for the whole block until an audit against the shard's vectors passes, on queries' links, themselves
left out, and on planted vectors just above the threshold. Found
pairs are verified by cosine in double precision; components are the union of links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.graph import components
from factlake.llm.hnsw import LINKS, Graph
from factlake.llm.tables import Scratch, map_rows

THRESHOLD = 0.9
#: vectors of a shard (one graph in one task) and queries of a block
SHARD, LEAST_SHARDS, BLOCK = 25_000, 4, 8_192
#: queries that stream past one copy of a graph at most, and copies to make at least while there are blocks for them
LOT, LEAST_TASKS = 32 * BLOCK, 64
BEAM = 24
#: queries of a block that are audited, and the mean recall asked of those with links; the same for planted ones
AUDIT, RECALL = 256, 0.99
PLANTED, PLANTED_RECALL = 64, 0.95
_MARGIN = 1e-4  # single precision of the search


def _vectors(part: pa.RecordBatch | pa.Table, dim: int) -> np.ndarray:
    """The embeddings, a row each, in the precision they came in."""
    column = part.column("embedding")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in single precision, and lengths."""
    wide = x.astype(np.float64)
    length = np.linalg.norm(wide, axis=1)
    wide /= length[:, None]
    return wide.astype(np.float32), length


def _build(key: tuple, rows: pa.Table) -> pa.Table:
    """The nodes of a shard's graph, each with its links in the lowest layer, then those in the layers above that hold it."""
    rows = rows.select(["dim", "shard", "vec_id", "copies", "embedding"]).sort_by("vec_id")
    graph = Graph.build(_unit(_vectors(rows, key[0].as_py()))[0])
    n = len(graph.x)
    width = np.full(n, graph.links[-1].shape[1], np.int64)
    for size in graph.sizes[1:]:
        width[graph.order[:size]] += LINKS
    first = np.concatenate(([0], np.cumsum(width)))
    flat = np.empty(first[-1], np.int32)
    filled = first[:-1].copy()
    for size, links in zip(graph.sizes, graph.links[::-1], strict=True):
        held = np.sort(graph.order[:size])
        flat[filled[held, None] + np.arange(links.shape[1])] = links[held]
        filled[held] += links.shape[1]
    links = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat))
    return rows.append_column("place", pa.array(np.arange(n, dtype=np.int32))).append_column("links", links)


def _restore(parts: list[pa.RecordBatch], dim: int) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The graph of the nodes that ``_build`` gave, in order of place, with their vectors, lengths, ids and copies."""
    rows = pa.Table.from_batches(parts)
    x = _vectors(rows, dim)
    unit, length = _unit(x)
    graph = Graph(unit)
    links = rows.column("links").combine_chunks()
    flat = links.flatten().to_numpy(zero_copy_only=False)
    at = np.concatenate(([0], np.cumsum(links.value_lengths().to_numpy(zero_copy_only=False))))[:-1].astype(np.int64)
    for layer, size in enumerate(graph.sizes):
        degree = LINKS * (2 if layer == 0 else 1)
        held = graph.order[:size]
        layer_links = np.full((len(x), degree), -1, np.int32)
        layer_links[held] = flat[at[held, None] + np.arange(degree)]
        at[held] += degree
        graph.links.insert(0, layer_links)
    return graph, x, length, rows.column("vec_id").to_numpy(), rows.column("copies").to_numpy()


def each_links(graph: Graph, q: np.ndarray, threshold: float, beam: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, nodes whose similarity to it reaches the threshold, similarities) of unit queries.

    The beam doubles where it is full of them; past an eighth of the graph all nodes are compared.
    Few queries are held at a time, however many links they have.
    """
    n = len(graph.x)
    for first in range(0, len(q), 512):
        todo = np.arange(first, min(first + 512, len(q)))
        wide = beam
        while len(todo) and 8 * wide < n:
            ids, sims = graph.search(q[todo], wide)
            near = (sims >= threshold - _MARGIN) & (ids >= 0)
            full = near[:, -1]
            for k in np.flatnonzero(~full):
                yield int(todo[k]), ids[k][near[k]], sims[k][near[k]]
            todo, wide = todo[full], wide * 2
        for k in range(0, len(todo), 128):
            some = todo[k : k + 128]
            for j, sims in zip(some.tolist(), q[some] @ graph.x.T, strict=True):
                near = np.flatnonzero(sims >= threshold - _MARGIN)
                yield j, near, sims[near]


def found_links(graph: Graph, q: np.ndarray, threshold: float, beam: int) -> list[np.ndarray]:
    """Nodes whose similarity to each unit query reaches the threshold."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(q)
    for k, near, _ in each_links(graph, q, threshold, beam):
        out[k] = near
    return out


def _audited_beam(graph: Graph, unit: np.ndarray, own: np.ndarray, ids: np.ndarray, threshold: float) -> int:
    """Doubles the beam until audits pass: mean recall over queries of the block that have links in the shard, themselves left out, and over planted ones.

    A planted query is a vector of the shard turned to just above the threshold from it, the
    hardest link there is, so a block without links is audited too.
    """
    pool = np.unique(np.linspace(0, len(own) - 1, AUDIT).astype(int))
    sims = unit[pool] @ graph.x.T
    sims[ids[None, :] == own[pool][:, None]] = -2
    linked = (sims >= threshold).any(1)
    rng = np.random.default_rng(len(ids))
    x = graph.x[rng.permutation(len(ids))[:PLANTED]]
    away = rng.standard_normal(x.shape).astype(np.float32)
    away -= (away * x).sum(1, keepdims=True) * x
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
    near = min(1.0, threshold + 2 * _MARGIN)
    planted = (near * x + np.sqrt(1 - near * near) * away).astype(np.float32)
    queries = (unit[pool[linked]], planted)
    truths = ([np.flatnonzero(r >= threshold) for r in sims[linked]], [np.flatnonzero(r >= threshold) for r in planted @ graph.x.T])
    beam = BEAM
    while beam < len(ids):
        recalls = [np.mean([len(np.intersect1d(f, t)) / len(t) for f, t in zip(found_links(graph, q, threshold, beam), truth, strict=True) if len(t)] or [1.0]) for q, truth in zip(queries, truths, strict=True) if len(q)]
        if all(r >= least for r, least in zip(recalls[::-1], (PLANTED_RECALL, RECALL), strict=False)):
            break
        beam *= 2
    return beam


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(dim, whether they are nodes, rows): rows of one kind that come together."""
    for batch in batches:
        dim, node = batch.column("dim").to_numpy(zero_copy_only=False), batch.column("place").is_valid().to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((dim[1:] != dim[:-1]) | (node[1:] != node[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(dim)], strict=True):
            if b > a:
                yield int(dim[a]), bool(node[a]), batch.slice(a, b - a)


class _Shard:
    """A shard's graph in a task, and what is known to hang together in it."""

    def __init__(self, parts: list[pa.RecordBatch], dim: int, threshold: float) -> None:
        self.graph, self.x, self.length, self.ids, self.copies = _restore(parts, dim)
        self.dim, self.threshold = dim, threshold
        # of the links found only a forest is passed on to the components
        self.parent = np.arange(len(self.x))

    def _joined(self, near: np.ndarray) -> np.ndarray:
        """One of the nodes for each tree they are in; from now on they are in one."""
        roots = self.parent[near]
        while ((up := self.parent[roots]) != roots).any():
            roots = up
        trees, first = np.unique(roots, return_index=True)
        self.parent[trees] = self.parent[near] = trees[0]
        return near[first]

    def answer(self, queries: pa.Table) -> pa.RecordBatch:
        """(vec_id, other, links): the forest's links with 0, and for each query that has links their number beside its own id."""
        threshold = self.threshold
        own, y = queries.column("vec_id").to_numpy(), _vectors(queries, self.dim)
        unit, length = _unit(y)
        beam = _audited_beam(self.graph, unit, own, self.ids, threshold)
        counts = np.zeros(len(own), np.int64)
        a, b = [], []
        for k, near, sims in each_links(self.graph, unit, threshold, beam):
            if not len(near):
                continue
            # only what single precision leaves open is measured again
            sure = sims >= threshold + _MARGIN
            if not sure.all():
                open_ = near[~sure]
                sure[~sure] = (self.x[open_].astype(np.float64) @ y[k].astype(np.float64)) / (self.length[open_] * length[k]) >= threshold
            near = near[sure & (self.ids[near] != own[k])]
            if len(near):
                counts[k] = self.copies[near].sum()
                others = self.ids[self._joined(near)]
                a.append(np.full(len(others), own[k]))
                b.append(others)
        linked = np.flatnonzero(counts)
        a, b = (np.concatenate([*x, own[linked]]) for x in (a, b))
        links = np.concatenate((np.zeros(len(a) - len(linked), np.int64), counts[linked]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links)], ["vec_id", "other", "links"])


def _search(threshold: float):
    """Of rows in order of dim, a shard's nodes and then the queries to it: the graph stays, the queries stream past it in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, shard, waiting, held = None, [], None, [], 0
        for dim, node, part in _runs(batches):
            if dim != at:
                if shard and held:
                    yield shard.answer(pa.Table.from_batches(waiting))
                at, nodes, shard, waiting, held = dim, [], None, [], 0
            if node:
                nodes.append(part)
                continue
            if nodes:
                shard, nodes = _Shard(nodes, dim, threshold), []
            if not shard:
                continue
            waiting.append(part.select(["vec_id", "embedding"]))
            held += part.num_rows
            while held >= BLOCK:
                block = pa.Table.from_batches(waiting)
                yield shard.answer(block.slice(0, BLOCK))
                waiting, held = block.slice(BLOCK).to_batches(), held - BLOCK
        if shard and held:
            yield shard.answer(pa.Table.from_batches(waiting))

    return run


def near_duplicate_vectors(vectors: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing,
    nor do vectors of different lengths or rows with a null id (component null, not kept). Equal
    vectors link with each other and count each. Rows that repeat an id and its vector count as
    rows. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding")
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"), F.col(vector_col).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    source = source.withColumn("key", F.when(usable, F.sha2(F.array_join(F.transform("embedding", lambda v: (v + F.lit(0.0)).cast("string")), ","), 256)))
    reps = source.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("vector").alias("embedding"))
    reps = scratch.save(reps, "representatives")
    total = reps.count()
    shards, blocks = max(LEAST_SHARDS, math.ceil(total / SHARD)), max(1, math.ceil(total / BLOCK))
    # a graph has few copies, so that all of them grow in proportion to the vectors that pass them
    lots = max(math.ceil(total / LOT), min(blocks, math.ceil(LEAST_TASKS / shards)))
    dealt = reps.withColumns({"dim": F.size("embedding"), "shard": F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"), "lot": F.pmod(F.xxhash64("key", F.lit(1)), F.lit(lots)).cast("int")}).drop("key")
    columns = f"dim int, shard int, vec_id long, copies long, embedding {kind}, place int, links array<int>"
    graphs = dealt.drop("lot").groupBy("dim", "shard").applyInArrow(_build, columns)
    graphs = scratch.save(graphs, "graphs")
    task = (F.col("shard") * lots + F.col("lot")).cast("int").alias("task")
    fields = ("dim", "place", "vec_id", "copies", "embedding", "links")
    nodes = graphs.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))).select(task, *fields)
    asked = dealt.drop("shard").withColumns({"shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), "place": F.lit(None).cast("int"), "links": F.lit(None).cast("array<int>")}).select(task, *fields)
    beside = nodes.unionByName(asked).repartitionById(shards * lots, "task").drop("task").sortWithinPartitions("dim", F.asc_nulls_last("place"), "vec_id")
    found = scratch.save(map_rows(beside, _search(threshold), "vec_id long, other long, links long"), "found")

    joined = components(found.where("vec_id <> other").select(F.col("vec_id").alias("a"), F.col("other").alias("b")), scratch)
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    place = reps.drop("embedding").join(counts, "vec_id", "left").join(joined.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    place = place.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    out = source.select("vec_id", "key").join(place, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
