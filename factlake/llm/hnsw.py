"""A navigable small-world graph with layers, built and searched for many vectors at once with numpy."""

from __future__ import annotations

import numpy as np

LINKS = 12  # of a node in the upper layers; twice as many in the lowest
AROUND = 48  # beam while building
_CELLS = 1 << 20  # numbers of one kind that a step of the build or of a search holds


class Graph:
    """Layers of links over unit vectors. Layer 0 holds all nodes, layer l a random 1 / LINKS**l of them, the first ones of ``order``."""

    def __init__(self, vectors: np.ndarray, seed: int = 11) -> None:
        self.x = np.ascontiguousarray(vectors, np.float32)
        n = len(self.x)
        self.order = np.random.default_rng(seed).permutation(n).astype(np.int32)
        self.sizes = [n]
        while self.sizes[-1] > 4 * LINKS:
            self.sizes.append(max(LINKS, self.sizes[-1] // LINKS))
        self.links: list[np.ndarray] = []  # from the top layer down; -1 where a node has fewer

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 11) -> Graph:
        graph = cls(vectors, seed)
        for layer in range(len(graph.sizes) - 1, -1, -1):
            graph._build_layer(layer)
        return graph

    def _build_layer(self, layer: int) -> None:
        size, degree = self.sizes[layer], LINKS * (2 if layer == 0 else 1)
        members = self.order[:size]
        links = np.full((len(self.x), degree), -1, np.int32)
        self.links.append(links)
        done = 0
        while done < size:
            # the next members: as many as are there already, at least a block that is compared in itself
            batch = members[done : done + max(256, min(done, 4096))]
            for k in range(0, len(batch), 1024):
                block = batch[k : k + 1024]
                inner = self.x[block] @ self.x[block].T
                np.fill_diagonal(inner, -2)
                m = min(AROUND, max(1, len(block) - 1))
                near = np.argpartition(-inner, m - 1, axis=1)[:, :m] if len(block) > 1 else np.zeros((1, 0), int)
                ids, sims = block[near], np.take_along_axis(inner, near, 1)
                if done:
                    found, s = self._descend(self.x[block], AROUND)
                    ids, sims = np.concatenate((ids, found), 1), np.concatenate((sims, s), 1)
                self._connect(links, block, ids, sims, degree)
            done += len(batch)

    def _connect(self, links: np.ndarray, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> None:
        """Links nodes with diverse near ones and back; a crowded node keeps its diverse nearest."""
        chosen = self._diverse(nodes, ids, sims, degree // 2)
        links[nodes, : chosen.shape[1]] = chosen
        src, col = np.nonzero(chosen >= 0)
        targets, sources = chosen[src, col], nodes[src]
        both = np.unique(targets)
        # all links of the targets, old and new, then the diverse nearest of each
        place = np.searchsorted(both, targets)
        sources = sources[np.argsort(place, kind="stable")]
        width = np.bincount(place, minlength=len(both))
        first = np.cumsum(width) - width
        # targets of like width together, so that one with very many new links widens no others
        by = np.argsort(width, kind="stable")
        done = 0
        while done < len(by):
            most = done + max(1, _CELLS // (degree + int(width[by[done]])))
            part = by[done:most][: max(1, _CELLS // (degree + int(width[by[done:most][-1]])))]
            done += len(part)
            cols = np.arange(width[part].max())
            more = np.where(cols < width[part, None], sources[np.minimum(first[part, None] + cols, len(sources) - 1)], -1).astype(np.int32)
            pool = np.concatenate((links[both[part]], more), 1)
            values = np.where(pool >= 0, self._sims(self.x[both[part]], pool), -2)
            links[both[part]] = self._diverse(both[part], pool, values, degree)

    def _sims(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = np.empty(ids.shape, np.float32)
        step = max(1, min(512, 4 * _CELLS // max(1, ids.shape[1] * self.x.shape[1])))
        for k in range(0, len(q), step):
            out[k : k + step] = np.matmul(self.x[ids[k : k + step]], q[k : k + step, :, None])[..., 0]
        return out

    def _diverse(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
        """Of each row half of the links to the nearest, the rest to those not nearer to a kept one; -1 fills up."""
        sims = np.where((ids < 0) | (ids == nodes[:, None]), -2, sims)
        most = min(ids.shape[1], 3 * keep)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :most]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        repeated = np.zeros(ids.shape, bool)
        for k in range(1, ids.shape[1]):
            repeated[:, k] = (ids[:, :k] == ids[:, k : k + 1]).any(1)
        usable = (sims > -2) & ~repeated
        out = np.full((len(ids), keep), -1, np.int32)
        filled = np.zeros(len(ids), np.int64)
        rows = np.arange(len(ids))
        nearest = keep // 2
        for k in range(ids.shape[1]):
            ok = usable[:, k] & (filled < keep)
            if k and ok.any():
                held = out >= 0
                closer = self._pairwise(ids[:, k], out)
                crowded = ((closer > sims[:, k : k + 1]) & held).any(1)
                ok &= ~crowded | (filled < nearest)
            out[rows[ok], filled[ok]] = ids[ok, k]
            filled[ok] += 1
        return out

    def _pairwise(self, one: np.ndarray, many: np.ndarray) -> np.ndarray:
        return self._sims(self.x[one], np.maximum(many, 0))

    def _descend(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best ``beam`` nodes of the lowest layer there is, for each query, entered through the layers above."""
        start = np.repeat(self.order[None, : min(4, len(self.order))], len(q), 0)
        for k, links in enumerate(self.links):
            wide = beam if k == len(self.links) - 1 else 8
            start, sims = self._beam(links, q, start, wide)
        return start, sims

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of each query, -1 where fewer were reached; similarities fall along a row."""
        step = max(1, min(512, _CELLS // (4 * max(1, beam))))
        parts = [self._descend(np.ascontiguousarray(q[k : k + step], np.float32), beam) for k in range(0, len(q), step)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _beam(self, links: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int, steps: int = 4) -> tuple[np.ndarray, np.ndarray]:
        n, rows = len(q), np.arange(len(q))[:, None]
        seen = np.zeros((n, len(self.x) + 1), bool)  # the last column is for -1
        seen[:, -1] = True
        ids = np.full((n, beam), -1, np.int32)
        sims = np.full((n, beam), -2, np.float32)
        start = start[:, :beam]
        ids[:, : start.shape[1]] = start
        sims[:, : start.shape[1]] = np.where(start >= 0, self._sims(q, start), -2)
        order = np.argsort(-sims, axis=1)
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        seen[rows, start] = True
        opened = ids < 0
        live = np.arange(n)
        while len(live):
            # the best nodes of each beam not opened yet
            closed = np.where(opened[live], -3, sims[live])
            pick = np.argpartition(-closed, min(steps, beam) - 1, axis=1)[:, : min(steps, beam)]
            fresh = np.take_along_axis(closed, pick, 1) > -2
            more = fresh.any(1)
            live, pick, fresh = live[more], pick[more], fresh[more]
            if not len(live):
                break
            node = np.where(fresh, np.take_along_axis(ids[live], pick, 1), -1)
            opened[live[:, None], pick] = True
            near = np.where(node[..., None] >= 0, links[node], -1).reshape(len(live), -1)
            near = np.where(seen[live[:, None], near], -1, near)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            seen[live[:, None], near] = True
            width = int((near >= 0).sum(1).max(initial=0))
            if not width:
                continue
            near = -np.sort(-near, axis=1)[:, :width]
            values = np.where(near >= 0, self._sims(q[live], near), -2)
            all_ids, all_sims = np.concatenate((ids[live], near), 1), np.concatenate((sims[live], values), 1)
            all_open = np.concatenate((opened[live], near < 0), 1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[live], sims[live] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
            opened[live] = np.take_along_axis(all_open, best, 1)
        return ids, sims
