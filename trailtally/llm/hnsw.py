"""A hierarchical navigable small-world graph over the unit vectors of one shard, in numpy."""

from __future__ import annotations

import heapq
import math

import numpy as np

LINKS = 12
BUILD_BEAM = 40


class Graph:
    """Layers of neighbour lists; an upper layer holds about one in ``LINKS`` of the one below.

    Nodes are row numbers of ``vectors``. Lists overfill by half before they are thinned to
    neighbours that are nearer to the node than to each other, which keeps groups of near
    copies connected with the rest.
    """

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray] | None = None, nodes=None, seed: int = 11):
        self.vectors = vectors
        self.seen = np.zeros(len(vectors), np.int64)
        self.turn = 0
        if layers is not None:
            self.layers, self.nodes = layers, nodes
            self.places = [{int(n): k for k, n in enumerate(names)} for names in nodes]
            return
        rng = np.random.default_rng(seed)
        scale = 1 / math.log(LINKS)
        tops = np.minimum(6, (-np.log(1 - rng.random(len(vectors))) * scale).astype(int))
        self.nodes = [np.flatnonzero(tops >= layer) for layer in range(int(tops.max(initial=0)) + 1)]
        self.places = [{int(n): k for k, n in enumerate(names)} for names in self.nodes]
        self.layers = [np.full((len(names), self._room(k)), -1, np.int32) for k, names in enumerate(self.nodes)]
        # The first node is the highest, so every search can start there.
        order = np.argsort(-tops, kind="stable")
        for position, node in enumerate(order):
            if position:
                self._insert(int(node), int(tops[node]))

    @staticmethod
    def _room(layer: int) -> int:
        return 3 * LINKS if layer == 0 else 3 * LINKS // 2

    def entry(self) -> int:
        return int(self.nodes[-1][0])

    def _near(self, layer: int, node: int) -> np.ndarray:
        found = self.layers[layer][node if layer == 0 else self.places[layer][node]]
        return found[found >= 0]

    def search(self, query: np.ndarray, start: list[int], beam: int, layer: int = 0) -> list[tuple[float, int]]:
        """The best ``beam`` nodes that the beam meets, as (similarity, node), best first."""
        self.turn += 1
        self.seen[start] = self.turn
        sims = (self.vectors[start] @ query).tolist()
        found = list(zip(sims, start))
        heapq.heapify(found)
        ahead = [(-sim, node) for sim, node in found]
        heapq.heapify(ahead)
        while ahead:
            sim, node = heapq.heappop(ahead)
            if len(found) >= beam and -sim < found[0][0]:
                break
            near = self._near(layer, node)
            near = near[self.seen[near] != self.turn]
            if not len(near):
                continue
            self.seen[near] = self.turn
            for sim, other in zip((self.vectors[near] @ query).tolist(), near.tolist()):
                if len(found) < beam:
                    heapq.heappush(found, (sim, other))
                elif sim > found[0][0]:
                    heapq.heapreplace(found, (sim, other))
                else:
                    continue
                heapq.heappush(ahead, (-sim, other))
        return sorted(found, reverse=True)

    def descend(self, query: np.ndarray, lowest: int) -> list[int]:
        """Best node of the layer above ``lowest``, from the top."""
        start = [self.entry()]
        for layer in range(len(self.layers) - 1, lowest, -1):
            start = [self.search(query, start, 1, layer)[0][1]]
        return start

    def _chosen(self, candidates: list[tuple[float, int]], most: int) -> list[int]:
        """Candidates, best first, that are nearer to the node than to those already chosen."""
        names = [node for _, node in candidates]
        between = self.vectors[names] @ self.vectors[names].T
        kept: list[int] = []
        for k, (sim, _) in enumerate(candidates):
            if all(between[k, j] <= sim for j in kept):
                kept.append(k)
                if len(kept) == most:
                    return [names[j] for j in kept]
        for k in range(len(candidates)):
            if len(kept) == most:
                break
            if k not in kept:
                kept.append(k)
        return [names[j] for j in kept]

    def _join(self, layer: int, node: int, other: int) -> None:
        row = self.layers[layer][node if layer == 0 else self.places[layer][node]]
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = other
            return
        names = np.append(row, other)
        sims = self.vectors[names] @ self.vectors[node]
        best = sorted(zip(sims.tolist(), names.tolist()), reverse=True)
        kept = self._chosen(best, len(row) * 2 // 3)
        row[:] = -1
        row[: len(kept)] = kept

    def _insert(self, node: int, top: int) -> None:
        query = self.vectors[node]
        start = self.descend(query, min(top, len(self.layers) - 1))
        for layer in range(min(top, len(self.layers) - 1), -1, -1):
            found = self.search(query, start, BUILD_BEAM, layer)
            found = [(sim, other) for sim, other in found if other != node]
            start = [other for _, other in found] or start
            for other in self._chosen(found, LINKS) if found else []:
                self._join(layer, node, other)
                self._join(layer, other, node)
