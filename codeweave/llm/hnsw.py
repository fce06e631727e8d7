"""A hierarchical navigable small-world graph over one shard of unit vectors.

Built and searched in numpy for many queries at once: a beam per query, of which
the best places not yet expanded are expanded together.  Neighbours are chosen
by the diversity rule (a candidate closer to a chosen neighbour than to the node
is left for last), so that dense groups stay connected to the rest."""

from __future__ import annotations

import io

import numpy as np

M, M0, BUILD_BEAM, SPREAD = 12, 24, 32, 4


def choose(node: np.ndarray, cand: np.ndarray, vectors: np.ndarray, m: int) -> np.ndarray:
    """``m`` diverse neighbours per row: ``node (b, d)`` vectors, ``cand (b, c)``
    ids, -1 where none; the result is padded with -1."""
    c = cand.shape[1]
    v = vectors[cand]
    sim = np.einsum("bd,bcd->bc", node, v)
    sim[cand < 0] = -4
    order = np.argsort(-sim, axis=1, kind="stable")
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    v = np.take_along_axis(v, order[:, :, None], 1)
    between = np.einsum("bcd,bed->bce", v, v)
    taken = np.zeros(cand.shape, dtype=bool)
    nearest = np.full(cand.shape, -4.0, dtype=np.float32)
    for j in range(c):
        good = (cand[:, j] >= 0) & (nearest[:, j] < sim[:, j]) & (taken.sum(axis=1) < m)
        taken[:, j] = good
        nearest = np.where(good[:, None], np.maximum(nearest, between[:, j]), nearest)
    rank = np.where(taken, 0, np.where(cand >= 0, 1, 2)) * c + np.arange(c)
    first = np.argsort(rank, axis=1, kind="stable")[:, :m]
    out = np.take_along_axis(cand, first, 1)
    if out.shape[1] < m:
        out = np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)
    return out


class Graph:
    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # top first: (node ids, neighbours as positions)

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 0) -> Graph:
        """Higher layers hold each node with probability 1/M of the one below;
        nodes of a layer are inserted in batches, each linked to what a beam
        finds in the part built so far and to its own batch."""
        g, n = cls(vectors.astype(np.float32)), len(vectors)
        level = (-np.log(np.random.default_rng(seed).random(n)) / np.log(M)).astype(int)
        for top in range(int(level.max()), -1, -1):
            nodes = np.flatnonzero(level >= top)
            g._grow(nodes, M0 if top == 0 else M)
        return g

    def _grow(self, nodes: np.ndarray, m: int) -> None:
        v, n = self.vectors[nodes], len(nodes)
        links = np.full((n, m), -1, dtype=np.int32)
        entry = self._descend(v)
        place = np.full(len(self.vectors), -1)
        place[nodes] = np.arange(n)
        start = place[entry] if self.layers else np.zeros(n, dtype=int)
        # nodes of the layer above come first, so that every descent ends in the built part
        above = np.zeros(n, dtype=bool)
        if self.layers:
            above[place[self.layers[-1][0]]] = True
        order, done = np.argsort(~above, kind="stable"), 0
        while done < n:
            size = n if n <= 64 else min(n - done, max(64, int(above.sum()) if not done else 0, min(256, done // 2)))
            part = order[done:done + size]
            own = v[part] @ v[part].T
            np.fill_diagonal(own, -4)
            near = part[np.argsort(-own, axis=1)[:, :min(m, size - 1)]] if size > 1 else np.zeros((size, 0), int)
            if done:
                ids, _ = beam(v, links, v[part], start[part], BUILD_BEAM, built=done)
                near = np.concatenate([ids, near], axis=1)
            pick = choose(v[part], near, v, m // 2) if near.shape[1] else np.full((size, m // 2), -1)
            links[part, :m // 2] = pick
            self._back(v, links, part, pick)
            done += size
        self.layers.append((nodes, links))

    @staticmethod
    def _back(v, links, part, pick) -> None:
        """Links back to the new nodes; full lists are chosen anew."""
        src, dst = np.repeat(part, pick.shape[1]), pick.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        if not len(dst):
            return
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        at, first, count = np.unique(dst, return_index=True, return_counts=True)
        m = links.shape[1]
        width = m + min(int(count.max()), 2 * m)
        cand = np.full((len(at), width), -1, dtype=np.int64)
        cand[:, :m] = links[at]
        # of very many new links to one node those with the closest nodes count
        close = np.einsum("ed,ed->e", v[src], v[dst])
        order = np.lexsort((-close, dst))
        slot = np.arange(len(dst)) - np.repeat(first, count)
        keep = slot < width - m
        row = np.repeat(np.arange(len(at)), count)
        cand[row[keep], m + slot[keep]] = src[order][keep]
        cand.sort(axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        links[at] = choose(v[at], cand, v, m)

    def _descend(self, queries: np.ndarray) -> np.ndarray:
        """Entry node per query for the layer below those built so far."""
        entry = np.zeros(len(queries), dtype=int)
        for k, (nodes, links) in enumerate(self.layers):
            place = np.full(len(self.vectors), 0)
            place[nodes] = np.arange(len(nodes))
            start = place[entry] if k else np.zeros(len(queries), dtype=int)
            out = []
            for a in range(0, len(queries), 512):
                ids, _ = beam(self.vectors[nodes], links, queries[a:a + 512], start[a:a + 512], 4)
                out.append(ids[:, 0])
            entry = nodes[np.concatenate(out)]
        return entry

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` best places found per query and their similarities,
        best first."""
        upper = Graph(self.vectors)
        upper.layers = self.layers[:-1]
        return beam(self.vectors, self.layers[-1][1], queries, upper._descend(queries), width)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f"n{i}": x[0] for i, x in enumerate(self.layers)},
                 **{f"l{i}": x[1] for i, x in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def load(cls, vectors: np.ndarray, blob: bytes) -> Graph:
        g, z = cls(vectors.astype(np.float32)), np.load(io.BytesIO(blob))
        g.layers = [(z[f"n{i}"], z[f"l{i}"]) for i in range(len(z.files) // 2)]
        return g


def beam(vectors, links, queries, start, width, built=None):
    """Beam search of many queries over one layer; ids are positions in it."""
    b, n = len(queries), len(vectors)
    width = min(width, built or n)
    rows = np.arange(b)[:, None]
    seen = np.zeros((b, n + 1), dtype=bool)
    seen[:, n] = True
    ids = np.full((b, width), -1, dtype=np.int64)
    sim = np.full((b, width), -4.0, dtype=np.float32)
    spent = np.ones((b, width), dtype=bool)
    ids[:, 0], sim[:, 0], spent[:, 0] = start, np.einsum("bd,bd->b", queries, vectors[start]), False
    seen[rows[:, 0], start] = True
    active = np.arange(b)
    while len(active):
        open_sim = np.where(spent[active], -9.0, sim[active])
        pick = np.argsort(-open_sim, axis=1)[:, :SPREAD]
        fine = np.take_along_axis(open_sim, pick, 1) > -4
        go = fine.any(axis=1)
        active, pick, fine = active[go], pick[go], fine[go]
        if not len(active):
            break
        r = active[:, None]
        spent[r, pick] = True
        node = np.where(fine, ids[r, pick], 0)
        near = np.where(fine[:, :, None], links[node], -1).reshape(len(active), -1).astype(np.int64)
        near[near < 0] = n
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[r, near]] = n
        seen[r, near] = True
        got = np.einsum("bd,bkd->bk", queries[active], vectors[np.minimum(near, n - 1)])
        got[near == n] = -4
        all_sim = np.concatenate([sim[active], got], axis=1)
        all_ids = np.concatenate([ids[active], np.where(near == n, -1, near)], axis=1)
        all_spent = np.concatenate([spent[active], near == n], axis=1)
        best = np.argsort(-all_sim, axis=1, kind="stable")[:, :width]
        sim[active] = np.take_along_axis(all_sim, best, 1)
        ids[active] = np.take_along_axis(all_ids, best, 1)
        spent[active] = np.take_along_axis(all_spent, best, 1)
    return ids, sim
