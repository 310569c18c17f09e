"""A hierarchical navigable small-world graph over unit vectors, in numpy.

Nodes stand in an order of falling level, so the nodes of a layer are a prefix
of it. A layer starts from the edges of the layer above and takes in its other
nodes in batches that grow with it. All searches of a batch step together: each
query opens the best few unopened nodes of its beam, and the unseen neighbours
of all queries are scored at once.
"""

from __future__ import annotations

import numpy as np

#: Edges a node chooses when it is inserted; layer 0 keeps twice as many, the others as many.
EDGES = 16
#: Beam of insertions.
BUILD_BEAM = 48
#: Nodes that a query opens in one step.
OPEN = 4
#: Cells of the table of seen nodes (queries x nodes) of one batch of searches.
SEEN_CELLS = 1 << 24
#: Vector entries gathered at once.
GATHERED = 1 << 22


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest entries of each row, in any order."""
    if sims.shape[1] <= k:
        return np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    return np.argpartition(sims, sims.shape[1] - k, axis=1)[:, -k:]


def _dots(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """a[i] . b[j] for each place of the flat index arrays."""
    out = np.empty(len(i), dtype=np.float32)
    step = max(1, GATHERED // a.shape[1])
    for at in range(0, len(i), step):
        part = slice(at, at + step)
        out[part] = np.einsum("ij,ij->i", a[i[part]], b[j[part]])
    return out


def beam_search(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and similarities (rows: queries) that a beam of the given width ends with, best first; -1 where none.

    ``edges`` has one row of neighbours per node (-1: none); ``entry`` the start nodes of each query.
    """
    q, n = len(queries), len(edges)
    rows = np.arange(q)[:, None]
    seen = np.zeros((q, n + 1), dtype=bool)
    seen[:, n] = True  # stands for "no node"
    ids = np.full((q, beam), n, dtype=np.int64)
    sims = np.full((q, beam), -np.inf, dtype=np.float32)
    opened = np.ones((q, beam), dtype=bool)

    def merge(at: np.ndarray, new: np.ndarray) -> None:
        """Score the unseen nodes ``new`` of the queries ``at`` and keep the best of each beam."""
        new = np.sort(new, axis=1)
        fresh = ~seen[at[:, None], new]
        fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
        r, c = np.nonzero(fresh)
        found = np.full(new.shape, -np.inf, dtype=np.float32)
        nodes = new[r, c]
        found[r, c] = _dots(x, nodes, queries, at[r])
        seen[at[r], nodes] = True
        all_sims = np.concatenate([sims[at], found], axis=1)
        keep = _top(all_sims, beam)
        line = np.arange(len(at))[:, None]
        sims[at] = all_sims[line, keep]
        ids[at] = np.concatenate([ids[at], new], axis=1)[line, keep]
        opened[at] = np.concatenate([opened[at], ~fresh], axis=1)[line, keep]

    merge(np.arange(q), np.where(entry < 0, n, entry))
    while True:
        waiting = np.where(opened, -np.inf, sims)
        active = np.flatnonzero(waiting.max(axis=1) > -np.inf)
        if not len(active):
            break
        best = _top(waiting[active], min(OPEN, beam))
        line = np.arange(len(active))[:, None]
        live = waiting[active][line, best] > -np.inf
        nodes = np.where(live, ids[active][line, best], 0)
        opened[active[:, None], best] |= live
        near = np.where(live[:, :, None], edges[nodes], -1).reshape(len(active), -1)
        merge(active, np.where(near < 0, n, near))
    order = np.argsort(-sims, axis=1, kind="stable")
    ids = ids[rows, order]
    return np.where(ids == n, -1, ids), sims[rows, order]


def _choose(x: np.ndarray, base: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first), those closer to the node than to any already chosen one; then the best rest.

    ``base`` are the nodes, ``ids`` their candidates (-1: none). At most ``most`` per row, -1 padded.
    """
    b, c = ids.shape
    step = max(1, GATHERED // (c * x.shape[1]))
    if b > step:
        parts = [slice(at, at + step) for at in range(0, b, step)]
        return np.concatenate([_choose(x, base[p], ids[p], sims[p], most) for p in parts])
    cand = x[np.maximum(ids, 0)]
    among = np.matmul(cand, cand.transpose(0, 2, 1))
    valid = (ids >= 0) & (ids != base[:, None])
    chosen = np.zeros((b, c), dtype=bool)
    count = np.zeros(b, dtype=np.int64)
    nearest = np.full((b, c), -np.inf, dtype=np.float32)  # similarity to the closest chosen one
    for k in range(c):
        take = valid[:, k] & (count < most) & (sims[:, k] > nearest[:, k])
        chosen[:, k] = take
        count += take
        nearest = np.where(take[:, None], np.maximum(nearest, among[:, k]), nearest)
    rank = np.where(chosen, 0, np.where(valid, 1, 2)) * c + np.arange(c)
    order = np.argsort(rank, axis=1)[:, :most]
    line = np.arange(b)[:, None]
    return np.where(valid[line, order], ids[line, order], -1)


def _link_back(x: np.ndarray, edges: np.ndarray, nodes: np.ndarray, chosen: np.ndarray) -> None:
    """Add the reverse of the new edges; a node whose list overflows chooses anew."""
    room = edges.shape[1]
    r, c = np.nonzero(chosen >= 0)
    target, source = chosen[r, c], nodes[r]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
    count = np.diff(np.r_[first, len(target)])
    place = np.arange(len(target)) - np.repeat(first, count)
    for at in range(0, int(count.max(initial=0)), room):  # many new edges of one node come in turns
        part = (place >= at) & (place < at + room)
        if not part.any():
            break
        t, s, p = target[part], source[part], place[part] - at
        owners, where = np.unique(t, return_inverse=True)
        pool = np.full((len(owners), 2 * room), -1, dtype=np.int64)
        pool[:, :room] = edges[owners]
        pool[where, room + p] = s
        pool = np.sort(pool, axis=1)
        pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
        sims = np.full(pool.shape, -np.inf, dtype=np.float32)
        i, j = np.nonzero(pool >= 0)
        sims[i, j] = _dots(x, pool[i, j], x, owners[i])
        line = np.arange(len(owners))[:, None]
        by = np.argsort(-sims, axis=1, kind="stable")
        pool, sims = pool[line, by], sims[line, by]
        full = (pool >= 0).sum(axis=1) > room
        edges[owners[~full]] = pool[~full][:, :room]
        if full.any():
            edges[owners[full]] = _choose(x, owners[full], pool[full], sims[full], room)


class Graph:
    """Layers of neighbours over unit vectors ``x`` (float32); nodes are rows of ``x`` in its own order."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray]):
        self.x, self.layers = x, layers  # layer k covers the first len(layers[k]) rows

    @classmethod
    def build(cls, x: np.ndarray) -> "Graph":
        """``x`` in random order: the first rows become the upper layers."""
        sizes = [len(x)]
        while sizes[-1] > 2 * EDGES:
            sizes.append(max(sizes[-1] // EDGES, 1))
        graph = cls(x, [])
        layers: list[np.ndarray] = []
        for level in range(len(sizes) - 1, -1, -1):
            room = 2 * EDGES if level == 0 else EDGES
            edges = np.full((sizes[level], room), -1, dtype=np.int64)
            done = 0
            if layers:
                done = len(layers[0])
                edges[:done, :EDGES] = layers[0][:, :EDGES]
            graph.layers = layers
            while done < sizes[level]:
                step = min(max(done // 4, 16), max(SEEN_CELLS // len(x), 16), 512, sizes[level] - done)
                graph._insert(edges, np.arange(done, done + step), done)
                done += step
            layers = [edges, *layers]
        graph.layers = layers
        return graph

    def _insert(self, edges: np.ndarray, nodes: np.ndarray, done: int) -> None:
        x = self.x
        queries = x[nodes]
        among = queries @ queries.T
        np.fill_diagonal(among, -np.inf)
        own = _top(among, 2 * EDGES)
        line = np.arange(len(nodes))[:, None]
        ids, sims = nodes[own], among[line, own]
        ids = np.where(sims > -np.inf, ids, -1)
        if done:
            entry = self._entries(queries) if self.layers else np.zeros((len(nodes), 1), dtype=np.int64)
            got, got_sims = beam_search(x, edges[:done], queries, entry, BUILD_BEAM)
            ids, sims = np.concatenate([ids, got], axis=1), np.concatenate([sims, got_sims], axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
        chosen = _choose(x, nodes, ids[line, order], sims[line, order], EDGES)
        edges[nodes, : chosen.shape[1]] = chosen
        _link_back(x, edges, nodes, chosen)

    def _entries(self, queries: np.ndarray) -> np.ndarray:
        """Start nodes for the layer below the finished ones."""
        entry = np.zeros((len(queries), 1), dtype=np.int64)
        for edges in reversed(self.layers):
            entry, _ = beam_search(self.x, edges, queries, entry, EDGES)
        return entry

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nodes found for each query, best first (-1: none), and their similarities."""
        entry = np.zeros((len(queries), 1), dtype=np.int64)
        for edges in reversed(self.layers[1:]):
            entry, _ = beam_search(self.x, edges, queries, entry, EDGES)
        return beam_search(self.x, self.layers[0], queries, entry, max(beam, 1))

    def pack(self) -> bytes:
        """The layers as bytes: their number, then rows, width and 32-bit neighbours of each."""
        out = [np.array([len(self.layers)], dtype=np.int32).tobytes()]
        for edges in self.layers:
            out += [np.array(edges.shape, dtype=np.int32).tobytes(), edges.astype(np.int32).tobytes()]
        return b"".join(out)

    @classmethod
    def unpack(cls, x: np.ndarray, data: bytes) -> "Graph":
        count = int(np.frombuffer(data, np.int32, 1)[0])
        at, layers = 4, []
        for _ in range(count):
            rows, width = np.frombuffer(data, np.int32, 2, at).tolist()
            edges = np.frombuffer(data, np.int32, rows * width, at + 8).reshape(rows, width)
            layers.append(edges.astype(np.int64))
            at += 8 + 4 * rows * width
        return cls(x, layers)
