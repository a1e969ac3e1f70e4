"""Graph algorithms over edges that one task holds: (src, dst), from what depends to what it depends on.

All take numbered nodes (n of them) and edges as two arrays, and need memory in proportion to the edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def numbered(src: pa.ChunkedArray, dst: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(nodes, edges' ends as places among the nodes)."""
    both = pa.chunked_array([*src.chunks, *dst.chunks], src.type).combine_chunks().dictionary_encode()
    places = both.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return both.dictionary, places[: len(src)], places[len(src) :]


class Ways:
    """From each node on along edges: `of(nodes)` are the far ends of all edges that begin there."""

    def __init__(self, n: int, near: np.ndarray, far: np.ndarray) -> None:
        order = np.argsort(near, kind="stable")
        self.far = far[order]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(near, minlength=n))])

    def of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places among `nodes`, far ends)."""
        first, size = self.begin[nodes], self.begin[nodes + 1] - self.begin[nodes]
        which = np.repeat(np.arange(len(nodes)), size)
        within = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        return which, self.far[first[which] + within]


def peeled(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges on the longest path down from each node, which nodes have it): those that reach no cycle."""
    depth, waits, up = np.zeros(n, np.int64), np.bincount(src, minlength=n), Ways(n, dst, src)
    done = waits == 0
    now = np.flatnonzero(done)
    while len(now):
        which, above = up.of(now)
        np.maximum.at(depth, above, depth[now[which]] + 1)
        np.subtract.at(waits, above, 1)
        now = np.unique(above)
        now = now[waits[now] == 0]
        done[now] = True
    return depth, done


def strong(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """For each node the smallest node that it shares cycles with, itself if there is none."""
    label = np.arange(n)
    inside = ~peeled(n, src, dst)[1] & ~peeled(n, dst, src)[1]  # neither above cycles alone nor below
    own = inside[src] & inside[dst]
    ways = Ways(n, src[own], dst[own])
    # Tarjan's algorithm with a stack of its own
    index, low, on = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    count, held = 0, []
    for root in np.flatnonzero(inside):
        if index[root] >= 0:
            continue
        work = [(int(root), int(ways.begin[root]))]
        while work:
            node, at = work.pop()
            if index[node] < 0:
                index[node] = low[node] = count
                count += 1
                held.append(node)
                on[node] = True
            while at < ways.begin[node + 1]:
                to = int(ways.far[at])
                if index[to] < 0:
                    work += [(node, at), (to, int(ways.begin[to]))]
                    break
                if on[to]:
                    low[node] = min(low[node], low[to])
                at += 1
            else:
                if low[node] == index[node]:
                    group = []
                    while not group or group[-1] != node:
                        group.append(held.pop())
                    on[group] = False
                    label[group] = min(group)
    return label


def cyclic(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Which nodes lie on a cycle, a loop included."""
    label = strong(n, src, dst)
    out = np.bincount(label, minlength=n)[label] > 1
    out[src[src == dst]] = True
    return out


def depths(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Edges on the longest path down from each node; those between nodes of one cycle don't count."""
    depth, done = peeled(n, src, dst)
    if not done.all():
        label = strong(n, src, dst)
        own = label[src] != label[dst]
        depth = peeled(n, label[src[own]], label[dst[own]])[0][label]
    return depth


def reached(n: int, src: np.ndarray, dst: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which nodes depend, by a path of one edge or more, on one of `start`."""
    up, out, now = Ways(n, dst, src), np.zeros(n, bool), start
    while len(now):
        above = np.unique(up.of(now)[1])
        now = above[~out[above]]
        out[now] = True
    return out


def pairs(n: int, src: np.ndarray, dst: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (from, to) joined by a path, some hundred nodes' at a time."""
    down = Ways(n, src, dst)
    for begin in range(0, n, 512):
        many = min(512, n - begin)
        now = np.arange(many) * n + np.arange(begin, begin + many)  # (node of the block, place reached) as one number
        found = np.empty(0, np.int64)
        while len(now):
            which, to = down.of(now % n)
            new = np.unique(now[which] // n * n + to)
            now = new[~np.isin(new, found, assume_unique=True)]
            found = np.concatenate([found, now])
        if len(found):
            yield begin + found // n, found % n


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each node the smallest node that edges, either way, join it to."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while (label[label] != label).any():
            label = label[label]


def chain(n: int, child: np.ndarray, parent: np.ndarray, start: int) -> list[int]:
    """From `start` on from parent to parent; ends where one comes again."""
    up = dict(zip(child.tolist(), parent.tolist()))
    out, seen = [start], {start}
    while (start := up.get(start, start)) not in seen:
        seen.add(start)
        out.append(start)
    return out
