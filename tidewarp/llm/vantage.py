"""Vantage-point trees over bit fingerprints. Points are rows of 64-bit words."""
import numpy as np

LEAF = 48  # points that are compared directly
BLOCK = 4_000_000  # comparisons at once


def hamming(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(points ^ one).sum(axis=-1, dtype=np.int32)


class Links:
    """Classes of points that are linked directly or through others."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        p = self.parent
        while len(a):
            a, b = p[a], p[b]
            differ = a != b
            a, b = a[differ], b[differ]
            if not len(a):
                return
            low = np.minimum(a, b)
            np.minimum.at(p, a, low)
            np.minimum.at(p, b, low)
            while not np.array_equal(q := p[p], p):
                p[:] = q


def _compare(points: np.ndarray, members: np.ndarray, queries: np.ndarray, radius: int, links: Links) -> None:
    step = max(1, BLOCK // max(1, len(members) * points.shape[1]))
    for i in range(0, len(queries), step):
        q = queries[i : i + step]
        near = hamming(points[q][:, None, :], points[members][None, :, :]) <= radius
        x, y = np.nonzero(near)
        links.add(q[x], members[y])


def link_all(points: np.ndarray, radius: int, links: Links | None = None) -> np.ndarray:
    """The class (smallest index in it) of each point, where points within radius are linked. Exact: pairs
    are skipped only if the triangle inequality keeps them beyond radius, or if they are in one class
    already.

    What lies within radius of a vantage point is one class with it and is not compared inside. So a group
    of near copies costs a few passes over its points and not one over its pairs."""
    links = links or Links(len(points))
    stack = [(np.arange(len(points)), np.arange(len(points)))]

    def halves(members: np.ndarray, d: np.ndarray, queries: np.ndarray, q: np.ndarray) -> None:
        """Two subtrees by the distances d and q to a vantage point, with the queries that reach each."""
        if not len(members):
            return
        cut = int(np.median(d))
        if not (d > cut).any():
            cut = int(d.max()) - 1
        if not (d <= cut).any():  # all at one distance
            _compare(points, members, queries[np.abs(q - d[0]) <= radius], radius, links)
            return
        for part, ask in ((members[d <= cut], queries[q <= cut + radius]), (members[d > cut], queries[q > cut - radius])):
            if len(ask):
                stack.append((part, ask))

    while stack:
        members, queries = stack.pop()
        top = links.parent[members]
        if (top == top[0]).all():
            queries = queries[links.parent[queries] != top[0]]
        if len(members) <= LEAF or len(members) * len(queries) <= LEAF * LEAF:
            _compare(points, members, queries, radius, links)
            continue
        at = members[len(members) // 2]
        d, q = hamming(points[members], points[at]), hamming(points[queries], points[at])
        near = d <= radius
        for linked in (members[near], queries[q <= radius]):
            links.add(linked, np.full(len(linked), at))
        between = (q > radius) & (q <= 2 * radius)  # of what is near, only they can reach it
        halves(members[near], d[near], queries[between], q[between])
        halves(members[~near], d[~near], queries, q)  # taken from the stack first
    return links.parent


def fit_shards(sample: np.ndarray, levels: int, radius: int = 0) -> list[tuple[np.ndarray, int] | None]:
    """The top of a tree as a heap of (vantage point, cut), levels deep; None where a sample's points
    are too few or too alike to split. A cut is that which leaves the smaller of the larger sides, with the points
    that shards_of also sends inside."""
    heap: list[tuple[np.ndarray, int] | None] = [None] * ((1 << levels) - 1)
    parts = {0: sample}
    for node in range(len(heap)):
        part = parts.pop(node, sample[:0])
        if len(part) < 2:
            continue
        # of a few points the one that splits best
        best = (len(part), None, 0)
        for p in part[:: max(1, len(part) // 8)][:8]:
            upto = np.cumsum(np.bincount(hamming(part, p), minlength=64 * part.shape[1] + 1))
            inner = upto[np.minimum(np.arange(len(upto)) + radius, len(upto) - 1)]
            larger = np.where(upto < len(part), np.maximum(inner, len(part) - upto), len(part))
            cut = int(larger.argmin())
            best = min(best, (int(larger[cut]), p, cut), key=lambda t: t[0])
        _, point, cut = best
        if point is None:
            parts[2 * node + 1] = part
        else:
            d = hamming(part, point)
            heap[node] = (point, cut)
            parts[2 * node + 1], parts[2 * node + 2] = part[d <= cut + radius], part[d > cut]
    return heap


def shards_of(points: np.ndarray, heap: list, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of points, shard) for every shard that a point is in. At a cut the points inside go to one side,
    those outside to the other, and those outside within radius of the cut inside as well: only they can be within radius
    of a point inside. So two points within radius share a shard, and no point goes to both sides for its own sake."""
    rows, nodes = np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(rows):
        leaf = nodes >= len(heap)
        done.append((rows[leaf], nodes[leaf]))
        rows, nodes = rows[~leaf], nodes[~leaf]
        next_rows, next_nodes = [rows[:0]], [nodes[:0]]
        for node in np.unique(nodes):
            r = rows[nodes == node]
            if heap[node] is None:
                inner, outer = r, r[:0]
            else:
                point, cut = heap[node]
                d = hamming(points[r], point)
                inner, outer = r[d <= cut + radius], r[d > cut]
            next_rows += [inner, outer]
            next_nodes += [np.full(len(inner), 2 * node + 1), np.full(len(outer), 2 * node + 2)]
        rows, nodes = np.concatenate(next_rows), np.concatenate(next_nodes)
    return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
