"""NumPy kernels for dynamic time warping. A batch kernel holds one series per lane (last axis)."""
from collections.abc import Callable

import numpy as np

Point = Callable[[np.ndarray, np.ndarray], np.ndarray]


def square(x, y):
    return (x - y) * (x - y)


def absval(x, y):
    return np.abs(x - y)


def poisson(n1, n2) -> Point:
    """Distance of counts from two series with sums n1 and n2 (of each lane): 0 where neither has any."""
    n1, n2 = np.asarray(n1, dtype=np.float64), np.asarray(n2, dtype=np.float64)

    def distance(x, y):
        both = np.asarray(x + y, dtype=np.float64)
        none = (np.asarray(x) <= 0) & (np.asarray(y) <= 0)
        mu = both / np.where(n1 + n2 == 0, 1.0, n1 + n2)
        return np.where(none, 0.0, ((x - mu * n1) ** 2 + (y - mu * n2) ** 2) / np.where(none, 1.0, both))

    return distance


POINT_DISTANCES: dict[str, Point] = {"square": square, "absval": absval}
CELLS = 4_000_000  # of the tables of pairs that are aligned together


def point_distance(point: str | Point) -> Point:
    """A distance of two values, by name or as given."""
    return point if callable(point) else POINT_DISTANCES[point]


def banded(query: np.ndarray, lanes: np.ndarray, r: int, point: Point = square) -> np.ndarray:
    """Sum of point distances on the cheapest path with |i - j| <= r from query (length, or length x n with
    one for each) to each column of lanes (length x n). One step per anti-diagonal: all its cells in the band, for all lanes, in
    buffers that are allocated once."""
    length, n = lanes.shape
    d0, d1, d2 = (np.full((length + 2, n), np.inf, dtype=lanes.dtype) for _ in range(3))
    cost = np.empty((min(r, length) + 1, n), dtype=lanes.dtype)
    d1[1] = point(query[0], lanes[0])
    column = query[:, None] if query.ndim == 1 else query
    for k in range(1, 2 * length - 1):
        low, high = max(0, k - length + 1, (k - r + 1) // 2), min(k, length - 1, (k + r) // 2)
        if low > high:  # r = 0: no cell on odd anti-diagonals
            d0[k // 2 : k // 2 + 3] = np.inf
            d0, d1, d2 = d2, d0, d1
            continue
        own, others = cost[: high - low + 1], lanes[k - low : k - high - 1 if k > high else None : -1]
        if point is square:
            np.subtract(column[low : high + 1], others, out=own)
            np.multiply(own, own, out=own)
        else:
            own[:] = point(column[low : high + 1], others)
        best = np.minimum(d1[low : high + 1], d1[low + 1 : high + 2], out=d0[low + 1 : high + 2])
        np.minimum(best, d2[low : high + 1], out=best)
        np.add(best, own, out=best)
        d0[low] = np.inf
        d0[high + 2] = np.inf
        d0, d1, d2 = d2, d0, d1
    return d1[length].copy()


def batches(query: np.ndarray, rows: np.ndarray, r: int, point: Point = square, lanes: int = 1024) -> np.ndarray:
    """banded() for the rows of a matrix, so many at a time that the band stays in the cache. At radius 0
    it is the sum of the distances of values at the same places."""
    if r == 0:
        if point is square:
            gap = rows - query.astype(rows.dtype)
            return np.einsum("ij,ij->i", gap, gap)
        return point(query.astype(rows.dtype), rows).sum(axis=1)
    out = np.empty(len(rows), dtype=rows.dtype)
    for at in range(0, len(rows), lanes):
        out[at : at + lanes] = banded(query.astype(rows.dtype), np.ascontiguousarray(rows[at : at + lanes].T), r, point)
    return out


def reached(query: np.ndarray, lanes: np.ndarray, r: int, most: float) -> tuple[np.ndarray, np.ndarray]:
    """The places of the columns of lanes (length x n) whose banded squared distance is at most so much, and these
    distances, in the type of lanes. Every path has a cell on one of two anti-diagonals that follow each other,
    so a lane whose cells there all exceed most is dropped on the way."""
    (length, n), kind = lanes.shape, lanes.dtype
    width, last = min(r, length) + 3, 2 * length - 2
    stops = {int(share * last) for share in (0.34, 0.5, 0.66)}
    # The cells of an anti-diagonal stand in rows 1 to width - 2, from its lowest place on, between infinite ones.
    d0, d1, d2 = (np.full((width, n), np.inf, dtype=kind) for _ in range(3))
    cost = np.empty((width - 2, n), dtype=kind)
    d1[1] = square(query[0], lanes[0])
    column, left, low1, high1, low2 = query[:, None], np.arange(n), 0, 0, 0
    for k in range(1, last + 1):
        low, high = max(0, k - length + 1, (k - r + 1) // 2), min(k, length - 1, (k + r) // 2)
        own = cost[: high - low + 1]
        np.subtract(column[low : high + 1], lanes[k - low : k - high - 1 if k > high else None : -1], out=own)
        np.multiply(own, own, out=own)
        best = np.minimum(d1[low - low1 : high - low1 + 1], d1[low - low1 + 1 : high - low1 + 2], out=d0[1 : high - low + 2])
        np.minimum(best, d2[low - low2 : high - low2 + 1], out=best)
        np.add(best, own, out=best)
        d0[high - low + 2] = np.inf
        if k in stops:
            front = np.minimum(best[0], d1[1])
            for cells in (*best[1:], *d1[2 : high1 - low1 + 2]):
                np.minimum(front, cells, out=front)
            keep = np.flatnonzero(front <= most)
            if len(keep) < 0.7 * n:
                left, n, first = left[keep], len(keep), k - high
                rest = np.empty((length, n), dtype=kind)
                rest[first:] = lanes[first:].take(keep, axis=1, mode="clip")  # places before are behind the band
                lanes, d0, d1 = rest, d0.take(keep, axis=1, mode="clip"), d1.take(keep, axis=1, mode="clip")
                d2, cost = np.full((width, n), np.inf, dtype=kind), np.empty((width - 2, n), dtype=kind)
                if not n:
                    break
        d0, d1, d2 = d2, d0, d1
        low1, high1, low2 = low, high, low1
    keep = np.flatnonzero(d1[1] <= most) if n else left
    return left[keep], d1[1][keep]


class Costs:
    """Cumulative costs of the alignments of many pairs, a pair per lane: x (n x lanes) with y (m x lanes).
    Only the cells of an anti-diagonal between the first and the last inside some lane's window are held.
    low, high: per element of x and lane the first and last place in y, from 0."""

    def __init__(self, x: np.ndarray, y: np.ndarray, point: Point, low: np.ndarray | None = None, high: np.ndarray | None = None):
        (n, lanes), m = x.shape, len(y)
        self.n, self.m, self.lanes = n, m, lanes
        first = np.zeros(n, dtype=int) if low is None else low.min(axis=1)
        last = np.full(n, m - 1) if high is None else high.max(axis=1)
        self.lo, self.hi = np.full(n + m - 1, n), np.full(n + m - 1, -1)
        for i in range(n):
            part = slice(i + first[i], i + last[i] + 1)
            self.lo[part] = np.minimum(self.lo[part], i)
            self.hi[part] = i
        width = np.maximum(self.hi - self.lo + 1, 0)
        self.base = np.cumsum(width) - width - self.lo
        self.cells = np.full((int(width.sum()), lanes), np.inf)
        for k in range(n + m - 1):
            a, z = int(self.lo[k]), int(self.hi[k])
            if a > z:
                continue
            own = point(x[a : z + 1], y[k - z : k - a + 1][::-1])
            if k:
                own = own + np.minimum(np.minimum(self.diagonal(k - 1, a, z), self.diagonal(k - 1, a - 1, z - 1)), self.diagonal(k - 2, a - 1, z - 1))
            if low is not None:
                j = k - np.arange(a, z + 1)[:, None]
                own = np.where((j >= low[a : z + 1]) & (j <= high[a : z + 1]), own, np.inf)
            self.cells[self.base[k] + a : self.base[k] + z + 1] = own

    def diagonal(self, k: int, a: int, z: int) -> np.ndarray:
        """Costs on an anti-diagonal for elements a to z of x, infinite where none are held."""
        out = np.full((z - a + 1, self.lanes), np.inf)
        if k >= 0 and (first := max(a, int(self.lo[k]))) <= (last := min(z, int(self.hi[k]))):
            out[first - a : last - a + 1] = self.cells[self.base[k] + first : self.base[k] + last + 1]
        return out

    def at(self, k: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Of each lane the cost on its anti-diagonal k for element i of x."""
        held = (k >= 0) & (i >= self.lo[k]) & (i <= self.hi[k])
        return np.where(held, self.cells[np.where(held, self.base[k] + i, 0), np.arange(self.lanes)], np.inf)

    def paths(self) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Of each lane the cost and the cheapest path, as places from 1 in x and in y. Of equal steps the
        diagonal is taken first, then the one that keeps the place in x, then that in y."""
        i, j = np.full(self.lanes, self.n - 1), np.full(self.lanes, self.m - 1)
        costs, steps = self.at(i + j, i), [(i, j)]
        while (live := i + j > 0).any():
            k = i + j
            both, stay, go = self.at(k - 2, i - 1), self.at(k - 1, i), self.at(k - 1, i - 1)
            diagonal = (both <= stay) & (both <= go)
            keep = ~diagonal & (stay <= go)
            i, j = i - (live & (i > 0) & ((j == 0) | ~keep)), j - (live & (j > 0) & ((i == 0) | diagonal | keep))
            steps.append((i, j))
        firsts, seconds = (np.stack([s[c] for s in steps]) for c in (0, 1))
        lengths = 1 + ((firsts + seconds) > 0).sum(axis=0)
        return [(float(c), firsts[: n, t][::-1] + 1, seconds[: n, t][::-1] + 1) for t, (c, n) in enumerate(zip(costs, lengths))]


def together(xs, ys, point: str | Point = "square", low=None, high=None, sums=None) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Cost and path of each pair. Pairs of the same lengths are aligned together, so many that a table of theirs
    has CELLS values at most (a single pair may have more). low, high: per pair and element of the first the
    first and last place in the second, from 1. sums: of each pair, for poisson."""
    xs, ys = ([np.asarray(v, dtype=float) for v in side] for side in (xs, ys))
    out: list = [None] * len(xs)
    sizes: dict[tuple[int, int], list[int]] = {}
    for t, (x, y) in enumerate(zip(xs, ys)):
        if not len(x) or not len(y):
            raise ValueError("an empty series has no alignment")
        sizes.setdefault((len(x), len(y)), []).append(t)
    for (n, m), members in sizes.items():
        if low is not None:
            for t in members:
                if len(low[t]) != n or len(high[t]) != n or low[t][0] != 1 or high[t][-1] != m:
                    raise ValueError("the window must have an entry per element of x and hold both corners")
        step = max(1, CELLS // (n * m))
        for part in (members[k : k + step] for k in range(0, len(members), step)):
            x, y = (np.stack([side[t] for t in part], axis=1) for side in (xs, ys))
            window = [None if w is None else np.stack([np.asarray(w[t]) for t in part], axis=1) - 1 for w in (low, high)]
            if point == "poisson":
                distance = poisson(*(x.sum(axis=0), y.sum(axis=0)) if sums is None else np.array([sums[t] for t in part]).T)
            else:
                distance = point_distance(point)
            for t, found in zip(part, Costs(x, y, distance, *window).paths()):
                out[t] = found
    return out


def dtw(x, y, point: str | Point = "square") -> tuple[float, np.ndarray, np.ndarray]:
    return together([x], [y], point)[0]


def windowed(x, y, low, high, point: str | Point = "square") -> tuple[float, np.ndarray, np.ndarray]:
    """low, high: per element of x the first and last element of y that it may meet, from 1."""
    return together([x], [y], point, [low], [high])[0]


def halved(x) -> np.ndarray:
    """Means of neighbours; an odd last element stays."""
    x = np.asarray(x, dtype=float)
    even = len(x) // 2 * 2
    return np.concatenate([x[:even].reshape(-1, 2).mean(axis=1), x[even:]])


def refined(cols: np.ndarray, rows: np.ndarray, n_cols: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A path through a halved grid as one through the full grid: each step is made twice."""
    step_c, step_r = np.diff(cols), np.diff(rows)
    c = 1 + np.concatenate([[0], np.cumsum(np.repeat(step_c, 2))])
    r = 1 + np.concatenate([[0], np.cumsum(np.repeat(step_r, 2))])
    c, r = np.append(c, n_cols), np.append(r, n_rows)
    if len(c) > 1 and c[-1] == c[-2] and r[-1] == r[-2]:
        c, r = c[:-1], r[:-1]
    return c, r


def window_around(cols, rows, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last row (from 1) per column within radius of a path; everything if radius reaches the
    last column or row."""
    cols, rows = np.asarray(cols), np.asarray(rows)
    n_cols, n_rows = int(cols[-1]), int(rows[-1])
    if radius >= n_cols - 1 or radius >= n_rows - 1:
        return np.ones(n_cols, dtype=int), np.full(n_cols, n_rows)
    first = np.full(n_cols, n_rows)
    last = np.ones(n_cols, dtype=int)
    np.minimum.at(first, cols - 1, rows)
    np.maximum.at(last, cols - 1, rows)
    at = np.arange(n_cols)
    low = np.where(at < radius, 1, first[np.maximum(at - radius, 0)] - radius)
    high = np.where(at >= n_cols - radius, n_rows, last[np.minimum(at + radius, n_cols - 1)] + radius)
    return np.maximum(low, 1), np.minimum(high, n_rows)


def fast_together(xs, ys, radius: int, point: str | Point = "square", sums=None) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Approximate alignments: those of the halved series, refined within radius."""
    if point == "poisson" and sums is None:
        sums = [(float(np.sum(x)), float(np.sum(y))) for x, y in zip(xs, ys)]
    long = [t for t, (x, y) in enumerate(zip(xs, ys)) if min(len(x), len(y)) > max(radius + 2, 10)]
    short = sorted(set(range(len(xs))) - set(long))
    pick = lambda values, at: None if values is None else [values[t] for t in at]
    out = dict(zip(short, together(pick(xs, short), pick(ys, short), point, sums=pick(sums, short))))
    if long:
        rough = fast_together([halved(xs[t]) for t in long], [halved(ys[t]) for t in long], radius, point, pick(sums, long))
        windows = [window_around(*refined(cols, rows, len(xs[t]), len(ys[t])), radius) for t, (_, cols, rows) in zip(long, rough)]
        out |= zip(long, together(pick(xs, long), pick(ys, long), point, [w[0] for w in windows], [w[1] for w in windows], pick(sums, long)))
    return [out[t] for t in range(len(xs))]


def fast(x, y, radius: int, point: str | Point = "square") -> tuple[float, np.ndarray, np.ndarray]:
    return fast_together([x], [y], radius, point)[0]
