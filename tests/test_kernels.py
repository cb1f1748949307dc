import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewarp.functions import kernels as k

# Fixed values, here and in the expectations below: published examples of alignments, windows and paths that
# results must equal.
A = [1, 1, 1, 2, 4, 6, 5, 5, 5, 4, 4, 3, 1, 1, 1]
B = [1, 1, 2, 4, 6, 6, 6, 5, 4, 4, 4, 3, 3, 3, 1]
BASE = ([0, 1, 2, 3, 4, 4, 4, 4], [0, 0, 1, 2, 2, 2, 3, 4])
BASE_PATH = ([1, 1, 2, 3, 3, 3, 4, 5, 6, 7, 8], [1, 2, 3, 4, 5, 6, 7, 8, 8, 8, 8])


def aligned(found, cost, first=None, second=None):
    assert found[0] == pytest.approx(cost)
    if first is not None:
        assert list(found[1]) == first and list(found[2]) == second


def test_point_distances():
    assert [k.square(*p) for p in ((0, 0), (0, 1), (9, 10), (0, 5))] == [0, 1, 1, 25]
    assert [k.absval(*p) for p in ((0, 3), (-2, 1), (-2, -5))] == [3, 3, 3]
    d = k.poisson(15, 30)
    assert [float(d(np.float64(x), np.float64(y))) for x, y in ((0, 0), (1, 2), (5, 10), (9, 0), (0, 9), (9, 9))] == pytest.approx([0, 0, 0, 8, 2, 1])


def test_alignment():
    aligned(k.dtw(A, B), 0, [1, 2, 3, 4, 5, 6, 6, 6, 7, 8, 9, 10, 10, 11, 12, 12, 12, 13, 14, 15], [1, 1, 2, 3, 4, 5, 6, 7, 8, 8, 8, 9, 10, 11, 12, 13, 14, 15, 15, 15])
    aligned(k.dtw([*A[:-1], 3], B), 4)
    aligned(k.dtw(range(1, 11), range(2, 12)), 2)
    aligned(k.dtw([0] * 6, [1] * 6), 6)
    aligned(k.dtw([1, 1, 1], [1, 1, 1]), 0, [1, 2, 3], [1, 2, 3])
    aligned(k.dtw([0, 1, 1, 1], [0, 0, 1, 1]), 0, [1, 1, 2, 3, 4], [1, 2, 3, 3, 4])


@pytest.mark.parametrize(
    "low,high",
    [
        ([1] * 8, [8] * 8), ([1, 1, 1, 2, 3, 4, 5, 6], [4, 6, 7, 8, 8, 8, 8, 8]), ([1, 3, 4, 7, 8, 8, 8, 8], [4, 6, 7, 8, 8, 8, 8, 8]),
        ([1, 1, 1, 2, 3, 4, 5, 6], [2, 3, 6, 7, 8, 8, 8, 8]), ([1, 3, 4, 7, 8, 8, 8, 8], [2, 3, 6, 7, 8, 8, 8, 8]),
    ],
)
def test_windows_around_the_path(low, high):
    aligned(k.windowed(*BASE, low, high), 0, *BASE_PATH)


def test_window_that_cuts_the_path():
    aligned(k.windowed(*BASE, [1, 1, 1, 2, 3, 4, 5, 6], [4, 4, 5, 6, 7, 8, 8, 8]), 2, [1, 1, 2, 3, 3, 4, 5, 6, 7, 8], [1, 2, 3, 4, 5, 6, 7, 8, 8, 8])
    with pytest.raises(ValueError):
        k.windowed(*BASE, [2] * 8, [8] * 8)


def test_halved():
    once = k.halved(np.arange(0, 99, 2))
    assert list(once) == list(range(1, 98, 4))
    assert list(k.halved(once)) == [*range(3, 92, 8), 97]
    assert list(k.halved([1])) == [1.0]


@pytest.mark.parametrize(
    "cols,rows,radius,low,high",
    [
        (range(1, 9), range(1, 9), 1, [1, 1, 1, 2, 3, 4, 5, 6], [3, 4, 5, 6, 7, 8, 8, 8]),
        (range(1, 9), range(1, 9), 2, [1, 1, 1, 1, 1, 2, 3, 4], [5, 6, 7, 8, 8, 8, 8, 8]),
        ([1, 1, 2, 3, 4, 5, 6, 7, 8, 8, 8], [1, 2, 3, 3, 3, 4, 4, 5, 6, 7, 8], 1, [1, 1, 2, 2, 2, 3, 3, 4], [4, 4, 4, 5, 5, 6, 8, 8]),
        ([1, 1, 2, 3, 4, 5, 6, 7, 8, 8, 8], [1, 2, 3, 3, 3, 4, 4, 5, 6, 7, 8], 2, [1, 1, 1, 1, 1, 1, 2, 2], [5, 5, 6, 6, 7, 8, 8, 8]),
        ([1, 1, 2, 3, 4, 5, 6, 7, 8, 8, 8], [1, 2, 3, 3, 3, 4, 4, 5, 6, 7, 8], 20, [1] * 8, [8] * 8),
        ([1] * 8 + list(range(2, 9)), list(range(1, 9)) + [8] * 7, 1, [1, 1, 7, 7, 7, 7, 7, 7], [8] * 8),
        ([1] * 8 + list(range(2, 9)), list(range(1, 9)) + [8] * 7, 2, [1, 1, 1, 6, 6, 6, 6, 6], [8] * 8),
        (range(1, 9), [1, 2, 3, 4, 4, 4, 4, 4], 1, [1, 1, 1, 2, 3, 3, 3, 3], [3, 4, 4, 4, 4, 4, 4, 4]),
        (range(1, 9), [1, 2, 3, 4, 4, 4, 4, 4], 2, [1, 1, 1, 1, 1, 2, 2, 2], [4] * 8),
        ([1, 2, 3, 4, 4, 4, 4, 4], range(1, 9), 1, [1, 1, 1, 2], [3, 4, 8, 8]),
        ([1, 2, 3, 4, 4, 4, 4, 4], range(1, 9), 47, [1] * 4, [8] * 4),
    ],
)
def test_window_around(cols, rows, radius, low, high):
    found = k.window_around(list(cols), list(rows), radius)
    assert list(found[0]) == low and list(found[1]) == high


def test_non_square_full_window():
    x, y = np.arange(1, 17.0), np.arange(1, 17.0, 2)
    full = k.dtw(x, y)
    aligned(k.windowed(x, y, [1] * 16, [8] * 16), full[0], list(full[1]), list(full[2]))


def test_fast_alignment():
    t = np.arange(1, 401)
    x = sum(np.exp(-0.5 * ((t - m) / s) ** 2) for m, s in ((70, 12), (150, 30), (240, 9), (330, 20)))
    y = x[::2]
    cost, first, second = k.fast(x, y, 15)
    assert cost >= k.dtw(x, y)[0] - 1e-9
    assert (np.diff(first) >= 0).all() and (np.diff(second) >= 0).all()
    assert (first[0], second[0], first[-1], second[-1]) == (1, 1, 400, 200)


def slow(x, y, r):
    n = len(x)
    c = np.full((n + 1, n + 1), np.inf)
    c[0, 0] = 0
    for i in range(n):
        for j in range(max(0, i - r), min(n, i + r + 1)):
            c[i + 1, j + 1] = (x[i] - y[j]) ** 2 + min(c[i, j], c[i, j + 1], c[i + 1, j])
    return c[n, n]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 12), st.integers(0, 6), st.integers(0, 10**6))
def test_banded(n, r, seed):
    rng = np.random.default_rng(seed)
    rows = rng.integers(-5, 6, (5, n)).astype(float)
    found = k.batches(rows[0], rows, r, lanes=3)
    assert list(found) == [slow(rows[0], y, r) for y in rows]
    assert found[0] == 0
    assert (k.batches(rows[0], rows, r + 1) <= found).all()
    assert list(k.batches(rows[0], rows, 0)) == [((rows[0] - y) ** 2).sum() for y in rows]
    assert k.batches(rows[1], rows[:1], r)[0] == found[1]
    assert np.allclose(k.batches(rows[0].astype("f4"), rows.astype("f4"), r), found, rtol=1e-5)


def slow_path(x, y, low, high):
    """Cost of the best alignment in a window, cell by cell."""
    c = np.full((len(x) + 1, len(y) + 1), np.inf)
    c[0, 0] = 0
    for i in range(len(x)):
        for j in range(low[i] - 1, high[i]):
            c[i + 1, j + 1] = (x[i] - y[j]) ** 2 + min(c[i, j], c[i, j + 1], c[i + 1, j])
    return c[-1, -1]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 14), st.integers(1, 14), st.integers(1, 5), st.integers(0, 10**6))
def test_pairs_together(n, m, lanes, seed):
    rng = np.random.default_rng(seed)
    xs, ys = rng.integers(0, 4, (lanes, n)).astype(float), rng.integers(0, 4, (lanes, m)).astype(float)
    low = np.sort(rng.integers(1, m + 1, (lanes, n)), axis=1)
    high = np.maximum(np.sort(rng.integers(1, m + 1, (lanes, n)), axis=1), low)
    low[:, 0], high[:, -1] = 1, m
    every = [[1] * n] * lanes, [[m] * n] * lanes
    for first, last, found in ((*every, k.together(xs, ys)), (low, high, k.together(xs, ys, "square", list(low), list(high)))):
        for x, y, u, v, (cost, here, there) in zip(xs, ys, first, last, found):
            assert cost == slow_path(x, y, u, v)
            if cost < np.inf:
                assert sum((x[i - 1] - y[j - 1]) ** 2 for i, j in zip(here, there)) == cost and all(u[i - 1] <= j <= v[i - 1] for i, j in zip(here, there))
                assert (here[0], there[0], here[-1], there[-1]) == (1, 1, n, m)
                assert all((a, b) in ((0, 1), (1, 0), (1, 1)) for a, b in zip(np.diff(here), np.diff(there)))


def test_pairs_of_many_lengths():
    rng = np.random.default_rng(4)
    xs, ys = ([rng.integers(0, 9, rng.integers(5, 60)).astype(float) for _ in range(30)] for _ in range(2))
    for point in ("square", "absval", "poisson"):
        for found, one in ((k.together(xs, ys, point), lambda x, y: k.dtw(x, y, point)), (k.fast_together(xs, ys, 2, point), lambda x, y: k.fast(x, y, 2, point))):
            for x, y, f in zip(xs, ys, found):
                aligned(one(x, y), f[0], list(f[1]), list(f[2]))
    assert k.together([], []) == []
    with pytest.raises(ValueError):
        k.dtw([], [1.0])
