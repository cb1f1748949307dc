"""Neighbours of many series at once, and the graph that grows by them."""
import numpy as np
import pytest

from tidewarp.functions import kernels
from tidewarp.operators import graph, many

LENGTH = 32


@pytest.fixture(scope="module")
def walks(spark):
    rng = np.random.default_rng(11)
    values = rng.normal(size=(150, LENGTH)).cumsum(axis=1)
    values[70:80] = values[7]  # ties
    rows = [(int(i), f"w{i}", v.tolist()) for i, v in enumerate(values)]
    return spark.createDataFrame([*rows, (None, "null", rows[0][2]), (999, None, rows[7][2]), (1000, "none", None)], "id long, ngram string, series array<double>").repartition(6)


def brute(walks, queries, r, limit, begin=0, end=LENGTH, point="square"):
    rows = [x for x in walks.collect() if x.id is not None and x.series is not None]
    measure = kernels.point_distance(point)
    out = []
    for q in queries:
        own = next(x.series for x in rows if x.id == q)
        d2 = kernels.batches(np.array(own[begin:end]), np.array([x.series[begin:end] for x in rows]), r, measure)
        order = sorted(zip(d2, (x.id for x in rows), (x.ngram for x in rows)))[:limit] if limit else []
        out += [(q, k, i, n, float(np.sqrt(d / (end - begin)))) for k, (d, i, n) in enumerate(order)]
    return out


@pytest.mark.parametrize("r, limit, begin, end, point, block", [(4, 5, 0, 32, "square", 256), (0, 12, 0, 32, "square", 3), (3, 4, 5, 21, "square", 2), (2, 3, 0, 32, "absval", 256), (2, 500, 0, 32, "square", 256), (2, 0, 0, 32, "square", 256)])
def test_against_brute_force(spark, walks, r, limit, begin, end, point, block):
    queries = walks.filter("id % 20 = 0 OR id = 7")
    got = many.knn_many(walks, queries.unionByName(queries), r, limit, begin, end, point, block=block).orderBy("query", "rank").collect()
    want = brute(walks, [0, 7, 20, 40, 60, 80, 100, 120, 140, 1000][:-1], r, limit, begin, end, point)
    assert [tuple(x)[:4] for x in got] == [x[:4] for x in want]
    assert np.allclose([x.distance for x in got], [x[4] for x in want])


def test_empty_and_wrong(spark, walks):
    assert many.knn_many(walks, walks.limit(0), 2, 3).collect() == []
    assert many.knn_many(walks.limit(0), walks, 2, 3).collect() == []
    for wrong in ({"r": 2, "limit": -1}, {"r": 20, "limit": 2}, {"r": 2, "limit": 2, "begin": 9, "end": 9}, {"r": 2, "limit": 2, "block": 0}):
        with pytest.raises(ValueError):
            many.knn_many(walks, walks, **wrong).collect()


def test_task_state_is_bounded():
    rng = np.random.default_rng(1)
    near = many.Nearest(rng.normal(size=(3, 16)), 2, 4, "square", "float64")
    for k in range(20):
        near.add(np.arange(100) + 100 * k, np.array(["x"] * 100, object), rng.normal(size=(100, 16)))
        assert all(len(part) == 4 for best in near.best for part in best)


def test_graph_does_not_hang_on_what_is_searched_ahead(spark, walks):
    rows = walks.filter("id IS NOT NULL AND series IS NOT NULL")
    edges, vertices = graph.similarity_graph(rows, "w3", 2, 5, 9, ahead=1)
    want, known = sorted(map(tuple, edges.collect())), sorted(map(tuple, vertices.collect()), key=str)
    for ahead in (3, 50):
        edges, vertices = graph.similarity_graph(rows, "w3", 2, 5, 9, ahead=ahead)
        assert sorted(map(tuple, edges.collect())) == want and sorted(map(tuple, vertices.collect()), key=str) == known


def test_graph_needs_fewer_passes(spark, walks, monkeypatch):
    rows, passes = walks.filter("id IS NOT NULL AND series IS NOT NULL"), []
    whole = many.knn_many
    monkeypatch.setattr(many, "knn_many", lambda *a, **b: passes.append(1) or whole(*a, **b))
    counts = []
    for ahead in (1, 4):
        graph.similarity_graph(rows, "w3", 2, 8, 12, ahead=ahead)
        counts.append(len(passes))
        passes.clear()
    assert counts[0] == 12 and counts[1] <= 6


def test_sifted_rows_are_those_of_exact_distances():
    """Sums in float32 decide nothing: far from 0 they cannot tell the rows apart."""
    rng = np.random.default_rng(5)
    rows = np.concatenate([rng.normal(size=(900, 24)), rng.normal(size=(900, 24)) + 3e5, np.repeat(rng.normal(size=(1, 24)), 700, axis=0)])
    ids, names = rng.permutation(len(rows)), np.array([f"s{i}" for i in range(len(rows))], object)
    queries = np.concatenate([rows[::300], rng.normal(size=(3, 24))])
    for limit in (1, 7, 800):
        near = many.Nearest(queries, 3, limit, "square", "float64")
        for at in range(0, len(rows), 640):
            near.add(ids[at : at + 640], names[at : at + 640], rows[at : at + 640])
        for q, (d2, own, label) in zip(queries, near.best):
            want = kernels.batches(q, rows, 3)
            order = np.lexsort([ids, want])[:limit]
            assert np.array_equal(d2, want[order]) and np.array_equal(own, ids[order]) and list(label) == list(names[order])


def test_lanes_are_dropped_on_the_way(monkeypatch):
    rng = np.random.default_rng(6)
    rows, query = rng.normal(size=(4000, 40)), rng.normal(size=40)
    d2 = kernels.batches(query, rows, 4)
    for most in (-1.0, np.sort(d2)[3], np.median(d2), np.inf):
        places, found = kernels.reached(query, np.ascontiguousarray(rows.T), 4, most)
        assert np.array_equal(places, np.flatnonzero(d2 <= most)) and np.array_equal(found, d2[places])


def test_few_distances_are_computed_exactly(monkeypatch):
    """All pairs of random series pass the bounds, but few of them are summed in float64."""
    rng, done = np.random.default_rng(7), []
    rows = rng.normal(size=(6000, 32))
    for name, lanes in (("batches", lambda q, x, *_: len(x)), ("banded", lambda q, x, *_: x.shape[1])):
        whole = getattr(kernels, name)
        monkeypatch.setattr(kernels, name, lambda *a, f=whole, n=lanes, **b: done.append(n(*a)) or f(*a, **b))
    many_near = many.Nearest(rows[:10], 3, 5, "square", "float64")
    many_near.add(np.arange(6000), np.array(["x"] * 6000, object), rows)
    assert sum(done) < 600
