"""Merging subtrees over a whole table, and restoring from the graph, against plain Python."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarp.functions import haar
from tidewarp.operators import merge, trace, wavelet

LENGTH = 16


def frame(spark, rows):
    return spark.createDataFrame([(i, s, "x") for i, s in rows], "id long, series array<double>, level string").repartition(3)


def some_rows(seed, n=40):
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.integers(-2, 4, LENGTH).astype(float).tolist()) for i in rng.choice(500, n, replace=False)]
    return rows + [(1000, [0.0] * LENGTH), (1001, [0.0] * LENGTH), (1002, [-0.0, 0.0] * 8), (1003, rows[0][1]), (2**50, rows[1][1]), (1004, [1e15] * 8 + [-1e15] * 8)]


def brute(rows, max_error, step):
    """(nodes, roots) by a dictionary per level."""
    tree = {i: [level[0] for level in haar.scaled(np.array([s]))] for i, s in rows}
    depth = haar.levels(LENGTH)
    nodes, state = {}, {}
    for level in reversed(range(depth)):
        block = LENGTH >> level
        here = []
        for i in tree:
            for pos in range(1 << level):
                kids = ((-1 - pos,) * 2, 0.0) if level == depth - 1 else ((state[i, 2 * pos][0], state[i, 2 * pos + 1][0]), max(state[i, 2 * pos][1], state[i, 2 * pos + 1][1]))
                here.append((i, pos, float(tree[i][level][pos]), *kids))
        width, low = step * max_error * block, {}
        cell = lambda k, x: (k, np.floor(x / width) if width else x)  # noqa: E731, B023
        for _, _, x, k, _ in here:
            low[cell(k, x)] = min(low.get(cell(k, x), x), x)
        taken, first = [], {}
        for i, pos, x, k, e in here:
            more = e + abs(x - low[cell(k, x)]) / block
            v, e = (low[cell(k, x)], more) if more <= max_error else (x, e)
            taken.append((i, pos, k, v, e))
            place = i * 2 * LENGTH + (1 << level) + pos
            first[k, v] = min(first.get((k, v), place), place)
        for i, pos, k, v, e in taken:
            node = first[k, v]
            state[i, pos] = (node, e)
            nodes[node] = (node, level, node % (2 * LENGTH) - (1 << level), v, *(c if c >= 0 else None for c in k))
    return sorted(nodes.values()), sorted((i, state[i, 0][0], sum(s) / LENGTH**0.5, state[i, 0][1]) for i, s in rows)


@pytest.mark.parametrize("max_error, step", [(0.0, 0.5), (1.0, 0.5), (2.0, 1.0), (3.0, 0.1)])
def test_merged_dag(spark, max_error, step):
    rows = some_rows(1)
    nodes, roots = merge.merged_dag(frame(spark, [*rows, (None, [1.0] * LENGTH), (7777, None)]), LENGTH, max_error, step)
    want = brute(rows, max_error, step)
    assert sorted(map(tuple, nodes.collect()), key=lambda r: r[0]) == want[0]
    got = sorted(map(tuple, roots.collect()))
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want[1]] and np.allclose([r[2] for r in got], [r[2] for r in want[1]])
    back = {r.id: np.array(r.series) for r in merge.restored(nodes, roots, LENGTH).collect()}
    error = {r[0]: r[3] for r in got}
    assert set(back) == {i for i, _ in rows}
    for i, s in rows:
        assert np.abs(back[i] - s).max() <= error[i] + 1e-9 * max(1, np.abs(s).max())
        assert error[i] <= max_error
    kept = {r.level: r.nodes for r in wavelet.dag_levels(nodes, roots).collect()}
    assert all(kept[level] <= len(rows) << level for level in kept) and sum(kept.values()) == len(want[0])


def test_more_error_shares_more(spark):
    rows = frame(spark, some_rows(2, 150))
    counts = [merge.merged_dag(rows, LENGTH, e)[0].count() for e in (0.0, 1.0, 2.0, 4.0)]
    assert counts == sorted(counts, reverse=True) and counts[-1] < 0.7 * counts[0]


def test_some_trees_only(spark):
    rows = some_rows(3)
    nodes, roots = merge.merged_dag(frame(spark, rows), LENGTH, 1.0)
    only = spark.createDataFrame([(rows[4][0],), (1001,), (1001,), (-9,)], "i long")
    some = {r.id: r.series for r in merge.restored(nodes, roots, LENGTH, only).collect()}
    every = {r.id: r.series for r in merge.restored(nodes, roots, LENGTH).collect()}
    assert set(some) == {rows[4][0], 1001} and all(every[i] == s for i, s in some.items())


def test_empty_and_wrong(spark):
    nodes, roots = merge.merged_dag(frame(spark, []), LENGTH, 1.0)
    assert nodes.count() == roots.count() == merge.restored(nodes, roots, LENGTH).count() == 0
    for wrong in ((LENGTH - 1, 1.0, 0.5), (LENGTH, -1.0, 0.5), (LENGTH, float("nan"), 0.5), (LENGTH, 1.0, 0.0), (LENGTH, 1.0, 2.0)):
        with pytest.raises(ValueError):
            merge.merged_dag(frame(spark, []), *wrong)


def test_plans_hold_no_group_in_python(spark):
    rows = frame(spark, some_rows(4))
    nodes, roots = merge.merged_dag(rows, LENGTH, 1.0)
    for df in (nodes, roots, merge.restored(nodes, roots, LENGTH)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(p in plan for p in ("Python", "InPandas", "InArrow"))


def test_traceback_limits_before_the_exchange(spark):
    found = spark.createDataFrame([(s, i, float(i % 7)) for s in range(3) for i in range(50)], "start int, i long, weight double")
    names = spark.createDataFrame([(i, f"w{i}") for i in range(50)], "id long, ngram string")
    top = trace.traceback(found, names, 4)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    got = {(r.start, r["rank"]): (r.id, r.weight, r.ngram) for r in top.collect()}
    assert got[0, 0] == (6, 6.0, "w6") and got[None, 3] == (27, 18.0, "w27") and len(got) == 16
    assert top.filter(F.col("rank") >= 4).count() == 0
