"""Averages under warping per group, against the average of each group alone."""
import numpy as np
import pytest

from tidewarp.operators import knn


def test_each_group_as_alone(spark):
    rng = np.random.default_rng(4)
    rows = [(["a", "b", None][int(rng.integers(3))] if i < 60 else "hot", int(i), rng.normal(size=int(rng.integers(3, 9))).cumsum().tolist(), 1) for i in range(200)]
    rows += [("one", 500, [1.0, 2.0], 1), ("one", None, [9.0], 1), ("null", 501, None, 1)]
    df = spark.createDataFrame(rows, "kind string, id long, series array<double>, n int").repartition(7)
    for rounds in (0, 1, 3):
        got = {r.kind: r for r in knn.barycenters(df, "kind", rounds).collect()}
        assert set(got) == {"a", "b", None, "hot", "one"}
        for kind, r in got.items():
            own = [x for x in rows if x[0] == kind]
            alone = spark.createDataFrame([(10**6 if x[1] is None else x[1], x[2]) for x in own], "id long, series array<double>")
            assert r.n == len(own) and np.allclose(r.series, knn.barycenter(alone, rounds))


def test_groups_of_other_types_and_empty(spark):
    df = spark.createDataFrame([(1.5, 1, [0.0, 1.0, 2.0]), (1.5, 2, [0.0, 1.0, 2.0]), (-2.0, 3, [])], "k double, id long, series array<double>")
    got = {r.k: (r.n, r.series) for r in knn.barycenters(df.filter("k > 0"), "k", 2).collect()}
    assert got == {1.5: (2, pytest.approx([0, 1, 2]))}
    assert {r.k: r.series for r in knn.barycenters(df, "k", 2).collect()}[-2.0] == []  # nothing to align: stays
    assert knn.barycenters(df.limit(0), "k").collect() == []
    assert sorted(knn.barycenters(df, "k", 0).columns) == ["k", "n", "series"]
