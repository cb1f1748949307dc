"""Envelopes, pruning with hashed ties, and its report."""
import numpy as np
import pytest

from tidewarp.functions import haar as h
from tidewarp.operators import knn, wavelet


@pytest.mark.parametrize("length", [1, 2, 7, 64])
@pytest.mark.parametrize("r", [0, 1, 2, 5, 31, 32, 500])
def test_envelopes(length, r):
    rows = np.random.default_rng(length * 100 + r).normal(size=(5, length))
    low, high = knn.envelopes(rows, r)
    for i in range(length):
        near = rows[:, max(0, i - r) : i + r + 1]
        assert np.array_equal(low[:, i], near.min(axis=1)) and np.array_equal(high[:, i], near.max(axis=1))


def test_envelopes_keep_their_type():
    assert knn.envelopes(np.zeros((2, 4), np.float32), 1)[0].dtype == np.float32
    assert knn.envelopes(np.zeros((0, 4)), 1)[0].shape == (0, 4)


def test_ties_follow_the_hash():
    c = np.array([0.0, 9, 9, 9, 1, 1, 1, 1])
    budget = np.sqrt(2) * 2.5  # two of the four finest
    gone = {key: tuple(np.flatnonzero(h.pruned(c, budget, key=key) == 0)[1:]) for key in range(20)}
    for key, places in gone.items():
        assert sorted(places) == sorted(4 + np.argsort(h.tie_order(key, np.arange(4, 8), 0))[:2])
    assert len(set(gone.values())) > 1
    assert h.pruned(c, budget, seed=1, key=3).tolist() != h.pruned(c, budget, seed=2, key=3).tolist() or len({tuple(h.pruned(c, budget, seed=s, key=3)) for s in range(9)}) > 1


def test_report_agrees_with_pruning(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.integers(0, 5, 16).astype(float).tolist()) for i in range(60)] + [(100, [0.0] * 16), (101, None)]
    df = spark.createDataFrame(rows, "id long, series array<double>").repartition(4)
    report = {(r.threshold, r.level): r for r in wavelet.pruning_report(df, 16, [0.1, 0.01, 0.1]).collect()}
    assert set(report) == {(t, k) for t in (0.01, 0.1) for k in range(4)}
    for t in (0.01, 0.1):
        one = wavelet.prune(df.filter("series IS NOT NULL"), t).collect()
        assert sum(report[t, k].kept for k in range(4)) == sum(r.kept for r in one)
        assert report[t, 2].n == 61 and report[t, 2].max_error == pytest.approx(max(r.error for r in one))
        assert report[t, 0].mean_error == pytest.approx(sum(r.error for r in one) / len(one))
        assert all(report[t, k].share == report[t, k].kept / (61 << k) for k in range(4))
    assert sum(report[0.1, k].kept for k in range(4)) < sum(report[0.01, k].kept for k in range(4))
    assert wavelet.pruning_report(df.limit(0), 16, [0.1]).collect() == []
    with pytest.raises(ValueError):
        wavelet.pruning_report(df, 15, [0.1])
