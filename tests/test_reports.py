"""Sub-ranges, user distances, windows, hooks, reports and frames."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarp.functions import kernels, stemming
from tidewarp.functions.series import downsampled, gradient
from tidewarp.operators import graph, knn, metrics, trace, wavelet
from tidewarp.sources import ngrams


@pytest.fixture(scope="module")
def walks(spark):
    rng = np.random.default_rng(11)
    rows = [(i, f"w{i}", [float(v) for v in rng.standard_normal(64).cumsum()]) for i in range(60)]
    return spark.createDataFrame(rows, "id long, ngram string, series array<double>").repartition(3).cache()


@pytest.mark.parametrize("begin,end,r", [(0, 64, 4), (10, 50, 4), (3, 17, 4), (32, 64, 4)])
def test_pruned_sub_ranges(walks, begin, end, r):
    index = knn.bound_index(walks, r, 64, 16).cache()
    stats = {}
    for limit in (1, 7, 100):
        want = [(x.rank, x.id, round(x.distance, 9)) for x in knn.knn_dtw(walks, ["w3"], r, limit, begin, end).orderBy("rank").collect()]
        out = knn.knn_dtw_pruned(index, "w3", r, limit, stats, begin=begin, end=end)
        assert [(x.rank, x.id, round(x.distance, 9)) for x in out.orderBy("rank").collect()] == want
        assert stats["n"] == 60 and len(want) <= stats["dtw"] <= 60
    with pytest.raises(ValueError):
        knn.knn_dtw_pruned(index, "w3", r, 5, begin=10, end=12)


def test_user_distances(walks):
    cube = lambda x, y: np.abs(x - y) ** 3
    rows = {r.id: np.array(r.series) for r in walks.collect()}
    for r in (0, 3):
        got = {x.id: x.distance for x in knn.dtw_distances(walks, "w0", r, point=cube).collect()}
        for i, v in rows.items():
            assert got[i] == pytest.approx(np.sqrt(kernels.banded(rows[0], v[:, None], r, cube)[0] / 64))
    assert [x.id for x in knn.knn_dtw(walks, ["w0"], 3, 4, point="absval").orderBy("rank").collect()][0] == 0
    far = knn.knn_euclid(walks, "w0", limit=60, distance=lambda m, q: np.abs(m - q).max(axis=1)).collect()
    assert {x.id: round(x.distance, 9) for x in far} == {i: round(float(np.abs(v - rows[0]).max()), 9) for i, v in rows.items()}


def test_windowed_alignment(spark):
    # fixed values of the published examples: a path that fits the window, and one that it cuts
    a, b = [0.0, 1.0, 2.0, 3.0, 4.0, 4.0, 4.0, 4.0], [0.0, 0.0, 1.0, 2.0, 2.0, 2.0, 3.0, 4.0]
    rows = [(0, a, b, [1] * 8, [8] * 8), (1, a, b, [1, 1, 1, 2, 3, 4, 5, 6], [4, 4, 5, 6, 7, 8, 8, 8])]
    df = spark.createDataFrame(rows, "id long, a_values array<double>, b_values array<double>, low array<int>, high array<int>")
    out = df.withColumn("a", knn.windowed_alignment()("a_values", "b_values", "low", "high"))
    got = {r.id: (r.a.cost, r.a.first, r.a.second) for r in out.collect()}
    assert got[0] == (0.0, [1, 1, 2, 3, 3, 3, 4, 5, 6, 7, 8], [1, 2, 3, 4, 5, 6, 7, 8, 8, 8, 8])
    assert got[1] == (2.0, [1, 1, 2, 3, 3, 4, 5, 6, 7, 8], [1, 2, 3, 4, 5, 6, 7, 8, 8, 8])
    steps = knn.alignment_frame(out).filter("id = 0").orderBy("step").collect()
    assert [s.i for s in steps] == got[0][1] and all(s.x == a[s.i - 1] and s.y == b[s.j - 1] for s in steps)
    assert [r[0] for r in knn.speed_test([20, 40], 3, 1)] == [20, 40] and all(r[3] >= 1 - 1e-9 for r in knn.speed_test([30], 2, 1))


def test_downsampled_by_any_function(spark):
    df = spark.createDataFrame([([3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0],)], "s array<double>")
    most = downsampled(F.col("s"), 4, 8, float("-inf"), lambda a, v: F.greatest(a, v))
    assert df.select(most.alias("m")).first().m == [3, 4, 9, 6]


@pytest.mark.parametrize("metric", sorted(wavelet.METRICS))
def test_error_metrics(walks, metric):
    limit = 0.8
    nodes, roots = wavelet.build_dag(walks.select("id", "series"), 64, limit, metric=metric, shuffle_leaves=True, seed=3)
    back = {r.id: np.array(r.series) for r in wavelet.reconstruct(nodes, roots, 64).collect()}
    error = {r.i: r.error for r in roots.collect()}
    for r in walks.collect():
        assert wavelet.METRICS[metric](np.abs(back[r.id] - r.series)) == pytest.approx(error[r.id], abs=1e-6)
        assert error[r.id] < limit + 0.05  # half floats
    assert nodes.count() < 60 * 63
    again, _ = wavelet.build_dag(walks.select("id", "series"), 64, limit, metric=metric, shuffle_leaves=True, seed=3)
    assert sorted(map(str, again.collect())) == sorted(map(str, nodes.collect()))


def test_node_growth(walks):
    nodes, roots = wavelet.build_dag(walks.select("id", "series"), 64, 2.0, 3)
    rows = wavelet.node_growth(roots).collect()
    assert sum(r.grown for r in rows) == nodes.count() and len(rows) == 60 and all(r.grown >= 0 for r in rows)
    with pytest.raises(ValueError):
        wavelet.build_dag(walks, 64, 2.0, metric="none")


def test_nearest_join(spark):
    rng = random.Random(2)
    left = [(i, rng.randrange(3), rng.uniform(-5, 5)) for i in range(40)]
    right = [(100 + i, rng.randrange(3), round(rng.uniform(-5, 5), 1)) for i in range(80)]
    out = wavelet.nearest_join(spark.createDataFrame(left, "id long, bucket int, x double"), spark.createDataFrame(right, "id long, bucket int, x double"), 0.7, 3).collect()
    want = set()
    for i, b, x in left:
        near = sorted((abs(x - y), y, j) for j, c, y in right if c == b and abs(x - y) <= 0.7)[:3]
        want |= {(i, j, k) for k, (_, _, j) in enumerate(near)}
    assert {(r.id, r.other, r.rank) for r in out} == want
    merger = wavelet.Merger(4, 1.0)
    merger.buckets[(0,)] = [(1.0, 7), (2.0, 8), (4.0, 9)]
    assert merger.nearest_many((0,), 3.0, 1.0, 5) == [(1.0, 8), (1.0, 9)] and merger.nearest_many((0,), 3.0, 9.0, 1) == [(1.0, 8)]
    assert merger.nearest_many((1,), 3.0, 9.0, 1) == []


@pytest.mark.parametrize("size, reach", [(1, 0.3), (3, 2.0), (4, 50.0)])
def test_nearest_join_makes_no_pairs(spark, size, reach):
    """Copies, values that differ by less than distances can show, and values where none is near; no join of rows."""
    rng = random.Random(size)
    tiny = [5e-17 * k for k in range(1, 9)]
    left = [(i, rng.randrange(2), rng.choice([rng.uniform(-4, 4), 1.0, 2.0, 30.0])) for i in range(60)]
    right = [(100 + i, rng.randrange(2), rng.choice([round(rng.uniform(-4, 4), 1), *tiny, 1.0])) for i in range(200)]
    frame = lambda rows: spark.createDataFrame([*rows, (900, None, 1.0), (901, 0, None), (902, 0, float("nan"))], "id long, bucket int, x double")
    out = wavelet.nearest_join(frame(left), frame(right), reach, size)
    want = []
    for i, b, x in left:
        near = sorted((abs(x - y), y, j) for j, c, y in right if c == b and abs(x - y) <= reach)[:size]
        want += [(i, j, d, k) for k, (d, _, j) in enumerate(near)]
    assert sorted((r.id, r.other, r.dist, r["rank"]) for r in out.collect()) == sorted(want)
    apart = frame([(i, 0, float(i)) for i in range(50)])
    assert "Join" not in wavelet.nearest_join(apart, apart, 9.0, 2)._jdf.queryExecution().optimizedPlan().toString()


def test_hooks_and_limits_of_a_trace(walks):
    nodes, roots = wavelet.build_dag(walks.select("id", "series"), 64, 2.0)
    plain = {(r.start, r.i): r.weight for r in trace.trace(nodes, roots, 0, 64, 6).collect()}
    seen = []
    hooks = trace.Hooks(keep_down=lambda level, rows: rows.filter(F.lit(level < 3)), up=lambda level, rows: seen.append(level) or rows, found=lambda rows: rows.filter("i <> 0"))
    some = {(r.start, r.i): r.weight for r in trace.trace(nodes, roots, 0, 64, 6, hooks=hooks).collect()}
    assert some == {k: w for k, w in plain.items() if k[0] < 3 and k[1] != 0} and seen == [1, 0]
    for wrong in ({"maxdepth": 7}, {"maxdepth": -1}, {"maxdepth": 2, "minweight": -0.1}, {"maxdepth": 2, "begin": 9, "end": 9}):
        with pytest.raises(ValueError):
            trace.trace(nodes, roots, 0, 64, **wrong)


def test_compression_round_trip(walks):
    exact = wavelet.compression_round_trip(walks, 64, 0.0, "w1", 4, 10)
    assert exact["ranks"]["rank_similarity"] == 1 and abs(exact["changes"]["mean"]) < 0.05
    rough = wavelet.compression_round_trip(walks, 64, 3.0, "w1", 4, 10)
    assert rough["rate"] < exact["rate"] and rough["levels"].count() == 6


def test_sweeps_and_gold(spark, walks, tmp_path):
    grid = {"r": [0, 4], "limit": [3, 5]}
    run = lambda r, limit: knn.knn_dtw(walks, ["w2"], r, limit)
    out = metrics.sweep(run, grid)
    assert {(x.r, x.limit): x["count"] for x in out.groupBy("r", "limit").count().collect()} == {(r, n): n for r in (0, 4) for n in (3, 5)}
    assert [t["r"] for t in metrics.timed_sweep(lambda r: run(r, 3), {"r": [0, 4]}, 2)] == [0, 4]
    results = out.filter("limit = 5").select(F.lit("w2").alias("query"), "r", F.col("rank").cast("long").alias("rank"), "id")
    gold = results.groupBy("query", "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("ids"))
    ngrams.write_gold(gold, str(tmp_path / "gold"))
    read = ngrams.read_gold(spark, str(tmp_path / "gold"))
    assert {(x.r, x.rank_similarity, x.new_share) for x in metrics.against_gold(results, read, 5).collect()} == {(0, 1.0, 0.0), (4, 1.0, 0.0)}
    ngrams.write_report(results.groupBy("r").count(), str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).columns == ["r", "count"]


def test_vectors_maps_and_stems(spark, walks, tmp_path):
    d = knn.dtw_distances(walks, "w0", 2)
    ngrams.write_distances(d, str(tmp_path / "d"))
    want = {r.id: r.distance for r in d.collect()}
    assert {r.id: r.distance for r in ngrams.read_distances(spark, str(tmp_path / "d")).collect()} == want
    words = [f"n{i:04d}" for i in random.Random(1).sample(range(9000), 2000)]
    ngrams.write_map(spark.createDataFrame([(w,) for w in words], "ngram string").repartition(7), str(tmp_path / "map"))
    assert [tuple(r) for r in ngrams.read_map(spark, str(tmp_path / "map")).orderBy("id").collect()] == list(enumerate(sorted(words)))
    tr = spark.createDataFrame([("wars", "war"), ("war", "war"), ("sky", "sky")], "ngram string, stem string")
    assert [r.stem for r in ngrams.stems(tr).collect()] == ["sky", "war"]
    assert ngrams.transition_of(tr, "wars") == "war" and ngrams.transition_of(tr, "none") is None


def test_verb_lemmatizer():
    lemma = stemming.verb_lemmatizer({"walk", "make", "try", "go", "sing"}, {"went": "go"})
    assert [lemma(w) for w in ("walked", "making", "tries", "went", "goes", "sing", "tables")] == ["walk", "make", "try", "go", "go", "sing", "tables"]
    assert stemming.stem_phrase("making tries", lemma) == "make tri"


def test_frames(spark, walks):
    rows = walks.unionByName(spark.createDataFrame([(99, "zero", [0.0] * 64)], walks.schema))
    picture = metrics.picture_frame(rows.filter("id IN (1, 99)"), 8, 40).collect()
    assert len(picture) == 64 and all((p.r, p.g, p.b) == (0, 0, 0) for p in picture if p.id == 99) and all(0 <= v <= 1 for p in picture for v in (p.r, p.g, p.b))
    assert any(p.r + p.g + p.b > 0 for p in picture if p.id == 1)
    plot = metrics.plot_frame(rows, ["w1"], 1753).orderBy("x").collect()
    assert [p.y for p in plot] == rows.filter("id = 1").first().series and plot[0].x == 1753 and plot[0].label == "w1"
    amplitude = metrics.frequency_frame(rows, ["w1"]).orderBy("x").collect()
    v = np.array(rows.filter("id = 1").first().series)
    assert [a.y for a in amplitude] == pytest.approx(np.abs(np.fft.rfft(v / v.sum()))[1:].tolist())
    assert gradient(v[None, :]).shape == (1, 64) and graph.quoted('a"b') == '"a\\"b"'
