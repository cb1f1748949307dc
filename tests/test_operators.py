import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarp.operators import graph, ingest, knn, metrics, trace, wavelet
from tidewarp.plans import scratch
from tidewarp.sources import ngrams


@pytest.fixture(scope="module")
def walks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"w{i}", np.cumsum(rng.standard_normal(64)).round(3).tolist()) for i in range(40)]
    rows.append((40, "w40", rows[0][2]))
    return spark.createDataFrame(rows, "id long, ngram string, series array<double>").repartition(3)


def test_entries_from_text(spark, tmp_path):
    (tmp_path / "a.tsv").write_bytes("war\t1753\t3\t1\textra\r\n\nWar\t2008\t4\t2\n".encode())
    rows = ngrams.read_entries(spark, str(tmp_path / "a.tsv"))
    assert sorted(map(tuple, rows.collect())) == [("War", 2008, 4, 2), ("war", 1753, 3, 1)]
    assert ngrams.scan_report(rows).first() == (1753, 2008, 2, 4, 2)
    (tmp_path / "b.tsv").write_text("war\tx\t3\t1\n")
    with pytest.raises(Exception, match="not an entry"):
        ngrams.read_entries(spark, str(tmp_path / "b.tsv")).collect()


def test_maps_and_transitions(spark, tmp_path):
    ngrams.write_map(spark.createDataFrame([("b",), ("a",), ("b",)], "ngram string"), str(tmp_path / "map"))
    assert [tuple(r) for r in ngrams.read_map(spark, str(tmp_path / "map")).orderBy("id").collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "twice").write_text("a\n\na\n")
    with pytest.raises(ValueError):
        ngrams.read_map(spark, str(tmp_path / "twice"))
    (tmp_path / "t").write_text("wars -> war\nno separator\nwars -> other\na -> b -> c\n")
    assert sorted(map(tuple, ngrams.read_transitions(spark, str(tmp_path / "t")).collect())) == [("a", "b -> c"), ("wars", "war")]


def test_matrix_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (0, [1.0, 2.0])], "id long, series array<double>")
    ngrams.write_matrix(rows, str(tmp_path / "m"))
    assert [tuple(r) for r in ngrams.read_matrix(spark, str(tmp_path / "m"), 2).orderBy("id").collect()] == [(0, [1, 2]), (1, [3, 4])]
    ngrams.write_matrix(rows, str(tmp_path / "u"), "u8")
    assert ngrams.read_matrix(spark, str(tmp_path / "u"), 2, "u8").count() == 2
    with pytest.raises(ValueError):
        ngrams.read_matrix(spark, str(tmp_path / "m"), 8)


def test_build_series(spark):
    e = spark.createDataFrame([("War", 1752, 9, 9), ("War", 1753, 1, 1), ("war", 1753, 2, 1), ("war", 1756, 5, 1), ("war", 1757, 5, 1), ("other", 1754, 1, 1)], "ngram string, year int, var0 long, var1 long")
    d = spark.createDataFrame([(0, "peace"), (1, "war")], "id long, ngram string")
    assert [tuple(r) for r in ingest.build_series(e, d, ylength=4).orderBy("id").collect()] == [(0, "peace", [0] * 4), (1, "war", [3, 0, 0, 5])]
    tr = spark.createDataFrame([("other", "peace"), ("war", "war")], "ngram string, stem string")
    assert ingest.build_series(e, d, tr, ylength=4).orderBy("id").first().series == [0, 1, 0, 0]
    assert [r.id for r in ingest.prune_support(ingest.build_series(e, d, ylength=4), 8).collect()] == [1]
    assert ingest.entry_counts(e, d, 1753, 4).first() == (6, 2)
    with pytest.raises(ValueError):
        ingest.summed(e, d, ylength=3)


def test_numbered_over_many_partitions(spark):
    rows = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("ngram"))
    out = [r.ngram for r in ngrams.numbered(rows.union(rows)).orderBy("id").collect()]
    assert out == sorted(out) and len(out) == 5000 and ngrams.numbered(rows).agg(F.max("id")).first()[0] == 4999


def test_knn_and_pruning_agree(walks):
    brute = [tuple(r) for r in knn.knn_dtw(walks, ["w0"], 4, 7).orderBy("rank").collect()]
    assert [r[0] for r in brute] == list(range(7)) and brute[0][2:] == (0, 0.0) and brute[1][2:] == (40, 0.0)
    index = knn.bound_index(walks, 4, 64, 16)
    stats = {}
    assert [tuple(r) for r in knn.knn_dtw_pruned(index, "w0", 4, 7, stats).orderBy("rank").collect()] == brute
    assert stats["n"] == 41 and stats["dtw"] <= 41
    assert len(knn.knn_dtw_pruned(index, "w0", 4, 99).collect()) == 41
    with pytest.raises(ValueError):
        knn.knn_dtw_pruned(index, "w0", 5, 7)
    with pytest.raises(KeyError):
        knn.knn_dtw(walks, ["nobody"], 4, 7)
    with pytest.raises(ValueError):
        knn.knn_dtw(walks, ["w0"], 40, 7)


def test_bounds_are_below_distances(walks):
    lb = knn.bounds(knn.bound_index(walks, 4, 64, 16), "w3", 4)
    q = walks.filter("id = 3").first().series
    both = knn.squared_sums(walks.select("id", "series"), [q], 4).join(lb.select("id", "lb", "mindist"), "id").collect()
    assert all(r.mindist <= r.lb + 1e-9 and r.lb <= r.d2 + 1e-9 for r in both)


def test_multi_query_and_auto_limit(walks):
    one, two = (knn.knn_dtw(walks, n, 3, 41).select("id", "distance") for n in (["w1"], ["w2"]))
    want = {r.id: math.sqrt(r.a**2 + r.b**2) for r in one.withColumnRenamed("distance", "a").join(two.withColumnRenamed("distance", "b"), "id").collect()}
    assert {r.id: r.distance for r in knn.knn_dtw(walks, ["w1", "w2"], 3, 41).collect()} == pytest.approx(want)
    ranks = knn.full_ranks(knn.squared_sums(walks.select("id", "series"), [walks.filter("id = 5").first().series], 3))
    d2 = [r.d2 for r in ranks.orderBy("rank").collect()]
    assert d2 == sorted(d2)
    for space in ("squared", "rooted"):
        d = np.array(d2 if space == "squared" else np.sqrt(d2[: round(len(d2) / 2)]))[1:]
        n = d - d[0]
        with np.errstate(all="ignore"):
            g2 = np.gradient(np.gradient(n) / n)
        g2[~np.isfinite(g2)] = -np.inf
        half = g2[1 : len(d2) // 2]
        assert knn.auto_limit(ranks, space) == int(np.argmax(half)) + 2


def test_barycenter_of_equal_series(spark):
    rows = spark.createDataFrame([(i, [0.0, 1.0, 2.0, 1.0]) for i in range(3)], "id long, series array<double>")
    assert knn.barycenter(rows) == pytest.approx([0, 1, 2, 1])
    assert knn.barycenter(rows.limit(0)) == []


@pytest.mark.parametrize("error,chunks", [(1e-9, 1), (0.5, 1), (4.0, 2)])
def test_dag(walks, error, chunks):
    nodes, roots = wavelet.build_dag(walks.select("id", "series"), 64, error, chunks)
    assert roots.count() == 41 and nodes.groupBy("node_id").count().filter("count > 1").isEmpty()
    back = {r.id: np.array(r.series) for r in wavelet.reconstruct(nodes, roots, 64).collect()}
    stated = {r.i: r.error for r in roots.collect()}
    half_floats = 0.15  # rounding alone may pass a small limit
    for r in walks.collect():
        gap = np.abs(back[r.id] - r.series).max()
        assert gap == pytest.approx(stated[r.id], abs=1e-9) and gap < max(error, half_floats)
    kept = {r.level: r.nodes for r in wavelet.dag_levels(nodes, roots).collect()}
    assert set(kept) == set(range(6)) and (chunks > 1 or error > 1e-9 or kept[5] > 32)
    assert 0 < wavelet.compression_rate(nodes, roots, 64)


def test_trace_finds_the_query_and_its_copy(walks):
    nodes, roots = wavelet.build_dag(walks.select("id", "series"), 64, 2.0)
    found = trace.trace(nodes, roots, 0, 64, 6)
    at_root = {r.i: r.weight for r in found.filter("start = 0").collect()}
    assert at_root[0] == 1.0
    top = trace.traceback(found, walks.select("id", "ngram"), 3)
    assert top.filter("start IS NULL AND rank = 0").count() == 1
    near = knn.knn_dtw(walks, ["w0"], 4, 3).select("id").collect()
    some = trace.knn_dtw_candidates(walks, nodes, roots, "w0", 4, 3, 6).orderBy("rank").collect()
    assert some[0].id == 0 and some[0].id == near[0].id
    assert {r.i for r in trace.trace(nodes, roots, 0, 64, 0).collect()} >= {0}
    with pytest.raises(KeyError):
        trace.trace(nodes, roots, 999, 64, 3)


def test_trace_weights(spark):
    nodes = spark.createDataFrame([(10, 1, 0, 0.0, None, None), (11, 1, 1, 0.0, None, None), (12, 1, 1, 0.0, None, None), (1, 0, 0, 0.0, 10, 11), (2, 0, 0, 0.0, 10, 12), (3, 0, 0, 0.0, 10, 11)], "node_id long, level int, pos int, x double, c0 long, c1 long")
    roots = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "i long, root_id long")
    out = {(r.start, r.i): r.weight for r in trace.trace(nodes, roots, 0, 4, 2).collect()}
    assert out == pytest.approx({(0, 0): 1.0, (1, 0): 1 / 3 * 1 / 2, (1, 1): 1 / 3, (1, 2): 1 / 3 * 1 / 2})
    assert {k for k, w in out.items() if w >= 0.3} == {(r.start, r.i) for r in trace.trace(nodes, roots, 0, 4, 2, minweight=0.3).collect()}
    assert {(r.start, r.i) for r in trace.trace(nodes, roots, 0, 4, 2, begin=2).collect()} == {(0, 0), (1, 0), (1, 2)}


def test_graphs(walks):
    edges, vertices = graph.similarity_graph(walks, "w0", 4, 3, 2)
    rows = [tuple(r) for r in edges.collect()]
    assert all(a >= b for a, b, _ in rows) and (0, 0, 0.0) in rows and (40, 0, 0.0) in rows
    assert "graph" in graph.graph_dot(edges, vertices) and vertices.count() >= 2
    nodes, roots = wavelet.build_dag(walks.select("id", "series"), 64, 2.0)
    used, links = graph.dag_frames(nodes, roots, [0, 40])
    assert used.filter("level = 0").count() in (1, 2) and links.count() >= 62
    assert graph.dag_dot(used, links).startswith("digraph") and "tikzpicture" in graph.dag_tikz(used, links)


def test_rank_metrics(spark):
    frame = lambda ids: spark.createDataFrame(list(enumerate(ids)), "rank long, id long")
    assert metrics.rank_changes(frame([5, 6, 7, 8]), frame([5, 7, 6, 9]), 4).first() == pytest.approx((1 - 3 / 4, 3 / 4, 1 / 4))
    assert metrics.rank_changes(frame([5, 6]), frame([5]), 2).first() == pytest.approx((1 / 2, 1 / 2, 1 / 2))
    assert metrics.rank_changes(frame([5, 6]), frame([5, 6]), 2).first() == pytest.approx((1, 0, 0))


def test_changes(spark):
    a = spark.createDataFrame([(0, 0.0), (1, 2.0)], "id long, distance double")
    b = spark.createDataFrame([(0, 0.5), (1, 3.0)], "id long, distance double")
    assert sorted(r.delta for r in metrics.relative_changes(a, b).collect()) == [0.5, 0.5]


def test_stream_of_entries(spark, tmp_path):
    from tidewarp.streaming import counts

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.tsv").write_text("war\t1753\t3\t1\nWar\t1753\t1\t1\n")
    (tmp_path / "in" / "2.tsv").write_text("war\t1753\t2\t2\nwar\t1700\t2\t2\n1999\t1800\t1\t1\n")
    stream = counts.running_counts(counts.read_entry_stream(spark, str(tmp_path / "in"), 1))
    for _ in range(2):  # the second run finds nothing new
        counts.to_table(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [tuple(r) for r in counts.read_table(spark, str(tmp_path / "out")).collect()] == [("war", 0, 6, 4)]
    (tmp_path / "in" / "3.tsv").write_text("war\t1753\t1\t1\nmoney\t1754\t1\t1\n")
    counts.to_table(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(map(tuple, counts.read_table(spark, str(tmp_path / "out")).collect())) == [("money", 1, 1, 1), ("war", 0, 7, 5)]


def test_tables_go_with_their_scope(spark):
    def held(df):
        return os.path.isdir(df.inputFiles()[0].removeprefix("file://").rpartition("/")[0])

    with scratch.scope():
        outer = scratch.materialized(spark.range(5), "outer")
        with scratch.scope():
            inner = scratch.materialized(spark.range(6), "inner")
            at = inner.inputFiles()[0].removeprefix("file://")
            assert inner.count() == 6 and os.path.exists(at)
        assert not os.path.exists(at) and held(outer) and outer.count() == 5
        at = outer.inputFiles()[0].removeprefix("file://")
    assert not os.path.exists(at) and held(scratch.materialized(spark.range(1), "kept"))


def test_entries_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("war und", 1753, 3, 1), ("\u00e9t\u00e9", 2008, 1, 1)], "ngram string, year int, var0 long, var1 long")
    ngrams.write_entries(rows, str(tmp_path / "e"))
    assert sorted(ngrams.read_entries(spark, str(tmp_path / "e")).collect()) == sorted(rows.collect())
    with pytest.raises(Exception, match="not a field"):
        ngrams.write_entries(spark.createDataFrame([("a\tb", 1, 1, 1)], rows.schema), str(tmp_path / "f"))
