"""The data source of raw matrices: both directions, ranges of ids, tasks that run again."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarp.sources import ngrams, raw


@pytest.fixture(scope="module")
def matrix(tmp_path_factory):
    at = tmp_path_factory.mktemp("raw")
    values = np.arange(4 * 100, dtype="<f8").reshape(100, 4)
    for k, (a, b) in enumerate(((0, 37), (37, 37), (37, 100))):
        values[a:b].tofile(at / f"part-{k:06d}.bin")
    (at / "_draft-x").write_bytes(b"left by a task")
    return str(at), values


@pytest.mark.parametrize("first, last", [(0, None), (0, 99), (36, 38), (50, 50), (99, 5), (200, None)])
def test_ranges(spark, matrix, first, last):
    at, values = matrix
    got = {r.id: r.series for r in ngrams.read_matrix(spark, at, 4, first=first, last=last).collect()}
    assert got == {i: list(values[i]) for i in range(first, min(100, 100 if last is None else last + 1))}


def test_only_wanted_records_are_partitions(matrix):
    at, _ = matrix
    reader = raw.RecordReader({"path": at, "width": "4", "first": "30", "last": "60", "part_bytes": "320"})
    parts = reader.partitions()
    assert [(p.begin, p.end, p.id) for p in parts] == [(30, 37, 30), (0, 10, 37), (10, 20, 47), (20, 24, 57)]
    assert [i for p in parts for b in reader.read(p) for i in b.column(0).to_pylist()] == list(range(30, 61))


def test_filters_are_pushed_down(spark, matrix):
    at, values = matrix
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for condition, want in (("id = 40", [40]), ("id > 97", [98, 99]), ("id >= 98 AND id < 99", [98]), ("id IN (3, 50) AND id <= 49", [3]), ("id IS NULL", []), ("series[0] = 8.0", [2])):
            got = ngrams.read_matrix(spark, at, 4).filter(condition).orderBy("id").collect()
            assert [r.id for r in got] == want and all(r.series == list(values[r.id]) for r in got)
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = raw.FilteredReader({"path": at, "width": "4"})
    list(reader.pushFilters([raw.GreaterThan(("id",), 96), raw.LessThan(("id",), 99), raw.EqualTo(("other",), 1)]))
    assert (reader.first, reader.last) == (97, 98) and sum(p.end - p.begin for p in reader.partitions()) == 2


@pytest.mark.parametrize("dtype", ["f8", "f4", "u8", "i2"])
def test_round_trip(spark, tmp_path, dtype):
    rows = spark.range(500).select("id", F.array(*(F.col("id") % 97 + k for k in range(8))).cast("array<double>").alias("series")).repartition(7)
    ngrams.write_matrix(rows, f"{tmp_path}/m", dtype)
    back = ngrams.read_matrix(spark, f"{tmp_path}/m", 8, dtype)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    whole = np.concatenate([np.fromfile(f, np.dtype(dtype).newbyteorder("<")) for f, _ in raw.data_files(f"{tmp_path}/m")])
    assert np.array_equal(whole.reshape(500, 8)[:, 0], np.arange(500) % 97)
    assert not any(f.name.startswith("_draft") for f in (tmp_path / "m").iterdir())


def test_append_overwrite_and_abort(spark, tmp_path):
    rows = lambda v, n: spark.range(n).select("id", F.array(F.lit(float(v)), F.lit(0.0)).alias("series"))
    at = f"{tmp_path}/m"
    ngrams.write_matrix(rows(1, 3), at)
    ngrams.write_matrix(rows(2, 2), at)
    assert [r.series[0] for r in ngrams.read_matrix(spark, at, 2).orderBy("id").collect()] == [1, 1, 1, 2, 2]
    rows(3, 4).coalesce(1).write.format("rawmatrix").mode("overwrite").options(path=at).save()
    assert [r.series[0] for r in ngrams.read_matrix(spark, at, 2).collect()] == [3] * 4
    writer = raw.RecordWriter({"path": at}, False)
    draft = tmp_path / "m" / "_draft-1"
    draft.write_bytes(b"x")
    writer.abort([None, raw.Part(str(draft), 0, 1)])
    assert not draft.exists() and ngrams.read_matrix(spark, at, 2).count() == 4


def test_wrong_and_empty(spark, tmp_path, matrix):
    for width in (8, 64):
        with pytest.raises(Exception, match="no whole rows"):
            ngrams.read_matrix(spark, matrix[0], width).collect()
    with pytest.raises(Exception, match="nowhere"):
        ngrams.read_matrix(spark, f"{tmp_path}/nowhere", 4).collect()
    ngrams.write_matrix(spark.createDataFrame([], "id long, series array<double>"), f"{tmp_path}/none")
    assert ngrams.read_matrix(spark, f"{tmp_path}/none", 4).collect() == []
