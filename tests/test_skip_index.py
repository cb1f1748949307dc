"""The skipping index: the same neighbours as brute force, and what it leaves unread."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarp.operators import knn, skip_index

LENGTH = 64


@pytest.fixture(scope="module")
def walks(spark):
    rng = np.random.default_rng(7)
    values = rng.normal(size=(600, LENGTH)).cumsum(axis=1) * 0.3 + rng.normal(size=(600, 1)) * 30
    values[50] = values[3]
    rows = [(int(i), f"w{i}", v.tolist()) for i, v in enumerate(values)]
    rows += [(1000 + k, "far", [1e9] * LENGTH) for k in range(2)] + [(2000 + k, "same", [0.0] * LENGTH) for k in range(200)] + [(3000, "none", None)]
    return spark.createDataFrame(rows, "id long, ngram string, series array<double>").repartition(5)


@pytest.fixture(scope="module")
def index(spark, walks, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("index"))
    skip_index.write_index(walks, at, LENGTH, file_rows=40)
    return at


@pytest.mark.parametrize("ngram, r, limit, begin, end", [("w3", 5, 10, 0, None), ("w0", 0, 7, 0, None), ("w9", 8, 5, 10, 50), ("w9", 2, 3, 1, 7), ("far", 3, 2, 0, None), ("w1", 5, 2000, 0, None), ("same", 4, 30, 0, None), ("w1", 5, 0, 0, None), ("w1", 3, 1, 0, None)])
def test_same_rows_as_brute_force(spark, walks, index, ngram, r, limit, begin, end):
    got = skip_index.knn_dtw_indexed(spark, index, ngram, r, limit, begin, end).collect()
    query = walks.filter(F.col("ngram") == ngram).orderBy("id").first()
    want = knn.ranked(knn.squared_sums(walks.filter("series IS NOT NULL").select("id", "ngram", "series"), [query.series], r, begin, end), limit, (end or LENGTH) - begin).collect()
    assert [(x["rank"], x.id, x.ngram) for x in got] == [(x["rank"], x.id, x.ngram) for x in want]
    assert np.allclose([x.distance for x in got], [x.distance for x in want])


def test_what_is_read(spark, index):
    read = skip_index.Read()
    skip_index.knn_dtw_indexed(spark, index, "w3", 5, 5, read=read).collect()
    assert read.rows == 802 and read.files > 10 and read.bytes > 0
    assert read.files_read < read.files / 2 and read.bytes_read < read.bytes / 2
    assert read.bounded <= read.rows_read < read.rows / 2 and read.distances < read.rows / 2 and np.isfinite(read.threshold)


def test_neighbours_of_the_curve_share_files(spark, index):
    files = spark.read.parquet(f"{index}/files")
    assert files.agg(F.sum("rows")).first()[0] == 802 == spark.read.parquet(f"{index}/rows").count()
    boxes = files.filter("hi_s0 < 1e8").select((F.col("hi_s0") - F.col("lo_s0")).alias("w")).agg(F.avg("w")).first()[0]
    spread = spark.read.parquet(f"{index}/rows").filter("s0 < 1e8").agg(F.max("s0") - F.min("s0")).first()[0]
    assert boxes < spread / 3
    hot = files.filter("lo_s0 <= 0 AND hi_s0 >= 0").agg(F.max("rows")).first()[0]
    assert hot < 120  # 200 equal series are parted by their ids


def test_curve(spark):
    cells = spark.createDataFrame([(float(a), float(b)) for a in range(4) for b in range(4)], "a double, b double")
    key = skip_index.curve(["a", "b"], [0.0, 0.0], [4.0, 4.0], 2)
    want = lambda a, b: sum(((int(a) >> k & 1) << (2 * k + 1)) | ((int(b) >> k & 1) << (2 * k)) for k in range(2))
    assert all(r.z == want(r.a, r.b) for r in cells.withColumn("z", key).collect())


def test_wrong_and_empty(spark, walks, index, tmp_path):
    with pytest.raises(KeyError):
        skip_index.knn_dtw_indexed(spark, index, "unknown", 5, 5)
    with pytest.raises(ValueError):
        skip_index.knn_dtw_indexed(spark, index, "w1", 40, 5)
    for wrong in ((63, 8), (64, 7), (64, 128), (64, 32)):
        with pytest.raises(ValueError):
            skip_index.write_index(walks, str(tmp_path), *wrong)
    skip_index.write_index(walks.limit(0), f"{tmp_path}/empty", LENGTH)
    with pytest.raises(KeyError):
        skip_index.knn_dtw_indexed(spark, f"{tmp_path}/empty", "w1", 5, 5)
