"""Nearest series from a table that is laid out so that a query reads only what can be near."""
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.series import matrix
from ..model import check_length, check_range
from ..plans.scratch import materialized
from .knn import envelopes, ranked

SEGMENTS = 8  # coarse means of a series, which its place in the table hangs on
BITS = 6  # of each mean in the sorting key; segments * bits are at most 62
FILE_ROWS = 25_000  # rows that a file has, about
PROBES = 512  # rows of a batch whose distances give the first threshold, those with the least bounds


def names(segments: int) -> list[str]:
    return [f"s{j}" for j in range(segments)]


def segment_means(values: Column, length: int, segments: int) -> list[Column]:
    """The means of equal parts of an array of doubles, in the JVM."""
    rate = length // segments
    return [(F.aggregate(F.slice(values, j * rate + 1, rate), F.lit(0.0), lambda t, v: t + v) / rate).alias(f"s{j}") for j in range(segments)]


def curve(columns: list[str], low: list[float], high: list[float], bits: int = BITS) -> Column:
    """The Z-order key of columns: the bits of their places in [low, high], the highest of each first."""
    cell = lambda c, a, b: F.least(F.greatest(F.floor((F.col(c) - a) * ((1 << bits) / (b - a) if b > a else 0.0)), F.lit(0)), F.lit((1 << bits) - 1)).cast("long")
    cells = [cell(c, a, b) for c, a, b in zip(columns, low, high)]
    key = F.lit(0).cast("long")
    for bit in reversed(range(bits)):
        for c in cells:
            key = F.shiftleft(key, 1).bitwiseOR(F.shiftright(c, bit).bitwiseAND(F.lit(1)))
    return key


def write_index(series: DataFrame, path: str, length: int, segments: int = SEGMENTS, file_rows: int = FILE_ROWS) -> None:
    """Writes series (id, ngram, series) to path/rows, sorted along a Z-order curve of their segments' means, and to path/files
    a row per file with its rows, bytes and the smallest and largest mean of each segment. Any radius can be queried.

    Rows are dealt by ranges of the curve, so a file holds series that are near each other and the files' boxes are small; within a
    file the row groups' own statistics serve the same filters. Cells span the 1st to the 99th percentile of each
    segment, so that a few far values do not make the others one cell. A series that is null is left out."""
    check_length(length)
    check_length(segments)
    if length < segments or segments * BITS > 62:
        raise ValueError(f"a power of two of segments, at most {62 // BITS} and no more than values")
    at = names(segments)
    rows = series.filter("series IS NOT NULL").select("id", "ngram", "series", *segment_means(F.col("series").cast("array<double>"), length, segments))
    spread = rows.agg(F.count("*").alias("n"), *(F.percentile_approx(c, [0.01, 0.99], 1000).alias(c) for c in at)).first()
    low, high = ([float(spread[c][k]) if spread.n else 0.0 for c in at] for k in (0, 1))
    keyed = rows.withColumn("z", curve(at, low, high))
    # the id parts rows of one cell, which may be a third of all
    dealt = keyed.repartitionByRange(max(1, -(-spread.n // file_rows)), "z", "id").sortWithinPartitions("z", "id").drop("z")
    dealt.write.mode("overwrite").option("compression", "lz4").option("parquet.block.size", 8 << 20).parquet(f"{path}/rows")
    written = series.sparkSession.read.parquet(f"{path}/rows")
    of = [f(c).alias(f"{k}_{c}") for c in at for k, f in (("lo", F.min), ("hi", F.max))]
    files = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), F.max("_metadata.file_size").alias("bytes"), *of)
    files.write.mode("overwrite").parquet(f"{path}/files")


@dataclass
class Read:
    """What a query of the index looked at."""

    files: int = 0
    files_read: int = 0
    bytes: int = 0
    bytes_read: int = 0
    rows: int = 0
    rows_read: int = 0
    bounded: int = 0  # rows that passed the bound by segments, whose values went to Python
    distances: int = 0
    threshold: float = float("inf")


def _bound(at: list[str], lo: np.ndarray, hi: np.ndarray, rate: int) -> Column:
    """A lower bound of the squared warping distance: what each segment's mean misses the query's box by. Plain
    columns, so it is compiled with the scan."""
    gaps = [F.greatest(F.col(c) - float(h), F.lit(float(a)) - F.col(c), F.lit(0.0)) for c, a, h in zip(at, lo, hi)]
    total = gaps[0] * gaps[0]
    for g in gaps[1:]:
        total = total + g * g
    return total * rate


def knn_dtw_indexed(spark: SparkSession, path: str, ngram: str, r: int, limit: int, begin: int = 0, end: int | None = None, dtype: str = "float64", read: Read | None = None) -> DataFrame:
    """knn_dtw over [begin, end) from an index: the same rows. read: gets what was read and computed.

    First the query's own file is read, and the nearest others until they have limit rows: the best distances there give a
    threshold. Then only files, row groups and rows whose means lie within that threshold of the query's envelope are read, in Python a closer
    bound by each value (LB_Keogh) goes first, and each task lowers the threshold by what it finds. The query's own row is
    found by its n-gram; segments that [begin, end) holds only in part do not count."""
    rows = spark.read.parquet(f"{path}/rows")
    at = [c for c in rows.columns if c[0] == "s" and c[1:].isdigit()]
    q = rows.filter(F.col("ngram") == ngram).select("series", F.col("_metadata.file_path").alias("file")).first()
    if q is None:
        raise KeyError(f"unknown n-gram: {ngram}")
    length = len(q.series)
    end = length if end is None else end
    check_range(begin, end, length, r)
    read = read if read is not None else Read()
    rate = length // len(at)
    whole = range(-(-begin // rate), max(-(-begin // rate), end // rate))
    own = np.asarray(q.series, dtype=dtype)[begin:end]
    low, high = (x[0] for x in envelopes(own[None, :].astype(np.float64), r))
    part = lambda x, j: x[j * rate - begin : (j + 1) * rate - begin]
    used = [at[j] for j in whole]
    lo, hi = np.array([part(low, j).mean() for j in whole]), np.array([part(high, j).mean() for j in whole])
    slack = 1 + (1e-9 if dtype == "float64" else 1e-4)
    values = F.col("series") if (begin, end) == (0, length) else F.slice("series", begin + 1, end - begin)
    schema = "id long, ngram string, d2 double, n long, dtw long"

    def read_files(chosen: list[str], keep: Sequence[Column] = ()) -> DataFrame:
        source = spark.read.schema(rows.schema).parquet(*chosen) if chosen else rows.limit(0)
        for condition in keep:
            source = source.filter(condition)
        return source.select(F.col("id").cast("long"), "ngram", values.alias("series"))

    def near(tau: float, most: int | None = None):
        """Rows at most tau away and among the best of a task, and a row with its counts. most: rows of a batch that are
        looked at, those with the least bounds."""

        def run(parts):
            import pyarrow as pa

            seen = np.full(max(0, limit), tau)
            total = done = 0
            for batch in parts:
                total += batch.num_rows
                if not batch.num_rows or not limit:
                    continue
                x = matrix(batch.column(2)).astype(dtype, copy=False)
                gap = np.maximum(x - high.astype(dtype), low.astype(dtype) - x)
                np.maximum(gap, 0, out=gap)
                bound = np.einsum("ij,ij->i", gap, gap)
                order = np.flatnonzero(bound <= seen[-1] * slack)
                order = order[np.argsort(bound[order], kind="stable")]
                kept, found = [], []
                for k in range(0, len(order[:most]), 512):
                    some = order[k : k + 512]
                    some = some[bound[some] <= seen[-1] * slack]
                    if not len(some):
                        break
                    d2 = kernels.batches(own, x[some], r).astype(np.float64)
                    done += len(some)
                    seen = np.sort(np.concatenate([seen, d2]))[:limit]
                    kept.append(some)
                    found.append(d2)
                if kept:
                    kept, found = np.concatenate(kept), np.concatenate(found)
                    best = found <= seen[-1] * slack
                    take, n = pa.array(kept[best]), int(best.sum())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(found[best]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=["id", "ngram", "d2", "n", "dtw"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.float64()), pa.array([total]), pa.array([done])], names=["id", "ngram", "d2", "n", "dtw"])

        return run

    files = spark.read.parquet(f"{path}/files").collect()  # a row per file
    read.files, read.bytes, read.rows = len(files), sum(f.bytes for f in files), sum(f.rows for f in files)
    gaps = np.array([[max(f[f"lo_{c}"] - b, a - f[f"hi_{c}"], 0.0) for c, a, b in zip(used, lo, hi)] for f in files]).reshape(len(files), len(used))
    apart = rate * (gaps * gaps).sum(axis=1)

    # Phase A: a threshold from the files around the query.
    probed, held = [], 0
    for k in np.lexsort([apart, [f.file != q.file for f in files]]):
        if probed and held >= limit:
            break
        probed.append(files[k].file)
        held += files[k].rows
    found = read_files(probed).mapInArrow(near(np.inf, PROBES), schema).select("d2", "dtw").collect()
    first = np.sort([f.d2 for f in found if f.d2 is not None])
    read.distances += sum(f.dtw for f in found if f.dtw is not None)
    tau = float(first[limit - 1]) * slack if 0 < limit <= len(first) else float("inf")
    read.threshold = tau

    # Phase B: files by their boxes, row groups and rows by plain ranges, then the bound by all segments.
    hit = [f for f, a in zip(files, apart) if a <= tau]
    read.files_read, read.bytes_read, read.rows_read = len(hit), sum(f.bytes for f in hit), sum(f.rows for f in hit)
    reach = (tau / rate) ** 0.5
    keep = []
    if np.isfinite(reach):
        keep = [(F.col(c) <= float(b) + reach) & (F.col(c) >= float(a) - reach) for c, a, b in zip(used, lo, hi)]
        keep += [_bound(used, lo, hi, rate) <= tau] if used else []
    out = read_files([f.file for f in hit], keep).mapInArrow(near(tau), schema)
    out = materialized(out, "indexed")
    counts = out.filter("n IS NOT NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("dtw"), F.lit(0))).first()
    read.bounded += counts[0]
    read.distances += counts[1]
    return ranked(out.filter("n IS NULL").select("id", "ngram", "d2"), limit, end - begin)
