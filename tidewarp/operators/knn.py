"""Neighbours by dynamic time warping: exhaustive, and exactly pruned by lower bounds."""
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..functions.series import lists, matrix, squared_distance, transformed
from ..model import check_length, check_range, series_of
from ..plans.scratch import materialized

DTYPE = "float64"  # of the warping sums; float32 halves memory traffic


def squared_sums(series: DataFrame, queries: Sequence[Sequence[float]], r: int, begin: int = 0, end: int | None = None, point: str | kernels.Point = "square", combine: str = "sum", dtype: str = DTYPE, best: int | None = None) -> DataFrame:
    """series with d2: the squared banded distance over [begin, end) to the query, summed over the
    queries; with combine="sum_sqrt" the square of the sum of distances. point: the distance of two values,
    by name or a function of two arrays. best: of a batch only the rows that can be among so many nearest
    ones are returned. The sub-range is sliced in the JVM, before values go to Python;
    nothing shuffles: queries are sent along."""
    length = len(queries[0])
    end = length if end is None else end
    check_range(begin, end, length, r)
    if combine not in ("sum", "sum_sqrt"):
        raise ValueError("combine is sum or sum_sqrt")
    own = [np.asarray(q[begin:end], dtype=dtype) for q in queries]
    measure, others = kernels.point_distance(point), [c for c in series.columns if c != "series"]
    values = F.col("series") if (begin, end) == (0, length) else F.slice("series", begin + 1, end - begin)
    floats = series.schema["series"].dataType.simpleString() in ("array<float>", "array<double>")
    source = series.select(*others, (values if floats else values.cast("array<double>")).alias("series"))
    schema = source.drop("series").withColumn("d2", F.lit(0.0)).schema

    def run(parts):
        import pyarrow as pa

        for batch in parts:
            at = batch.schema.get_field_index("series")
            rows = matrix(batch.column(at)).astype(dtype, copy=False)
            if not len(rows):
                continue
            d2 = [kernels.batches(q, rows, r, measure).astype(np.float64) for q in own]
            total = sum(d2) if combine == "sum" else sum(np.sqrt(d) for d in d2) ** 2
            kept = [batch.column(i) for i in range(batch.num_columns) if i != at]
            if best is not None and best < len(total):
                near = np.flatnonzero(total <= np.partition(total, best - 1)[best - 1]) if best > 0 else np.zeros(0, dtype=int)
                kept, total = [c.take(pa.array(near)) for c in kept], total[near]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(total)], names=schema.names)

    return source.mapInArrow(run, schema)


def dtw_distances(series: DataFrame, ngram: str, r: int, begin: int = 0, end: int | None = None, dtype: str = DTYPE, point: str | kernels.Point = "square") -> DataFrame:
    """id, ngram, distance of every series to one: the root of the mean squared distance on the path."""
    query = series_of(series, [ngram])[ngram][1]
    length = (len(query) if end is None else end) - begin
    out = squared_sums(series.select("id", "ngram", "series"), [query], r, begin, end, point, dtype=dtype)
    return out.select("id", "ngram", F.sqrt(F.col("d2") / length).alias("distance"))


def ranked(distances: DataFrame, limit: int | None, length: int) -> DataFrame:
    """rank (from 0), ngram, id, distance by (d2, id). With a limit only that many rows are sorted, and
    numbered, in one task; each task sends its own best ones."""
    if limit is not None:
        top = distances.orderBy("d2", "id").limit(max(0, limit))
        rank = F.row_number().over(Window.orderBy("d2", "id")) - 1
        return top.select(rank.alias("rank"), "ngram", "id", F.sqrt(F.col("d2") / length).alias("distance"))
    return full_ranks(distances.select("id", "ngram", "d2")).select("rank", "ngram", "id", F.sqrt(F.col("d2") / length).alias("distance"))


def full_ranks(distances: DataFrame) -> DataFrame:
    """distances with rank (from 0) by (d2, id) of all rows. Range partitions of (d2, id) are numbered
    inside and offset by the sizes of those before: no task sorts all rows."""
    ranged = distances.repartitionByRange("d2", "id").sortWithinPartitions("d2", "id").withColumn("m", F.monotonically_increasing_id())
    ranged = ranged.withColumns({"p": F.shiftright("m", 33), "k": F.col("m").bitwiseAND(F.lit((1 << 33) - 1))}).drop("m")
    ranged = materialized(ranged, "ranks")
    offsets = ranged.groupBy("p").count().withColumn("at", F.sum("count").over(Window.orderBy("p")) - F.col("count")).select("p", "at")
    return ranged.join(F.broadcast(offsets), "p").withColumn("rank", F.col("at") + F.col("k")).drop("p", "k", "at")


def curvature(ranks: DataFrame, space: str = "squared") -> DataFrame:
    """rank, g2: the second derivative that the automatic limit looks at. With distances d in order from
    rank 1 on (rank 0 is the query): n = d - d[1], g = gradient(n) / n, g2 = gradient(g). space: squared
    distances over all ranks, or rooted ones over the first half. Not finite values are null."""
    if space not in ("squared", "rooted"):
        raise ValueError("space is squared or rooted")
    d = F.col("d2") if space == "squared" else F.sqrt("d2")
    rows = ranks.select("rank", d.alias("d")).filter("rank >= 1")
    n = ranks.count()
    if space == "rooted":
        rows = rows.filter(F.col("rank") < round(n / 2))
    last = n - 1 if space == "squared" else round(n / 2) - 1
    first = rows.filter("rank = 1").select(F.col("d").alias("d1"))
    rows = rows.join(F.broadcast(first)).withColumn("n", F.col("d") - F.col("d1")).select("rank", "n")
    g = neighbours(rows, "n", 1, last).withColumn("g", F.try_divide("slope", "n")).select("rank", "g")
    return neighbours(g, "g", 1, last).select("rank", F.when(F.isnan("slope"), None).otherwise(F.col("slope")).alias("g2"))


def neighbours(rows: DataFrame, column: str, first: int, last: int) -> DataFrame:
    """rows with slope: half the difference of the values at the ranks next to each, at the ends the
    difference to the one. Joined on ranks instead of one window over all rows."""
    shifted = lambda by, name: rows.select((F.col("rank") + by).alias("rank"), F.col(column).alias(name))
    both = rows.join(shifted(1, "before"), "rank", "left").join(shifted(-1, "after"), "rank", "left")
    here = F.col(column)
    slope = F.when(F.col("rank") == first, F.col("after") - here).when(F.col("rank") == last, here - F.col("before")).otherwise((F.col("after") - F.col("before")) / 2)
    return both.withColumn("slope", slope).drop("before", "after")


def auto_limit(ranks: DataFrame, space: str = "squared") -> int:
    """How many neighbours stand out, the query among them: the rank with the largest finite g2, the
    first of equal ones, up to half of all; 1 if none is finite."""
    n = ranks.count()
    best = curvature(ranks, space).filter((F.col("rank") >= 2) & (F.col("rank") <= n // 2) & F.col("g2").isNotNull()).orderBy(F.col("g2").desc(), "rank").limit(1).first()
    return 1 if best is None else int(best.rank)


def knn_dtw(series: DataFrame, ngrams: Sequence[str], r: int, limit: int | None = None, begin: int = 0, end: int | None = None, combine: str = "sum", dtype: str = DTYPE, point: str | kernels.Point = "square") -> DataFrame:
    """rank, ngram, id, distance of the nearest series to one or more n-grams together. Without a limit
    it is found automatically."""
    queries = [v for _, v in series_of(series, list(ngrams)).values()]
    length = (len(queries[0]) if end is None else end) - begin
    d2 = squared_sums(series.select("id", "ngram", "series"), queries, r, begin, end, point, combine, dtype, limit)
    if limit is None:
        ranks = full_ranks(d2)
        limit = auto_limit(ranks)
        return ranks.filter(F.col("rank") < limit).select("rank", "ngram", "id", F.sqrt(F.col("d2") / length).alias("distance"))
    return ranked(d2, limit, length)


def knn_euclid(series: DataFrame, ngram: str, transform: str = "id", norm: str = "id", limit: int | None = None, distance: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """rank, ngram, id, distance (squared Euclidean) after transforming both sides. distance: another one, a
    function of a matrix with a series per row and the query's values to a distance per row."""
    rows = transformed(series.select("id", "ngram", "series"), transform, norm)
    query = series_of(rows, [ngram])[ngram][1]
    if distance is None:
        d2 = rows.select("id", "ngram", squared_distance(F.col("series"), F.array(*map(F.lit, query))).alias("d2"))
    else:
        own = np.asarray(query, dtype=np.float64)

        def run(parts):
            import pyarrow as pa

            for batch in parts:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.asarray(distance(matrix(batch.column(2)).astype(np.float64), own), dtype=np.float64))], names=["id", "ngram", "d2"])

        d2 = rows.mapInArrow(run, rows.select("id", "ngram", F.lit(0.0).alias("d2")).schema)
    if limit is None:
        return full_ranks(d2).select("rank", "ngram", "id", F.col("d2").alias("distance"))
    rank = F.row_number().over(Window.orderBy("d2", "id")) - 1
    return d2.orderBy("d2", "id").limit(limit).select(rank.alias("rank"), "ngram", "id", F.col("d2").alias("distance"))


# Lower bounds


def bound_index(series: DataFrame, r: int, length: int, resolution: int = 64) -> DataFrame:
    """series with the means of resolution segments (down), the smallest and largest value of the
    r-envelope in each (lo, hi), and r and resolution, which a query checks."""
    check_length(length)
    check_length(resolution)
    if length < resolution or not 0 <= r <= length // 2:
        raise ValueError("series are at least as long as the resolution, and the radius is at most half of that")
    rate = length // resolution

    def run(parts):
        import pyarrow as pa

        for batch in parts:
            rows = matrix(batch.column(batch.schema.get_field_index("series"))).astype(np.float64)
            if not len(rows):
                continue
            low, high = envelopes(rows, r)
            part = lambda x: x.reshape(len(rows), resolution, rate)
            more = [lists(part(rows).mean(axis=2)), lists(part(low).min(axis=2)), lists(part(high).max(axis=2)), *(pa.array(np.full(len(rows), k, dtype=np.int32)) for k in (r, resolution))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "down", "lo", "hi", "r", "resolution"])

    more = [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("down", "lo", "hi")] + [T.StructField(n, T.IntegerType()) for n in ("r", "resolution")]
    return series.mapInArrow(run, T.StructType([*series.schema.fields, *more]))


def envelopes(rows: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest of each value and its r neighbours on either side. Windows double until two overlapping ones
    make up one of 2r + 1 values, so the cost grows with the logarithm of r."""
    n, length = rows.shape
    r = min(r, length - 1)
    width, out = 2 * r + 1, []
    for fold, beyond in ((np.minimum, np.inf), (np.maximum, -np.inf)):
        window = np.full((n, length + 2 * r), beyond, dtype=rows.dtype)
        window[:, r : r + length] = rows
        size = 1
        while 2 * size <= width:
            window, size = fold(window[:, :-size], window[:, size:]), 2 * size
        out.append(fold(window[:, :length], window[:, width - size : width - size + length]))
    return out[0], out[1]


def box_bound(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
    """Squared distance of two boxes."""
    gap = F.zip_with(F.zip_with(lo, other_hi, lambda a, b: a - b), F.zip_with(other_lo, hi, lambda a, b: a - b), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(gap, F.lit(0.0), lambda s, v: s + v * v)


def point_bound(down: Column, lo: Column, hi: Column) -> Column:
    """Squared distance of a point and a box."""
    return box_bound(down, down, lo, hi)


def bounds(index: DataFrame, ngram: str, r: int) -> DataFrame:
    """index with lb (point to box) and mindist (box to box), both scaled to bound the squared warping
    distance from below. A query whose radius is not the index's is refused."""
    q = index.filter(F.col("ngram") == ngram).select("lo", "hi", "r", "resolution", F.size("series").alias("n")).first()
    if q is None:
        raise KeyError(f"unknown n-gram: {ngram}")
    if q.r != r:
        raise ValueError(f"the index is for radius {q.r}, not {r}")
    lo, hi = F.array(*map(F.lit, q.lo)), F.array(*map(F.lit, q.hi))
    rate = q.n // q.resolution
    return index.withColumns({"lb": rate * point_bound(F.col("down"), lo, hi), "mindist": rate * box_bound(F.col("lo"), F.col("hi"), lo, hi)})


def knn_dtw_pruned(index: DataFrame, ngram: str, r: int, limit: int, stats: dict | None = None, dtype: str = DTYPE, begin: int = 0, end: int | None = None) -> DataFrame:
    """knn_dtw over [begin, end), computing only the distances that can matter. stats: gets n and the number
    of distances computed.

    One pass and one job: each task takes a batch's rows in the order of their bounds from the index, then
    of those that remain by a closer bound (what each value misses the query's envelope by, LB_Keogh), and computes
    distances while bounds are under the limit-th best distance that it has seen. Only rows that are among a
    task's best leave it. Over a sub-range the index bounds with the segments that lie inside."""
    q = index.filter(F.col("ngram") == ngram).select("series", "lo", "hi", "r", "resolution").first()
    if q is None:
        raise KeyError(f"unknown n-gram: {ngram}")
    if q.r != r:
        raise ValueError(f"the index is for radius {q.r}, not {r}")
    length = len(q.series)
    end = length if end is None else end
    check_range(begin, end, length, r)
    rate = length // q.resolution
    inside = slice(-(-begin // rate), max(-(-begin // rate), end // rate))
    lo, hi = np.array(q.lo, dtype=dtype)[inside], np.array(q.hi, dtype=dtype)[inside]
    own = np.asarray(q.series, dtype=dtype)[begin:end]
    low, high = (x[0] for x in envelopes(own[None, :], r))
    slack = 1 + (1e-9 if dtype == "float64" else 1e-4)
    values = F.col("series") if (begin, end) == (0, length) else F.slice("series", begin + 1, end - begin)

    def run(parts):
        import pyarrow as pa

        seen = np.full(max(0, limit), np.inf)  # the best distances of this task
        total = done = 0
        for batch in parts:
            total += batch.num_rows
            if not batch.num_rows or not limit:
                continue
            tau = seen[-1] * slack
            down = matrix(batch.column(3)).astype(dtype, copy=False)[:, inside]
            gap = np.maximum(np.maximum(down - hi, lo - down), 0)
            at = np.flatnonzero(rate * np.einsum("ij,ij->i", gap, gap) <= tau)
            rows = matrix(batch.column(2)).astype(dtype, copy=False)
            rows = rows if len(at) == len(rows) else rows[at]
            gap = np.maximum(np.maximum(rows - high, low - rows), 0)
            bound = np.einsum("ij,ij->i", gap, gap)
            order = np.argsort(bound, kind="stable")
            kept, found = [], []
            for k in range(0, len(order), 512):
                part = order[k : k + 512]
                part = part[bound[part] <= seen[-1] * slack]
                if not len(part):
                    break
                d2 = kernels.batches(own, rows[part], r).astype(np.float64)
                done += len(part)
                seen = np.sort(np.concatenate([seen, d2]))[:limit]
                kept.append(at[part])
                found.append(d2)
            if kept:
                kept, found = np.concatenate(kept), np.concatenate(found)
                best = found <= seen[-1]
                take = pa.array(kept[best])
                n = int(best.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(found[best]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=["id", "ngram", "d2", "n", "dtw"])
        if stats is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.float64()), pa.array([total]), pa.array([done])], names=["id", "ngram", "d2", "n", "dtw"])

    out = index.select(F.col("id").cast("long"), "ngram", values.alias("series"), "down").mapInArrow(run, "id long, ngram string, d2 double, n long, dtw long")
    if stats is not None:
        out = materialized(out, "pruned")
        sums = out.filter("n IS NOT NULL").agg(F.sum("n").alias("n"), F.sum("dtw").alias("dtw")).first()
        stats.update(n=sums.n or 0, dtw=sums.dtw or 0)
        out = out.filter("n IS NULL")
    return ranked(out.select("id", "ngram", "d2"), limit, end - begin)


# Alignments


ALIGNMENT = "struct<cost:double,first:array<int>,second:array<int>>"


def alignment(point: str | kernels.Point = "square", radius: int | None = None):
    """A column function of two arrays (of any lengths): the cost and the path (positions from 1) of their
    unconstrained alignment, or the approximate one of radius. point may be poisson, or a function of two
    arrays of values. Pairs of a batch with the same lengths are aligned together."""
    import pandas as pd

    @F.pandas_udf(ALIGNMENT)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = kernels.together(list(a), list(b), point) if radius is None else kernels.fast_together(list(a), list(b), radius, point)
        return pd.DataFrame({"cost": [f[0] for f in found], "first": [f[1] for f in found], "second": [f[2] for f in found]})

    return run


def windowed_alignment(point: str | kernels.Point = "square"):
    """A column function of two arrays and, per element of the first, the first and last position (from 1) in
    the second that it may meet: cost and path of the best alignment inside that window. A window that
    misses a corner, or has not an entry per element, fails."""
    import pandas as pd

    @F.pandas_udf(ALIGNMENT)
    def run(a: pd.Series, b: pd.Series, low: pd.Series, high: pd.Series) -> pd.DataFrame:
        found = kernels.together(list(a), list(b), point, list(low), list(high))
        return pd.DataFrame({"cost": [f[0] for f in found], "first": [f[1] for f in found], "second": [f[2] for f in found]})

    return run


def alignment_frame(pairs: DataFrame, found: str = "a") -> DataFrame:
    """id, step, i, j, x, y: the aligned pairs of values, one row per step of a path, for drawing. pairs: id,
    first and second series as a_values and b_values, and the alignment found."""
    steps = pairs.select("id", "a_values", "b_values", F.posexplode(F.arrays_zip(F.col(f"{found}.first").alias("i"), F.col(f"{found}.second").alias("j"))).alias("step", "at"))
    return steps.select("id", "step", F.col("at.i").alias("i"), F.col("at.j").alias("j"), F.get("a_values", F.col("at.i") - 1).alias("x"), F.get("b_values", F.col("at.j") - 1).alias("y"))


def speed_test(sizes: Sequence[int], radius: int, times: int = 3, seed: int = 0) -> list[tuple[int, float, float, float]]:
    """(size, exact seconds, approximate seconds, approximate cost over exact) of random walks of each size,
    seconds averaged over times."""
    import time

    rng = np.random.default_rng(seed)
    out = []
    for n in sizes:
        x, y = rng.standard_normal((2, n)).cumsum(axis=1)
        took, cost = [0.0, 0.0], [0.0, 0.0]
        for _ in range(times):
            for k, run in enumerate((lambda: kernels.dtw(x, y), lambda: kernels.fast(x, y, radius))):
                began = time.perf_counter()
                cost[k] = run()[0]
                took[k] += (time.perf_counter() - began) / times
        out.append((n, *took, cost[1] / cost[0] if cost[0] else 1.0))
    return out


def barycenter(series: DataFrame, iterations: int = 5) -> list[float]:
    """The average sequence of all series under warping: starts from the one with the smallest id, and so
    many times takes the mean of what each of its elements is aligned to. Per round each task aligns its
    series and sums per element; only those sums, a row per element and task, are exchanged."""
    start = series.orderBy("id").limit(1).select("series").first()
    if start is None:
        return []
    average = list(start.series)
    for _ in range(iterations):
        now = np.asarray(average)

        def run(parts, now=now):
            import pyarrow as pa

            total, count = np.zeros(len(now)), np.zeros(len(now), dtype=np.int64)
            for batch in parts:
                rows = [row.values.to_numpy(zero_copy_only=False) for row in batch.column(0)]
                for values, (_, here, there) in zip(rows, kernels.together([now] * len(rows), rows)):
                    np.add.at(total, here - 1, values[there - 1])
                    np.add.at(count, here - 1, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(now), dtype=np.int32)), pa.array(total), pa.array(count)], names=["pos", "total", "n"])

        sums = series.select(F.col("series").cast("array<double>")).mapInArrow(run, "pos int, total double, n long")
        average = [r.v for r in sums.groupBy("pos").agg((F.sum("total") / F.sum("n")).alias("v")).orderBy("pos").collect()]  # a row per element
    return average


def barycenters(series: DataFrame, by: str, iterations: int = 5) -> DataFrame:
    """by, n, series: the barycenter of each group of series (by, id, series) and the number of its members. A group starts from its
    series with the smallest id (null ids last), and all groups take the same number of rounds, in one pass each. Null series
    are left out; a null group is a group. Lengths may differ, also inside a group.

    Averages are a table, a row per group; each row of series meets its group's. Tasks sum per group and element of the average in each
    batch, so a group that holds a third of all rows leaves a task as one row an element. Beyond what is broadcast, the join has two written
    sides, and adaptive execution splits a hot group."""
    rows = series.filter("series IS NOT NULL").select(F.col(by).alias("__group"), "id", F.col("series").cast("array<double>").alias("series"))
    first = F.min_by("series", F.struct(F.col("id").isNull(), "id"))
    averages = materialized(rows.groupBy("__group").agg(first.alias("average"), F.count("*").alias("n")), "barycenters")
    for _ in range(iterations):
        met = rows.join(averages.select(F.col("__group").alias("__of"), "average"), F.col("__group").eqNullSafe(F.col("__of")))
        sums = met.select(F.to_json(F.struct("__group")).alias("key"), "series", "average").mapInArrow(_aligned_sums, "key string, pos int, total double, n long")
        means = sums.groupBy("key", "pos").agg((F.sum("total") / F.sum("n")).alias("v"))
        # a group's average has as many elements as one of its series
        means = means.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("at")).select("key", F.col("at.v").alias("average"))
        averages = materialized(averages.select("__group", "n", "average", F.to_json(F.struct("__group")).alias("key")).join(means.withColumnRenamed("average", "moved"), "key", "left").select("__group", F.coalesce("moved", "average").alias("average"), "n"), "barycenters")
    return averages.select(F.col("__group").alias(by), "n", F.col("average").alias("series"))


def _aligned_sums(parts):
    """Of batches (key, series, average) the sums and counts, per key and element of the average, of the values aligned to it."""
    import pyarrow as pa

    for batch in parts:
        if not batch.num_rows:
            continue
        keys, encoded = np.unique(np.array(batch.column(0).to_pylist(), dtype=object), return_inverse=True)
        rows, own = ([row.values.to_numpy(zero_copy_only=False) for row in batch.column(k)] for k in (1, 2))
        used = [k for k in range(len(rows)) if len(rows[k]) and len(own[k])]
        width = max((len(o) for o in own), default=0)
        total, count = np.zeros((len(keys), width)), np.zeros((len(keys), width), dtype=np.int64)
        for k, (_, here, there) in zip(used, kernels.together([own[k] for k in used], [rows[k] for k in used])):
            np.add.at(total[encoded[k]], here - 1, rows[k][there - 1])
            np.add.at(count[encoded[k]], here - 1, 1)
        at, pos = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(keys[at], pa.string()), pa.array(pos, pa.int32()), pa.array(total[at, pos]), pa.array(count[at, pos])], names=["key", "pos", "total", "n"])
