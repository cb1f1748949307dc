"""How compression and radii change distances and ranks; histograms and totals."""
import itertools
import statistics
import time
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import gauss, gradient, gradient_colors, matrix, sliced, smoothed, spectrum

PICTURE_KERNEL = gauss(14, 10.0)
QUANTILES = (0.02, 0.09, 0.25, 0.45, 0.5, 0.55, 0.75, 0.91, 0.98)


def zero_to_one(x: Column) -> Column:
    return F.when(x == 0, F.lit(1.0)).otherwise(x)


def relative_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, delta: (after - before) / before of the distances of each id, over 1 where before is 0."""
    a, b = before.select("id", F.col("distance").alias("a")), after.select("id", F.col("distance").alias("b"))
    return a.join(b, "id").select("id", ((F.col("b") - F.col("a")) / zero_to_one(F.col("a"))).alias("delta"))


def summary(values: DataFrame, column: str = "delta") -> DataFrame:
    """mean, std (of a sample), min, max and exact quantiles with linear interpolation."""
    names = [f"q{int(round(1000 * q)):03d}" for q in QUANTILES]
    exact = [F.percentile(column, q).alias(n) for q, n in zip(QUANTILES, names)]
    return values.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"), *exact)


def rank_changes(reference: DataFrame, other: DataFrame, limit: int) -> DataFrame:
    """rank_similarity, rank_distance and new_share of two results (rank, id). Ids are recoded to
    characters in the order in which they are first seen, the reference first; a shorter list is filled
    with ids of its own. The distance is the Levenshtein distance over the length; new_share is the share
    of ids that the reference has not."""
    ref = reference.filter(F.col("rank") < limit).select(F.lit(0).alias("side"), F.col("rank").cast("long").alias("rank"), F.col("id").cast("long").alias("id"))
    new = other.filter(F.col("rank") < limit).select(F.lit(1).alias("side"), F.col("rank").cast("long").alias("rank"), F.col("id").cast("long").alias("id"))
    both = ref.unionByName(new)
    first = both.groupBy("id").agg(F.min(F.struct("side", "rank")).alias("at"))
    code = first.select("id", F.col("at.side").alias("first_side"), (F.row_number().over(Window.orderBy("at"))).alias("code"))
    # Codes are characters from U+4E00 on, which need no surrogate pairs.
    rows = both.join(code, "id").select("side", "rank", "first_side", "code")
    text = lambda side: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("rank", "code")))), lambda s: F.decode(F.unhex(F.lpad(F.hex(s["code"] + 0x4E00), 4, "0")), "UTF-16BE")), "")
    out = rows.agg(text(0).alias("a"), text(1).alias("b"), F.count_if((F.col("side") == 1) & (F.col("first_side") == 1)).alias("new"))
    n = F.greatest(F.char_length("a"), F.char_length("b"))
    filled = F.concat("b", F.repeat(F.decode(F.unhex(F.lit("4DFF")), "UTF-16BE"), (n - F.char_length("b")).cast("int")))
    missing = n - F.char_length("b")
    distance = F.try_divide(F.levenshtein("a", filled), n)
    return out.select((1 - distance).alias("rank_similarity"), distance.alias("rank_distance"), F.try_divide(F.col("new") + missing, n).alias("new_share"))


def histogram(values: DataFrame, column: str, width: float) -> DataFrame:
    """bin (its lower end), n."""
    return values.groupBy((F.floor(F.col(column) / width) * width).alias("bin")).agg(F.count("*").alias("n"))


def per_year(counts: DataFrame, value: str = "var0") -> DataFrame:
    """y, total: sums over all series of a long table."""
    return counts.groupBy("y").agg(F.sum(value).alias("total"))


def relative_counts(counts: DataFrame, value: str = "var0") -> DataFrame:
    """id, y, share of all counts of the year."""
    return counts.join(F.broadcast(per_year(counts, value)), "y").select("id", "y", (F.col(value) / F.col("total")).alias("share"))


def extrema(series: DataFrame) -> DataFrame:
    """id, y, kind: where the values' slope changes its sign, 1 for a maximum and -1 for a minimum."""
    values = series.select("id", F.posexplode("series").alias("y", "v"))
    w = Window.partitionBy("id").orderBy("y")
    steps = values.withColumns({"up": F.signum(F.col("v") - F.lag("v").over(w)), "next": F.signum(F.lead("v").over(w) - F.col("v"))})
    return steps.filter(F.col("up") * F.col("next") < 0).select("id", "y", F.col("up").cast("int").alias("kind"))


def mean_spectrum(spectra: DataFrame) -> DataFrame:
    """frequency (from 1), mean, std over all series."""
    return spectra.select(F.posexplode("series").alias("k", "v")).groupBy((F.col("k") + 1).alias("frequency")).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))


def sweep(run: Callable[..., DataFrame], grid: Mapping[str, Sequence]) -> DataFrame:
    """The rows of run(**parameters) for every combination of a grid, with the parameters as columns."""
    out = None
    for values in itertools.product(*grid.values()):
        now = run(**dict(zip(grid, values))).withColumns({k: F.lit(v) for k, v in zip(grid, values)})
        out = now if out is None else out.unionByName(now)
    return out


def timed_sweep(run: Callable[..., DataFrame], grid: Mapping[str, Sequence], times: int = 20) -> list[dict]:
    """The parameters of every combination, with the mean and the standard deviation of the seconds of so
    many runs. Rows are computed and thrown away."""
    out = []
    for values in itertools.product(*grid.values()):
        took = []
        for _ in range(times):
            began = time.perf_counter()
            run(**dict(zip(grid, values))).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        out.append(dict(zip(grid, values)) | {"mean": statistics.fmean(took), "std": statistics.stdev(took) if times > 1 else 0.0})
    return out


def against_gold(results: DataFrame, gold: DataFrame, limit: int = 20) -> DataFrame:
    """query, r, rank_similarity, rank_distance, new_share of results (query, r, rank, id) against reference
    lists (query, r, ids). A job per reference list: they are few."""
    out = None
    for row in gold.select("query", "r", "ids").collect():
        reference = gold.filter((F.col("query") == row.query) & (F.col("r") == row.r)).select(F.posexplode("ids").alias("rank", "id"))
        now = rank_changes(reference, results.filter((F.col("query") == row.query) & (F.col("r") == row.r)), limit)
        now = now.select(F.lit(row.query).alias("query"), F.lit(row.r).alias("r"), *now.columns)
        out = now if out is None else out.unionByName(now)
    return out


def plot_frame(series: DataFrame, ngrams: Sequence[str], first_x: int = 0) -> DataFrame:
    """x, y, label: the values of some n-grams, for drawing."""
    rows = series.filter(F.col("ngram").isin(list(ngrams))).select("ngram", F.posexplode("series").alias("k", "y"))
    return rows.select((F.col("k") + first_x).alias("x"), "y", F.col("ngram").alias("label"))


def frequency_frame(series: DataFrame, ngrams: Sequence[str]) -> DataFrame:
    """x (frequency, from 1), y (amplitude), label: the spectra of some n-grams, for drawing."""
    some = series.filter(F.col("ngram").isin(list(ngrams)))
    rows = spectrum(some).join(some.select("id", "ngram"), "id").select("ngram", F.posexplode("series").alias("k", "y"))
    return rows.select((F.col("k") + 1).alias("x"), "y", F.col("ngram").alias("label"))


def picture_frame(series: DataFrame, begin: int, end: int) -> DataFrame:
    """id, x, r, g, b: a column of pixels per series, coloured by its gradient and its smoothed gradient, both
    over its largest absolute value. A series that sums to 0 over the range is black."""

    def run(parts):
        import pyarrow as pa

        for batch in sliced(parts):
            rows = matrix(batch.column(1))[:, begin:end].astype(np.float64)
            none = rows.sum(axis=1) == 0
            most = np.abs(rows).max(axis=1, keepdims=True)
            most[most == 0] = 1
            rgb = gradient_colors(gradient(rows) / most, gradient(smoothed(rows, PICTURE_KERNEL)) / most)
            rgb = np.where(none[None, :, None], 0.0, rgb)
            n = rows.shape[1]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(rows)), n)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(begin, end, dtype=np.int32), len(rows))), *(pa.array(np.ascontiguousarray(c).ravel()) for c in rgb)], names=["id", "x", "r", "g", "b"])

    return series.select(F.col("id").cast("long"), F.col("series").cast("array<double>")).mapInArrow(run, "id long, x int, r double, g double, b double")
