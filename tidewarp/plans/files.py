"""Queries that write a file of each format and read it again, and queries over reports, sweeps and frames."""
import math
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import series as fs
from ..functions import text
from ..operators import knn, metrics, wavelet
from ..sources import ngrams
from .catalog import EMBEDDED, ENTRIES, EVENTS, LENGTH, ORACLES, QUERY, R6, UNCLEAN, UNROLL, _two_radii, embedded, entries, event_counts, event_series, query, rounded, smoothed_sql, table, warping_sql
from .scratch import removed_later, shared_dir


def _file(spark: SparkSession, label: str) -> str:
    return removed_later(spark, f"{shared_dir(spark)}/tidewarp-{label}-{uuid.uuid4().hex}")


@query(f"WITH {ENTRIES} SELECT ngram, year, var0, var1 FROM en")
def entries_file(spark, sf_dir):
    at = _file(spark, "entries")
    ngrams.write_entries(entries(spark, sf_dir), at)
    return ngrams.read_entries(spark, at)


@query(ORACLES["ngram_map"])
def map_file(spark, sf_dir):
    at = _file(spark, "map")
    ngrams.write_map(entries(spark, sf_dir), at)
    return ngrams.read_map(spark, at)


def _prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transition map: words to their first three letters."""
    words = entries(spark, sf_dir).filter(text.clean(F.col("ngram"))).select(F.lower("ngram").alias("ngram")).distinct()
    at = _file(spark, "transitions")
    ngrams.write_transitions(words.withColumn("stem", F.substring("ngram", 1, 3)), at)
    return ngrams.read_transitions(spark, at)


PREFIXES = f"tr AS (SELECT DISTINCT lower(ngram) AS ngram, substr(lower(ngram), 1, 3) AS stem FROM en WHERE NOT regexp_matches(ngram, '{UNCLEAN}'))"


@query(f"WITH {ENTRIES}, {PREFIXES} SELECT ngram, stem FROM tr")
def transitions_file(spark, sf_dir):
    return _prefixes(spark, sf_dir)


@query(f"WITH {ENTRIES}, {PREFIXES} SELECT DISTINCT stem FROM tr")
def stem_list(spark, sf_dir):
    return ngrams.stems(_prefixes(spark, sf_dir))


@query(f"WITH {ENTRIES}, {PREFIXES}, w AS (SELECT max(ngram) AS ngram FROM tr) SELECT ngram, stem FROM tr JOIN w USING (ngram)")
def transition_lookup(spark, sf_dir):
    rows = _prefixes(spark, sf_dir)
    last = rows.agg(F.max("ngram").alias("ngram")).first().ngram
    return spark.createDataFrame([(last, ngrams.transition_of(rows, last))], "ngram string, stem string")


@query(f"WITH {EVENTS} " + UNROLL.format("(SELECT row_number() OVER (ORDER BY id) - 1 AS id, series AS x FROM es)", LENGTH))
def matrix_file(spark, sf_dir):
    at = _file(spark, "matrix")
    ngrams.write_matrix(event_series(spark, sf_dir), at)
    return rounded(ngrams.read_matrix(spark, at, LENGTH))


@query(f"WITH RECURSIVE {EMBEDDED},\n" + warping_sql("SELECT s.id, q.series AS a, s.series AS b FROM es s, (SELECT series FROM es WHERE id = 0) q", 64, 5) + "\nSELECT row_number() OVER (ORDER BY id) - 1 AS id, round(sqrt(d2 / 64), 6) AS distance FROM d2")
def distances_file(spark, sf_dir):
    at = _file(spark, "distances")
    ngrams.write_distances(knn.dtw_distances(embedded(spark, sf_dir), QUERY, 5), at)
    return ngrams.read_distances(spark, at).withColumn("distance", R6(F.col("distance")))


@query(f"WITH {EVENTS} SELECT CAST(y AS VARCHAR) AS y, CAST(sum(var0) AS VARCHAR) AS total FROM ec WHERE y BETWEEN 0 AND 255 GROUP BY ec.y")
def report_file(spark, sf_dir):
    """A report as CSV with a header, read back as text."""
    at = _file(spark, "report")
    ngrams.write_report(metrics.per_year(event_counts(spark, sf_dir)), at)
    return spark.read.option("header", True).csv(at)


@query(f"""WITH {EMBEDDED}, d AS (SELECT id, ngram, list_sum(list_transform(range(64), lambda i: (series[i + 1] - qs[i + 1]) * (series[i + 1] - qs[i + 1]))) AS d FROM es, (SELECT series AS qs FROM es WHERE id = 0))
SELECT string_agg(concat('"', ngram, '"'), ', ' ORDER BY d, id) AS line FROM (SELECT * FROM d ORDER BY d, id LIMIT 20)""")
def result_list(spark, sf_dir):
    """The n-grams of a result as one quoted list."""
    found = knn.knn_euclid(embedded(spark, sf_dir), QUERY, limit=20)
    return spark.createDataFrame([(ngrams.quoted_list(found),)], "line string")


# Distances and joins given by functions


@query(f"""WITH {EMBEDDED}, d AS (SELECT id, ngram, list_max(list_transform(range(64), lambda i: abs(series[i + 1] - qs[i + 1]))) AS d FROM es, (SELECT series AS qs FROM es WHERE id = 0))
SELECT row_number() OVER (ORDER BY d, id) - 1 AS rank, ngram, id, round(d, 6) AS distance FROM d ORDER BY d, id LIMIT 20""")
def knn_largest_gap(spark, sf_dir):
    """Nearest by a distance that the caller gives: the largest gap of two values."""
    out = knn.knn_euclid(embedded(spark, sf_dir), QUERY, limit=20, distance=lambda m, q: np.abs(m - q).max(axis=1))
    return out.withColumns({"rank": F.col("rank").cast("long"), "distance": R6(F.col("distance"))})


@query(f"WITH RECURSIVE {EMBEDDED},\n" + warping_sql("SELECT s.id, q.series AS a, s.series AS b FROM es s, (SELECT series FROM es WHERE id = 0) q", 64, 5, "abs(p - q) * abs(p - q) * abs(p - q)") + "\nSELECT id, round(sqrt(d2 / 64), 6) AS distance FROM d2")
def dtw_cubes(spark, sf_dir):
    """Warping with a point distance that the caller gives."""
    gap = lambda x, y: np.abs(x - y) * np.abs(x - y) * np.abs(x - y)
    return knn.dtw_distances(embedded(spark, sf_dir), QUERY, 5, point=gap).select("id", R6(F.col("distance")).alias("distance"))


@query(f"WITH {EVENTS} SELECT id, CAST(k AS INT) AS y, list_max(series[16 * k + 1:16 * k + 16]) AS v FROM es, (SELECT unnest(range(16)) AS k)")
def segment_maxima(spark, sf_dir):
    most = fs.downsampled(F.col("series"), 16, LENGTH, -math.inf, lambda a, v: F.greatest(a, v))
    return event_series(spark, sf_dir).select("id", F.posexplode(most).alias("y", "v"))


@query("""WITH a AS (SELECT c_custkey AS id, c_nationkey AS bucket, CAST(c_acctbal AS DOUBLE) AS x FROM customer WHERE c_acctbal IS NOT NULL), b AS (SELECT s_suppkey AS other, s_nationkey AS bucket, CAST(s_acctbal AS DOUBLE) AS y FROM supplier WHERE s_acctbal IS NOT NULL),
n AS (SELECT id, other, abs(x - y) AS dist, row_number() OVER (PARTITION BY id ORDER BY abs(x - y), y, other) - 1 AS rank FROM a JOIN b USING (bucket) WHERE abs(x - y) <= 500)
SELECT id, other, round(dist, 4) AS dist, rank FROM n WHERE rank < 3""")
def nearest_join(spark, sf_dir):
    """The suppliers of a customer's nation whose balance is nearest: three at most, at most 500 away."""
    part = lambda name, p: table(spark, sf_dir, name).filter(f"{p}_acctbal IS NOT NULL")
    a = part("customer", "c").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("bucket"), F.col("c_acctbal").cast("double").alias("x"))
    b = part("supplier", "s").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("bucket"), F.col("s_acctbal").cast("double").alias("x"))
    return wavelet.nearest_join(a, b, 500.0, 3).select("id", "other", F.round("dist", 4).alias("dist"), F.col("rank").cast("long").alias("rank"))


# Sweeps and reference lists


def _ranks(d2: str, r: int) -> str:
    return f"SELECT row_number() OVER (ORDER BY d2, id) - 1 AS rank, id, round(sqrt(d2 / 64), 6) AS distance, {r} AS r FROM {d2}"


@query(_two_radii() + f",\nruns AS ({_ranks('d2', 0)} UNION ALL {_ranks('d2_b', 5)})\nSELECT b.*, n AS \"limit\" FROM runs b, (SELECT unnest([3, 8]) AS n) WHERE rank < n")
def parameter_sweep(spark, sf_dir):
    """Neighbours for every combination of radii and limits."""
    e = embedded(spark, sf_dir)
    run = lambda r, limit: knn.knn_dtw(e, [QUERY], r, limit).select(F.col("rank").cast("long").alias("rank"), "id", R6(F.col("distance")).alias("distance"))
    return metrics.sweep(run, {"r": [0, 5], "limit": [3, 8]})


@query(ORACLES["rank_changes"].replace("SELECT round(1 - levenshtein", f"SELECT '{QUERY}' AS query, 5 AS r, round(1 - levenshtein"))
def gold_file(spark, sf_dir):
    """A result against a reference list of another radius that was written to a file."""
    e = embedded(spark, sf_dir)
    key = {"query": F.lit(QUERY), "r": F.lit(5)}
    reference = knn.knn_dtw(e, [QUERY], 0, 20).withColumns(key)
    at = _file(spark, "gold")
    ngrams.write_gold(reference.groupBy("query", "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("ids")), at)
    out = metrics.against_gold(knn.knn_dtw(e, [QUERY], 5, 20).withColumns(key), ngrams.read_gold(spark, at), 20)
    return out.select("query", "r", *(R6(F.col(c)).alias(c) for c in ("rank_similarity", "rank_distance", "new_share")))


# Frames for drawing


@query(f"WITH {EVENTS} SELECT CAST(1753 + y AS INT) AS x, series[y + 1] AS y, ngram AS label FROM es, (SELECT unnest(range(256)) AS y) t WHERE ngram IN ('0', '1')")
def plot_frame(spark, sf_dir):
    return metrics.plot_frame(event_series(spark, sf_dir), ["0", "1"], 1753)


@query(f"""WITH {EVENTS} SELECT CAST(f AS INT) AS x, round(sqrt(pow(list_sum(list_transform(range(256), lambda t: series[t + 1] * cos(2 * pi() * f * t / 256))), 2) + pow(list_sum(list_transform(range(256), lambda t: series[t + 1] * sin(2 * pi() * f * t / 256))), 2)) / list_sum(series), 5) AS y, ngram AS label
FROM es, (SELECT unnest(range(1, 129)) AS f) WHERE ngram IN ('0', '1')""")
def frequency_frame(spark, sf_dir):
    return metrics.frequency_frame(event_series(spark, sf_dir), ["0", "1"]).withColumn("y", F.round("y", 5))


def _picture_sql() -> str:
    gradient = lambda c: f"list_transform(range(256), lambda t: CASE WHEN t = 0 THEN {c}[2] - {c}[1] WHEN t = 255 THEN {c}[256] - {c}[255] ELSE ({c}[t + 2] - {c}[t]) / 2 END)"
    boost = lambda c: f"sign({c}) * pow(least(abs({c}), 1), 0.3)"
    inverse = lambda v: f"CASE WHEN {v} > 6.0 / 29 THEN pow({v}, 3) ELSE 3 * pow(6.0 / 29, 2) * ({v} - 4.0 / 29) END"
    # The matrix from CIE XYZ to linear sRGB and the white point are fixed values.
    channels = {"r": (3.2406, -1.5372, -0.4986), "g": (-0.9689, 1.8758, 0.0415), "b": (0.0557, -0.2040, 1.0570)}
    linear = lambda w: f"least(greatest({w[0]} * cx + {w[1]} * cy + {w[2]} * cz, 0), 1)"
    rgb = ", ".join(f"round(CASE WHEN total = 0 THEN 0 WHEN {linear(w)} <= 0.0031308 THEN 12.92 * {linear(w)} ELSE 1.055 * pow({linear(w)}, 1 / 2.4) - 0.055 END, 5) AS {c}" for c, w in channels.items())
    return f"""WITH {EVENTS},
sm AS (SELECT id, x, {smoothed_sql(metrics.PICTURE_KERNEL)} AS s FROM (SELECT id, series AS x FROM es)),
gr AS (SELECT id, {gradient('x')} AS g1, {gradient('s')} AS g2, CASE WHEN list_max(x) = 0 THEN 1 ELSE list_max(x) END AS most, list_sum(x) AS total FROM sm),
px AS (SELECT id, y, total, {boost('(g1[y + 1] / most)')} AS a, {boost('(g2[y + 1] / most)')} AS b FROM gr, (SELECT unnest(range(256)) AS y)),
li AS (SELECT id, y, total, a, b, (100 * least(1, sqrt(a * a + b * b)) + 16) / 116 AS fy FROM px),
xy AS (SELECT id, y, total, 0.95047 * ({inverse('(fy + 100 * a / 500)')}) AS cx, {inverse('fy')} AS cy, 1.08883 * ({inverse('(fy - 100 * b / 200)')}) AS cz FROM li)
SELECT id, CAST(y AS INT) AS x, {rgb} FROM xy"""


@query(_picture_sql())
def picture_frame(spark, sf_dir):
    out = metrics.picture_frame(event_series(spark, sf_dir), 0, LENGTH)
    return out.select("id", "x", *(F.round(c, 5).alias(c) for c in "rgb"))
