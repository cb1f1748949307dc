"""The queries over the driver's tables, each with the SQL that gives the same rows."""
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import series as fs
from ..functions import text
from ..operators import graph, ingest, knn, lemmas, many, merge, metrics, skip_index, trace, wavelet
from ..sources import ngrams
from .scratch import materialized, removed_later, shared_dir

LENGTH, RADIUS, QUERY = 256, 10, "0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_normalized(c):
    return F.lower(c)


# Fixtures


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id (user), y (of 256 equal parts of 30 days), var0, var1."""
    e = table(spark, sf_dir, "events").filter("user_id IS NOT NULL AND ts IS NOT NULL")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200
    return e.groupBy(F.col("user_id").alias("id"), F.floor(seconds / 10125).cast("int").alias("y")).agg(F.count("*").alias("var0"), F.count_distinct("event_type").alias("var1")).filter(F.col("y").between(0, LENGTH - 1))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ngram (the id as text), series."""
    return ingest.densified(event_counts(spark, sf_dir), "var0", LENGTH).select("id", F.col("id").cast("string").alias("ngram"), "series")


def similar_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transformed series as a table: a query first looks its own series up."""
    return materialized(fs.transformed(event_series(spark, sf_dir), "loggradient_smooth1"), "series")


def part_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.floor(F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")) / 10).cast("int")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), y.alias("y"), "l_orderkey").filter(F.col("y").between(0, LENGTH - 1))
    return rows.groupBy("id", "y").agg(F.count("*").alias("var0"), F.count_distinct("l_orderkey").alias("var1"))


def part_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = ingest.densified(part_counts(spark, sf_dir), "var0", LENGTH)
    return dense.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("ngram")), "id").select("id", "ngram", "series")


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("vec_id").cast("string").alias("ngram"), F.col("embedding").cast("array<double>").alias("series"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of documents as entries, in pseudo-years."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    cores = spark.sparkContext.defaultParallelism
    if d.rdd.getNumPartitions() < cores:  # a small table in one file: all cores part its texts
        d = d.select("doc_id", "text").repartition(cores)
    d = d.select("doc_id", "text", (1753 + F.col("doc_id") % 256).cast("int").alias("year"))
    again = d.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    again = materialized(again, "repeated-ids")
    if again.isEmpty():
        rest, d = d.filter("doc_id IS NULL"), d.filter("doc_id IS NOT NULL")
    else:
        rest = d.join(again, "doc_id", "left_semi").unionByName(d.filter("doc_id IS NULL"))
        d = d.filter("doc_id IS NOT NULL").join(again, "doc_id", "left_anti")
    # texts of one document in several rows, or of none, are counted once they have met
    words = rest.select("doc_id", "year", F.explode(F.split("text", r"\s+")).alias("ngram")).filter("ngram <> ''")
    met = words.groupBy("ngram", "year", "doc_id").agg(F.count("*").alias("n")).select("ngram", "year", F.col("n").alias("var0"), F.col("doc_id").isNotNull().cast("long").alias("var1"))
    counts = text.word_counts(d, "year", "text").unionByName(met)
    counts = counts.groupBy("ngram", "year").agg(F.sum("var0").alias("var0"), F.sum("var1").alias("var1"))
    return materialized(counts, "entries")  # a query reads them more than once


EVENTS = """ec AS MATERIALIZED (SELECT user_id AS id, CAST(floor((epoch_us(ts) / 1e6 - 1704067200) / 10125) AS INT) AS y, count(*) AS var0, count(DISTINCT event_type) AS var1 FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
es AS MATERIALIZED (SELECT id, CAST(id AS VARCHAR) AS ngram, list(coalesce(var0, 0)::DOUBLE ORDER BY y) AS series FROM (SELECT k.id, g.y, var0 FROM (SELECT DISTINCT id FROM ec WHERE y BETWEEN 0 AND 255) k CROSS JOIN (SELECT unnest(range(256)) AS y) g LEFT JOIN ec ON ec.id = k.id AND ec.y = g.y) GROUP BY id)"""
EMBEDDED = "es AS MATERIALIZED (SELECT vec_id AS id, CAST(vec_id AS VARCHAR) AS ngram, CAST(embedding AS DOUBLE[]) AS series FROM embeddings)"
ENTRIES = r"""en AS MATERIALIZED (SELECT ngram, CAST(1753 + doc_id % 256 AS INT) AS year, count(*) AS var0, count(DISTINCT doc_id) AS var1 FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \t\n\x0B\f\r]+')) AS ngram FROM documents WHERE text IS NOT NULL) WHERE ngram <> '' GROUP BY 1, 2)"""
UNCLEAN = text.UNCLEAN.replace("'", "''")


def smoothed_sql(kernel: list[float]) -> str:
    """x -> its smoothed list."""
    half, n = len(kernel) // 2, LENGTH
    w = "[" + ", ".join(map(repr, kernel)) + "]"
    at = f"range(greatest(t - {half}, 0), least(t + {half}, {n - 1}) + 1)"
    return f"list_transform(range({n}), lambda t: list_sum(list_transform({at}, lambda u: {w}[u - t + {half + 1}] * x[u + 1])) / list_sum(list_transform({at}, lambda u: {w}[u - t + {half + 1}])))"


def gradient_sql(n: int = LENGTH) -> str:
    return f"list_transform(range({n}), lambda t: CASE WHEN t = 0 THEN x[2] - x[1] WHEN t = {n - 1} THEN x[{n}] - x[{n - 1}] ELSE (x[t + 2] - x[t]) / 2 END)"


LOG_SQL = "list_transform(x, lambda v: ln(1 + v))"
INPUT = f"""{EVENTS},
t1 AS MATERIALIZED (SELECT id, ngram, {LOG_SQL} AS x FROM (SELECT id, ngram, series AS x FROM es)),
t2 AS MATERIALIZED (SELECT id, ngram, {smoothed_sql(fs.SMOOTH1)} AS x FROM t1),
si AS MATERIALIZED (SELECT id, ngram, {gradient_sql()} AS series FROM t2)"""


def warping_sql(pairs: str, length: int, r: int, point: str = "(p - q) * (p - q)") -> str:
    """CTE pairs(id, a, b) to d2(id, d2), over anti-diagonals."""
    cost = point.replace("p", "c.a[i + 1]").replace("q", "c.b[k + 2 - i]")
    return f"""pr AS MATERIALIZED ({pairs}),
cell(id, k, x2, x1) AS (
  SELECT id, 0, list_transform(range({length}), lambda i: 'infinity'::DOUBLE), list_transform(range({length}), lambda i: CASE WHEN i = 0 THEN {point.replace("p", "a[1]").replace("q", "b[1]")} ELSE 'infinity'::DOUBLE END) FROM pr
  UNION ALL
  SELECT c.id, k + 1, x1, list_transform(range({length}), lambda i: CASE WHEN i > k + 1 OR k + 1 - i >= {length} OR abs(2 * i - (k + 1)) > {r} THEN 'infinity'::DOUBLE
    ELSE {cost} + least(x1[i + 1], CASE WHEN i = 0 THEN 'infinity'::DOUBLE ELSE x1[i] END, CASE WHEN i = 0 THEN 'infinity'::DOUBLE ELSE x2[i] END) END)
  FROM (SELECT cell.*, a, b FROM cell JOIN pr USING (id)) c WHERE k < {2 * length - 2}),
d2 AS MATERIALIZED (SELECT id, x1[{length}] AS d2 FROM cell WHERE k = {2 * length - 2})"""


def aligned_sql(pre: str, pairs: str, n: int, m: int, point: str = "({p} - {q}) * ({p} - {q})", window: bool = False) -> str:
    """CTEs, named from pre on: pairs(id, a of n values, b of m, and with a window lo and hi, lists of the first and
    last place in b per element of a) to d2(id, d2) and pa(id, step, i, j), the best path with places from 1."""
    inf, here = "'infinity'::DOUBLE", point.format(p="c.a[i + 1]", q="c.b[k + 2 - i]")
    cut = " OR NOT (k + 2 - i BETWEEN c.lo[i + 1] AND c.hi[i + 1])" if window else ""
    diagonal = "x2[i] <= x1[i + 1] AND x2[i] <= x1[i]"
    return f"""{pre}pr AS MATERIALIZED ({pairs}),
{pre}cell(id, k, x2, x1) AS (
  SELECT id, 0, list_transform(range({n}), lambda i: {inf}), list_transform(range({n}), lambda i: CASE WHEN i = 0 THEN {point.format(p="c.a[1]", q="c.b[1]")} ELSE {inf} END) FROM {pre}pr c
  UNION ALL
  SELECT c.id, k + 1, x1, list_transform(range({n}), lambda i: CASE WHEN i > k + 1 OR k + 1 - i >= {m}{cut} THEN {inf}
    ELSE {here} + least(x1[i + 1], CASE WHEN i = 0 THEN {inf} ELSE x1[i] END, CASE WHEN i = 0 THEN {inf} ELSE x2[i] END) END)
  FROM (SELECT {pre}cell.*, {pre}pr.* EXCLUDE (id) FROM {pre}cell JOIN {pre}pr USING (id)) c WHERE k < {n + m - 2}),
{pre}cl AS MATERIALIZED (SELECT id, k, x2, x1 FROM {pre}cell),
{pre}d2 AS MATERIALIZED (SELECT id, x1[{n}] AS d2 FROM {pre}cl WHERE k = {n + m - 2}),
{pre}wk(id, i, j) AS (
  SELECT id, {n - 1}, {m - 1} FROM {pre}pr
  UNION ALL
  SELECT w.id, CASE WHEN i = 0 THEN 0 WHEN j = 0 OR ({diagonal}) OR x1[i] < x1[i + 1] THEN i - 1 ELSE i END, CASE WHEN j = 0 THEN 0 WHEN i = 0 OR ({diagonal}) OR x1[i + 1] <= x1[i] THEN j - 1 ELSE j END
  FROM {pre}wk w JOIN {pre}cl c ON c.id = w.id AND c.k = w.i + w.j - 1),
{pre}pa AS MATERIALIZED (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i + j) - 1 AS step, i + 1 AS i, j + 1 AS j FROM {pre}wk)"""


def input_warping(query: str = QUERY, r: int = RADIUS, begin: int = 0, end: int = LENGTH) -> str:
    part = "" if (begin, end) == (0, LENGTH) else f"[{begin + 1}:{end}]"
    return f"WITH RECURSIVE {INPUT},\n" + warping_sql(f"SELECT s.id, q.series{part} AS a, s.series{part} AS b FROM si s, (SELECT series FROM si WHERE ngram = '{query}') q", end - begin, r)


R6 = lambda c: F.round(c, 6)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, column: str = "series") -> DataFrame:
    """id, y, v of arrays, rounded to six digits."""
    return df.select("id", F.posexplode(column).alias("y", "v")).select("id", "y", (R6(F.col("v")) + F.lit(0.0)).alias("v"))


UNROLL = "SELECT id, CAST(y AS INT) AS y, round(x[y + 1], 6) + 0.0 AS v FROM {0}, (SELECT unnest(range({1})) AS y)"


# Neighbours


@query(input_warping() + "\nSELECT row_number() OVER (ORDER BY d2, id) - 1 AS rank, ngram, id, round(sqrt(d2 / 256), 6) AS distance FROM d2 JOIN si USING (id) ORDER BY d2, id LIMIT 20")
def knn_dtw(spark, sf_dir):
    return knn.knn_dtw(similar_input(spark, sf_dir), [QUERY], RADIUS, 20).withColumns({"rank": F.col("rank").cast("long"), "distance": R6(F.col("distance"))})


@query(input_warping() + "\nSELECT id, ngram, round(sqrt(d2 / 256), 6) AS distance FROM d2 JOIN si USING (id)")
def dtw_distances(spark, sf_dir):
    return knn.dtw_distances(similar_input(spark, sf_dir), QUERY, RADIUS).withColumn("distance", R6(F.col("distance")))


@query(input_warping(begin=32, end=160) + "\nSELECT row_number() OVER (ORDER BY d2, id) - 1 AS rank, ngram, id, round(sqrt(d2 / 128), 6) AS distance FROM d2 JOIN si USING (id) ORDER BY d2, id LIMIT 20")
def knn_dtw_range(spark, sf_dir):
    return knn.knn_dtw(similar_input(spark, sf_dir), [QUERY], RADIUS, 20, 32, 160).withColumns({"rank": F.col("rank").cast("long"), "distance": R6(F.col("distance"))})


@query(f"WITH RECURSIVE {INPUT},\n" + warping_sql("SELECT s.id * 10 + q.id AS id, q.series AS a, s.series AS b FROM si s, (SELECT id, series FROM si WHERE ngram IN ('0', '1')) q", LENGTH, RADIUS) + """,
tot AS (SELECT id // 10 AS id, sum(d2) AS d2 FROM d2 GROUP BY 1)
SELECT row_number() OVER (ORDER BY d2, id) - 1 AS rank, ngram, id, round(sqrt(d2 / 256), 6) AS distance FROM tot JOIN si USING (id) ORDER BY d2, id LIMIT 20""")
def knn_dtw_multi(spark, sf_dir):
    return knn.knn_dtw(similar_input(spark, sf_dir), ["0", "1"], RADIUS, 20).withColumns({"rank": F.col("rank").cast("long"), "distance": R6(F.col("distance"))})


@query(f"WITH RECURSIVE {EMBEDDED},\n" + warping_sql("SELECT s.id * 1000000 + q.id AS id, q.series[17:48] AS a, s.series[17:48] AS b FROM es s, (SELECT id, series FROM es WHERE id % 20 = 0) q", 32, 3) + """
SELECT id % 1000000 AS query, row_number() OVER w - 1 AS rank, id // 1000000 AS id, CAST(id // 1000000 AS VARCHAR) AS ngram, round(sqrt(d2 / 32), 6) AS distance FROM d2 WINDOW w AS (PARTITION BY id % 1000000 ORDER BY d2, id) QUALIFY rank < 5""")
def knn_many(spark, sf_dir):
    """The five nearest over a part of the series for every id divisible by 20, against all."""
    rows = embedded(spark, sf_dir)
    out = many.knn_many(rows, rows.filter("id % 20 = 0"), 3, 5, 16, 48)
    return out.withColumns({"rank": F.col("rank").cast("long"), "distance": R6(F.col("distance"))})


def _skip_index(spark, sf_dir) -> str:
    at = removed_later(spark, f"{shared_dir(spark)}/tidewarp-index-{uuid.uuid4().hex}")
    skip_index.write_index(similar_input(spark, sf_dir), at, LENGTH, file_rows=64)
    return at


@query(ORACLES["knn_dtw"])
def knn_dtw_indexed(spark, sf_dir):
    return skip_index.knn_dtw_indexed(spark, _skip_index(spark, sf_dir), QUERY, RADIUS, 20).withColumns({"rank": F.col("rank").cast("long"), "distance": R6(F.col("distance"))})


@query(ORACLES["knn_dtw_range"])
def knn_dtw_indexed_range(spark, sf_dir):
    return skip_index.knn_dtw_indexed(spark, _skip_index(spark, sf_dir), QUERY, RADIUS, 20, 32, 160).withColumns({"rank": F.col("rank").cast("long"), "distance": R6(F.col("distance"))})


@query(ORACLES["knn_dtw"])
def knn_dtw_pruned(spark, sf_dir):
    index = materialized(knn.bound_index(similar_input(spark, sf_dir), RADIUS, LENGTH), "bounds")
    return knn.knn_dtw_pruned(index, QUERY, RADIUS, 20).withColumns({"rank": F.col("rank").cast("long"), "distance": R6(F.col("distance"))})


@query(f"""WITH {EMBEDDED}, q AS (SELECT series AS qs FROM es WHERE id = 0),
d AS (SELECT id, ngram, list_sum(list_transform(range(64), lambda i: (series[i + 1] - qs[i + 1]) * (series[i + 1] - qs[i + 1]))) AS d FROM es, q)
SELECT row_number() OVER (ORDER BY d, id) - 1 AS rank, ngram, id, round(d, 6) AS distance FROM d ORDER BY d, id LIMIT 20""")
def knn_euclid(spark, sf_dir):
    return knn.knn_euclid(embedded(spark, sf_dir), QUERY, limit=20).withColumns({"rank": F.col("rank").cast("long"), "distance": R6(F.col("distance"))})


@query(f"WITH RECURSIVE {EMBEDDED},\n" + warping_sql("SELECT s.id, q.series AS a, s.series AS b FROM es s, (SELECT series FROM es WHERE id = 0) q", 64, 0) + "\nSELECT id, round(d2, 6) AS d2 FROM d2")
def dtw_radius_zero(spark, sf_dir):
    e = embedded(spark, sf_dir)
    return knn.squared_sums(e.select("id", "series"), [e.filter("id = 0").first().series], 0).withColumn("d2", R6(F.col("d2")))


@query(f"WITH RECURSIVE {EMBEDDED},\n" + warping_sql("SELECT s.id, q.series AS a, s.series AS b FROM es s, (SELECT series FROM es WHERE id = 0) q", 64, 5, "abs(p - q)") + "\nSELECT id, round(d2, 6) AS d2 FROM d2")
def dtw_absval(spark, sf_dir):
    e = embedded(spark, sf_dir)
    return knn.squared_sums(e.select("id", "series"), [e.filter("id = 0").first().series], 5, point="absval").withColumn("d2", R6(F.col("d2")))


@query(f"WITH RECURSIVE {EMBEDDED},\n" + warping_sql("SELECT s.id, q.series AS a, s.series AS b FROM es s, (SELECT series FROM es WHERE id = 0) q", 64, 64) + "\nSELECT id, round(d2, 6) AS cost FROM d2")
def dtw_unbanded(spark, sf_dir):
    e = embedded(spark, sf_dir)
    q = e.filter("id = 0").select(F.col("series").alias("q"))
    pairs = e.join(F.broadcast(q))  # a query row against the table
    return pairs.select("id", knn.alignment()("q", "series").alias("a")).select("id", R6(F.col("a.cost")).alias("cost"))


@query(f"WITH RECURSIVE {EMBEDDED},\n" + aligned_sql("", "SELECT s.id, q.series[1:48] AS a, s.series AS b FROM es s, (SELECT series FROM es WHERE id = 0) q", 48, 64) + """
SELECT id, CAST(step AS INT) AS step, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(a[i], 6) AS x, round(b[j], 6) AS y, round(d2, 6) AS cost FROM pa JOIN pr USING (id) JOIN d2 USING (id)""")
def dtw_alignment(spark, sf_dir):
    """The steps of the best path of each series with a shorter query, and its cost."""
    e = embedded(spark, sf_dir)
    q = e.filter("id = 0").select(F.slice("series", 1, 48).alias("a_values"))
    found = materialized(e.join(F.broadcast(q)).select("id", "a_values", F.col("series").alias("b_values"), knn.alignment()("a_values", "series").alias("a")), "alignments")
    steps = knn.alignment_frame(found).withColumns({"x": R6(F.col("x")), "y": R6(F.col("y"))})
    return steps.join(found.select("id", R6(F.col("a.cost")).alias("cost")), "id")


WINDOW = "list_transform(range(64), lambda t: {0})"


@query(f"WITH RECURSIVE {EMBEDDED},\n" + aligned_sql("", f"SELECT s.id, q.series AS a, s.series AS b, {WINDOW.format('greatest(t - 2, 1)')} AS lo, {WINDOW.format('least(t + 9, 64)')} AS hi FROM es s, (SELECT series FROM es WHERE id = 0) q", 64, 64, window=True) + """
SELECT id, CAST(step AS INT) AS step, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(d2, 6) AS cost FROM pa JOIN d2 USING (id)""")
def windowed_alignment(spark, sf_dir):
    """Paths that may fall 3 behind the query and run 8 ahead of it."""
    e = embedded(spark, sf_dir)
    q = e.filter("id = 0").select(F.col("series").alias("a_values"))
    place = F.sequence(F.lit(1), F.lit(64))
    rows = e.join(F.broadcast(q)).withColumns({"low": F.transform(place, lambda t: F.greatest(t - 3, F.lit(1))), "high": F.transform(place, lambda t: F.least(t + 8, F.lit(64)))})
    found = materialized(rows.select("id", knn.windowed_alignment()("a_values", "series", "low", "high").alias("a")), "alignments")
    return found.select("id", R6(F.col("a.cost")).alias("cost"), F.posexplode(F.arrays_zip(F.col("a.first").alias("i"), F.col("a.second").alias("j"))).alias("step", "at")).select("id", "cost", "step", "at.i", "at.j")


POISSON = "CASE WHEN {p} <= 0 AND {q} <= 0 THEN 0::DOUBLE ELSE (pow({p} - ({p} + {q}) / (c.na + c.nb) * c.na, 2) + pow({q} - ({p} + {q}) / (c.na + c.nb) * c.nb, 2)) / ({p} + {q}) END"


@query(f"WITH RECURSIVE {EVENTS},\nqs AS MATERIALIZED (SELECT id, list_transform(range(64), lambda k: list_sum(series[4 * k + 1:4 * k + 4])) AS series FROM es),\n" + aligned_sql("", "SELECT s.id, q.series AS a, s.series AS b, list_sum(q.series) AS na, list_sum(s.series) AS nb FROM qs s, (SELECT series FROM qs WHERE id = 0) q", 64, 64, POISSON) + "\nSELECT id, round(d2, 6) AS cost FROM d2")
def dtw_poisson(spark, sf_dir):
    """Alignments of the whole series, counted in quarters of their resolution."""
    e = event_series(spark, sf_dir).withColumn("series", fs.downsampled(F.col("series"), 64, LENGTH, 0.0, lambda t, v: t + v))
    q = e.filter("id = 0").select(F.col("series").alias("q"))
    return e.join(F.broadcast(q)).select("id", knn.alignment("poisson")("q", "series").alias("a")).select("id", R6(F.col("a.cost")).alias("cost"))


def _fast_sql(n: int, radius: int, base: int) -> str:
    """CTEs from the halved series up: f<length>_d2 and f<length>_pa of each length."""
    half = lambda x, k: f"list_transform(range({k}), lambda t: ({x}[2 * t + 1] + {x}[2 * t + 2]) / 2)"
    out, sizes = f"h{n} AS MATERIALIZED (SELECT s.id, q.series AS a, s.series AS b FROM es s, (SELECT series FROM es WHERE id = 0) q)", [n]
    while sizes[-1] > base:
        k = sizes[-1] // 2
        out += f",\nh{k} AS MATERIALIZED (SELECT id, {half('a', k)} AS a, {half('b', k)} AS b FROM h{sizes[-1]})"
        sizes.append(k)
    out += ",\n" + aligned_sql(f"f{sizes[-1]}_", f"SELECT * FROM h{sizes[-1]}", sizes[-1], sizes[-1])
    for k in sizes[-2::-1]:
        was = f"f{k // 2}_pa"
        out += f""",
p{k} AS (SELECT id, 2 * i - 1 AS i, 2 * j - 1 AS j FROM {was} UNION ALL SELECT x.id, x.i + y.i - 1, x.j + y.j - 1 FROM {was} x JOIN {was} y ON x.id = y.id AND y.step = x.step + 1 UNION ALL SELECT id, {k}, {k} FROM h{k}),
g{k} AS (SELECT id, list(f ORDER BY i) AS f, list(l ORDER BY i) AS l FROM (SELECT id, i, min(j) AS f, max(j) AS l FROM p{k} GROUP BY id, i) GROUP BY id),
"""
        low = f"list_transform(range({k}), lambda t: CASE WHEN t < {radius} THEN 1 ELSE greatest(f[t - {radius - 1}] - {radius}, 1) END)"
        high = f"list_transform(range({k}), lambda t: CASE WHEN t >= {k - radius} THEN {k} ELSE least(l[t + {radius + 1}] + {radius}, {k}) END)"
        out += aligned_sql(f"f{k}_", f"SELECT id, a, b, {low} AS lo, {high} AS hi FROM h{k} JOIN g{k} USING (id)", k, k, window=True)
    return out


@query(f"WITH RECURSIVE {EMBEDDED},\n{_fast_sql(64, 5, 8)}\nSELECT id, round(d2, 6) AS cost, CAST(count(*) AS INT) AS steps FROM f64_pa JOIN f64_d2 USING (id) GROUP BY id, d2")
def fastdtw(spark, sf_dir):
    e = embedded(spark, sf_dir)
    q = e.filter("id = 0").select(F.col("series").alias("q"))
    return e.join(F.broadcast(q)).select("id", knn.alignment(radius=5)("q", "series").alias("a")).select("id", R6(F.col("a.cost")).alias("cost"), F.size("a.first").alias("steps"))


def _barycenter_sql(iterations: int) -> str:
    out = "av0 AS MATERIALIZED (SELECT series AS s FROM es ORDER BY id LIMIT 1)"
    for k in range(1, iterations + 1):
        pre = f"b{k}_"
        out += ",\n" + aligned_sql(pre, f"SELECT id, s AS a, series AS b FROM es, av{k - 1}", 64, 64)
        out += f",\nav{k} AS MATERIALIZED (SELECT list(v ORDER BY i) AS s FROM (SELECT i, sum(b[j]) / count(*) AS v FROM {pre}pa JOIN {pre}pr USING (id) GROUP BY i))"
    return out


@query(f"WITH RECURSIVE {EMBEDDED},\n{_barycenter_sql(5)}\nSELECT CAST(y AS INT) AS pos, round(s[y + 1], 6) AS v FROM av5, (SELECT unnest(range(64)) AS y)")
def barycenter(spark, sf_dir):
    rows = embedded(spark, sf_dir)
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in enumerate(knn.barycenter(rows.select("id", "series")))], "pos int, v double")


def _barycenters_sql(iterations: int) -> str:
    out = "gl AS (SELECT vec_id AS id, label FROM embeddings),\nav0 AS MATERIALIZED (SELECT label, arg_min(series, id) AS s, count(*) AS n FROM es JOIN gl USING (id) GROUP BY label)"
    for k in range(1, iterations + 1):
        pre = f"b{k}_"
        out += ",\n" + aligned_sql(pre, f"SELECT es.id, s AS a, series AS b FROM es JOIN gl ON gl.id = es.id JOIN av{k - 1} USING (label)", 64, 64)
        out += f",\nav{k} AS MATERIALIZED (SELECT label, list(v ORDER BY i) AS s FROM (SELECT label, i, sum(b[j]) / count(*) AS v FROM {pre}pa JOIN {pre}pr USING (id) JOIN gl USING (id) GROUP BY label, i) GROUP BY label)"
    return out


@query(f"WITH RECURSIVE {EMBEDDED},\n{_barycenters_sql(3)}\nSELECT label, n, CAST(y AS INT) AS pos, round(av3.s[y + 1], 6) + 0.0 AS v FROM av3 JOIN (SELECT label, n FROM av0) USING (label), (SELECT unnest(range(64)) AS y)")
def barycenters(spark, sf_dir):
    """The averages of the series of each label."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("series"))
    return knn.barycenters(rows, "label", 3).select("label", "n", F.posexplode("series").alias("pos", "v")).withColumn("v", R6(F.col("v")) + F.lit(0.0))


@query(input_warping() + """,
o AS (SELECT row_number() OVER (ORDER BY d2, id) - 1 AS rank, d2 FROM d2),
n AS (SELECT rank, d2 - (SELECT d2 FROM o WHERE rank = 1) AS n FROM o WHERE rank >= 1),
m AS (SELECT max(rank) AS last FROM n),
s AS (SELECT rank, n, CASE WHEN rank = 1 THEN lead(n) OVER w - n WHEN rank = last THEN n - lag(n) OVER w ELSE (lead(n) OVER w - lag(n) OVER w) / 2 END AS slope FROM n, m WINDOW w AS (ORDER BY rank)),
g AS (SELECT rank, CASE WHEN n = 0 THEN NULL ELSE slope / n END AS g FROM s),
g2 AS (SELECT rank, CASE WHEN rank = 1 THEN lead(g) OVER w - g WHEN rank = last THEN g - lag(g) OVER w ELSE (lead(g) OVER w - lag(g) OVER w) / 2 END AS g2 FROM g, m WINDOW w AS (ORDER BY rank))
SELECT rank, round(g2, 6) AS g2 FROM g2 WHERE g2 IS NOT NULL""")
def auto_limit_curvature(spark, sf_dir):
    rows = similar_input(spark, sf_dir)
    d2 = knn.squared_sums(rows.select("id", "series"), [rows.filter(F.col("ngram") == QUERY).first().series], RADIUS)
    return knn.curvature(knn.full_ranks(d2)).filter("g2 IS NOT NULL").select(F.col("rank").cast("long").alias("rank"), R6(F.col("g2")).alias("g2"))


@query(ORACLES["auto_limit_curvature"].replace("SELECT rank, round(g2, 6) AS g2 FROM g2 WHERE g2 IS NOT NULL", """,
cut AS (SELECT coalesce((SELECT rank FROM g2 WHERE rank BETWEEN 2 AND (SELECT count(*) // 2 FROM d2) AND isfinite(g2) ORDER BY g2 DESC, rank LIMIT 1), 1) AS n)
SELECT rank, ngram, id, round(sqrt(d2 / 256), 6) AS distance FROM (SELECT row_number() OVER (ORDER BY d2, id) - 1 AS rank, id, d2 FROM d2) JOIN si USING (id), cut WHERE rank < n""".lstrip()).replace("\n,\ncut", ",\ncut"))
def knn_auto_limit(spark, sf_dir):
    """Neighbours with the limit left open."""
    out = knn.knn_dtw(similar_input(spark, sf_dir), [QUERY], RADIUS)
    return out.select(F.col("rank").cast("long").alias("rank"), "ngram", "id", R6(F.col("distance")).alias("distance"))


@query(input_warping() + """,
o AS (SELECT row_number() OVER (ORDER BY d2, id) - 1 AS rank, id, sqrt(d2 / 256) AS d FROM d2)
SELECT rank, id, round(d - (SELECT d FROM o WHERE rank = 1), 6) AS above FROM o WHERE rank >= 1""")
def relative_distances(spark, sf_dir):
    """Distances less that of the nearest other series."""
    rows = similar_input(spark, sf_dir)
    d2 = knn.squared_sums(rows.select("id", "series"), [rows.filter(F.col("ngram") == QUERY).first().series], RADIUS)
    ranks = knn.full_ranks(d2).select("rank", "id", F.sqrt(F.col("d2") / LENGTH).alias("d"))
    first = ranks.filter("rank = 1").select(F.col("d").alias("d1"))
    return ranks.filter("rank >= 1").join(F.broadcast(first)).select(F.col("rank").cast("long").alias("rank"), "id", R6(F.col("d") - F.col("d1")).alias("above"))


@query(input_warping() + "\nSELECT CAST(floor(sqrt(d2 / 256) / 0.01) AS BIGINT) AS bin, count(*) AS n FROM d2 GROUP BY 1")
def distance_histogram(spark, sf_dir):
    d = knn.dtw_distances(similar_input(spark, sf_dir), QUERY, RADIUS)
    return metrics.histogram(d.withColumn("distance", F.col("distance") / 0.01), "distance", 1.0).select(F.col("bin").cast("long").alias("bin"), "n")


# Lower bounds

ENVELOPE = f"list_transform(range({LENGTH}), lambda t: {{0}}(series[greatest(t - {RADIUS}, 0) + 1:least(t + {RADIUS}, {LENGTH - 1}) + 1]))"
BOUNDS = f"""{INPUT},
ev AS MATERIALIZED (SELECT id, ngram, series, {ENVELOPE.format("list_min")} AS l, {ENVELOPE.format("list_max")} AS u FROM si),
ix AS MATERIALIZED (SELECT id, ngram, list_transform(range(64), lambda k: list_sum(series[4 * k + 1:4 * k + 4]) / 4) AS down, list_transform(range(64), lambda k: list_min(l[4 * k + 1:4 * k + 4])) AS lo, list_transform(range(64), lambda k: list_max(u[4 * k + 1:4 * k + 4])) AS hi FROM ev)"""


@query(f"WITH {INPUT}, ev AS (SELECT id, {ENVELOPE.format('list_min')} AS l, {ENVELOPE.format('list_max')} AS u FROM si) SELECT id, CAST(y AS INT) AS y, round(l[y + 1], 6) + 0.0 AS lower, round(u[y + 1], 6) + 0.0 AS upper FROM ev, (SELECT unnest(range(256)) AS y)")
def envelope(spark, sf_dir):
    values = similar_input(spark, sf_dir).select("id", F.posexplode("series").alias("y", "v"))
    w = Window.partitionBy("id").orderBy("y").rowsBetween(-RADIUS, RADIUS)
    return values.select("id", "y", (R6(F.min("v").over(w)) + F.lit(0.0)).alias("lower"), (R6(F.max("v").over(w)) + F.lit(0.0)).alias("upper"))


@query(f"WITH {BOUNDS} SELECT id, CAST(y AS INT) AS y, round(down[y + 1], 6) + 0.0 AS down, round(lo[y + 1], 6) + 0.0 AS lo, round(hi[y + 1], 6) + 0.0 AS hi FROM ix, (SELECT unnest(range(64)) AS y)")
def bound_index(spark, sf_dir):
    index = knn.bound_index(similar_input(spark, sf_dir), RADIUS, LENGTH)
    rows = index.select("id", F.posexplode(F.arrays_zip("down", "lo", "hi")).alias("y", "b"))
    return rows.select("id", "y", *((R6(F.col(f"b.{c}")) + F.lit(0.0)).alias(c) for c in ("down", "lo", "hi")))


@query(f"""WITH {BOUNDS}, q AS (SELECT lo AS ql, hi AS qh FROM ix WHERE ngram = '{QUERY}')
SELECT id, round(4 * list_sum(list_transform(range(64), lambda i: power(greatest(down[i + 1] - qh[i + 1], ql[i + 1] - down[i + 1], 0), 2))), 6) AS lb,
round(4 * list_sum(list_transform(range(64), lambda i: power(greatest(lo[i + 1] - qh[i + 1], ql[i + 1] - hi[i + 1], 0), 2))), 6) AS mindist FROM ix, q""")
def lower_bounds(spark, sf_dir):
    index = materialized(knn.bound_index(similar_input(spark, sf_dir), RADIUS, LENGTH), "bounds")
    return knn.bounds(index, QUERY, RADIUS).select("id", R6(F.col("lb")).alias("lb"), R6(F.col("mindist")).alias("mindist"))


# Transforms


def _transform_query(name: str, steps: list[str], norm: str | None = None):
    ctes, last = "", "(SELECT id, series AS x FROM es)"
    for k, step in enumerate(steps):
        ctes += f", s{k} AS MATERIALIZED (SELECT id, {step} AS x FROM {last})"
        last = f"s{k}"

    def run(spark, sf_dir):
        return rounded(fs.transformed(event_series(spark, sf_dir), name.removeprefix("transform_") if norm is None else "id", norm or "id"))

    run.__name__ = name
    query(f"WITH {EVENTS}{ctes} " + UNROLL.format(f"(SELECT * FROM {last})", LENGTH))(run)


_S1, _S2, _G = smoothed_sql(fs.SMOOTH1), smoothed_sql(fs.SMOOTH2), gradient_sql()
for _name, _steps in {
    "log": [LOG_SQL], "smooth1": [_S1], "smooth2": [_S2], "log_smooth1": [LOG_SQL, _S1], "log_smooth2": [LOG_SQL, _S2], "gradient": [_G], "loggradient": [LOG_SQL, _G],
    "gradient_smooth1": [_S1, _G], "gradient_smooth2": [_S2, _G], "loggradient_smooth1": [LOG_SQL, _S1, _G], "loggradient_smooth2": [LOG_SQL, _S2, _G],
}.items():
    _transform_query(f"transform_{_name}", _steps)
_transform_query("norm_max", ["list_transform(x, lambda v: v / CASE WHEN list_max(x) = 0 THEN 1 ELSE list_max(x) END)"], "max")
_transform_query("norm_avg", ["list_transform(x, lambda v: v / CASE WHEN list_avg(x) = 0 THEN 1 ELSE list_avg(x) END)"], "avg")


@query(f"WITH {EVENTS} SELECT id, CAST(f AS INT) AS y, round(sqrt(pow(list_sum(list_transform(range(256), lambda t: series[t + 1] * cos(2 * pi() * f * t / 256))), 2) + pow(list_sum(list_transform(range(256), lambda t: series[t + 1] * sin(2 * pi() * f * t / 256))), 2)) / list_sum(series), 5) AS v FROM es, (SELECT unnest(range(1, 129)) AS f)")
def spectrum(spark, sf_dir):
    return fs.spectrum(event_series(spark, sf_dir)).select("id", F.posexplode("series").alias("y", "v")).select("id", (F.col("y") + 1).alias("y"), F.round("v", 5).alias("v"))


@query(f"""WITH {EVENTS}, a AS (SELECT id, f, sqrt(pow(list_sum(list_transform(range(256), lambda t: series[t + 1] * cos(2 * pi() * f * t / 256))), 2) + pow(list_sum(list_transform(range(256), lambda t: series[t + 1] * sin(2 * pi() * f * t / 256))), 2)) / list_sum(series) AS v FROM es, (SELECT unnest(range(1, 129)) AS f))
SELECT CAST(f AS INT) AS frequency, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS std FROM a GROUP BY f""")
def mean_spectrum(spark, sf_dir):
    return metrics.mean_spectrum(fs.spectrum(event_series(spark, sf_dir))).select("frequency", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


@query(f"""WITH {EVENTS}, sm AS (SELECT id, {smoothed_sql(fs.SMOOTH2)} AS s FROM (SELECT id, series AS x FROM es)),
a AS (SELECT id, f, sqrt(pow(list_sum(list_transform(range(256), lambda t: s[t + 1] * cos(2 * pi() * f * t / 256))), 2) + pow(list_sum(list_transform(range(256), lambda t: s[t + 1] * sin(2 * pi() * f * t / 256))), 2)) / list_sum(s) AS v FROM sm, (SELECT unnest(range(1, 129)) AS f))
SELECT CAST(f AS INT) AS frequency, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS std FROM a GROUP BY f""")
def mean_spectrum_smooth2(spark, sf_dir):
    out = metrics.mean_spectrum(fs.spectrum(fs.transformed(event_series(spark, sf_dir), "smooth2").select("id", "series")))
    return out.select("frequency", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


@query(f"""WITH {EVENTS}, v AS (SELECT id, y, series[y + 1] AS v FROM es, (SELECT unnest(range(256)) AS y)),
s AS (SELECT id, y, sign(v - lag(v) OVER w) AS up, sign(lead(v) OVER w - v) AS nx FROM v WINDOW w AS (PARTITION BY id ORDER BY y))
SELECT id, CAST(y AS INT) AS y, CAST(up AS INT) AS kind FROM s WHERE up * nx < 0""")
def extrema(spark, sf_dir):
    return metrics.extrema(event_series(spark, sf_dir))


@query(f"""WITH {INPUT}, v AS (SELECT id, y, round(series[y + 1], 9) AS v FROM si, (SELECT unnest(range(256)) AS y)),
s AS (SELECT id, y, sign(v - lag(v) OVER w) AS up, sign(lead(v) OVER w - v) AS nx FROM v WINDOW w AS (PARTITION BY id ORDER BY y))
SELECT id, CAST(y AS INT) AS y, CAST(up AS INT) AS kind FROM s WHERE up * nx < 0""")
def extrema_gradient(spark, sf_dir):
    """Extrema of the smoothed gradient."""
    return metrics.extrema(similar_input(spark, sf_dir).withColumn("series", F.transform("series", lambda v: F.round(v, 9))))


# Ingest


@query(f"WITH {ENTRIES} SELECT min(year) AS min_year, max(year) AS max_year, count(DISTINCT ngram) AS n_ngrams, max(greatest(var0, var1)) AS max_count, count(*) AS n_entries FROM en")
def scan_report(spark, sf_dir):
    return ngrams.scan_report(entries(spark, sf_dir))


@query(f"WITH {ENTRIES} SELECT row_number() OVER (ORDER BY ngram) - 1 AS id, ngram FROM (SELECT DISTINCT ngram FROM en)")
def ngram_map(spark, sf_dir):
    return ngrams.numbered(entries(spark, sf_dir))


@query(f"WITH {ENTRIES} SELECT ngram, year, var0, var1 FROM en WHERE NOT regexp_matches(ngram, '{UNCLEAN}')")
def clean_entries(spark, sf_dir):
    return ingest.clean_entries(entries(spark, sf_dir))


@query(f"WITH {ENTRIES} SELECT row_number() OVER (ORDER BY ngram) - 1 AS id, ngram FROM (SELECT DISTINCT lower(nfc_normalize(ngram)) AS ngram FROM en)")
def normalized_map(spark, sf_dir):
    return ingest.normalized_map(entries(spark, sf_dir))


@query()
def stemmed_map(spark, sf_dir):
    words = entries(spark, sf_dir).filter(text.clean(F.col("ngram"))).select(F.lower("ngram").alias("ngram")).distinct()
    return words.select("ngram", text.stemmed()(F.col("ngram")).alias("stem"))


def _lemma_tables(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words of up to four letters, or that end in e, as known lemmas; words that begin with q as irregular forms of what follows."""
    known = words.filter("length(ngram) <= 4 OR ngram LIKE '%e'").select(F.col("ngram").alias("lemma"))
    return known, words.filter("ngram LIKE 'q_%'").select(F.col("ngram").alias("form"), F.substr("ngram", F.lit(2)).alias("lemma"))


@query(f"""WITH {ENTRIES},
wd AS MATERIALIZED (SELECT DISTINCT lower(ngram) AS w FROM en WHERE NOT regexp_matches(ngram, '{UNCLEAN}')),
kn AS (SELECT w AS made FROM wd WHERE length(w) <= 4 OR w LIKE '%e'),
ca AS (SELECT w, w AS made FROM wd UNION ALL SELECT w, left(w, length(w) - length(e)) || b FROM wd, (VALUES """ + ", ".join(f"('{e}', '{b}')" for e, b in lemmas.VERB_ENDINGS) + """) AS v(e, b) WHERE ends_with(w, e)),
be AS (SELECT w, arg_min(made, length(made) * 1000000 + k) AS made FROM (SELECT w, made, row_number() OVER (ORDER BY made) % 1000000 AS k FROM ca WHERE made IN (SELECT made FROM kn)) GROUP BY w)
SELECT wd.w AS ngram, CASE WHEN wd.w LIKE 'q_%' THEN substr(wd.w, 2) ELSE coalesce(be.made, wd.w) END AS stem FROM wd LEFT JOIN be ON be.w = wd.w""")
def lemmatized_map(spark, sf_dir):
    """Base forms of all words, by tables of lemmas and of irregular forms."""
    words = materialized(entries(spark, sf_dir).filter(text.clean(F.col("ngram"))).select(F.lower("ngram").alias("ngram")).distinct(), "words")
    return lemmas.lemmatized(words, *_lemma_tables(words))


STORE = f"""{ENTRIES},
mp AS (SELECT row_number() OVER (ORDER BY ngram) - 1 AS id, ngram FROM (SELECT DISTINCT lower(ngram) AS ngram FROM en WHERE NOT regexp_matches(ngram, '{UNCLEAN}'))),
su AS (SELECT id, year - 1800 AS y, sum(var0)::BIGINT AS var0, sum(var1)::BIGINT AS var1 FROM en JOIN mp ON lower(en.ngram) = mp.ngram WHERE year BETWEEN 1800 AND 1927 GROUP BY 1, 2)"""


def _dictionary(e: DataFrame) -> DataFrame:
    return ingest.normalized_map(ingest.clean_entries(e), ascii_normalized)


@query(f"WITH {STORE} SELECT id, CAST(y AS INT) AS y, var0, var1 FROM su")
def store(spark, sf_dir):
    e = entries(spark, sf_dir)
    return ingest.summed(e, _dictionary(e), ystart=1800, ylength=128, normalize=ascii_normalized)


NORMAL = "lower(nfc_normalize(ngram))"  # the texts here have no characters that NFKC maps further
MAPPED = f"""{ENTRIES},
mp AS (SELECT row_number() OVER (ORDER BY ngram) - 1 AS id, ngram FROM (SELECT DISTINCT {NORMAL} AS ngram FROM en WHERE NOT regexp_matches(ngram, '{UNCLEAN}'))),
su AS (SELECT id, year - 1753 AS y, sum(var0)::BIGINT AS var0, sum(var1)::BIGINT AS var1 FROM (SELECT *, {NORMAL} AS norm FROM en) e JOIN mp ON e.norm = mp.ngram GROUP BY 1, 2)"""


@query(f"WITH {MAPPED} SELECT id, CAST(y AS INT) AS y, var0, var1 FROM su")
def store_normalized(spark, sf_dir):
    """All years, by the library's own normalisation."""
    e = entries(spark, sf_dir)
    return ingest.summed(e, ingest.normalized_map(ingest.clean_entries(e)))


@query(f"WITH {MAPPED} SELECT id, ngram, CAST(y AS INT) AS y, var0::DOUBLE AS v FROM su JOIN mp USING (id)")
def built_series(spark, sf_dir):
    """The values other than 0 of the series of every n-gram."""
    e = entries(spark, sf_dir)
    rows = ingest.build_series(e, ingest.normalized_map(ingest.clean_entries(e)))
    return rows.select("id", "ngram", F.posexplode("series").alias("y", "v")).filter("v <> 0")


@query(f"""WITH {ENTRIES},
tr AS (SELECT DISTINCT lower(ngram) AS ngram, substr(lower(ngram), 1, 3) AS stem FROM en WHERE NOT regexp_matches(ngram, '{UNCLEAN}')),
mp AS (SELECT row_number() OVER (ORDER BY stem) - 1 AS id, stem FROM (SELECT DISTINCT stem FROM tr))
SELECT id, CAST(year - 1753 AS INT) AS y, sum(var0)::BIGINT AS var0, sum(var1)::BIGINT AS var1 FROM en JOIN tr ON lower(en.ngram) = tr.ngram JOIN mp USING (stem) WHERE year BETWEEN 1753 AND 2008 GROUP BY 1, 2""")
def store_transitions(spark, sf_dir):
    e = entries(spark, sf_dir)
    tr = ingest.clean_entries(e).select(F.lower("ngram").alias("ngram")).distinct().withColumn("stem", F.substring("ngram", 1, 3))
    return ingest.summed(e, ngrams.numbered(tr.select(F.col("stem").alias("ngram"))), tr, normalize=ascii_normalized)


@query(f"""WITH {STORE}, g AS (SELECT id, ngram, list(coalesce(var0, 0)::DOUBLE ORDER BY t) AS series FROM (SELECT mp.id, ngram, t, var0 FROM mp CROSS JOIN (SELECT unnest(range(128)) AS t) LEFT JOIN su ON su.id = mp.id AND su.y = t) GROUP BY 1, 2)
SELECT id, ngram, list_sum(series) AS total FROM g WHERE list_sum(series) >= 20""")
def prune_support(spark, sf_dir):
    e = entries(spark, sf_dir)
    rows = ingest.build_series(e, _dictionary(e), ystart=1800, ylength=128, normalize=ascii_normalized)
    return ingest.prune_support(rows, 20).select("id", "ngram", ingest.support(F.col("series")).alias("total"))


@query(f"WITH {ENTRIES}, k AS (SELECT DISTINCT ngram FROM en WHERE NOT regexp_matches(ngram, '{UNCLEAN}')) SELECT count(*) AS total, count(*) FILTER (k.ngram IS NOT NULL AND year BETWEEN 1800 AND 1927) AS written FROM en LEFT JOIN k USING (ngram)")
def entry_counts(spark, sf_dir):
    e = entries(spark, sf_dir)
    return ingest.entry_counts(e, ingest.clean_entries(e).select("ngram").distinct(), 1800, 128)


@query(f"""WITH {ENTRIES}, r AS (SELECT DISTINCT ngram, NOT regexp_matches(ngram, '{UNCLEAN}') AS ok, lower(substr(ngram, 1, 1)) AS letter FROM en)
SELECT letter, count(*) AS raw, count(*) FILTER (ok) AS cleaned, count(DISTINCT CASE WHEN ok THEN lower(ngram) END) AS normalised, round(1 - count(DISTINCT CASE WHEN ok THEN lower(ngram) END)::DOUBLE / count(*), 6) AS lost FROM r GROUP BY ROLLUP (letter)""")
def cleaning_losses(spark, sf_dir):
    return ingest.cleaning_losses(entries(spark, sf_dir), ascii_normalized).withColumn("lost", R6(F.col("lost")))


@query(f"""WITH {ENTRIES}, w AS (SELECT DISTINCT lower(ngram) AS ngram FROM en WHERE year < 1881 UNION SELECT DISTINCT lower(ngram) FROM en WHERE year >= 1881)
SELECT row_number() OVER (ORDER BY ngram) - 1 AS id, ngram FROM w""")
def joined_maps(spark, sf_dir):
    e = entries(spark, sf_dir)
    half = lambda c: ingest.normalized_map(e.filter(c), ascii_normalized)
    return ingest.joined_maps(half("year < 1881"), half("year >= 1881"))


@query(f"WITH {ENTRIES} SELECT DISTINCT ngram FROM en WHERE year >= 1881 AND ngram NOT IN (SELECT ngram FROM en WHERE year < 1881)")
def new_ngrams(spark, sf_dir):
    e = entries(spark, sf_dir)
    return e.filter("year >= 1881").select("ngram").distinct().join(e.filter("year < 1881").select("ngram"), "ngram", "left_anti")


@query(r"""SELECT l_partkey AS id, CAST(datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) // 10 AS INT) AS y, count(*) AS var0, count(DISTINCT l_orderkey) AS var1 FROM lineitem
WHERE datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) >= 0 AND datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) // 10 < 256 GROUP BY 1, 2""")
def series_parts(spark, sf_dir):
    return part_counts(spark, sf_dir)


@query(f"WITH {EVENTS} SELECT CAST(y AS INT) AS y, sum(var0)::BIGINT AS total FROM ec WHERE y BETWEEN 0 AND 255 GROUP BY 1")
def year_sums(spark, sf_dir):
    return metrics.per_year(event_counts(spark, sf_dir))


@query(f"WITH {EVENTS}, e AS (SELECT * FROM ec WHERE y BETWEEN 0 AND 255) SELECT id, CAST(y AS INT) AS y, round(var0 / sum(var0) OVER (PARTITION BY y), 6) AS share FROM e")
def relative_counts(spark, sf_dir):
    return metrics.relative_counts(event_counts(spark, sf_dir)).withColumn("share", R6(F.col("share")))


@query(f"WITH {EVENTS} SELECT floor(v / 2) * 2 AS bin, count(*) AS n FROM (SELECT unnest(series) AS v FROM es) GROUP BY 1")
def value_histogram(spark, sf_dir):
    rows = event_series(spark, sf_dir).select(F.explode("series").alias("v"))
    return metrics.histogram(rows, "v", 2.0).withColumn("bin", F.col("bin").cast("double"))


@query(f"WITH {EVENTS} SELECT floor(ln(1 + v) / 0.5) * 0.5 AS bin, count(*) AS n FROM (SELECT unnest(series) AS v FROM es) GROUP BY 1")
def log_histogram(spark, sf_dir):
    rows = event_series(spark, sf_dir).select(F.explode("series").alias("v")).select(F.log1p("v").alias("v"))
    return metrics.histogram(rows, "v", 0.5)


# Wavelets, graphs and metrics


@query(f"""WITH {EVENTS}, v AS (SELECT id, y, series[y + 1] AS v FROM es, (SELECT unnest(range(256)) AS y)),
l AS (SELECT unnest(range(8)) AS level)
SELECT id, CAST(level AS INT) AS level, CAST(y // (1 << (8 - level)) AS INT) AS pos, sum(CASE WHEN (y // (1 << (7 - level))) % 2 = 0 THEN v ELSE -v END) AS x FROM v, l GROUP BY 1, 2, 3""")
def haar_coefficients(spark, sf_dir):
    return wavelet.haar_long(event_series(spark, sf_dir), LENGTH)


@query(f"WITH {EVENTS} " + UNROLL.format("(SELECT id, series AS x FROM es)", LENGTH))
def haar_round_trip(spark, sf_dir):
    return rounded(wavelet.inverse_haar(wavelet.haar(event_series(spark, sf_dir))))


def _pruned_sql(source: str, length: int, threshold: float) -> str:
    """co (all coefficients), rest (those kept), bk (id, t, v, b: values in the logarithm and restored), st (what is gone). Coefficients are tried
    one after another, a step of the recursion each."""
    return f"""lg AS MATERIALIZED (SELECT id, x, list_sum(x) AS total FROM (SELECT id, list_transform(series, lambda v: log10(1 + v)) AS x FROM ({source}))),
le AS (SELECT level, {length} >> level AS block FROM (SELECT unnest(range({length.bit_length() - 1}))::INT AS level)),
co AS MATERIALIZED (SELECT id, level, (1 << level) + pos AS i, (list_sum(x[pos * block + 1:pos * block + block // 2]) - list_sum(x[pos * block + block // 2 + 1:(pos + 1) * block])) / sqrt(block) AS c, sqrt(block) AS root FROM lg, (SELECT level, block, unnest(range(1 << level)) AS pos FROM le)),
od AS MATERIALIZED (SELECT id, i, root * abs(c) AS cost, row_number() OVER (PARTITION BY id ORDER BY level DESC, round(c, 9) + 0.0, substr(md5(concat('0:', id, ':', i)), 1, 15)) AS n FROM co),
st(id, n, budget, gone) AS (
  SELECT id, 0::BIGINT, {threshold} * total, []::BIGINT[] FROM lg
  UNION ALL
  SELECT id, n, CASE WHEN go THEN budget - cost ELSE budget END, CASE WHEN go THEN list_append(gone, i) ELSE gone END
  FROM (SELECT o.id, o.n, budget, gone, cost, i, (i >= {length // 2} OR (list_contains(gone, 2 * i) AND list_contains(gone, 2 * i + 1))) AND cost < budget - 1e-9 AS go FROM st JOIN od o ON o.id = st.id AND o.n = st.n + 1)),
rest AS MATERIALIZED (SELECT id, i, c, level FROM co JOIN (SELECT id, gone FROM st WHERE n = {length - 1}) g USING (id) WHERE NOT list_contains(gone, i)),
bk AS MATERIALIZED (SELECT l.id, t, l.x[t + 1] AS v, total, total / {length} + coalesce(sum(CASE WHEN t % ({length} >> level) < ({length // 2} >> level) THEN c ELSE -c END / sqrt({length} >> level)), 0) AS b
  FROM (SELECT *, unnest(range({length})) AS t FROM lg) l LEFT JOIN rest r ON r.id = l.id AND r.i = (1 << r.level) + t // ({length} >> r.level) GROUP BY l.id, t, v, total),
er AS (SELECT id, max(pow((v - b) / CASE WHEN total = 0 THEN 1 ELSE total END, 2)) AS error FROM bk GROUP BY id),
kp AS (SELECT lg.id, count(i) AS kept FROM lg LEFT JOIN (SELECT * FROM rest WHERE abs(c) > 1e-9) r ON r.id = lg.id GROUP BY lg.id)"""


@query(f"WITH RECURSIVE {EVENTS},\n{_pruned_sql('SELECT id, series FROM es', LENGTH, 0.02)}\nSELECT id, CAST(kept AS INT) AS kept, round(error, 9) AS error FROM kp JOIN er USING (id)")
def wavelet_prune(spark, sf_dir):
    """Counts, where many coefficients are equal and a hash of their places says which goes first."""
    return wavelet.prune(event_series(spark, sf_dir), 0.02).select("id", "kept", F.round("error", 9).alias("error"))


@query(f"WITH RECURSIVE {EMBEDDED},\n{_pruned_sql('SELECT id, list_transform(series, lambda v: abs(v)) AS series FROM es', 64, 0.1)}\nSELECT id, CAST(t AS INT) AS y, round(pow(10, b) - 1, 6) + 0.0 AS v, round(error, 6) AS error, CAST(kept AS INT) AS kept FROM bk JOIN er USING (id) JOIN kp USING (id)")
def wavelet_prune_rows(spark, sf_dir):
    """Pruned and restored values, where no two coefficients are equal and so their order is given."""
    rows = embedded(spark, sf_dir).withColumn("series", F.transform("series", F.abs))
    out = wavelet.prune(rows, 0.1)
    return out.select("id", F.posexplode("series").alias("y", "v"), R6(F.col("error")).alias("error"), "kept").withColumn("v", R6(F.col("v")) + F.lit(0.0))


THRESHOLDS = (0.005, 0.02, 0.1)


def _report_sql() -> str:
    ctes, rows = [], []
    for k, t in enumerate(THRESHOLDS):
        named = lambda sql, k=k: re.sub(r"\b(lg|le|co|od|st|rest|bk|er|kp)\b", rf"\1_{k}", sql)
        ctes.append(named(_pruned_sql("SELECT id, series FROM es", LENGTH, t)))
        rows.append(named(f"SELECT {t}::DOUBLE AS threshold, level, (SELECT count(*) FROM es) AS n, (SELECT count(*) FROM rest r WHERE abs(c) > 1e-9 AND r.level = le.level) AS kept, round((SELECT avg(error) FROM er), 9) AS mean_error, round((SELECT max(error) FROM er), 9) AS max_error FROM le"))
    every = ",\n".join(ctes)
    return f"WITH RECURSIVE {EVENTS},\n{every}\nSELECT threshold, level, n, kept, round(kept::DOUBLE / (n * (1 << level)), 6) AS share, mean_error, max_error FROM ({' UNION ALL '.join(rows)})"


@query(_report_sql())
def pruning_report(spark, sf_dir):
    """What pruning keeps and loses at several thresholds, a row per threshold and level."""
    out = wavelet.pruning_report(event_series(spark, sf_dir), LENGTH, THRESHOLDS)
    return out.withColumns({"share": R6(F.col("share")), "mean_error": F.round("mean_error", 9), "max_error": F.round("max_error", 9)})


def _graph_sql(r: int, limit: int, howmany: int) -> str:
    """CTEs up to edges(a, b, dist): an expansion of the nearest known series after another."""
    out, links = "k0(id, dist) AS (SELECT 0::BIGINT, 0::DOUBLE)", []
    for s in range(1, howmany + 1):
        w = warping_sql(f"SELECT s.id, o.series AS a, s.series AS b FROM es s, (SELECT series FROM es JOIN q{s} USING (id)) o", 64, r)
        w = w.replace("pr AS", f"pr{s} AS").replace("FROM pr", f"FROM pr{s}").replace("JOIN pr", f"JOIN pr{s}").replace("cell", f"cell{s}").replace("d2 AS MATERIALIZED", f"d2_{s} AS MATERIALIZED")
        done = " UNION ALL ".join(f"SELECT id FROM q{t}" for t in range(1, s + 1))
        out += f""",
q{s} AS MATERIALIZED (SELECT id FROM k{s - 1} ORDER BY dist, id LIMIT 1),
{w},
n{s} AS (SELECT id, sqrt(d2) AS d, row_number() OVER (ORDER BY d2, id) AS k FROM d2_{s} QUALIFY k <= {max(limit, 2)}),
e{s} AS MATERIALIZED (SELECT n.id, CASE WHEN u.d <> 0 THEN n.d / u.d WHEN n.d <> 0 THEN 'infinity'::DOUBLE ELSE 0 END AS dist FROM n{s} n, (SELECT d FROM n{s} WHERE k = 2) u WHERE k <= {limit}),
k{s} AS MATERIALIZED (SELECT id, min(dist) AS dist FROM (SELECT * FROM k{s - 1} UNION ALL SELECT * FROM e{s}) WHERE id NOT IN ({done}) GROUP BY id)"""
        links.append(f"SELECT {s} AS s, greatest(e.id, q.id) AS a, least(e.id, q.id) AS b, dist FROM e{s} e, q{s} q")
    return out + f",\nedges AS MATERIALIZED (SELECT a, b, arg_min(dist, s) AS dist FROM ({' UNION ALL '.join(links)}) GROUP BY a, b)"


GRAPH = f"WITH RECURSIVE {EMBEDDED},\n{_graph_sql(5, 6, 4)}"


@query(f"{GRAPH}\nSELECT a, b, round(dist, 6) AS dist FROM edges")
def similarity_graph(spark, sf_dir):
    return graph.similarity_graph(embedded(spark, sf_dir), QUERY, 5, 6, 4)[0].withColumn("dist", R6(F.col("dist")))


@query(GRAPH + """
SELECT concat('  n', id, ' [label="', ngram, '"];') AS line FROM es WHERE id IN (SELECT a FROM edges UNION SELECT b FROM edges)
UNION ALL SELECT concat('  n', a, ' -- n', b, ' [weight=', printf('%.6g', dist), '];') FROM edges WHERE a <> b
UNION ALL SELECT unnest(['graph similar {', '}'])""")
def similarity_drawing(spark, sf_dir):
    """The lines of the graph's DOT file."""
    text = graph.graph_dot(*graph.similarity_graph(embedded(spark, sf_dir), QUERY, 5, 6, 4))
    return spark.createDataFrame([(line,) for line in text.split("\n")], "line string")


# The graph that shares equal subtrees only, which SQL can build too: a subtree is its place and its steps.

LINKS = """ed AS MATERIALIZED (SELECT DISTINCT c.key AS node, p.key AS parent FROM tr c JOIN tr p ON c.id = p.id AND c.level = p.level + 1 AND c.pos // 2 = p.pos),
np AS (SELECT node, count(*) AS n FROM ed GROUP BY node)"""

SHARED = f"""{EVENTS},
tr AS MATERIALIZED (SELECT id, level, pos, concat(level, ':', pos, ':', CAST(list_transform(range((256 >> level) - 1), lambda t: series[pos * (256 >> level) + t + 2] - series[pos * (256 >> level) + t + 1]) AS VARCHAR)) AS key,
  list_sum(series[pos * (256 >> level) + 1:pos * (256 >> level) + (128 >> level)]) - list_sum(series[pos * (256 >> level) + (128 >> level) + 1:(pos + 1) * (256 >> level)]) AS x
  FROM (SELECT id, series, level, unnest(range(1 << level)) AS pos FROM es, (SELECT unnest(range(8))::INT AS level))),
{LINKS}"""


def _traced(query: int, maxdepth: int, begin: int = 0, end: int = LENGTH, minweight: float = 0.0) -> str:
    """fr(start, i, weight) of the walks from each level, which go up together."""
    ctes, last = "", None
    for level in range(maxdepth, -1, -1):
        width = LENGTH >> level
        inside = f" AND {end} > {width} * pos AND {begin} < {width} * (pos + 1)" if level else ""
        own = f"SELECT {level} AS start, key AS node, 1.0::DOUBLE AS w FROM tr WHERE id = {query} AND level = {level}{inside}"
        up = f"SELECT start, parent AS node, product(w / n) AS w FROM {last} JOIN ed USING (node) JOIN np USING (node) GROUP BY 1, 2 UNION ALL " if last else ""
        ctes += f"\nup{level} AS MATERIALIZED (SELECT * FROM ({up}{own}) WHERE w >= {minweight}),"
        last = f"up{level}"
    return f"{ctes}\nfr AS (SELECT start, id AS i, w AS weight FROM {last} JOIN tr ON tr.key = {last}.node AND tr.level = 0)"


RANKED = """, su AS (SELECT start, i, sum(weight) AS s FROM fr GROUP BY start, i UNION ALL SELECT NULL, i, sum(weight) FROM fr GROUP BY i)
SELECT start, row_number() OVER (PARTITION BY start ORDER BY s DESC) - 1 AS rank, round(log10(s), 6) + 0.0 AS strength FROM su QUALIFY rank < 20"""


def _strengths(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Rank and strength of the best. Which of equally strong ones comes first hangs on the last digit of products, so it is left out."""
    best = trace.traceback(found, rows.select("id", "ngram"))
    return best.select("start", F.col("rank").cast("long").alias("rank"), (R6(F.log10("weight")) + F.lit(0.0)).alias("strength"))


def _shared(spark, sf_dir):
    rows = materialized(event_series(spark, sf_dir), "event-series")
    return rows, *wavelet.shared_dag(rows, LENGTH)


@query(f"WITH {SHARED} SELECT level, count(DISTINCT key) AS nodes, round(count(DISTINCT key)::DOUBLE / ((SELECT count(*) FROM es) * (1 << level)), 6) AS ratio FROM tr GROUP BY level")
def shared_levels(spark, sf_dir):
    _, nodes, roots = _shared(spark, sf_dir)
    return wavelet.dag_levels(nodes, roots).withColumn("ratio", R6(F.col("ratio")))


@query(f"WITH {SHARED} SELECT round((count(DISTINCT key) * 14 + (SELECT count(*) FROM es) * 20)::DOUBLE / ((SELECT count(*) FROM es) * 256 * 8), 6) AS rate FROM tr")
def shared_rate(spark, sf_dir):
    """Bytes of the graph over those of the series."""
    _, nodes, roots = _shared(spark, sf_dir)
    return spark.createDataFrame([(round(wavelet.compression_rate(nodes, roots, LENGTH), 6),)], "rate double")


@query(f"WITH {EVENTS} " + UNROLL.format("(SELECT id, series AS x FROM es)", LENGTH))
def shared_reconstruct(spark, sf_dir):
    _, nodes, roots = _shared(spark, sf_dir)
    return rounded(wavelet.reconstruct(nodes, roots, LENGTH))


@query(f"WITH {SHARED},{_traced(0, 6)}\nSELECT start, i, round(log10(weight), 6) + 0.0 AS strength FROM fr")
def shared_trace(spark, sf_dir):
    _, nodes, roots = _shared(spark, sf_dir)
    return trace.trace(nodes, roots, 0, LENGTH, 6).select("start", "i", (R6(F.log10("weight")) + F.lit(0.0)).alias("strength"))


@query(f"WITH {SHARED},{_traced(0, 6)}{RANKED}")
def shared_traceback(spark, sf_dir):
    rows, nodes, roots = _shared(spark, sf_dir)
    return _strengths(trace.trace(nodes, roots, 0, LENGTH, 6), rows)


@query(f"""WITH RECURSIVE {SHARED},{_traced(0, 6)},
""" + warping_sql("SELECT s.id, q.series AS a, s.series AS b FROM es s, (SELECT series FROM es WHERE id = 0) q WHERE s.id IN (SELECT i FROM fr)", LENGTH, RADIUS) + """
SELECT row_number() OVER (ORDER BY d2, id) - 1 AS rank, ngram, id, round(sqrt(d2 / 256), 6) AS distance FROM d2 JOIN es USING (id) ORDER BY d2, id LIMIT 20""")
def shared_candidates(spark, sf_dir):
    rows, nodes, roots = _shared(spark, sf_dir)
    return trace.knn_dtw_candidates(rows, nodes, roots, QUERY, RADIUS, 20, 6).withColumns({"rank": F.col("rank").cast("long"), "distance": R6(F.col("distance"))})


@query(f"""WITH {SHARED}, us AS (SELECT level, pos, key, any_value(x) AS x, count(DISTINCT id) AS uses FROM tr WHERE id IN (0, 1, 2) GROUP BY 1, 2, 3)
SELECT level, CAST(pos AS INT) AS pos, uses, x, round(coalesce((x - min(x) OVER w) / nullif(max(x) OVER w - min(x) OVER w, 0), 0.5), 6) AS scaled_x FROM us WINDOW w AS (PARTITION BY level, pos)""")
def shared_frames(spark, sf_dir):
    _, nodes, roots = _shared(spark, sf_dir)
    return graph.dag_frames(nodes, roots, [0, 1, 2])[0].select("level", "pos", "uses", "x", R6(F.col("scaled_x")).alias("scaled_x"))


# The graph of merged subtrees: blocks with the same children and coefficients in one cell share a node.

MERGE_ERROR = 2.0


def _merged_sql(max_error: float = MERGE_ERROR, step: float = merge.STEP) -> str:
    """tr(id, level, pos, key, x, c0, c1, error): each place of each tree, with the node that it takes as key."""
    out = f"""{EVENTS},
tx AS MATERIALIZED (SELECT id, level, pos, list_sum(series[pos * (256 >> level) + 1:pos * (256 >> level) + (128 >> level)]) - list_sum(series[pos * (256 >> level) + (128 >> level) + 1:(pos + 1) * (256 >> level)]) AS x
  FROM (SELECT id, series, level, unnest(range(1 << level)) AS pos FROM es, (SELECT unnest(range(8))::INT AS level)))"""
    for level in reversed(range(8)):
        block = 256 >> level
        if level == 7:
            own = "SELECT id, pos, x, -1 - pos AS c0, -1 - pos AS c1, 0.0::DOUBLE AS error FROM tx WHERE level = 7"
        else:
            own = f"SELECT x.id, x.pos, x.x, a.key AS c0, b.key AS c1, greatest(a.error, b.error) AS error FROM tx x JOIN m{level + 1} a ON a.id = x.id AND a.pos = 2 * x.pos JOIN m{level + 1} b ON b.id = x.id AND b.pos = 2 * x.pos + 1 WHERE x.level = {level}"
        out += f""",
m{level} AS MATERIALIZED (SELECT id, {level} AS level, pos, min(id * 512 + {1 << level} + pos) OVER (PARTITION BY c0, c1, v) AS key, v AS x, c0, c1, error FROM (
  SELECT id, pos, c0, c1, CASE WHEN more <= {max_error} THEN low ELSE x END AS v, CASE WHEN more <= {max_error} THEN more ELSE error END AS error FROM (
    SELECT *, error + abs(x - low) / {block} AS more FROM (SELECT *, min(x) OVER (PARTITION BY c0, c1, floor(x / {step * max_error * block})) AS low FROM ({own})))))"""
    return out + ",\ntr AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM m{level}" for level in range(8)) + ")"


def _dag(spark, sf_dir):
    rows = materialized(event_series(spark, sf_dir), "event-series")
    return rows, *merge.merged_dag(rows, LENGTH, MERGE_ERROR)


@query(f"WITH {_merged_sql()} SELECT level, count(DISTINCT key) AS nodes, round(count(DISTINCT key)::DOUBLE / ((SELECT count(*) FROM es) * (1 << level)), 6) AS ratio FROM tr GROUP BY level")
def dag_levels(spark, sf_dir):
    _, nodes, roots = _dag(spark, sf_dir)
    return wavelet.dag_levels(nodes, roots).withColumn("ratio", R6(F.col("ratio")))


@query(f"""WITH {_merged_sql()}
SELECT DISTINCT level, CAST(key % 512 - (1 << level) AS INT) AS pos, key AS node_id, x, CASE WHEN c0 >= 0 THEN c0 END AS c0, CASE WHEN c1 >= 0 THEN c1 END AS c1 FROM tr""")
def dag_nodes(spark, sf_dir):
    """Every node of the merged graph."""
    return _dag(spark, sf_dir)[1]


RESTORED = """bk AS MATERIALIZED (SELECT e.id, e.t, any_value(e.v) AS v, any_value(e.total) / 256 + sum(CASE WHEN t % (256 >> level) < (128 >> level) THEN x ELSE -x END / (256 >> level)) AS b
  FROM (SELECT id, unnest(range(256)) AS t, unnest(series) AS v, list_sum(series) AS total FROM es) e JOIN tr ON tr.id = e.id AND tr.pos = e.t // (256 >> tr.level) GROUP BY e.id, e.t)"""


@query(f"""WITH {_merged_sql()},
{RESTORED}
SELECT id, round(max(abs(v - b)), 6) AS gap, round(error, 6) AS error FROM bk JOIN (SELECT id, error FROM m0) USING (id) GROUP BY id, error""")
def dag_reconstruct(spark, sf_dir):
    """The largest absolute difference that the graph leaves in each series, and the error it states."""
    rows, nodes, roots = _dag(spark, sf_dir)
    back = wavelet.reconstruct(nodes, roots, LENGTH).withColumnRenamed("series", "back")
    gap = F.array_max(F.zip_with("series", "back", lambda a, b: F.abs(a - b)))
    return rows.join(back, "id").join(roots.withColumnRenamed("i", "id"), "id").select("id", R6(gap).alias("gap"), R6(F.col("error")).alias("error"))


@query(f"WITH {_merged_sql()},\n{LINKS},{_traced(0, 4)}{RANKED}")
def traceback(spark, sf_dir):
    rows, nodes, roots = _dag(spark, sf_dir)
    return _strengths(trace.trace(nodes, roots, 0, LENGTH, 4), rows)


@query(f"""WITH {_merged_sql()},
{RESTORED},
di AS (SELECT x.id, sqrt(sum(pow(x.v - q.v, 2)) / 256) AS a, sqrt(sum(pow(x.b - q.b, 2)) / 256) AS b FROM bk x JOIN bk q ON q.t = x.t AND q.id = 0 GROUP BY x.id)
SELECT id, round((b - a) / CASE WHEN a = 0 THEN 1 ELSE a END, 6) + 0.0 AS delta FROM di""")
def round_trip(spark, sf_dir):
    """How much compressing and restoring changes each series' distance to one of them."""
    rows, nodes, roots = _dag(spark, sf_dir)
    back = wavelet.reconstruct(nodes, roots, LENGTH).join(rows.select("id", "ngram"), "id")
    a, b = (knn.dtw_distances(materialized(r.select("id", "ngram", "series"), "round-trip"), QUERY, 0) for r in (rows, back))
    return metrics.relative_changes(a, b).select("id", (R6(F.col("delta")) + F.lit(0.0)).alias("delta"))


@query(f"WITH {_merged_sql()},\n{LINKS},{_traced(0, 5).replace('AND level = ', 'AND pos = 0 AND level = ')}\nSELECT start, i, round(log10(weight), 6) + 0.0 AS strength FROM fr WHERE i % 2 = 1")
def trace_hooks(spark, sf_dir):
    """A trace with a caller's conditions: walks only from the first node of each level, and only series with odd ids."""
    _, nodes, roots = _dag(spark, sf_dir)
    hooks = trace.Hooks(keep_down=lambda level, rows: rows.filter("pos = 0"), found=lambda rows: rows.filter("i % 2 = 1"))
    found = trace.trace(nodes, roots, 0, LENGTH, 5, hooks=hooks)
    return found.select("start", "i", (R6(F.log10("weight")) + F.lit(0.0)).alias("strength"))


@query(f"WITH {_merged_sql()},\n{LINKS},{_traced(0, 7, 40, 170, 1e-9)}\nSELECT start, i, round(log10(weight), 6) + 0.0 AS strength FROM fr")
def trace_range(spark, sf_dir):
    """Walks from the nodes over a part of the series, without those that grow too weak on the way up."""
    _, nodes, roots = _dag(spark, sf_dir)
    found = trace.trace(nodes, roots, 0, LENGTH, 7, 40, 170, 1e-9)
    return found.select("start", "i", (R6(F.log10("weight")) + F.lit(0.0)).alias("strength"))


@query(f"""WITH RECURSIVE {_merged_sql()},
{LINKS},{_traced(0, 5)},
""" + warping_sql("SELECT s.id, q.series AS a, s.series AS b FROM es s, (SELECT series FROM es WHERE id = 0) q WHERE s.id IN (SELECT i FROM fr)", LENGTH, RADIUS) + """
SELECT row_number() OVER (ORDER BY d2, id) - 1 AS rank, ngram, id, round(sqrt(d2 / 256), 6) AS distance FROM d2 JOIN es USING (id) ORDER BY d2, id LIMIT 20""")
def knn_dtw_candidates(spark, sf_dir):
    rows, nodes, roots = _dag(spark, sf_dir)
    return trace.knn_dtw_candidates(rows, nodes, roots, QUERY, RADIUS, 20, 5).withColumns({"rank": F.col("rank").cast("long"), "distance": R6(F.col("distance"))})


@query(f"""WITH {_merged_sql()}, us AS (SELECT key AS node_id, level, CAST(key % 512 - (1 << level) AS INT) AS pos, any_value(x) AS x, count(DISTINCT id) AS uses FROM tr WHERE id IN (0, 1) GROUP BY 1, 2, 3)
SELECT node_id, level, pos, uses, x, round(coalesce((x - min(x) OVER w) / nullif(max(x) OVER w - min(x) OVER w, 0), 0.5), 6) AS scaled_x FROM us WINDOW w AS (PARTITION BY level, pos)""")
def dag_frames(spark, sf_dir):
    _, nodes, roots = _dag(spark, sf_dir)
    return graph.dag_frames(nodes, roots, [0, 1])[0].withColumn("scaled_x", R6(F.col("scaled_x")))


def _two_radii() -> str:
    pair = "SELECT s.id, q.series AS a, s.series AS b FROM es s, (SELECT series FROM es WHERE id = 0) q"
    a = warping_sql(pair, 64, 0)
    b = warping_sql(pair, 64, 5).replace("pr AS", "pr_b AS").replace("JOIN pr USING", "JOIN pr_b USING").replace("FROM pr\n", "FROM pr_b\n").replace("cell", "cell_b").replace("d2 AS MATERIALIZED", "d2_b AS MATERIALIZED")
    return f"WITH RECURSIVE {EMBEDDED},\n{a},\n{b}"


@query(_two_radii() + """,
r AS (SELECT id, (sqrt(b.d2 / 64) - sqrt(a.d2 / 64)) / CASE WHEN a.d2 = 0 THEN 1 ELSE sqrt(a.d2 / 64) END AS delta FROM d2 a JOIN d2_b b USING (id))
SELECT round(avg(delta), 6) AS mean, round(stddev_samp(delta), 6) AS std, round(min(delta), 6) AS min, round(max(delta), 6) AS max, """ + ", ".join(f"round(quantile_cont(delta, {q}), 6) AS q{int(round(1000 * q)):03d}" for q in metrics.QUANTILES) + " FROM r")
def change_summary(spark, sf_dir):
    e = embedded(spark, sf_dir)
    a, b = (knn.dtw_distances(e, QUERY, r) for r in (0, 5))
    out = metrics.summary(metrics.relative_changes(a, b))
    return out.select(*(R6(F.col(c)).alias(c) for c in out.columns))


@query(_two_radii() + """,
a AS (SELECT id, row_number() OVER (ORDER BY d2, id) - 1 AS rank FROM d2), b AS (SELECT id, row_number() OVER (ORDER BY d2, id) - 1 AS rank FROM d2_b),
u AS (SELECT 0 AS side, rank, id FROM a WHERE rank < 20 UNION ALL SELECT 1, rank, id FROM b WHERE rank < 20),
f AS (SELECT id, min(side * 1000 + rank) AS seen FROM u GROUP BY id),
c AS (SELECT id, seen, row_number() OVER (ORDER BY seen) AS code FROM f),
t AS (SELECT string_agg(chr(CAST(32 + code AS INT)), '' ORDER BY rank) FILTER (side = 0) AS x, string_agg(chr(CAST(32 + code AS INT)), '' ORDER BY rank) FILTER (side = 1) AS y, count(*) FILTER (side = 1 AND seen >= 1000) AS fresh FROM u JOIN c USING (id))
SELECT round(1 - levenshtein(x, y) / 20, 6) AS rank_similarity, round(levenshtein(x, y) / 20, 6) AS rank_distance, round(fresh / 20, 6) AS new_share FROM t""")
def rank_changes(spark, sf_dir):
    e = embedded(spark, sf_dir)
    a, b = (knn.knn_dtw(e, [QUERY], r, 20) for r in (0, 5))
    out = metrics.rank_changes(a, b, 20)
    return out.select(*(R6(F.col(c)).alias(c) for c in out.columns))


@query(f"WITH {ENTRIES} SELECT lower(ngram) AS ngram, CAST(year - 1753 AS INT) AS y, sum(var0)::BIGINT AS var0, sum(var1)::BIGINT AS var1 FROM en WHERE NOT regexp_matches(ngram, '{UNCLEAN}') AND year BETWEEN 1753 AND 2008 GROUP BY 1, 2")
def streamed_counts(spark, sf_dir):
    """The same sums from a stream of files of entries."""
    from ..streaming import counts

    out = entries(spark, sf_dir)
    stream = spark.readStream.schema(out.schema).parquet(out.inputFiles()[0].rpartition("/")[0])
    at = removed_later(spark, f"{shared_dir(spark)}/tidewarp-stream-{uuid.uuid4().hex}")
    query = counts.to_table(counts.running_counts(stream), f"{at}/counts", f"{at}/state")
    query.awaitTermination()
    return counts.read_table(spark, f"{at}/counts")
