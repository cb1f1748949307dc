"""Target-distribution importance resampling: n-grams from a table of word positions, hashed to buckets whose
gains compare a target text's distribution with the corpus's, then Gumbel top-k."""
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, ascii_lower, broadcast_if_small, materialized

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased text
ORDERS = 2  # n-grams of 1 to so many words
BUCKETS = 10_000
SEED = "7"
SHARE = 25  # per cent of the documents that are long enough
MIN_WORDS = 20
SCALE = 1000


def positions(rows: DataFrame, keys: list[str], orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """keys and b1, b2, ...: per word the bucket of the run of 1, 2, ... words that begins there, null where the text ends
    before. A text without words has one row of nulls. rows: keys (which tell texts apart), text.

    Words are exploded with their positions, and window functions take the following ones from the same text. Where
    rows are already dealt by keys, as from a grouping by them, this exchanges nothing."""
    words = F.filter(F.split(ascii_lower(F.coalesce("text", F.lit(""))), SEPARATORS, -1), lambda w: w != "")
    table = rows.select(*keys, F.posexplode_outer(words).alias("pos", "word"))
    at = Window.partitionBy(*keys).orderBy("pos")
    follow = [F.col("word"), *(F.lead("word", k).over(at) for k in range(1, orders))]
    table = table.select(*keys, *(w.alias(f"w{k}") for k, w in enumerate(follow, 1)))
    grams = [F.col("w1")]
    for k in range(2, orders + 1):
        grams.append(F.concat(grams[-1], F.lit(" "), F.col(f"w{k}")))
    return table.select(*keys, *((F.crc32(g) % buckets).cast("int").alias(f"b{n}") for n, g in enumerate(grams, 1)))


def bucket_counts(table: DataFrame, orders: int, times: Column) -> DataFrame:
    """bucket, n: features of each bucket, each counted `times`. At most as many rows as there are buckets; summed in
    each task first."""
    features = table.select(times.alias("times"), F.explode(F.array(*(f"b{n}" for n in range(1, orders + 1)))).alias("bucket"))
    return features.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("times").cast("long").alias("n"))


def texts_of(docs: DataFrame, doc_id: str) -> DataFrame:
    """doc_id, h, m, text: each different pair of id and text once, with the number of rows that have it."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("doc_id", F.unhex(F.md5("text")).alias("h")).agg(F.count("*").alias("m"), F.first("text").alias("text"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: floor(1000 ln ratio) of the smoothed shares of a bucket in the target and in the corpus. Both:
    bucket, n. Null totals, of an empty table, count as 0."""
    total = lambda t: int(t.agg(F.sum("n")).first()[0] or 0)
    both = corpus.select("bucket", F.col("n").alias("s")).join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
    s, t = F.col("s").cast("double"), F.coalesce("t", F.lit(0)).cast("double")
    ratio = (t + 1) * F.lit(float(total(corpus) + buckets)) / ((s + 1) * F.lit(float(total(target) + buckets)))
    return both.select("bucket", F.floor(SCALE * F.log(ratio)).cast("long").alias("gain"))


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """floor(-1000 ln(-ln u)), u in (0, 1) from the first 32 bits of SHA-256 of seed:id; a null id is the empty string."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def importance_resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", orders: int = ORDERS, buckets: int = BUCKETS, share: int = SHARE, min_words: int = MIN_WORDS, seed: str = SEED) -> DataFrame:
    """One row per row of docs: doc_id, n_features, weight, score, rank. docs: doc_id, text; target: text.

    weight is the floored mean gain of a document's features, score adds Gumbel noise, so that the share of documents with
    the best scores, of those with min_words words, is a sample without replacement by importance. rank counts the
    drawn ones from 1, by score and then by smaller id; others have null.

    Null text counts as empty: no features, weight 0, never drawn. Rows that repeat an id with another text are
    documents of their own, with the same noise; rows that repeat both share their score and get neighbouring
    ranks. A null id ranks behind others of its score, then fewer features go first. An empty target gives each bucket t = 0; an empty docs gives
    no rows. Other columns are not looked at.

    Texts shuffle once, to be dealt by id and hash; positions, windows and buckets follow without another exchange and are
    written as one narrow row a word. One text is the most that a task must sort at once, and it spills. A group of
    equal rows is one text. Only the table of gains, of a row a bucket, is broadcast."""
    keys = ["doc_id", "h", "m"]
    names = [f"b{n}" for n in range(1, orders + 1)]
    table = materialized(positions(texts_of(docs, doc_id), keys, orders, buckets), "positions")
    goal = positions(target.select(F.monotonically_increasing_id().alias("row"), "text"), ["row"], orders, buckets)
    counts = materialized(bucket_counts(table, orders, F.col("m")), "corpus-buckets")
    aims = materialized(bucket_counts(goal, orders, F.lit(1)), "target-buckets")
    gains = materialized(bucket_gains(counts, aims, buckets), "gains")
    for n, name in enumerate(names):
        side = gains.select(F.col("bucket").alias(name), F.col("gain").alias(f"g{n}"))
        table = table.join(broadcast_if_small(side, buckets), name, "left")
    gain = reduce(lambda a, b: a + b, (F.coalesce(f"g{n}", F.lit(0)) for n in range(orders)))
    features = reduce(lambda a, b: a + b, (F.col(c).isNotNull().cast("long") for c in names))
    docs_ = table.groupBy(*keys).agg(F.sum(gain).alias("gains"), F.sum(features).alias("n_features"), F.count("b1").alias("words"))
    mean = F.when(F.col("n_features") > 0, F.expr("(gains - pmod(gains, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    docs_ = docs_.select("doc_id", "n_features", mean.alias("weight"), "words", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
    scored = docs_.select("doc_id", "n_features", "weight", "words", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"))
    return drawn(materialized(scored, "scores"), share, min_words)


def drawn(scored: DataFrame, share: int, min_words: int) -> DataFrame:
    """Adds rank and takes words away. Range partitions of the score are numbered inside and offset by those before, so no
    task sorts all rows."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")]
    able = scored.filter(F.col("words") >= min_words)
    ranged = able.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = ranged.withColumns({"p": F.shiftright("at", 33), "k": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("at")
    ranged = materialized(ranged, "ranked")
    offsets = ranged.groupBy("p").count().withColumns({"before": F.sum("count").over(Window.orderBy("p")) - F.col("count"), "all": F.sum("count").over(Window.partitionBy(F.lit(0)))})
    rank = F.col("before") + F.col("k") + 1
    ranged = ranged.join(broadcast_if_small(materialized(offsets.drop("count"), "rank-offsets")), "p")
    ranged = ranged.withColumn("rank", F.when(rank <= F.floor(F.col("all") * share / 100), rank).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    short = scored.filter(F.col("words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranged.select(*columns).unionByName(short.select(*columns))


def oracle() -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH RECURSIVE crc(i, c) AS (SELECT 0, range(256)::BIGINT[] UNION ALL SELECT i + 1, list_transform(c, lambda x: xor(x >> 1, 3988292384 * (x & 1))) FROM crc WHERE i < 8),
tab AS MATERIALIZED (SELECT c AS tab FROM crc WHERE i = 8),
d AS (SELECT doc_id, {words} AS w, row_number() OVER () AS rid FROM documents),
b AS (SELECT {words} AS w FROM benchmark),
df AS (SELECT rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
bf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
u AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION SELECT f FROM bf)),
k AS MATERIALIZED (SELECT f, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda a, c: xor(a >> 8, tab[1 + (xor(a, c) & 255)]), 4294967295::BIGINT), 4294967295) % {BUCKETS} AS bucket FROM u, tab),
s AS (SELECT bucket, count(*) AS s FROM df JOIN k USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN k USING (f) GROUP BY bucket),
g AS (SELECT bucket, floor({SCALE} * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + {BUCKETS}) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM bf) + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
e AS (SELECT rid, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS w FROM df JOIN k USING (f) JOIN g USING (bucket) GROUP BY rid),
c AS (SELECT d.doc_id, d.rid, coalesce(n, 0)::BIGINT AS n_features, coalesce(e.w, 0)::BIGINT AS weight, len(d.w) AS words,
  (coalesce(e.w, 0) + floor(-{SCALE} * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296.0))))::BIGINT AS score FROM d LEFT JOIN e ON d.rid = e.rid),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS n FROM c WHERE words >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {SHARE} * n // 100 THEN rank END AS rank FROM c LEFT JOIN r ON c.rid = r.rid"""
