"""Mixing sources to target weights: water-filled targets, Efraimidis-Spirakis sampling. Native."""
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, materialized

WEIGHTS = (3, 1, 2)  # of the sources in code-point order, repeating; null is the last source
SHARE = 1.5  # of all sizes goes to the mix
MOST = 2  # times its size a source, and so a document, is taken at most
SEED = "mix-1"
QUALITY = {1: 2.0, 0: 0.5}  # a document's sampling weight by its quality label; 1 without a label
BUCKET_ROWS = 20_000  # rows with neighbouring keys that one task sorts, about


def sampling_key(doc_id: Column, weight: Column) -> Column:
    """Exponential key -ln(u) / weight, smallest first; u in (0, 1) from 52 bits of an MD5 of the id."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(2**52)) / weight


def source_ranks(sources: DataFrame) -> DataFrame:
    """Adds rank (from 0, in code-point order, null last) without one task for all: range partitions,
    ranked inside, offset by the counts of the partitions before."""
    ranged = materialized(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("p", F.spark_partition_id()), "mix-sources")
    before = ranged.groupBy("p").count().withColumn("before", F.sum("count").over(Window.orderBy("p")) - F.col("count")).select("p", "before")
    inside = F.row_number().over(Window.partitionBy("p").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranged.withColumn("inside", inside).join(F.broadcast(before), "p").select("source", "source_size", "n", (F.col("inside") + F.col("before")).alias("rank"))


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sources: source, source_size, n. Adds target. share of all sizes is dealt by weight; what is
    above most times a source's size is dealt again to the others by weight, until none is above.
    Each round is one sum over the table of sources."""
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int"))
    ranked = materialized(source_ranks(sources).withColumn("w", weight).withColumn("cap", F.col("source_size") * most), "mix-ranked")
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    left, over = total, 0
    while True:
        capped = F.lit(False) if not over else F.col("cap") * F.lit(over) < F.col("w") * F.lit(left)
        cap, w = ranked.agg(F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("w"))), F.lit(0))).first()
        if (total - cap, w) == (left, over) or not w:
            break
        left, over = total - cap, w
    if not over:
        return ranked.withColumn("target", F.lit(0.0)).select("source", "source_size", "n", "target")
    target = F.when(F.col("cap") * F.lit(over) < F.col("w") * F.lit(left), F.col("cap").cast("double")).otherwise(F.col("w") * F.lit(float(left)) / F.lit(over))
    return ranked.withColumn("target", target).select("source", "source_size", "n", "target")


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, quality: DataFrame | None = None) -> DataFrame:
    """docs with size, source_size, target and taken: the words of each document that the mix takes.

    Complete epochs of a source come first, floor(target / size) of them. The rest of its target goes
    to its documents in the order of their sampling keys; the document at the cut gives as many words as
    are missing, so a source is met to the word. quality: doc_id, quality (see QUALITY).

    Null text has size 0; null sources form one source, the last; null ids share one key. Rows that
    repeat an id are one unit at the cut and share it evenly, rounded down. Sources without words have
    target 0. An empty table gives no rows. Columns of docs with the names added are replaced.

    Only (source, id, size) is summed and sorted. A source's keys are dealt to buckets of about
    BUCKET_ROWS rows, whose sums are prefix-summed; rows are sorted in the one bucket with the cut. So a
    hot source is spread over all tasks, and whole documents never shuffle for their source."""
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(*keep, size.alias("size"))
    if quality is None:
        rows = rows.withColumn("__weight", F.lit(1.0))
    else:
        grade = F.col("grade")
        by_id = materialized(quality.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("grade")).select(F.col("doc_id").alias("__id"), F.coalesce(*(F.when(grade == g, w) for g, w in QUALITY.items()), F.lit(1.0)).alias("__w")), "mix-quality")
        rows = rows.join(broadcast_if_small(by_id), F.col("doc_id") == F.col("__id"), "left").withColumn("__weight", F.coalesce("__w", F.lit(1.0))).drop("__id", "__w")
    rows = rows.withColumn("__key", sampling_key(F.col("doc_id"), F.col("__weight")))
    narrow = materialized(rows.select("source", "doc_id", "size", F.col("__key").alias("key")), "mix-rows")
    sources = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = source_targets(sources, weights, share, most).withColumn("epochs", epochs)
    targets = materialized(targets.withColumn("rest", F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")), "mix-targets")
    hint = broadcast_if_small(targets, 100_000)
    at_source = lambda t: narrow["source"].eqNullSafe(t["source"])

    # The bucket of a key, in its order. Dense keys (near 0) get more buckets in larger sources.
    unit = narrow.join(hint, at_source(targets)).select(narrow["source"], "doc_id", "size", "key", "rest", F.floor(F.col("key") * F.ceil(F.col("n") / BUCKET_ROWS)).cast("long").alias("b"))
    buckets = unit.groupBy("source", "b", "rest").agg(F.sum("size").alias("s"))
    running = F.sum("s").over(Window.partitionBy("source").orderBy("b"))
    cut = buckets.withColumn("upto", running).filter("upto > rest AND upto - s <= rest").select(F.col("source").alias("cs"), F.col("b").alias("cb"), (F.col("rest") - (F.col("upto") - F.col("s"))).alias("here"))
    cut = materialized(cut, "mix-buckets")
    near = unit.join(broadcast_if_small(cut, 100_000), F.col("source").eqNullSafe(F.col("cs")) & (F.col("b") == F.col("cb")))
    near = near.groupBy("source", "b", "here", "key", "doc_id").agg(F.sum("size").alias("s"), F.count("*").alias("m"))
    running = F.sum("s").over(Window.partitionBy("source", "b").orderBy("key", "doc_id"))
    cut = near.withColumn("upto", running).filter("upto > here AND upto - s <= here")
    cut = cut.select("source", F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_id"), F.floor((F.col("here") - (F.col("upto") - F.col("s"))) / F.col("m")).cast("long").alias("each"))
    plan = targets.alias("t").join(cut.alias("c"), F.expr("t.source <=> c.source"), "left").select(F.col("t.source").alias("__source"), "source_size", "target", "epochs", "rest", "cut_key", "cut_id", "each")
    plan = materialized(plan, "mix-plan")
    first = (F.col("__key") < F.col("cut_key")) | ((F.col("__key") == F.col("cut_key")) & (F.coalesce(F.col("doc_id") < F.col("cut_id"), F.col("doc_id").isNull() & F.col("cut_id").isNotNull())))
    at_cut = (F.col("__key") == F.col("cut_key")) & F.col("doc_id").eqNullSafe(F.col("cut_id"))
    more = F.when(F.col("cut_key").isNull(), F.when(F.col("rest") > 0, F.col("size")).otherwise(0)).when(first, F.col("size")).when(at_cut, F.least("each", "size")).otherwise(0)
    out = rows.join(broadcast_if_small(plan, 100_000), F.col("source").eqNullSafe(F.col("__source")))
    return out.select(*keep, "size", "source_size", "target", (F.col("epochs") * F.col("size") + more).cast("long").alias("taken"))


def oracle() -> str:
    u = f"(CAST(concat('0x', substr(md5(concat('{SEED}|', coalesce(CAST(doc_id AS VARCHAR), 'null'))), 1, 13)) AS BIGINT) + 0.5) / {float(2**52)}"
    weight = "CASE quality " + " ".join(f"WHEN {g} THEN {w}" for g, w in QUALITY.items()) + " ELSE 1.0 END"
    return f"""WITH q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
d AS (SELECT d.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, -ln({u.replace("doc_id", "d.doc_id")}) / ({weight}) AS key FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS w, {MOST} * source_size AS cap, {SHARE} * sum(source_size) OVER () AS total FROM s),
f AS (SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
  sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ovr FROM w),
lam AS (SELECT lft, ovr FROM f WHERE cap * ovr >= w * lft ORDER BY cap / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN cap * lam.ovr < w * lam.lft THEN cap::DOUBLE ELSE w * lam.lft::DOUBLE / lam.ovr END AS target FROM w, lam),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (SELECT *, floor(target)::BIGINT - epochs * source_size AS rest FROM e),
un AS (SELECT source, key, doc_id, sum(size) AS us, count(*) AS m FROM d GROUP BY source, key, doc_id),
c AS (SELECT *, sum(us) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST) - us AS before FROM un)
SELECT d.doc_id, d.size::BIGINT AS size, r.source_size, r.target,
  (epochs * d.size + CASE WHEN before + us <= rest THEN d.size WHEN before < rest THEN least(floor((rest - before) / m), d.size) ELSE 0 END)::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.key = c.key AND d.doc_id IS NOT DISTINCT FROM c.doc_id"""
