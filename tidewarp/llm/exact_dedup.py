"""Exact dedup: 128-bit content hash, bytes compared inside groups. Native."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, ascii_lower, broadcast_if_small, materialized


def exact_dedup(docs: DataFrame, keep: str = "max") -> DataFrame:
    """One row per row of docs: doc_id, keep_id (of the row that stays), group_size, kept, text_sha256.
    keep: "min" keeps the smallest doc_id of equal texts, "max" the largest.

    Texts are equal if identical after lower-casing A-Z; null counts as empty. Null ids never win over
    others; a group that has no other keeps one of them. Of rows that repeat the winning id in a group
    one is kept. An empty table gives no rows; other columns of docs are not looked at.

    Rows shuffle as hashes and ids only. Texts move only for hashes that occur twice or more, and equal
    bytes are collapsed in each task before that exchange, so a group that holds a third of all rows
    costs no task more than one text from each other task. Should two texts share a hash, they are told
    apart by SHA-256, and if that agreed too, by the texts themselves."""
    best = {"min": F.min, "max": F.max}[keep]
    text = ascii_lower(F.coalesce("text", F.lit("")))
    norm = docs.select("doc_id", text.alias("norm"))
    rows = materialized(norm.select("doc_id", F.unhex(F.md5("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha")), "exact-hashes")
    again = materialized(rows.groupBy("h").count().filter("count > 1").select("h"), "exact-repeated")
    texts = norm.withColumn("h", F.unhex(F.md5("norm"))).join(broadcast_if_small(again), "h", "left_semi")
    same = materialized(texts.groupBy("h", "norm").agg(F.count("*").alias("n"), best("doc_id").alias("keep_id")).withColumn("sha", F.unhex(F.sha2("norm", 256))), "exact-classes")
    if not same.groupBy("h", "sha").count().filter("count > 1").isEmpty():
        rows = norm.select("doc_id", F.unhex(F.md5("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha"), "norm")
        key = ["h", "sha", "norm"]
    else:
        key = ["h", "sha"]
    classes = same.select(*key, "n", "keep_id")
    joined = rows.join(broadcast_if_small(classes), key, "left").select("doc_id", "sha", "n", "keep_id")
    alone = joined.filter("n IS NULL").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    many = joined.filter("n IS NOT NULL").groupBy("sha", "keep_id", "n", "doc_id").agg(F.count("*").alias("m"))
    many = many.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("i"))
    many = many.select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    return alone.unionByName(many)


def oracle() -> str:
    return f"""WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm)"""
