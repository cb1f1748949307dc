"""From entries to series: cleaning, normalising, stemming, summing, densifying, pruning."""
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import lists, sliced
from ..functions.text import clean, normalized
from ..model import SUPPORT, YLENGTH, YSTART, check_length
from ..sources.ngrams import numbered


def clean_entries(entries: DataFrame) -> DataFrame:
    return entries.filter(clean(F.col("ngram")))


def normalized_map(entries: DataFrame, normalize=normalized) -> DataFrame:
    """id, ngram of the distinct normalised n-grams. Distinct comes first: it is cheaper than normalising
    every entry, and only the n-gram column is read."""
    raw = entries.select("ngram").distinct()
    return numbered(raw.select(normalize(F.col("ngram")).alias("ngram")))


def summed(entries: DataFrame, dictionary: DataFrame, transitions: DataFrame | None = None, ystart: int = YSTART, ylength: int = YLENGTH, normalize=normalized) -> DataFrame:
    """id, y, var0, var1: counts of all entries that normalise (and stem) to an n-gram of the
    dictionary, for the years from ystart on.

    The year filter reaches the scan. Entries are dealt out by what they normalise to, once: there they are summed, and their sums
    meet the dictionary."""
    check_length(ylength)
    inside = entries.filter(F.col("year").between(ystart, ystart + ylength - 1))
    inside = inside.select(normalize(F.col("ngram")).alias("norm"), (F.col("year") - ystart).alias("y"), "var0", "var1").repartition("norm")
    sums = inside.groupBy("norm", "y").agg(F.sum("var0").alias("var0"), F.sum("var1").alias("var1"))
    if transitions is None:
        return sums.join(dictionary.select("id", F.col("ngram").alias("norm")), "norm").select("id", "y", "var0", "var1")
    to = transitions.select(F.col("ngram").alias("norm"), "stem").join(dictionary.withColumnRenamed("ngram", "stem"), "stem").select("norm", "id")
    return sums.join(to, "norm").groupBy("id", "y").agg(F.sum("var0").alias("var0"), F.sum("var1").alias("var1"))


def densified(counts: DataFrame, value: str, ylength: int, key: str = "id", y: str = "y") -> DataFrame:
    """key, series: the values of each key as an array of ylength doubles, 0 where there is none. One
    exchange by key; a key has at most ylength rows once summed. Values are scattered a batch at a time."""

    def run(parts):
        import pyarrow as pa

        for batch in sliced(parts):
            at, v = batch.column(1), batch.column(2)
            lengths = at.value_lengths().to_numpy()
            rows = np.zeros((batch.num_rows, ylength))
            rows[np.repeat(np.arange(batch.num_rows), lengths), at.flatten().to_numpy()] = v.flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(rows)], names=[key, "series"])

    by = counts.groupBy(key).agg(F.collect_list(F.struct(F.col(y).cast("int").alias("y"), F.col(value).cast("double").alias("v"))).alias("m"))
    by = by.select(key, F.col("m.y").alias("y"), F.col("m.v").alias("v"))
    return by.mapInArrow(run, f"`{key}` {counts.schema[key].dataType.simpleString()}, series array<double>")


def build_series(entries: DataFrame, dictionary: DataFrame, transitions: DataFrame | None = None, ystart: int = YSTART, ylength: int = YLENGTH, value: str = "var0", normalize=normalized) -> DataFrame:
    """id, ngram, series for every n-gram of the dictionary, all 0 for those without entries."""
    dense = densified(summed(entries, dictionary, transitions, ystart, ylength, normalize), value, ylength)
    zeros = F.array_repeat(F.lit(0.0), ylength)
    return dictionary.join(dense, "id", "left").select("id", "ngram", F.coalesce("series", zeros).alias("series"))


def entry_counts(entries: DataFrame, dictionary: DataFrame, ystart: int = YSTART, ylength: int = YLENGTH) -> DataFrame:
    """total entries, and written: those of the years and n-grams that are kept."""
    known = dictionary.select("ngram", F.lit(True).alias("known"))
    kept = F.col("known").isNotNull() & F.col("year").between(ystart, ystart + ylength - 1)
    return entries.join(known, "ngram", "left").agg(F.count("*").alias("total"), F.count_if(kept).alias("written"))


def support(series: DataFrame, column: str = "series") -> Column:
    return F.aggregate(column, F.lit(0.0), lambda s, v: s + v)


def prune_support(series: DataFrame, least: float = SUPPORT) -> DataFrame:
    """Series whose values sum to least or more."""
    return series.filter(support(series) >= least)


def joined_maps(*maps: DataFrame) -> DataFrame:
    """One dictionary of several, numbered anew."""
    out = maps[0].select("ngram")
    for m in maps[1:]:
        out = out.unionByName(m.select("ngram"))
    return numbered(out)


def cleaning_losses(entries: DataFrame, normalize=normalized) -> DataFrame:
    """letter, raw, cleaned, normalised (distinct n-grams) and the fraction lost, per first letter and in
    all (letter null)."""
    raw = entries.select("ngram").distinct().select("ngram", clean(F.col("ngram")).alias("ok"), F.lower(F.substring("ngram", 1, 1)).alias("letter"))
    raw = raw.withColumn("norm", F.when(F.col("ok"), normalize(F.col("ngram"))))
    out = raw.rollup("letter").agg(F.count("*").alias("raw"), F.count_if("ok").alias("cleaned"), F.count_distinct("norm").alias("normalised"))
    return out.withColumn("lost", 1 - F.col("normalised") / F.col("raw"))
