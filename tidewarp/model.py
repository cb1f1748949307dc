"""Schemas and validation. A series table has id, ngram and series, an array of equally many doubles."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRIES = T.StructType([T.StructField("ngram", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("var0", T.LongType()), T.StructField("var1", T.LongType())])
YSTART, YLENGTH, SUPPORT = 1753, 256, 1000


def check_length(ylength: int) -> None:
    if ylength < 1 or ylength & (ylength - 1):
        raise ValueError(f"the length of series is a power of two, not {ylength}")


def check_range(begin: int, end: int, ylength: int, r: int) -> None:
    if not 0 <= begin < end <= ylength:
        raise ValueError(f"0 <= begin < end <= {ylength} must hold, not {begin}, {end}")
    if not 0 <= r <= (end - begin) // 2:
        raise ValueError(f"the radius is at most half the range, {(end - begin) // 2}, not {r}")


def series_of(series: DataFrame, ngrams: list[str]) -> dict[str, tuple[int, list[float]]]:
    """id and values of each queried n-gram; an unknown one is an error. The query set is stated by the
    caller, so its rows come to the driver."""
    found = {r.ngram: (r.id, r.series) for r in series.filter(F.col("ngram").isin(ngrams)).select("id", "ngram", "series").collect()}
    if missing := [n for n in ngrams if n not in found]:
        raise KeyError(f"unknown n-grams: {missing}")
    return found
