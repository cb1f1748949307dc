"""Functions of n-grams."""
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stemming import same, stem_phrase

#: Characters that a clean n-gram has none of. A set of fixed values.
UNCLEAN = r"[_.,:;!?/\\'" + '"' + r"#()<>=+*{}0-9]"


def clean(ngram: Column) -> Column:
    return ~ngram.rlike(UNCLEAN)


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.lower() if x.isascii() else unicodedata.normalize("NFKC", x).lower())


def normalized(ngram: Column) -> Column:
    """NFKC, then lower case. Spark has no NFKC, so this is an Arrow batch call."""
    return F.pandas_udf(_nfkc, "string")(ngram)


def stemmed(lemmatize: Callable[[str], str] = same) -> Callable[[Column], Column]:
    """A column function that lemmatizes (by default not at all) and stems each word."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else stem_phrase(x, lemmatize))

    return lambda ngram: F.pandas_udf(run, "string")(ngram)


HELD = 1 << 24  # bytes of texts whose words a task counts at a time


def word_counts(rows: DataFrame, year: str, texts: str) -> DataFrame:
    """ngram, year, var0 (occurrences), var1 (rows with it) of the words between white space (of ASCII), without nulls in either column. Tasks count
    some rows at a time, so a word and year comes more than once: sums are for the caller. No row per word is made."""

    def run(parts: Iterator) -> Iterator:
        from pyarrow import compute as pc

        for batch in parts:
            ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64))
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD, "right")))
                yield _counted(batch.slice(at, stop - at))
                at = stop

    return rows.select(F.col(year).cast("int"), F.col(texts).cast("string")).mapInArrow(run, "ngram string, year int, var0 long, var1 long")


def _counted(batch):
    """word_counts of one batch: words are sorted as numbers, of equal words by year and row."""
    import pyarrow as pa
    from pyarrow import compute as pc

    words = pc.ascii_split_whitespace(batch.column(1))
    coded = words.flatten().dictionary_encode()
    years = batch.column(0).to_numpy()
    order, n = np.argsort(years, kind="stable"), len(years)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    keys = coded.indices.to_numpy().astype(np.int64) * n + np.repeat(place, words.value_lengths().to_numpy())
    none = coded.dictionary.index("").as_py()
    if none >= 0:
        keys = keys[keys // n != none]
    keys.sort()
    first = np.flatnonzero(np.diff(keys, prepend=-1))  # of a word in a row
    times, (word, row) = np.diff(first, append=len(keys)), np.divmod(keys[first], n)
    year = years[order[row]]
    start = np.flatnonzero((np.diff(word, prepend=-1) != 0) | (np.diff(year, prepend=0) != 0)) if len(word) else np.zeros(0, np.int64)
    sums = np.add.reduceat(times, start) if len(start) else times
    columns = [coded.dictionary.take(pa.array(word[start])), pa.array(year[start], pa.int32()), pa.array(sums, pa.int64()), pa.array(np.diff(start, append=len(word)), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["ngram", "year", "var0", "var1"])
