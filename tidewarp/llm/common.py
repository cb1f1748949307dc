"""Helpers that the corpus operators share."""
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import materialized  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_BYTES = 32 << 20  # of strings and binaries in a table that is broadcast, at most
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. translate() alone costs some 100 ns a character, so ASCII texts take
    lower() and the others are cut before each capital, of which only the first character is mapped."""
    piece = lambda p: F.concat(F.translate(F.substring(p, 1, 1), UPPER, UPPER.lower()), F.substr(p, F.lit(2)))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.array_join(F.transform(F.split(text, "(?=[A-Z])", -1), piece), ""))


def at_most(df: DataFrame, rows: int, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most so many rows, and strings and binaries of at most so many bytes. Counted where the
    rows are; columns of a fixed width are bounded by the rows."""
    if df.limit(rows + 1).count() > rows:
        return False
    wide = [F.coalesce(F.octet_length(f.name), F.lit(0)).cast("long") for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    return not wide or (df.agg(F.sum(sum(wide[1:], wide[0]))).first()[0] or 0) <= size


def broadcast_if_small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """A broadcast hint for a narrow, already materialized table of at most so many rows and BROADCAST_BYTES of
    strings; beyond that df as it is, and the join shuffles with adaptive skew handling."""
    return F.broadcast(df) if at_most(df, rows) else df
