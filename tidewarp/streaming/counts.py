"""An extension: counts summed from a stream of entries."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import clean
from ..model import ENTRIES, YLENGTH, YSTART


def read_entry_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Tab-separated entries as files arrive in a folder."""
    reader = spark.readStream.schema(ENTRIES).option("sep", "\t").option("quote", "")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.csv(path)


def running_counts(entries: DataFrame, ystart: int = YSTART, ylength: int = YLENGTH) -> DataFrame:
    """ngram, y, var0, var1: the additive upsert of clean entries inside the years. The state has a row per
    n-gram and year, as the series have."""
    inside = entries.filter(clean(F.col("ngram")) & F.col("year").between(ystart, ystart + ylength - 1))
    return inside.groupBy(F.lower("ngram").alias("ngram"), (F.col("year") - ystart).alias("y")).agg(F.sum("var0").alias("var0"), F.sum("var1").alias("var1"))


def to_table(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs over what is there and stops. Each batch writes the sums that it changed as a part of its own,
    batch=N, under path; a batch that runs again replaces its part. State and output stay on the executors."""

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """ngram, y, var0, var1: the latest sums of each n-gram and year."""
    parts = spark.read.parquet(path)
    latest = parts.groupBy("ngram", "y").agg(F.max_by(F.struct("var0", "var1"), "batch").alias("last"))
    return latest.select("ngram", "y", "last.var0", "last.var1")
