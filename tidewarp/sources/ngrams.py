"""Sources and sinks: entries, dictionaries, transition maps, series and distance files."""
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import ENTRIES, check_length
from ..plans.scratch import materialized
from . import raw


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ngram, year, var0, var1. Empty lines are skipped, further columns ignored; a line
    whose numbers do not parse fails the read, naming the line. \\n and \\r\\n end lines."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("value")).filter("value <> ''")
    lines, parts = lines.select("value", F.split("value", "\t").alias("parts")), F.col("parts")
    number = lambda k: F.when(F.get(parts, F.lit(k)).rlike("^[0-9]+$"), F.get(parts, F.lit(k)).cast("long")).otherwise(F.raise_error(F.concat(F.lit("not an entry: "), "value")).cast("long"))
    return lines.select(F.get(parts, F.lit(0)).alias("ngram"), number(1).cast("int").alias("year"), number(2).alias("var0"), number(3).alias("var1")).to(ENTRIES)


def write_entries(entries: DataFrame, path: str) -> None:
    """Entries as tab-separated lines, as read_entries reads them. An n-gram with a tab or a line end fails."""
    broken = F.raise_error(F.concat(F.lit("not a field: "), "ngram")).cast("string")
    fields = [F.when(F.col("ngram").rlike(r"[\t\r\n]"), broken).otherwise(F.col("ngram")), *(F.col(c).cast("string") for c in ("year", "var0", "var1"))]
    entries.select(F.concat_ws("\t", *fields).alias("value")).write.text(path)


def scan_report(entries: DataFrame) -> DataFrame:
    """min_year, max_year, n_ngrams, max_count (over both variables), n_entries."""
    return entries.agg(
        F.min("year").alias("min_year"), F.max("year").alias("max_year"), F.count_distinct("ngram").alias("n_ngrams"),
        F.max(F.greatest("var0", "var1")).alias("max_count"), F.count("*").alias("n_entries"),
    )


def numbered(ngrams: DataFrame) -> DataFrame:
    """id, ngram of the distinct n-grams, numbered from 0 in code-point order. Range partitions are
    numbered inside and offset by the sizes of those before, so no task holds the whole dictionary."""
    unique = materialized(ngrams.select("ngram").filter("ngram IS NOT NULL").distinct(), "unique")  # ranges are sampled from it first
    ranged = unique.repartitionByRange("ngram").sortWithinPartitions("ngram")
    ids = ranged.withColumn("m", F.monotonically_increasing_id()).select("ngram", F.shiftright("m", 33).alias("p"), F.col("m").bitwiseAND(F.lit((1 << 33) - 1)).alias("k"))
    return _offset(materialized(ids, "numbered"), "p")


def _offset(ids: DataFrame, *order: str) -> DataFrame:
    """id, ngram of rows with their part (by the columns of order) and place k there. Only a row per part is
    summed up."""
    offsets = ids.groupBy(*order).agg((F.max("k") + 1).alias("count")).withColumn("at", F.sum("count").over(Window.orderBy(*order)) - F.col("count"))
    return ids.join(F.broadcast(offsets), list(order)).select((F.col("at") + F.col("k")).alias("id"), "ngram")


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary file, an n-gram a line, blank lines skipped; ids follow the order of lines. Repeated
    n-grams are an error: their ids would not be positions. Each block of a file numbers its own lines; the
    blocks before, by file name and position, give the offset."""

    def run(parts):
        import pyarrow as pa

        seen: dict[tuple[str, int], int] = {}
        for batch in parts:
            places = []
            for key in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                places.append(seen.get(key, 0))
                seen[key] = places[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=["ngram", "file", "start", "k"])

    lines = spark.read.text(path).select(F.col("value").alias("ngram"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = lines.filter("ngram <> ''").mapInArrow(run, "ngram string, file string, start long, k long")
    out = _offset(materialized(lines, "map"), "file", "start")
    twice = out.groupBy("ngram").count().filter("count > 1").first()
    if twice:
        raise ValueError(f"the dictionary repeats {twice.ngram!r}")
    return out


def write_map(ngrams: DataFrame, path: str) -> None:
    """The dictionary in code-point order as one sorted text file set."""
    ngrams.select("ngram").distinct().orderBy("ngram").write.text(path)


def read_transitions(spark: SparkSession, path: str) -> DataFrame:
    """ngram, stem from lines `ngram -> stem`, parted at the first separator. The first line of an n-gram
    wins; lines without a separator are skipped."""
    lines = spark.read.text(path).withColumn("m", F.monotonically_increasing_id()).filter(F.instr("value", " -> ") > 0)
    parts = F.split("value", " -> ", 2)
    pairs = lines.select(parts[0].alias("ngram"), F.struct("m", parts[1].alias("stem")).alias("at"))
    return pairs.groupBy("ngram").agg(F.min("at").alias("at")).select("ngram", "at.stem")


def write_transitions(transitions: DataFrame, path: str) -> None:
    transitions.select(F.concat_ws(" -> ", "ngram", "stem").alias("value")).orderBy("value").write.text(path)


def stems(transitions: DataFrame) -> DataFrame:
    """The distinct stems of a transition map, in code-point order."""
    return transitions.select("stem").filter("stem IS NOT NULL").distinct().orderBy("stem")


def transition_of(transitions: DataFrame, ngram: str) -> str | None:
    """The stem of one n-gram; None if the map has none. The filter reaches the scan."""
    found = transitions.filter(F.col("ngram") == ngram).select("stem").first()
    return found.stem if found else None


def read_matrix(spark: SparkSession, path: str, ylength: int, dtype: str = "f8", first: int = 0, last: int | None = None) -> DataFrame:
    """id, series from a raw row-major matrix of little-endian values, in a file or in the parts of a folder
    in the order of their names. Ids are positions. Tasks read ranges of records; ids outside [first, last] are not read, nor are
    those that a filter on the id excludes where the session pushes filters down to Python sources."""
    check_length(ylength)
    raw.check_files(path, ylength, dtype)
    spark.dataSource.register(raw.RawMatrix)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    options = {"path": path, "width": ylength, "dtype": dtype, "first": first, "pushdown": pushed.lower()} | ({} if last is None else {"last": last})
    return spark.read.format("rawmatrix").options(**options).load()


def _write_rows(rows: DataFrame, path: str, dtype: str) -> None:
    """Arrays (id, series) in the order of ids, a part file per task in a new folder that all tasks reach."""
    rows.sparkSession.dataSource.register(raw.RawMatrix)
    ranged = rows.repartitionByRange("id").sortWithinPartitions("id")
    ranged.write.format("rawmatrix").mode("append").options(path=path, dtype=dtype).save()


def write_matrix(series: DataFrame, path: str, dtype: str = "f8") -> None:
    """A raw row-major matrix in the order of ids: part files of a folder, whose names are in that order."""
    _write_rows(series.select(F.col("id").cast("long"), F.col("series").cast("array<double>")), path, dtype)


def write_distances(distances: DataFrame, path: str, dtype: str = "f8") -> None:
    """A raw vector of distances in the order of ids, as write_matrix writes rows."""
    _write_rows(distances.select(F.col("id").cast("long"), F.array(F.col("distance").cast("double")).alias("series")), path, dtype)


def read_distances(spark: SparkSession, path: str, dtype: str = "f8") -> DataFrame:
    """id, distance of a raw vector."""
    return read_matrix(spark, path, 1, dtype).select("id", F.get("series", F.lit(0)).alias("distance"))


def write_report(report: DataFrame, path: str) -> None:
    """A report table as CSV with a header. Reports have a row per level, letter or parameter set, so they go to
    one file."""
    report.coalesce(1).write.option("header", True).csv(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """query, r, ids: reference results, a JSON object a line with query, r and the ids in order."""
    return spark.read.schema("query string, r int, ids array<long>").json(path)


def write_gold(gold: DataFrame, path: str) -> None:
    gold.select("query", "r", "ids").write.json(path)


def quoted_list(results: DataFrame, order: str = "rank") -> str:
    """The n-grams of a result table as a quoted comma-separated list."""
    return ", ".join(f'"{r.ngram}"' for r in results.orderBy(order).select("ngram").toLocalIterator())
