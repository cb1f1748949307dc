"""The step from texts to entries, and from entries to sums."""
from collections import Counter

from pyspark.sql import functions as F

from tidewarp.functions import text
from tidewarp.operators import ingest
from tidewarp.plans import catalog, scratch

ROWS = [(1, "b a\tb\n a"), (257, " a a a\x0b"), (2, ""), (3, None), (4, "c"), (4, "c d"), (None, "e e"), (5, " x  y\r\nx")]


def test_words_are_counted_by_rows_and_years(spark, monkeypatch):
    monkeypatch.setattr(text, "HELD", 8)  # a few rows at a time
    rows = spark.createDataFrame([(1753 + i % 3, f"w{i % 5} w{i % 7} w{i % 5}") for i in range(90)], "year int, text string").repartition(3)
    out = text.word_counts(rows, "year", "text")
    got = {(r.ngram, r.year): (r.a, r.b) for r in out.groupBy("ngram", "year").agg(F.sum("var0").alias("a"), F.sum("var1").alias("b")).collect()}
    times, of = Counter(), Counter()
    for year, value in rows.collect():
        times.update((w, year) for w in value.split())
        of.update((w, year) for w in set(value.split()))
    assert got == {k: (times[k], of[k]) for k in times}
    assert out.groupBy("ngram").count()._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 0


def test_entries_of_repeated_and_missing_ids(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    with scratch.scope():
        got = {tuple(r) for r in catalog.entries(spark, str(tmp_path)).collect()}
    assert got == {("b", 1754, 2, 1), ("a", 1754, 3, 2), ("a a", 1754, 1, 1), ("c", 1757, 2, 1), ("d", 1757, 1, 1), ("e", None, 2, 0), (" x", 1758, 1, 1), ("y", 1758, 1, 1), ("x", 1758, 1, 1)}


def test_entries_are_dealt_out_once(spark):
    entries = spark.createDataFrame([("A", 1800, 1, 1), ("a", 1800, 2, 1), ("b", 1801, 3, 2), ("z", 1802, 1, 1)], "ngram string, year int, var0 long, var1 long")
    words = spark.createDataFrame([(0, "a"), (1, "b")], "id long, ngram string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ingest.summed(entries, words, ystart=1800, ylength=4)
        assert sorted(map(tuple, out.collect())) == [(0, 0, 3, 2), (1, 1, 3, 2)]
        plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple").split("Initial Plan")[-1]
        assert plan.count("Exchange hashpartitioning") == 2  # of entries and of the dictionary
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
