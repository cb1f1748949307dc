"""Base forms of words by tables: known lemmas, irregular forms and rules for endings, joined in the JVM."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stemming import VERB_ENDINGS, stem
from ..plans.scratch import materialized


def candidates(word: Column) -> Column:
    """The word, and what each ending that it has makes of it."""
    made = [F.when(word.endswith(end), F.concat(F.left(word, F.length(word) - len(end)), F.lit(base))) for end, base in VERB_ENDINGS]
    return F.array_distinct(F.array_compact(F.array(word, *made)))


def word_lemmas(words: DataFrame, lemmas: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """word, lemma of each distinct word of words (word): an irregular form's base (exceptions: form, lemma; of several the first in
    code-point order), else the shortest known word (lemmas: lemma) that the word or an ending makes, of equally long ones the first,
    else the word itself. Null words are left out.

    Words are distinct before they meet the tables, and a word has at most ten candidates. Both joins have distinct keys on the side
    of the tables, so no word grows; a frequent word is one row."""
    distinct = materialized(words.select("word").filter("word IS NOT NULL").distinct(), "lemma-words")
    known = lemmas.select(F.col("lemma").alias("made")).filter("made IS NOT NULL").distinct()
    made = distinct.select("word", F.explode(candidates(F.col("word"))).alias("made")).join(known, "made")
    best = made.groupBy("word").agg(F.min(F.struct(F.length("made").alias("n"), "made")).alias("best")).select("word", F.col("best.made").alias("regular"))
    out = distinct.join(best, "word", "left")
    if exceptions is not None:
        forms = exceptions.filter("form IS NOT NULL AND lemma IS NOT NULL").groupBy(F.col("form").alias("word")).agg(F.min("lemma").alias("irregular"))
        out = out.join(forms, "word", "left")
    else:
        out = out.withColumn("irregular", F.lit(None).cast("string"))
    return out.select("word", F.coalesce("irregular", "regular", "word").alias("lemma"))


def lemmatized(phrases: DataFrame, lemmas: DataFrame, exceptions: DataFrame | None = None, stemmed: bool = False) -> DataFrame:
    """ngram, stem of each distinct phrase (ngram): its words, parted by single spaces, as lemmas; with stemmed each lemma's stem. A
    transition map, as ingest takes it. Stems are made once per distinct lemma, in Arrow batches; everything else is in the JVM."""
    distinct = materialized(phrases.select("ngram").filter("ngram IS NOT NULL").distinct(), "lemma-phrases")
    places = distinct.select("ngram", F.posexplode(F.split("ngram", " ", -1)).alias("at", "word"))
    found = word_lemmas(places, lemmas, exceptions)
    if stemmed:
        bases = materialized(found.select("lemma").distinct(), "lemmas")
        stems = bases.mapInArrow(_stems, "lemma string, stem string")
        found = found.join(stems, "lemma").select("word", F.col("stem").alias("lemma"))
    joined = places.join(materialized(found, "lemma-of"), "word")
    parts = joined.groupBy("ngram").agg(F.sort_array(F.collect_list(F.struct("at", "lemma"))).alias("parts"))
    return parts.select("ngram", F.array_join(F.col("parts.lemma"), " ").alias("stem"))


def _stems(batches):
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([stem(w) for w in batch.column(0).to_pylist()], pa.string())], names=["lemma", "stem"])
