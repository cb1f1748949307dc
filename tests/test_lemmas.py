"""Lemmas by joins against the lemmatizer of single words."""
from tidewarp.functions import stemming
from tidewarp.operators import lemmas

KNOWN = ["war", "make", "mak", "cry", "go", "s", "be", "tie", "ti", "word"]
ODD = {"went": "go", "was": "be", "makes": "manufacture"}
PHRASES = ["wars", "making", "cries", "went", "was home", "makes", "ties tied tying", "unknown words", "", " ", "a  b", "é", "s", "es", "ing", "war", "x" * 50_000, "cries cries", None, "wars"]


def frames(spark, known, odd):
    table = spark.createDataFrame([(w, 1) for w in [*known, None, *known[:2]]], "lemma string, word int")
    forms = spark.createDataFrame([*odd.items(), (None, "x"), ("y", None), ("went", "zzz")], "form string, lemma string")
    return spark.createDataFrame([(p, "s") for p in PHRASES], "ngram string, stem string").repartition(3), table, forms


def test_against_single_words(spark):
    phrases, table, forms = frames(spark, KNOWN, ODD)
    one = stemming.verb_lemmatizer(KNOWN, ODD)
    for stemmed in (False, True):
        got = {r.ngram: r.stem for r in lemmas.lemmatized(phrases, table, forms, stemmed).collect()}
        want = {p: stemming.stem_phrase(p, one) if stemmed else " ".join(map(one, p.split(" "))) for p in PHRASES if p is not None}
        assert got == want


def test_without_tables(spark):
    phrases, table, forms = frames(spark, KNOWN, ODD)
    regular = {r.ngram: r.stem for r in lemmas.lemmatized(phrases, table).collect()}
    one = stemming.verb_lemmatizer(KNOWN)
    assert regular == {p: " ".join(map(one, p.split(" "))) for p in PHRASES if p is not None}
    same = {r.ngram: r.stem for r in lemmas.lemmatized(phrases, table.limit(0), forms.limit(0)).collect()}
    assert all(a == b for a, b in same.items())
    assert lemmas.lemmatized(phrases.limit(0), table, forms).collect() == []
