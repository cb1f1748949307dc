import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarp.functions import haar as h
from tidewarp.functions import series as fs
from tidewarp.functions.stemming import stem, stem_phrase
from tidewarp.functions.text import clean, normalized


@pytest.mark.parametrize(
    "word,want",
    [
        ("consign", "consign"), ("consigned", "consign"), ("consigning", "consign"), ("consignment", "consign"), ("consist", "consist"), ("consistency", "consist"), ("consolations", "consol"),
        ("knack", "knack"), ("knackeries", "knackeri"), ("knavish", "knavish"), ("kneaded", "knead"), ("kneel", "kneel"), ("knightly", "knight"), ("knocker", "knocker"),
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("this", "this"), ("gaps", "gap"), ("kiwis", "kiwi"),
        ("hopping", "hop"), ("hoped", "hope"), ("hoping", "hope"), ("agreed", "agre"), ("feed", "feed"), ("sky", "sky"), ("skies", "sky"), ("dying", "die"), ("news", "news"), ("succeed", "succeed"),
        ("happy", "happi"), ("say", "say"), ("by", "by"), ("relational", "relat"), ("conditional", "condit"), ("rational", "ration"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"),
        ("formative", "format"), ("adoption", "adopt"), ("adjustable", "adjust"), ("controlling", "control"), ("rate", "rate"), ("cease", "ceas"), ("generously", "generous"), ("generate", "generat"), ("communism", "communism"),
        ("democracies", "democraci"), ("geology", "geolog"), ("boy's", "boy"), ("'tis", "tis"), ("youth", "youth"), ("yes", "yes"), ("happiness", "happi"), ("at", "at"), ("", ""),
    ],
)
def test_stems(word, want):
    assert stem(word) == want


def test_phrases_are_stemmed_word_by_word():
    assert stem_phrase("running wars") == "run war"
    assert stem_phrase("running wars", lambda w: {"wars": "peace"}.get(w, w)) == "run peac"


def test_clean_and_normalized(spark):
    rows = spark.createDataFrame([("It's",), ("x_NOUN",), ("1999",), ("A-b",), ("Ｗar",), (None,)], "ngram string")
    out = [r.n for r in rows.filter(clean(F.col("ngram"))).select(normalized(F.col("ngram")).alias("n")).collect()]
    assert out == ["a-b", "war"]


def test_gradient_and_smoothing():
    assert fs.gradient(np.array([[1.0, 4, 9]])).tolist() == [[3, 4, 5]]
    assert fs.gradient(np.array([[7.0]])).tolist() == [[0]]
    assert np.allclose(fs.smoothed(np.full((2, 30), 3.0), fs.SMOOTH2), 3)
    assert sum(fs.SMOOTH1) == pytest.approx(1) and len(fs.SMOOTH1) == 21


def test_transforms_by_name(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0, 3.0, 7.0]), (2, [0.0] * 4)], "id long, series array<double>")
    assert [r.series for r in fs.transformed(rows, "id", "max").orderBy("id").collect()] == [[0, 1 / 7, 3 / 7, 1], [0] * 4]
    assert fs.transformed(rows, "log").orderBy("id").first().series == pytest.approx(np.log1p([0, 1, 3, 7]).tolist())
    with pytest.raises(ValueError):
        fs.transformed(rows, "__import__('os')")


def test_haar_layout_and_round_trip():
    x = np.random.default_rng(1).standard_normal((5, 16))
    c = h.haar(x)
    assert np.allclose(h.inverse(c), x)
    assert np.allclose(np.linalg.norm(c, axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(c[:, 1] * 4, x[:, :8].sum(axis=1) - x[:, 8:].sum(axis=1))


def test_pruning_uses_the_budget_from_the_finest_level():
    c = h.haar(np.array([[4.0, 4, 1, 1, 0, 0, 0, 0.5]]))[0]
    assert h.pruned(c, 0.0).tolist() == c.tolist()
    assert (h.pruned(c, 1e9)[1:] == 0).all()
    some = h.pruned(c, 0.6, by="abs")
    assert some[7] == 0 and some[2] != 0 and some[0] == c[0]


def test_colors():
    rgb = fs.gradient_colors(np.array([0.0, 2.0, -0.5]), np.array([0.0, 0.0, 0.3]))
    assert rgb.shape == (3, 3) and (rgb >= 0).all() and (rgb <= 1).all() and np.allclose(rgb[:, 0], 0, atol=1e-6)


def test_batches_are_worked_on_in_pieces():
    import pyarrow as pa

    from tidewarp.functions.series import matrix, sliced

    batch = pa.RecordBatch.from_arrays([pa.array(range(2500)), pa.array([[float(k), 1.0] for k in range(2500)])], names=["id", "series"])
    pieces = list(sliced([batch, batch.slice(0, 0)]))
    assert [p.num_rows for p in pieces] == [1024, 1024, 452]
    assert [v for p in pieces for v in matrix(p.column(1))[:, 0]] == list(range(2500))
