"""The stages of the pipeline against brute force, on odd input, and the whole of it."""
import random

import duckdb
import pytest
from test_copies import assert_space_holds, hidden_passages, slow_kept
from test_models import late_labels

import corpus_pipeline
from tidewarp.llm import decontamination, mixing

STAGE = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return ["".join(rng.choices("abcdefghilmnoprstuv", k=rng.randint(2, 9))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents of many lines, some low, some near copies, some with passages or items of others."""
    rng = random.Random(31)
    at = tmp_path_factory.mktemp("pipeline")
    items = [(k, " ".join(words(rng, rng.randint(20, 50)))) for k in range(12)]
    passages = ["\n".join(" ".join(words(rng, 12)) for _ in range(3)) for _ in range(6)]
    rows, labels = [], []
    for i in range(160):
        lines = [" ".join(words(rng, rng.randint(5, 15))) + "." for _ in range(rng.randint(3, 12))]
        if i % 9 == 4:
            lines.insert(rng.randrange(len(lines)), rng.choice(passages))
        if i % 11 == 5:
            lines.insert(rng.randrange(len(lines)), items[i % 12][1])
        if i % 8 == 7:  # a near copy of the one before, on one line: no block in common
            lines = [rows[-1][1].replace("\n", " ") + " " + words(rng, 1)[0]]
        if i % 10 == 3:
            lines = [rng.choice(["!!! ### " * 30, "again " * 60])]
        rows.append((i, "\n".join(lines), "en", f"s{i % 4}"))
        if i % 2 == 0 or i % 10 == 3:
            labels.append((i, int(i % 10 != 3), 0))
    rows += [(None, "no id " + rows[0][1], "en", "s1"), (500, None, None, None), (501, "", "en", "s1"), (502, " \n ", "en", "s2"), rows[1], rows[1]]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    for name, part, known, bench in (("full", docs, labels, items), ("empty", docs.limit(0), [], [])):
        part.write.parquet(f"{at}/{name}/documents.parquet")
        spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{at}/{name}/labels.parquet")
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/{name}/benchmark.parquet")
    return str(at), items


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_are_those_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "mixing"]


def test_quality_stage(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/full/documents.parquet")
    out = STAGE["quality"](spark, docs, f"{corpus[0]}/full")
    kept = {r.doc_id for r in out.collect()}
    assert out.columns == docs.columns and out.filter("doc_id = 1").count() == 3
    assert not kept & set(range(3, 160, 10)) and len(kept & set(range(160))) >= 140


def test_quality_stage_is_fitted_on_all_labels(spark, tmp_path):
    docs, labels, held = late_labels(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in STAGE["quality"](spark, docs, str(tmp_path)).collect()}
    assert sum((i in kept) == (i % 2 == 0) for i in held) >= 97


def test_line_stage(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/full/documents.parquet")
    out = STAGE["line_dedup"](spark, docs, f"{corpus[0]}/full")
    full = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None and r.text is not None}
    want = slow_kept(full)
    got = {r.doc_id: [x for x in r.text.split("\n") if x.split()] for r in out.collect() if r.doc_id is not None and r.text is not None}
    assert got == {d: lines for d, lines in want.items() if lines or not full[d].split()}
    assert sum(want[d] != [x for x in t.split("\n") if x.split()] for d, t in full.items()) > 5
    assert out.filter("doc_id IS NULL OR doc_id = 500").count() == 2 and all(r.n_chars == len(r.text or "") for r in out.collect())


def test_near_stage(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/full/documents.parquet")
    full = {r.doc_id: (r.text or "").lower().split() for r in docs.collect() if r.doc_id is not None}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for d, w in full.items()}
    top = {d: d for d in sets}
    order = sorted(sets)
    for i, d in enumerate(order):  # groups of a similarity of 0.8 or more, by brute force
        for e in order[:i]:
            if sets[d] == sets[e] or len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e]):
                a, b = sorted((top[d], top[e]))
                top = {k: a if v == b else v for k, v in top.items()}
    out = STAGE["near_dedup"](spark, docs, f"{corpus[0]}/full")
    kept = {r.doc_id for r in out.collect()} - {None}
    assert kept == {d for d in order if top[d] == d} and len(order) - len(kept) > 20
    assert out.filter("doc_id IS NULL").count() == 1 and out.filter("doc_id = 1").count() == 3 and out.columns == docs.columns


def test_benchmark_stage(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/full/documents.parquet")
    number = {}
    ids = lambda text: [number.setdefault(w, len(number)) for w in decontamination.terms(text.encode())]
    leaks = {r.doc_id for r in docs.collect() for _, t in corpus[1] if r.text and decontamination.common(ids(t), ids(r.text)) >= decontamination.LEAK * len(ids(t))}
    kept = {r.doc_id for r in STAGE["decontamination"](spark, docs, f"{corpus[0]}/full").collect()}
    assert len(leaks) > 10 and kept == {r.doc_id for r in docs.collect()} - leaks


def test_benchmark_stage_is_fitted_on_all_documents(spark, tmp_path, monkeypatch):
    docs, items, shared = hidden_passages()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found, fitted = [], decontamination.fitted
    monkeypatch.setattr(decontamination, "fitted", lambda *a: found.append(fitted(*a)) or found[-1])
    STAGE["decontamination"](spark, spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path))
    assert len(found) == 1
    assert_space_holds(found[0], shared)


def test_mixing_stage(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/full/documents.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{corpus[0]}/full/{t}.parquet/*.parquet'")
    want = con.sql(f"SELECT doc_id, size, source_size, round(target, 6), taken FROM ({mixing.oracle()}) WHERE taken > 0").fetchall()
    out = STAGE["mixing"](spark, docs, f"{corpus[0]}/full").selectExpr("doc_id", "size", "source_size", "round(target, 6)", "taken")
    assert rows_of(out) == sorted(want, key=str) and want


def test_run_is_its_stages(spark, corpus):
    at = f"{corpus[0]}/full"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at)
    out = corpus_pipeline.run(spark, at)
    assert rows_of(out) == rows_of(docs) and out.count() > 50


@pytest.mark.parametrize("name", list(STAGE))
def test_empty_tables_and_clashing_columns(spark, corpus, name):
    none = spark.read.parquet(f"{corpus[0]}/empty/documents.parquet")
    assert STAGE[name](spark, none, f"{corpus[0]}/empty").collect() == []
    docs = spark.read.parquet(f"{corpus[0]}/full/documents.parquet")
    clash = docs.selectExpr("*", "'x' AS blocks", "1 AS item_id", "2 AS fp", "3 AS h", "4 AS part", "5 AS size", "named_struct('a', 1) AS grade", "'q' AS selected", "6 AS root", "7 AS band")
    out = STAGE[name](spark, clash, f"{corpus[0]}/full")
    if name != "mixing":
        assert out.columns == clash.columns
        assert rows_of(out.select(*docs.columns)) == rows_of(STAGE[name](spark, docs, f"{corpus[0]}/full"))
        assert out.select("blocks", "item_id", "fp", "h", "part", "size", "selected", "root", "band").distinct().collect() == [("x", 1, 2, 3, 4, 5, "q", 6, 7)]
    else:
        assert out.count() == STAGE[name](spark, docs, f"{corpus[0]}/full").count()


@pytest.mark.parametrize("name", list(STAGE))
def test_very_long_and_null_columns(spark, corpus, name):
    rows = [(i, "many words " * 20_000 if i == 0 else None if i % 2 else f"text {i} of some words.", None, None, None) for i in range(8)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = STAGE[name](spark, docs, f"{corpus[0]}/empty")
    kept = {r.doc_id for r in out.collect()}
    assert {0, 2, 4, 6} <= kept if name != "mixing" else kept <= set(range(8))
