"""Importance resampling against plain Python and against SQL."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from tidewarp.llm import importance, registry

WORDS = ["alpha", "Beta", "gamma", "É", "straße", "x1", "42", "naïve", "日本", "İx", "😀"]


def texts(n, seed, most=60):
    rng = random.Random(seed)
    return [rng.choice([" ", "-", "\n", "_", "\x00"]).join(rng.choices(WORDS, k=rng.randint(0, most))) for _ in range(n)]


def brute(docs, target, orders, buckets, share, min_words, seed):
    def features(text):
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, orders + 1) for i in range(len(w) - n + 1)]

    mine = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in mine for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    rows = []
    for i, words, f in mine:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {id(r): k for k, r in enumerate(able[: share * len(able) // 100], 1)}
    return [(*r[:4], rank.get(id(r))) for r in rows]


CASES = [None, "", " ", "one", "one two", "x" * 100_000, "long Text, " * 40_000, "a b " * 12, "A-B_" * 12]


@pytest.fixture(scope="module")
def rows():
    docs = list(enumerate([*CASES, *texts(150, 1)]))
    docs += [docs[-1]] * 40 + [docs[-2]] * 3 + [(3, "another text of a repeated id " * 5), (None, docs[-3][1]), (None, docs[-3][1]), (None, "word " * 30), (None, None), (-5, docs[-5][1])]
    return docs, [None, "", *texts(12, 2), "alpha beta " * 10]


def frames(spark, docs, target):
    d = spark.createDataFrame([(t, i, "w", 1) for i, t in docs], "text string, doc_id long, word string, m int").repartition(5)
    return d, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")


@pytest.mark.parametrize("orders, buckets, share, min_words, seed", [(2, 10_000, 25, 20, "7"), (1, 50, 100, 0, "a"), (3, 7, 33, 1, "b"), (2, 10_000, 0, 20, "7")])
def test_against_brute_force(spark, rows, orders, buckets, share, min_words, seed):
    out = importance.importance_resample(*frames(spark, *rows), orders=orders, buckets=buckets, share=share, min_words=min_words, seed=seed)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in out.dtypes} == {"bigint"}
    assert sorted(map(tuple, out.collect()), key=str) == sorted(brute(*rows, orders, buckets, share, min_words, seed), key=str)


def test_empty(spark, rows):
    d, t = frames(spark, *rows)
    assert importance.importance_resample(d.limit(0), t).collect() == []
    got = importance.importance_resample(d, t.limit(0)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows[0], [], 2, 10_000, 25, 20, "7"), key=str)


def test_one_exchange_of_texts(spark, rows):
    """Windows need no exchange beyond that of the grouping by id and hash."""
    d, _ = frames(spark, *rows)
    table = importance.positions(importance.texts_of(d, "doc_id"), ["doc_id", "h", "m"])
    table.collect()
    plan = table._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" in plan


def test_query_against_sql(spark, rows, tmp_path):
    d, t = frames(spark, *rows)
    con = duckdb.connect()
    for name, df in (("documents", d), ("benchmark", t)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    df = registry.op11_importance(spark, str(tmp_path))
    want = con.sql(registry.oracle_sql()["op11_importance"])
    assert sorted((tuple(r[c] for c in want.columns) for r in df.collect()), key=str) == sorted(want.fetchall(), key=str)
