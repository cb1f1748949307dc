"""Chat formatting: exact round trips, layouts, odd rows."""
import hashlib
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewarp.llm import chat_format as cf
from tidewarp.llm import registry

ROWS = "conv_id long, turn long, role string, text string, record int"
PIECES = [*cf.CONTROLS, "\\", "<", "[", ">", "]", "/", "|", "s", "INST", "im_end", "\n", " ", "é", "😀", "x"]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 5) for r in rows], ROWS)


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("template", [cf.INST, cf.CHATML])
def test_round_trip(spark, template):
    """Texts and roles out of pieces of control strings come back exactly, and hold no control string when escaped."""
    texts = [*random_texts(3000, 1), *(c[:1] + "\\" * k + c[1:] for c in cf.CONTROLS for k in range(3)), "x" * 100_000 + "</s>", "</s>" * 20_000]
    rows = spark.createDataFrame([(i, [(a, b), ("assistant", a)]) for i, (a, b) in enumerate(zip(texts, reversed(texts)))], "i long, messages array<struct<role string, text string>>")
    out = cf.chat_format(rows, template).select("i", "messages", "formatted", cf.turns_in(F.col("formatted"), template).alias("back"), cf.loss_text(F.col("segments"), template).alias("loss"), cf.escaped(F.col("messages")[0]["text"], template).alias("e"))
    for r in out.collect():
        assert r.back == r.messages
        assert r.loss == "".join(m.text for m in r.messages if m.role == "assistant")
        assert not any(c in r.e for c in template.strings())
        assert r.formatted.count(template.close) == r.formatted.count(template.open) == 2


def test_templates_are_checked():
    for bad in (("<a>", "<a", "<b>"), ("ab", "ba", "cc"), ("x", "<a>", "<b>"), ("<\\>", "<a>", "<b>")):
        with pytest.raises(ValueError):
            cf.Template(*bad, controls=())


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, [("user", "q"), ("assistant", "a")]),
    ({"id": 7, "meta": {"a": [{"b": 1}]}, "messages": [{"role": "tool", "content": "q", "odd name": {"x": [1, {"y<z": 2}]}, "weight": 0.5}]}, [("tool", "q")]),
    ({"messages": [{"role": "user", "content": "q"}, {"role": None, "content": None}]}, [("user", "q"), ("", "")]),
    ({"messages": [{"content": "only"}, {"role": "user"}]}, [("", "only"), ("user", "")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image", "url": "u"}, {"text": "b"}]}]}, [("user", "ab")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "odd", "value": "b"}]}, [("user", "q"), ("assistant", "a"), ("odd", "b")]),
    ({"turns": [{"text": "t", "role": "human"}]}, [("human", "t")]),
    ({"prompt": "p", "completion": "c", "score": 3}, [("user", "p"), ("assistant", "c")]),
    ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "x", "output": "o"}, [("user", "i\n\nx"), ("assistant", "o")]),
    ({"system": "s", "question": "q", "answer": "a", "prompt": None}, [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ({"messages": []}, []),
    ({"messages": [{"role": "user", "content": "q"}, 3]}, None),
    ({"prompt": "p"}, None), ({"unknown": 1}, None), ([1, 2], None), ("text", None), ({}, None),
]


def test_layouts(spark):
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(LAYOUTS)] + [(-1, None), (-2, "no json"), (-3, ""), (0, json.dumps(LAYOUTS[0][0]))]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "i long, record string, turns string, formatted string")
    out = cf.chat_format(df)
    assert out.columns == ["i", "record", "fingerprint", "turns", "formatted", "segments"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        want = LAYOUTS[r.i][1] if r.i >= 0 else None
        assert (None if r.turns is None else [tuple(t) for t in r.turns]) == want, r
        assert (r.formatted is None) == (r.segments is None) == (want is None)
        assert (r.fingerprint is None) == (r.i < 0)
    table = {r.fingerprint: r for r in cf.layouts(df).collect()}
    assert table[cf.fingerprint_of(["messages[].content", "messages[].role"])].n == 5
    assert table[cf.fingerprint_of(["prompt"])].known is False and table[None].n == 3
    assert cf.chat_format(df.limit(0)).collect() == []


def test_columns_as_layouts(spark):
    """Columns of one table: each row's layout is what is not null in it."""
    rows = [(1, [("user", "a", 1)], None, None), (2, None, "p", "c"), (3, None, None, None), (4, [], None, None), (5, [("user", "a", 1)], "p", None)]
    df = spark.createDataFrame(rows, "i int, messages array<struct<role string, content string, w int>>, prompt string, completion string")
    got = {r.i: r.turns and [tuple(t) for t in r.turns] for r in cf.chat_format(df).collect()}
    assert got == {1: [("user", "a")], 2: [("user", "p"), ("assistant", "c")], 3: None, 4: [], 5: None}
    assert [r.turns for r in cf.chat_format(df.select("i")).collect()] == [None] * 5


def test_query_against_sql(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", *random_texts(60, 2), "y" * 50_000]
    rows = [(rng.choice([None, 1, 2, 3, -5, 10**12]), rng.choice([None, 0, 1, 2]), rng.choice([None, "user", "assistant", "a]b", "</s>", "system"]), rng.choice(texts)) for _ in range(400)]
    for name, part in (("full", rows + rows[:20]), ("empty", [])):
        at = f"{tmp_path}/{name}"
        conversations(spark, part).write.parquet(f"{at}/conversations.parquet")
        df = registry.op13_chat_format(spark, at)
        con = duckdb.connect()
        con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{at}/conversations.parquet/*.parquet'")
        want = con.sql(registry.oracle_sql()["op13_chat_format"])
        got = df.collect()
        assert sorted((tuple(r[c] for c in want.columns) for r in got), key=str) == sorted(want.fetchall(), key=str)
        planted = {r.conv_id: r for r in got}[-7]
        said = f"user\n{cf.PLANTED}\nassistant\n{cf.PLANTED}\n"
        assert (planted.n_turns, planted.turns_sha256) == (2, hashlib.sha256(said.encode()).hexdigest())
        assert (planted.loss_chars, planted.loss_sha256) == (len(cf.PLANTED), hashlib.sha256(cf.PLANTED.encode()).hexdigest())
