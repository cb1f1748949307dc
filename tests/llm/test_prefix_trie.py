"""The prefix trie against a dictionary of prefixes and against SQL, with blocks of every size."""
import hashlib
import itertools
import math
import random
import zlib

import duckdb
import numpy as np
import pytest

from tidewarp.llm import prefix_trie as pt
from tidewarp.llm import registry


def brute(rows, rebuild):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            h = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, h, (role, text)))
    own = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        seqs[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    nodes, below = {}, {}
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    for k in nodes:
        if k:
            below.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in below.get(k, [])) or 1
        saved[k] = sum(saved[x] for x in below.get(k, [])) + ((len(nodes[k]) - 1) * len(k[-1][1]) if k else 0)
    ends = lambda k: hashlib.sha256(",".join(str(c) for c in sorted(nodes[k]) if len(seqs[c]) == len(k)).encode()).hexdigest()
    return sorted(((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(below.get(k, [])), leaves[k], saved[k], ends(k)) for k, m in nodes.items()), key=str)


def rows_of(kind, seed=5):
    rng = random.Random(seed)
    texts = [None, "", "a", "é😀", "long " * 50]
    if kind == "shared":  # few different turns, so long shared starts; ids of several hundreds, some without their first
        ids = [*range(-130, -90), *range(0, 140), 205, 10**12, 10**12 + 1]
        return [(c, t, rng.choice(["user", None]), rng.choice(texts[2:4])) for c in ids for t in range(rng.randint(1, 9))]
    if kind == "equal":  # one conversation over and over, and what continues or ends inside it
        turns = [("user", f"t{i}") for i in range(7)]
        out = [(c, t, *turns[t]) for c in range(300) for t in range(7)]
        out += [(c, t, *turns[t]) for c in range(300, 320) for t in range(c % 8)] + [(400 + c, t, *(turns[t] if t < 7 else ("user", str(c)))) for c in range(30) for t in range(9)]
        return out
    if kind == "deep":
        return [(c, t, "user", "x" * (t % 3)) for c in range(12) for t in range(150 + c)] + [(50 + c, t, "user", "x" * (t % 3) if t < 20 * c else f"{c}") for c in range(8) for t in range(200)]
    odd = [(None, 0, "user", "no id"), (7, None, "user", "a"), (7, None, "user", "b"), (7, 1, None, None), (7, 1, None, None), (8, 0, "us", "er1"), (9, 0, "user", "1"), (10, 0, None, "user1"), (100, 3, "u", "x" * 100_000)]
    return odd if kind == "odd" else odd[:1] if kind == "no ids" else odd[-1:] if kind == "one" else []


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, n int, key string")


@pytest.mark.parametrize("kind, size", [*itertools.product(["shared", "equal"], [1, 7, 50_000]), ("deep", 3), ("odd", 2), ("no ids", 2), ("one", 2), ("empty", 2)])
def test_against_brute_force(spark, kind, size):
    rows = rows_of(kind)
    seqs = pt.sequences(frame(spark, rows).repartition(3))
    rebuild = kind != "equal"
    out = pt.prefix_trie(pt.rebuilt(seqs) if rebuild else seqs, rows=size)
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows, rebuild)


def test_hot_blocks_are_bounded(spark):
    """Ids of one sequence are packed where they are; the digest is the same for any number of rows they come in."""
    rows = spark.createDataFrame([(b"s", i) for i in range(2500)] + [(b"t", -1)], "s binary, conv_id long")
    ids = rows.repartitionByRange(5, "s", "conv_id").sortWithinPartitions("s", "conv_id").mapInArrow(pt.packed, "s binary, first long, n long, ids string")
    assert ids.count() >= 5
    got = ids.repartition(3, "s").sortWithinPartitions("s", "first").mapInArrow(pt.digested, "conv_id long, n long, ends string").collect()
    want = hashlib.sha256(",".join(map(str, range(2500))).encode()).hexdigest()
    assert sorted(map(tuple, got)) == [(-1, 1, hashlib.sha256(b"-1").hexdigest()), (0, 2500, want)]


def test_nearest_smaller():
    rng = random.Random(1)
    for _ in range(300):
        v = [rng.randint(-1, 4) for _ in range(rng.randint(1, 25))]
        left, right, head = pt.nearest_smaller(v)
        for i, x in enumerate(v):
            lo = max((j for j in range(i) if v[j] < x), default=-1)
            hi = min((j for j in range(i + 1, len(v)) if v[j] < x), default=len(v))
            assert (left[i], right[i], head[i]) == (lo, hi, min(j for j in range(lo + 1, i + 1) if v[j] == x))
        a = np.array(v)
        start = np.array([rng.randrange(len(v)) for _ in range(9)])
        stop = np.array([rng.randint(s + 1, len(v)) for s in start])
        assert pt.range_minimum(a)(start, stop).tolist() == [min(v[s:e]) for s, e in zip(start, stop)]


def test_common_symbols():
    rng = random.Random(2)
    for _ in range(500):
        a, b = (bytes(16 * rng.randint(0, 40)) for _ in range(2))
        if a and rng.random() < 0.8:
            at = rng.randrange(len(a))
            a = a[:at] + b"x" + a[at + 1 :]
        want = next((i for i in range(min(len(a), len(b)) // 16) if a[16 * i : 16 * i + 16] != b[16 * i : 16 * i + 16]), min(len(a), len(b)) // 16)
        assert pt.common_symbols(a, b) == want


@pytest.mark.parametrize("kind", ["shared", "odd", "empty"])
def test_query_against_sql(spark, tmp_path, kind):
    rows = rows_of(kind)
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    df = registry.op12_prefix_trie(spark, str(tmp_path))
    want = con.sql(registry.oracle_sql()["op12_prefix_trie"])
    got = sorted((tuple(r[c] for c in want.columns) for r in df.collect()), key=str)
    assert got == sorted(want.fetchall(), key=str)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == names and (df.select(names).count() == len(brute(rows, True)))
