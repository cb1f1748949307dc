"""Near copies, repeated lines, leaks and tokens against brute force."""
import random
import re

import numpy as np
import pytest
import xxhash

from tidewarp.llm import components, decontamination, line_dedup, simhash, token_counts, vantage


def words(rng, n):
    return ["".join(rng.choices("abcdefghilmnoprstuv", k=rng.randint(2, 9))) for _ in range(n)]


def slow_fingerprint(text, n):
    w = (text or "").encode().translate(simhash.LOWER).decode().split()
    w = [x for x in w if x]
    parts = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, radius):
    parent = list(range(len(fps)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(1)
    rows = [(None, "null id"), (0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "One"), (5, "two words"), (6, "é É two three four")]
    i = 10
    for _ in range(60):
        base = words(rng, rng.randint(3, 120))
        rows.append((i, " ".join(base)))
        for _ in range(rng.randint(0, 3)):
            i += 1
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(words(rng, 1))
            rows.append((i, "\n".join(w).upper() if rng.random() < 0.3 else " ".join(w)))
        i += 1
    rows += [rows[20], rows[20], (i + 1, "long " * 60_000)]
    return rows


@pytest.mark.parametrize("shard", [simhash.SHARD, 8])
def test_near_dedup(spark, copies, shard):
    docs = spark.createDataFrame(copies, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS component_id").repartition(5)
    out = simhash.near_dedup(docs, shard=shard).collect()
    fps = [slow_fingerprint(t, 3) for _, t in copies]
    group = classes(fps, 3)
    least = {}
    for (d, _), g in zip(copies, group):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    want = sorted((str(d), f"{f:016x}", least.get(g)) for (d, _), f, g in zip(copies, fps, group))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in out) == want
    assert simhash.near_dedup(docs.limit(0)).collect() == []


@pytest.mark.parametrize("radius", [0, 3, 9])
def test_tree_and_shards_lose_no_pair(radius):
    rng = np.random.default_rng(2)
    points = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    more = [p ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, radius + 2), replace=False))) for p in points[:200]]
    points = np.unique(np.concatenate([points, more]))[:, None]
    want = classes([int(p) for p in points[:, 0]], radius)
    assert vantage.link_all(points, radius).tolist() == want
    heap = vantage.fit_shards(points[::3], 4)
    at, shard = vantage.shards_of(points, heap, radius)
    links = vantage.Links(len(points))
    for s in np.unique(shard):
        rows = at[shard == s]
        links.add(rows, rows[vantage.link_all(points[rows], radius)])
    assert len(np.unique(shard)) > 4 and links.parent.tolist() == want


def test_points_go_to_few_shards():
    """Unrelated points, the worst case: copies of a point, and the largest shard."""
    points = np.random.default_rng(3).integers(0, 1 << 63, (20_000, 1), dtype=np.uint64)
    heap = vantage.fit_shards(points[:8192], 6, 3)
    at, shard = vantage.shards_of(points, heap, 3)
    assert len(at) < 6 * len(points) and set(at.tolist()) == set(range(len(points)))
    assert np.bincount(shard).max() < 0.12 * len(points)


def test_near_points_cost_no_pairs(monkeypatch):
    """Points around few centres: exact, and compared about as often as there are points, not pairs."""
    rng = np.random.default_rng(5)
    bits = lambda n, at_most: np.packbits(np.arange(256)[None, :] < 0, axis=1).repeat(n, 0) if not at_most else np.packbits(rng.permuted(np.arange(256)[None, :].repeat(n, 0), axis=1) < rng.integers(0, at_most + 1, n)[:, None], axis=1)
    centres = rng.integers(0, 1 << 63, (3, 4), dtype=np.uint64)
    points = np.concatenate([c[None, :] ^ bits(400, 40).view(np.uint64) for c in centres])
    want = []
    for i in range(len(points)):  # classes by brute force
        want.append(np.flatnonzero(vantage.hamming(points, points[i]) <= 50))
    parent = list(range(len(points)))
    changed = True
    while changed:
        changed = False
        for i, near in enumerate(want):
            low = min(parent[k] for k in near)
            for k in near:
                changed |= parent[k] != low and parent.__setitem__(k, low) is None
    compared = [0]
    honest = vantage.hamming
    monkeypatch.setattr(vantage, "hamming", lambda a, b: compared.__setitem__(0, compared[0] + int(np.prod(np.broadcast_shapes(a.shape, b.shape)[:-1]))) or honest(a, b))
    assert vantage.link_all(points, 50).tolist() == parent
    assert compared[0] < 0.2 * len(points) ** 2


def test_near_copies_recall(spark):
    """Pairs of a similarity of 0.8 or more are linked, unrelated documents are not."""
    rng = random.Random(4)
    rows, pairs = [], []
    for k in range(150):
        base = words(rng, rng.randint(40, 300))
        w = list(base)
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = words(rng, 1)[0]
        shingles = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (base, w)]
        similar = len(shingles[0] & shingles[1]) / len(shingles[0] | shingles[1])
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(w))]
        if similar >= 0.8:
            pairs.append((2 * k + 1, 2 * k))
    rows += [(1001, ""), (1000, None), (None, " ".join(words(rng, 30))), (1002, rows[0][1]), (1002, rows[0][1])]
    gone = {(r.doc_id, r.root) for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 80 and len(set(pairs) & gone) >= 0.97 * len(pairs)
    assert {(1001, 1000), (1002, 0)} <= gone
    assert all(r == d - 1 and d % 2 for d, r in gone if d < 1000)
    assert simhash.near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("times", [5, 20])
def test_near_copies_of_repeated_phrases(spark, times):
    """A similarity is of sets of shingles: how often a phrase is repeated does not weigh."""
    rng = random.Random(8)
    rows = []
    for k in range(40):
        base = words(rng, 600)
        rows += [(2 * k + i, " ".join(base + times * words(rng, 7))) for i in range(2)]
    gone = {(r.doc_id, r.root) for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(gone) == 40 and all(r == d - 1 for d, r in gone)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (300, 100), (7, 7)] + [(500, k) for k in range(501, 600)]
    out = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100, **{k: 500 for k in range(500, 600)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_patience():
    assert line_dedup.increasing([(0, 3), (1, 1), (2, 2), (3, 0), (4, 4)]) == [(1, 1), (2, 2), (4, 4)]
    assert line_dedup.patience([(0, 0), (1, 1), (1, 3), (2, 2), (3, 1), (3, 3)]) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert line_dedup.common_blocks([(0, 5), (1, 6), (4, 0), (5, 1)], dict.fromkeys(range(9), 10), 20) == [(0, 1), (4, 5)]
    assert line_dedup.common_blocks([], {}, 1) == []


def test_line_dedup(spark):
    rng = random.Random(3)
    line = lambda n=30: " ".join(words(rng, n))
    a, b, c, short, own = line(), line(60), line(), "too short to go", [line() for _ in range(6)]
    texts = {
        5: [own[0], a, b, short, own[1]], 6: [b, own[2]], 7: [own[3], c, short, a, b, ""], 8: [a, b, short], 9: [c, a], 10: ["", "", own[4]], 11: [short, own[5]], 12: [a, a, own[5] + "x"],
    }
    rows = [(d, "\n".join(t), "keep") for d, t in texts.items()] + [(13, None, None), (14, "", None), (None, a, None), (5, "\n".join(texts[5]), "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "length(text) AS n_chars", "'x' AS blocks")
    out = line_dedup.line_dedup(docs).collect()
    got = {r.doc_id: r.text for r in out if r.lang != "twice"}
    assert got[5] == "\n".join(texts[5]) and got[6] == own[2] and got[7] == "\n".join([own[3], c, short, ""])
    assert got[8] == "" and got[9] == "" and got[10] == "\n".join(texts[10]) and got[11] == "\n".join(texts[11])
    assert got[12].split("\n")[-1] == own[5] + "x" and got[13] is None and got[14] == "" and got[None] == a
    assert len(out) == len(rows) and all(r.text is None or r.n_chars == len(r.text) for r in out)
    assert {(b.partner, b.first, b.last) for r in out if r.doc_id == 7 for b in r.blocks} == {(5, 3, 4)}
    assert {(b.partner, b.first) for r in out if r.doc_id == 9 for b in r.blocks} == {(7, 0), (5, 1)}
    assert line_dedup.line_dedup(docs.limit(0)).collect() == []


def slow_kept(texts, least=20):
    """Lines of each document that stay: not in a run of so many words that an earlier document has."""
    full = {d: [(k, x) for k, x in enumerate(t.split("\n")) if x.split()] for d, t in texts.items()}
    out = {}
    for d, mine in full.items():
        gone = set()
        for e, other in full.items():
            for i in range(len(mine) if e < d else 0):
                for j in range(len(other)):
                    n = 0
                    while i + n < len(mine) and j + n < len(other) and mine[i + n][1] == other[j + n][1]:
                        n += 1
                    if n and sum(len(x.split()) for _, x in mine[i : i + n]) >= least:
                        gone.update(k for k, _ in mine[i : i + n])
        out[d] = [x for k, x in enumerate(texts[d].split("\n")) if x.split() and k not in gone]
    return out


def test_line_dedup_of_lines_seen_elsewhere(spark):
    """Shared passages go though their lines stood alone, or in other order, in earlier documents."""
    rng = random.Random(6)
    parts = [" ".join(words(rng, 12)) for _ in range(5)]
    passage = "\n".join("\nread more\n".join(parts).split("\n"))
    texts = {1: "read more\n" + " ".join(words(rng, 30)), 2: passage, 3: passage}
    pool = [" ".join(words(rng, rng.choice([1, 2, 5, 9, 12, 19, 20]))) for _ in range(25)]
    for d in range(10, 90):
        at = rng.randrange(20)
        texts[d] = "\n".join([rng.choice(pool) for _ in range(rng.randint(0, 8))] + pool[at : at + 6] + [rng.choice(pool) for _ in range(4)])
    out = line_dedup.line_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    got = {r.doc_id: [x for x in r.text.split("\n") if x.split()] for r in out}
    assert got[3] == [] and got == slow_kept(texts)


def aligned_kept(texts, least=20):
    """Lines of each document that stay when it is aligned, whole, with every earlier one."""
    full = {d: [(k, x) for k, x in enumerate(t.split("\n")) if x.split()] for d, t in texts.items()}
    out = {}
    for d, mine in full.items():
        counts = {i: len(x.split()) for i, (_, x) in enumerate(mine)}
        gone = set()
        for other in (o for e, o in full.items() if e < d):
            pairs = [(i, j) for i, (_, x) in enumerate(mine) for j, (_, y) in enumerate(other) if x == y]
            gone.update(i for a, z in line_dedup.common_blocks(pairs, counts, least) for i in range(a, z + 1))
        out[d] = [x for i, (_, x) in enumerate(mine) if i not in gone]
    return out


def test_line_dedup_aligns(spark, monkeypatch):
    """Passages that documents share in any order, among short frequent lines: the same lines go as when all pairs of whole
    documents are aligned, and none without an alignment."""
    rng = random.Random(23)
    passages = [[" ".join(words(rng, rng.randint(4, 25))) for _ in range(rng.randint(3, 6))] for _ in range(8)]
    short = ["read more", "share this page", "contact us"]
    texts = {}
    for d in range(60):
        parts = [*rng.sample(passages, rng.randint(0, 4)), *([rng.choice(short)] for _ in range(3)), *([" ".join(words(rng, 9))] for _ in range(3))]
        rng.shuffle(parts)
        texts[d] = "\n".join(x for part in parts for x in part)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    kept = lambda: {r.doc_id: [x for x in r.text.split("\n") if x.split()] for r in line_dedup.line_dedup(docs).collect()}
    want = aligned_kept(texts)
    assert kept() == want and sum(map(len, want.values())) < sum(t.count("\n") + 1 for t in texts.values()) - 200
    shared, counts = [(0, 1, 5), (4, 5, 0)], dict.fromkeys(range(9), 10)
    assert line_dedup.blocks_of(shared, counts, 20) == [(0, 1), (4, 5)]
    monkeypatch.setattr(line_dedup, "patience", lambda pairs: pairs.clear() or [])  # aligns nothing
    assert line_dedup.blocks_of(shared, counts, 20) == []


def test_line_dedup_over_blank_lines(spark):
    """Blank lines part no passage and go with it; those outside stay."""
    rng = random.Random(7)
    own, parts = [" ".join(words(rng, 12)) for _ in range(4)], [" ".join(words(rng, 12)) for _ in range(5)]
    texts = {1: [own[0], "", *"\n\n".join(parts).split("\n"), "", own[1]], 2: [own[2], "", *"\n \t\n".join(parts).split("\n"), "", own[3]]}
    out = line_dedup.line_dedup(spark.createDataFrame([(d, "\n".join(x)) for d, x in texts.items()], "doc_id long, text string")).collect()
    got = {r.doc_id: r for r in out}
    assert got[1].text == "\n".join(texts[1]) and got[2].text == "\n".join([own[2], "", "", own[3]])
    assert [tuple(b) for b in got[2].blocks] == [(1, 2, 10)]


def test_line_dedup_probes(spark):
    """Passages whose lines stood elsewhere before, or stand twice in the partner, and texts that share an id."""
    rng = random.Random(17)
    line = lambda n=12: " ".join(words(rng, n))
    block, own, parts = [line() for _ in range(3)], [line() for _ in range(12)], [line() for _ in range(3)]
    rows = [
        (1, [block[0], own[0]]), (2, [own[1], block[1]]), (3, [own[2], *block]), (4, [*block, own[3]]),  # two lines stood elsewhere
        (11, [own[4], *"\n\n".join(parts).split("\n")]), (12, [*"\n\n".join(parts).split("\n"), own[6]]),
        (21, [own[7], own[8], own[7], own[9]]), (22, [own[8], own[7], own[9], "end"]),  # the partner has a line earlier too
        (31, ["quite another first line of " + own[10], own[11]]), (31, [*block, "tail"]), (31, [*block, "tail"]), (32, ["quite another first line of " + own[10], "x"]),
    ]
    docs = spark.createDataFrame([(d, "\n".join(x), i) for i, (d, x) in enumerate(rows)], "doc_id long, text string, row int").repartition(3)
    out = {r.row: r.text for r in line_dedup.line_dedup(docs).collect()}
    text = lambda i: "\n".join(rows[i][1])
    assert [out[i] == text(i) for i in (0, 1, 2, 4, 6, 8, 11)] == [True] * 7
    assert out[3] == own[3] and out[5] == own[6] and out[7] == "end" and out[9] == out[10] == "tail"


def test_line_dedup_of_texts_with_one_id(spark):
    """Two texts of an id that share a block: one of them keeps it."""
    rng = random.Random(18)
    block, own = " ".join(words(rng, 30)), [" ".join(words(rng, 9)) for _ in range(2)]
    out = line_dedup.line_dedup(spark.createDataFrame([(5, f"{o}\n{block}") for o in own], "doc_id long, text string")).collect()
    assert sorted(block in r.text for r in out) == [False, True] and all(any(o in r.text for o in own) for r in out)


def test_hot_line_grows_with_its_rows(spark):
    line = " ".join(f"w{i}" for i in range(55))
    docs = spark.range(3000).selectExpr("id AS doc_id", f"concat('own ', id, '\\n{line}') AS text")
    out = line_dedup.line_dedup(docs)
    assert out.filter("size(blocks) = 0").count() == 1 and out.filter(f"text LIKE '%{line}%'").count() == 1


@pytest.fixture(scope="module")
def leaking():
    rng = random.Random(9)
    vocabulary = words(rng, 4000)
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(say(rng.randint(15, 60))[:-6] + ["."] + say(6)) + ".") for k in range(40)]
    docs, truth = [], set()
    for d in range(300):
        w = say(rng.randint(0, 400))
        if d % 5 == 0:
            k = rng.randrange(40)
            part = items[k][1].split()
            if d % 10 == 0:  # a paraphrase: one word in five is another
                part = [x if rng.random() < 0.8 else rng.choice(vocabulary) for x in part]
            at = rng.randint(0, len(w))
            w[at:at] = part
            truth.add((d, k))
        docs.append((d, " ".join(w)))
    return docs, items, truth


def test_leaks(spark, leaking, monkeypatch):
    docs, items, truth = leaking
    odd = [(None, items[3][1].upper()), (1000, None), (1001, ""), (1002, items[5][1]), (1002, items[5][1]), (1003, "the " * 80_000 + items[6][1])]
    rows = spark.createDataFrame(docs + odd, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS cosine")
    bench = spark.createDataFrame(items + [(None, "null id of some words here"), (77, None), (78, ""), items[2]], "item_id long, text string")
    found = [(r.doc_id, r.item_id) for r in decontamination.benchmark_leaks(rows, bench).collect()]
    got = set(found)
    assert len(truth & got) >= 0.95 * len(truth) and {(None, 3), (1002, 5), (1003, 6)} <= got and found.count((1002, 5)) == 2
    assert len({d for d, _ in got if d is not None and d < 1000} - {d for d, _ in truth}) == 0
    kept = {r.doc_id for r in decontamination.without_leaks(rows, bench).collect()}
    assert kept == ({d for d, _ in docs} | {1000, 1001}) - {d for d, _ in got}
    monkeypatch.setattr(decontamination, "ITEMS", 15)  # items in three blocks
    assert len(truth & {(r.doc_id, r.item_id) for r in decontamination.benchmark_leaks(rows, bench).collect()}) >= 0.95 * len(truth)
    assert decontamination.benchmark_leaks(rows.limit(0), bench).collect() == []
    assert decontamination.benchmark_leaks(rows, bench.limit(0)).collect() == []


def test_latent_candidates_recall(spark, leaking):
    """Of the passages whose plain TF-IDF cosine to an item is well over the limit, the latent space finds
    nearly all."""
    docs, items, _ = leaking
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    index = decontamination.fitted(frame, spark.createDataFrame(items, "item_id long, text string").collect())
    hits = total = 0
    for _, text in docs:
        ids = [index["vocabulary"].get(t, -1) for t in decontamination.terms(text.encode())]
        for a in range(0, max(1, len(ids) - decontamination.STRIDE), decontamination.STRIDE):
            part = ids[a : a + decontamination.WINDOW]
            v = np.zeros(len(index["idf"]))
            for t in part:
                if t >= 0:
                    v[t] += index["idf"][t]
            norm = np.sqrt(v @ v + sum(t < 0 for t in part) * index["other"] ** 2)
            z = sum((index["x"][t] for t in part if t >= 0), np.zeros(index["x"].shape[1]))
            for item, z_item in zip(index["items"], index["z"]):
                u = np.bincount(item, minlength=len(v)) * index["idf"]
                if norm and (v @ u) / norm / np.sqrt(u @ u) >= decontamination.COSINE + 0.1:
                    total += 1
                    hits += z @ z_item / norm >= decontamination.COSINE
    assert total > 30 and hits >= 0.9 * total


def test_leaks_of_many_items(spark):
    """Recall does not fall with the number of items: each is found verbatim."""
    rng = random.Random(12)
    vocabulary = words(rng, 6000)
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, say(rng.randint(15, 60))) for k in range(1000)]
    docs = [(k, f"{say(rng.randint(20, 200))} {items[k][1]} {say(rng.randint(20, 200))}") for k in range(0, 1000, 5)]
    out = decontamination.benchmark_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in out.collect()}
    assert sum((d, d) in found for d, _ in docs) >= 0.98 * len(docs)


def test_leaks_of_long_items(spark):
    """An item is found however many passages long it is."""
    rng = random.Random(13)
    vocabulary = words(rng, 4000)
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, say(n)) for k, n in enumerate([40, 300, 600, 1500, 4000])]
    docs = [(k, f"{say(100)} {text} {say(100)}") for k, text in items] + [(k + 10, f"{say(50)} {' '.join(text.split()[: len(text.split()) // 2])}") for k, text in items]
    docs += [(k, say(400)) for k in range(100, 200)]
    out = decontamination.benchmark_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in out.collect()} == {(k, k) for k, _ in items}


@pytest.mark.parametrize("n,lengths", [(40, [50, 300, 1000]), (600, [50, 200]), (2400, [50])])
def test_leaks_against_common_subsequences(spark, n, lengths):
    """Of the items that stand in a document in common order, verbatim or with one word in five replaced,
    nearly all are found, however many and however long they are."""
    rng = random.Random(n)
    vocabulary = words(rng, 20_000)
    say = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    items = [(k, " ".join(say(rng.choice(lengths)))) for k in range(n)]
    docs, truth = [], {}
    for d in range(80):
        truth[d] = rng.randrange(n)
        part = [w if d % 2 == 0 or rng.random() < 0.8 else rng.choice(vocabulary) for w in items[truth[d]][1].split()]
        docs.append((d, " ".join(say(rng.randint(20, 300)) + part + say(rng.randint(20, 300)))))
    docs += [(d, " ".join(say(300))) for d in range(100, 160)]
    out = decontamination.benchmark_leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in out.collect()}
    number: dict[bytes, int] = {}
    ids = lambda text: [number.setdefault(w, len(number)) for w in decontamination.terms(text.encode())]
    leaks = [d for d, k in truth.items() if decontamination.common(ids(items[k][1]), ids(docs[d][1])) >= decontamination.LEAK * len(items[k][1].split())]
    for odd in (0, 1):
        part = [d for d in leaks if d % 2 == odd]
        assert len(part) >= 30 and sum((d, truth[d]) in found for d in part) >= 0.9 * len(part)
    assert all(truth.get(d) == k for d, k in found)


def hidden_passages():
    """Documents, items, and passages that only documents have that a sample by hash leaves out."""
    rng = random.Random(14)
    vocabulary = sorted(set(words(rng, 400)))[:240]
    rng.shuffle(vocabulary)
    items = [(k, " ".join(vocabulary[60 * k : 60 * k + 60])) for k in range(4)]
    mixed = rng.sample(vocabulary, 80)
    shared = [mixed[k : k + 20] for k in range(0, 80, 20)]
    out_of_sample = [d for d in range(1200) if xxhash.xxh32_intdigest(str(d), 5) % 3][:400]
    docs = {d: " ".join(rng.sample(vocabulary, 20)) for d in range(1200)} | {d: " ".join(shared[d % 4]) for d in out_of_sample}
    return list(docs.items()), items, shared


def assert_space_holds(index, passages):
    x = index["x"][:-1] / index["idf"][:, None]  # all terms are the first space's
    assert x.shape[1] < 120 and np.allclose(x.T @ x, np.eye(x.shape[1]), atol=1e-4)
    for part in passages:
        v = np.zeros(len(x))
        at = [index["vocabulary"][w.encode()] for w in part]
        v[at] = index["idf"][at]
        assert np.linalg.norm(v @ x) >= 0.99 * np.linalg.norm(v)


def test_space_of_all_passages(spark):
    """The latent space holds what many passages share, whichever documents have it."""
    docs, items, shared = hidden_passages()
    index = decontamination.fitted(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").collect())
    assert_space_holds(index, shared)


@pytest.mark.parametrize("cells", [decontamination.CELLS, 50])
def test_products_of_terms(spark, leaking, monkeypatch, cells):
    """The products of terms are those of the TF-IDF rows of every passage, however many fit at once."""
    docs, items, _ = leaking
    docs = docs + [(d, items[d % 40][1]) for d in range(1000, 2000)]
    monkeypatch.setattr(decontamination, "CELLS", cells)
    monkeypatch.setattr(decontamination, "HELD", 1_000)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    shared = decontamination.weighed(frame, spark.createDataFrame(items[:12], "item_id long, text string").collect())
    own = np.unique(np.concatenate([np.array(i) for i in shared["items"][:1 if cells == 50 else 6]]))
    exact, n = np.zeros((len(own), len(own))), 0
    for _, text in docs:
        ids = [shared["vocabulary"].get(t, -1) for t in decontamination.terms(text.encode())]
        for a in range(0, len(ids), decontamination.WINDOW):
            v, n = np.zeros(len(shared["idf"])), n + 1
            for t in ids[a : a + decontamination.WINDOW]:
                if t >= 0:
                    v[t] += shared["idf"][t]
            v = (v / max(1e-9, np.sqrt(v @ v)))[own]
            exact += np.outer(v, v)
    got = np.zeros_like(exact)
    for r in decontamination.products(shared, own).collect():
        cols = np.frombuffer(r.cols, np.int32)
        assert (cols >= r.row).all() and not got[r.row, cols].any()
        got[r.row, cols] = got[cols, r.row] = np.frombuffer(r["products"], np.int64) / decontamination.UNIT
    assert shared["n"] == n and np.allclose(got, exact, atol=1e-4)


def test_common_subsequence():
    rng = random.Random(0)
    for _ in range(50):
        x, y = ([rng.randrange(6) for _ in range(rng.randint(0, 20))] for _ in range(2))
        c = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                c[i + 1][j + 1] = c[i][j] + 1 if a == b else max(c[i][j + 1], c[i + 1][j])
        assert decontamination.common(x, y) == c[-1][-1]


def test_allocation():
    tokens, sections = np.array([0, 3, 5, 9]), np.array([0, 4, 7, 9])
    assert token_counts.allocate(tokens, sections, "first").tolist() == [2, 1, 0]
    assert token_counts.allocate(tokens, sections, "last").tolist() == [1, 1, 1]
    assert token_counts.allocate(tokens, sections, "most").tolist() == [2, 1, 0]
    assert token_counts.allocate(np.array([0]), np.array([0, 0]), "first").tolist() == [0]


def brute_allocation(lengths, spans, rule):
    """Token by token and byte by byte."""
    out, at = [0] * (len(spans) - 1), 0
    owner = [next(k for k in range(len(spans) - 1) if spans[k] <= i < spans[k + 1]) for i in range(spans[-1])]
    for n in lengths:
        mine = owner[at : at + n]
        out[mine[0] if rule == "first" else mine[-1] if rule == "last" else max(sorted(set(mine)), key=mine.count)] += 1
        at += n
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
@pytest.mark.parametrize("sections", ["lines", "paragraphs", ["title", "text", "title"]])
def test_sections_against_brute_force(spark, rule, sections):
    import base64

    import tiktoken

    with open(token_counts.VOCABULARY, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=table, special_tokens={})
    rng = random.Random(21)
    pieces = ["one", " two", "\n", "\n\n", " \n\n\n", "\r\n", "Ünï", "😀😀", "   ", "end.", "\t"]
    say = lambda: rng.choice([None, "".join(rng.choices(pieces, k=rng.randint(0, 40)))])
    rows = [(i, say(), say()) for i in range(60)]
    out = {}
    for r in token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, title string, text string"), rule=rule, sections=sections).collect():
        out.setdefault(r.doc_id, []).append(r)
    for i, title, text in rows:
        if isinstance(sections, str):
            whole = text or ""
            parts = re.split(r"(?<=\n)", whole) if sections == "lines" else paragraphs(whole)
            parts = [x for x in parts if x] or [""]
        else:
            parts = [f"{title or ''}\n", f"{text or ''}\n", title or ""]
            whole = "".join(parts)
        spans = np.cumsum([0] + [len(p.encode()) for p in parts]).tolist()
        mine = sorted(out[i], key=lambda r: r.section)
        assert [whole[r.char_start : r.char_end] for r in mine] == parts
        assert [r.tokens for r in mine] == brute_allocation([len(enc.decode_single_token_bytes(t)) for t in enc.encode_ordinary(whole)], spans, rule)


def paragraphs(text):
    """Lines, joined up to the end of each run of lines that are blank but for the first."""
    out, now, blank = [], "", False
    for line in text.split("\n")[:-1]:
        if blank and line.strip(" \t\r\x0b\x0c"):
            out.append(now)
            now, blank = "", False
        blank = blank or (now != "" and not line.strip(" \t\r\x0b\x0c"))
        now += line + "\n"
    last = text.split("\n")[-1]
    return [*out, now, last] if blank else [*out, now + last]


TEXTS = [None, "", "\n", "one line", "two\nlines\n", "\n\nÜber 😀 naïve\r\ntabs\tand <|endoftext|>\n last", "x" * 50_000, "a\n" * 5_000]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, rule):
    import base64

    import tiktoken

    with open(token_counts.VOCABULARY, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=table, special_tokens={})
    rows = spark.createDataFrame([*enumerate(TEXTS), (3, "one line"), (None, "null id")], "doc_id long, text string").selectExpr("*", "5 AS tokens", "6 AS section")
    out = token_counts.token_counts(rows, rule=rule).collect()
    for i, text in enumerate(TEXTS):
        mine = sorted((r for r in out if r.doc_id == i), key=lambda r: (r.section, r.char_start))
        mine = mine if i != 3 else mine[:1]
        assert sum(r.tokens for r in mine) == len(enc.encode_ordinary(text or ""))
        assert "".join((text or "")[r.char_start : r.char_end] for r in mine) == (text or "")
        assert all((text or "")[r.char_start : r.char_end].endswith("\n") for r in mine[:-1])
    assert sum(r.doc_id == 3 for r in out) == 2 and sum(r.doc_id is None for r in out) == 1
    assert token_counts.token_counts(rows.limit(0)).collect() == []
    with pytest.raises(ValueError):
        token_counts.token_counts(rows, rule="any")
    with pytest.raises(ValueError):
        token_counts.token_counts(rows, sections="pages")
