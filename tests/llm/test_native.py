"""Operators that SQL can express, on tables of odd rows: Spark against DuckDB."""
import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter

import duckdb
import pytest

from tidewarp.llm import common, exact_dedup, mixing, registry, secrets, url_filters

KEY = "AKIA" + "ABCDEFGH12345678"
HEX = "0123456789abcdef" * 3
TEXTS = [
    None, "", " ", "\n\n", "Straße ÉÀ Ünï", "STRASSE", "a b c", "A B C", "a b c", "x" * 200_000, "word " * 50_000, "\x0b\x0c\r\t mixed \x00 nul", "😀 emoji 😀",
    f"password = 'hunter2hunter2' and token: short {KEY}", f"{HEX} {HEX[:31]} API_KEY=abc.def-ghi/jk=", "😀secret=\"ABCDEFGH\" passwd:12345678", "password=token: abcdefghijk",
    "key Zx9Qw3Rt7Yu1Io5Pa8Sd2Fg6Hj4Kl0 end", "550e8400-e29b-41d4-a716-446655440000", "abcdefghijklmnopqrstuvwxyz0123456789", "2024-01-02-03-04-05-06-07-08-09", "Zx9Qw3Rt7Yu1Io5Pa8Sd2Fg6Hj4Kl0" * 3, "ſecret=abcdefghij tOKEN=abcdefghij",
    "/example/v1/Zx9Qw3Rt7Yu1Io5Pa8Sd2Fg6Hj4Kl0", f"{HEX}/Zx9Qw3Rt7Yu1Io5Pa8Sd2Fg6Hj4Kl0 {HEX}-{HEX}", "abcdefghijKLMNOP012345678QRSTUV0123456789zyxwv", " ".join(f"k{i}Zx9Qw3Rt7Yu1Io5Pa8Sd2Fg6Hj4Kl0" for i in range(700)), "Zx9Qw3Rt7Yu1Io5Pa8Sd2Fg6Hj4Kl0Ab" * 40 + "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9 + "Zx9Qw3Rt7Yu1Io5Pa8Sd2Fg6Hj4Kl0Ab" * 20,
]


def documents(spark, texts=TEXTS):
    rows = [(i, t, "en", [None, "s1", "s2", "s10", "ß"][i % 5], 0) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, "a b c", None, None, None), (None, None, None, "s1", None), (3, "other text of a repeated id", "en", "s2", 1)] if texts else []
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    for name, texts in (("full", TEXTS), ("empty", [])):
        documents(spark, texts).write.parquet(f"{at}/{name}/documents.parquet")
        labels = [(1, 1, 0), (2, 0, 0), (2, 1, 1), (None, 0, 0), (4, None, None)] if texts else []
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/{name}/labels.parquet")
        urls = [None, "", "no scheme", "http://", "HTTP://Sub.EXAMPLE.com/en/7/x", "http://com/en/", "http://xcom/en/a", "http://a.com/EN/b", "https://é.ORG?q=/es/", "http://a.org/es/a#b", "http://a.example.net/de/81", "http://a.example.net/de/7", "ftp://h#://x/y", "http://a.b/x\ny/z?://"]
        urls += [f"http://many.example.com/{c}/{i}/t" for i, c in itertools.product(range(12), ("en", "fr", "shop", ""))] + [f"http://many.example.com/en/{i}/t" for i in range(3)]
        urls += [f"http://big.org/{c}/{i}" for i, c in itertools.product(range(30), ("es", "x", f"y{'z' * 50}"))]
        spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(urls)] if texts else [], "page_id long, url string, html string").write.parquet(f"{at}/{name}/pages.parquet")
    return str(at)


@pytest.mark.parametrize("table", ["full", "empty"])
@pytest.mark.parametrize("name", sorted(n for n in registry.oracle_sql() if int(n[2:].split("_")[0]) <= 10))
def test_against_sql(spark, folder, name, table):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{table}/{t}.parquet/*.parquet'")
    df = registry.queries()[name](spark, f"{folder}/{table}")
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = sorted(df.columns)
    values = lambda names, rows: sorted((tuple(f"{r[names.index(c)]:.9g}" if isinstance(r[names.index(c)], float) else r[names.index(c)] for c in at) for r in rows), key=str)
    got = values(df.columns, df.collect())
    assert got == values(want.columns, want.fetchall())
    assert bool(got) == (table == "full")


def test_only_small_tables_are_broadcast(spark):
    df = spark.createDataFrame([(i, "x" * 100, None) for i in range(50)], "id long, text string, raw binary")
    assert common.at_most(df, 50) and not common.at_most(df, 49)
    assert common.at_most(df, 50, 5_000) and not common.at_most(df, 50, 4_999)
    assert common.at_most(df.limit(0), 0, 0) and common.at_most(df.select("id"), 50, 0)


def test_rules():
    ordered = [r[1] for r in url_filters.RULES]
    assert ordered == ["com/en/", "example.com/en/7", "net/de/", "example.net/de/8", "org/es/"]


def test_url_verdicts(spark):
    urls = [("http://m.example.com/en/71?x", 1), ("http://m.example.com/en/81", 2), ("http://com/en/", 3), ("http://notcom/en/", 4)]
    rows = spark.createDataFrame(urls, "url string, host int")  # host clashes, and is replaced
    out = {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filters.url_filter(rows).collect()}
    assert out["http://m.example.com/en/71?x"] == ("m.example.com", "/en/71", "example.com/en/7", "allow")
    assert out["http://m.example.com/en/81"] == ("m.example.com", "/en/81", "com/en/", "block")
    assert out["http://com/en/"][2] == "com/en/" and out["http://notcom/en/"][2:] == (None, "allow")


def brute_templates(urls, rules, depth):
    """(template, rejected) of each (host, path), by recursion over the whole tree of each host."""
    u = url_filters
    by_rule = lambda h, p: next((v for v, r in sorted(rules, key=lambda r: -len(r[1])) if (h == r.split("/", 1)[0] or h.endswith("." + r.split("/", 1)[0])) and p.startswith("/" + r.split("/", 1)[1])), None)
    rows = [(h, p, by_rule(h, p)) for h, p in urls]
    count = lambda part: (sum(r[2] is not None for r in part), sum(r[2] == "block" for r in part))
    labelled, blocked = count(rows)
    out = {}

    def down(part, template, above, level, support):
        l_, b = count(part)
        purity = (b + u.PRIOR_ROWS * above) / (l_ + u.PRIOR_ROWS)
        groups = {}
        for r in part:
            parts = r[1].removeprefix("/").split("/")
            if level < len(parts) and level <= depth:
                groups.setdefault(parts[level] if level < depth else "**", []).append(r)
            else:
                out[r[:2]] = (template, purity >= u.PURITY and support >= u.MIN_LABELS)
        sure = [count(g) for g in groups.values() if count(g)[0] >= u.MIN_LABELS]
        pool = sum(x[1] for x in sure) / sum(x[0] for x in sure) if sure else 0
        variable = len(groups) >= u.MIN_CHILDREN and sum(map(len, groups.values())) <= len(groups) * u.MAX_REPEAT
        named = {}
        for s, g in groups.items():
            n, k = count(g)
            close = n >= u.MIN_LABELS and len(sure) > 1 and (k / n - pool) ** 2 * n <= u.MERGE_Z**2 * pool * (1 - pool)
            named.setdefault("*" if variable and s else "{*}" if close else s, []).extend(g)
        for name, g in named.items():
            down(g, f"{template}/{name}", purity, level + 1, support)

    for h in {r[0] for r in rows}:
        part = [r for r in rows if r[0] == h]
        down(part, "", blocked / labelled if labelled else 0.0, 0, count(part)[0])
    return out, rows


@pytest.mark.parametrize("depth", [1, 3])
def test_templates_against_brute_force(spark, depth):
    """Random trees of several levels: templates, rejections and verdicts."""
    rng = random.Random(depth)
    rules = (("block", "com/a/"), ("allow", "com/a/x/"), ("block", "h1.com/b/1"), ("allow", "h2.com/c"), ("block", "h2.com/b"), ("block", "h3.com/"))
    urls = [(rng.choice(("h1.com", "h2.com", "www.h1.com", "h3.com", "h4.org", "")), "/" + "/".join(rng.choice(("a", "b", "c", "x", "y", "", str(rng.randint(1, 40)))) for _ in range(rng.randint(0, 5)))) for _ in range(900)]
    urls = [(h, p if h else "") for h, p in urls]
    want, rows = brute_templates(urls, rules, depth)
    frame = spark.createDataFrame([(f"http://{h}{p}" if h else None,) for h, p in urls], "url string").repartition(3)
    out = url_filters.url_filter(frame, rules=rules, depth=depth).collect()
    assert len(out) == len(urls)
    assert {(r.host, r.path): (r.template, r.rejected) for r in out} == want
    verdict = {r[:2]: r[2] or ("block" if want[r[:2]][1] else "allow") for r in rows}
    assert all(r.verdict == verdict[r.host, r.path] for r in out)
    assert any(r.rule is None and r.verdict == "block" for r in out) and any(r.rule is None and r.verdict == "allow" for r in out)


def test_templates_generalise_merge_and_judge_siblings(spark):
    rules = (("block", "site.org/a/1"), ("block", "site.org/b/1"), ("allow", "good.org/c/1"), ("block", "few.org/a/"))
    urls = [(f"http://{h}/{c}/{n}{i}",) for h, cs in (("site.org", "abd"), ("good.org", "cd")) for c in cs for n in (1, 2) for i in range(20)]
    urls += [("http://few.org/a/1",), ("http://few.org/d/1",)]
    out = url_filters.url_filter(spark.createDataFrame(urls, "url string"), rules=rules).collect()
    verdict = lambda host, start: {r.verdict for r in out if r.host == host and r.path.startswith(start)}
    assert verdict("site.org", "/a/2") == verdict("site.org", "/b/2") == {"block"}
    assert verdict("site.org", "/d/") == {"block"}  # without labels of its own: judged by its siblings
    assert verdict("good.org", "/c/2") == verdict("good.org", "/d/") == verdict("few.org", "/d/") == {"allow"}
    assert {r.template for r in out if r.host == "site.org"} == {"/{*}/*", "/d/*"} and {r.template for r in out if r.path.startswith("/c/")} == {"/c/*"}


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 4}") for i in range(400)] + [(1000, "w " * 500, "rare"), (1001, "", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed(docs, quality=spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect()
    total = sum(r.size for r in out)
    by = {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        size, target, taken = by.get(r.source, (r.source_size, r.target, 0))
        by[r.source] = (size, target, taken + r.taken)
    assert all(abs(taken - target) < 1 and target <= 2 * size + 1e-9 for size, target, taken in by.values())
    assert sum(t for _, t, _ in by.values()) == pytest.approx(1.5 * total)
    order = sorted(by)
    free = {s: by[s][1] / (3, 1, 2)[k % 3] for k, s in enumerate(order) if by[s][1] < 2 * by[s][0]}
    assert max(free.values()) == pytest.approx(min(free.values()))
    again = mixing.mixed(docs.repartition(7), quality=spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_small_buckets_give_the_same_mix(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 11), f"s{i % 3}") for i in range(500)], "doc_id long, text string, source string")
    want = sorted(map(tuple, mixing.mixed(docs).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    assert sorted(map(tuple, mixing.mixed(docs).collect())) == want


def test_exact_dedup_keeps_either_end(spark):
    docs = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "c"), (2, "a B"), (None, "a b")], "doc_id long, text string")
    for keep, best in (("min", 1), ("max", 2)):
        out = exact_dedup.exact_dedup(docs, keep).collect()
        assert len(out) == 5 and sum(r.kept for r in out) == 2
        assert {(r.keep_id, r.group_size, r.text_sha256) for r in out if r.doc_id != 3} == {(best, 4, hashlib.sha256(b"a b").hexdigest())}


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    """With one hash for all texts only the bytes tell them apart."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.when(F.lit(True), F.lit("00" * 16)))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()} == {(1, 3, 2), (3, 3, 2), (2, 2, 1)}
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.when(F.lit(True), F.lit("11" * 32)))
    out = exact_dedup.exact_dedup(docs)
    assert {(r.doc_id, r.keep_id, r.group_size) for r in out.collect()} == {(1, 3, 2), (3, 3, 2), (2, 2, 1)}


def brute_runs(s):
    """What hot windows of a candidate cover, each window's entropy computed anew."""
    kind = "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", s) else "upper" if re.fullmatch("[0-9A-Z]+", s) else "mixed"
    hot = set()
    for k in range(len(s) - secrets.WINDOW + 1):
        counts = Counter(s[k : k + secrets.WINDOW])
        if -sum(c / 20 * math.log2(c / 20) for c in counts.values()) >= secrets.BITS[kind] - 1e-6:
            hot.update(range(2 * k, 2 * (k + secrets.WINDOW) + 1))  # odd: between two characters
    out = []
    for i in sorted(hot):
        if out and out[-1][1] == i - 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return [(a // 2, z // 2) for a, z in out]


def test_entropy_of_planted_secrets(spark):
    """Every planted key is found where it stands; spans are those of a window-by-window computation."""
    rng = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows, planted = [], {}
    for i in range(120):
        key = "".join(rng.choices(("0123456789ABCDEF", letters[:26] + letters[52:62], letters)[i % 3], k=rng.randint(24, 31) if i % 3 == 0 else rng.randint(24, 60))) + "7Q"[i % 3 == 2]
        before = " ".join(rng.choice(("plain", "words", "é😀")) for _ in range(rng.randint(0, 30)))
        glue = rng.choice((" ", " (", ": ", " /example/", ' "'))
        rows.append((i, f"{before}{glue}{key} after it"))
        planted[i] = (len(before) + len(glue), len(before) + len(glue) + len(key), key)
    out = {r.doc_id: [(s.start, s.end) for s in r.found if s.kind == "entropy"] for r in secrets.secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(any(a < planted[i][1] and planted[i][0] < z for a, z in out[i]) for i in planted)
    assert found >= 0.95 * len(planted)
    for i, (at, _, key) in planted.items():
        if "/example/" not in rows[i][1] and not re.search(secrets.PLACEHOLDER, key) and re.search("[0-9]", key):
            assert out[i] == [(at + a, at + z) for a, z in brute_runs(key)], rows[i]


def test_long_candidates_take_linear_time(spark):
    rng = random.Random(4)
    text = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=300_000))
    began = time.monotonic()
    out = secrets.secret_scan(spark.createDataFrame([(1, text), (2, "g" * 50 + "1" + text[:5_000])], "doc_id long, text string")).collect()
    took = time.monotonic() - began
    spans = {r.doc_id: [(s.start, s.end) for s in r.found] for r in out}
    assert spans[1] == brute_runs(text) and spans[2] == brute_runs("g" * 50 + "1" + text[:5_000])
    assert took < 60


def test_secret_spans(spark):
    docs = spark.createDataFrame([(1, TEXTS[13]), (2, TEXTS[17]), (3, TEXTS[18]), (4, TEXTS[16])], "doc_id long, text string")
    out = {r.doc_id: [(s.kind, s.start, s.end) for s in r.found] for r in secrets.secret_scan(docs).collect()}
    assert out[1] == [("assign", 0, 26), ("access", 45, 65)]
    assert [s[0] for s in out[2]] == ["entropy"] and out[2][0][1] >= 4 and out[2][0][2] <= 34
    assert out[3] == [] and out[4] == []
