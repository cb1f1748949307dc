"""Secret scans: named patterns, and sliding-window entropy over candidate strings. Native."""
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 20  # characters
MIN_RUN = 20  # a candidate's length at least
#: Bits per character from which a window is hot, by the class of its candidate.
BITS = {"hex": 3.0, "upper": 3.5, "mixed": 3.6}
BLOCK = 256  # windows, or matches, that one bounded state runs over: its lists stay short however long a text is
#: Candidates that are no secrets: UUIDs, numbers and dates, strings without digits.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9]+([-_/+=][0-9]+)*$",
    r"^[^0-9]*$",
)
#: Parts of candidates that are none; what stands around them is scanned.
PLACEHOLDER = r"abcdefghij|ABCDEFGHIJ|0123456789|[xX]{6}|[Ee][Xx][Aa][Mm][Pp][Ll][Ee]"
_either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
ASSIGN = f"({'|'.join(_either(w) for w in ('password', 'passwd', 'secret', 'token'))}|{_either('api')}_?{_either('key')})" + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
MIN_VALUE = 8
#: In the order in which spans that start together are listed. A run that is too short fails whole, so
#: for access and hex the length can stand in the pattern.
KINDS = (("assign", ASSIGN), ("access", "AKIA[A-Z0-9]{12,}"), ("hex", "[0-9a-f]{32,}"))
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}"
#: round(1e6 * c * log2(c)) for counts in a window: sums of them are exact.
CLOG = [round(1e6 * c * math.log2(c)) if c else 0 for c in range(WINDOW + 1)]
#: A window is hot if its sum of CLOG is at most this: H = log2(W) - sum / W.
LIMIT = {k: math.floor(1e6 * WINDOW * (math.log2(WINDOW) - b) + 0.5) for k, b in BITS.items()}
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: in a lambda an outer expression would be computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(xs: Column, block: int = BLOCK) -> Column:
    """An array in pieces."""
    starts = F.when(F.size(xs) > 0, F.sequence(F.lit(1), F.size(xs), F.lit(block))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda a: F.slice(xs, a, F.lit(block)))


def _located(text: Column, pattern: str) -> Column:
    """array<struct<start, text>> of all matches, in code points: pieces between matches and matches
    alternate, so lengths add up to offsets. They are summed by blocks, then in them, so that no growing
    list is copied for each match."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, f: F.struct(F.char_length(b).alias("gap"), f.alias("found")))
    none = F.expr("cast(array() as array<struct<start:int,text:string>>)")

    def size(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + F.char_length(x["found"]))

    def before(n: Column, block: Column) -> Column:
        return F.struct((n["at"] + size(block)).alias("at"), F.concat(n["out"], F.array(F.struct(n["at"].alias("at"), block.alias("block")))).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        return F.struct((start + F.char_length(x["found"])).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), x["found"].alias("text")))).alias("out"))

    def placed(pairs: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<at:int,block:array<struct<gap:int,found:string>>>>)").alias("out"))
        blocks = F.aggregate(_blocks(pairs), zero, before, lambda n: n["out"])
        return F.flatten(F.transform(blocks, lambda b: F.aggregate(b["block"], F.struct(b["at"].alias("at"), none.alias("out")), step, lambda acc: acc["out"])))

    return _let(pairs, placed)


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """The matches that do not fail, as in _located."""
    located = _located(text, pattern)
    if kind != "assign":
        return located
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.filter(F.zip_with(located, values, lambda m, v: F.when(F.char_length(v) >= MIN_VALUE, m)), lambda m: m.isNotNull())


def _spans(text: Column, kind: str, rank: int, pattern: str) -> Column:
    spans = F.transform(_matches(text, kind, pattern), lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (m["start"] + F.char_length(m["text"])).cast("int").alias("end")))
    return F.when(text.rlike(pattern), spans).otherwise(F.expr(f"cast(array() as {SPAN})")).cast(SPAN)


def _class(s: Column) -> Column:
    return F.when(s.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(s.rlike("^[0-9A-Z]+$"), "upper").otherwise("mixed")


def hot_runs(candidate: Column) -> Column:
    """array<struct<a, b>>: what the windows of WINDOW characters cover whose entropy is at least that of the
    class, from 0, those that overlap or touch joined.

    The counts of a window follow from those of the one before: one character goes, one comes, and the
    sum is corrected by the difference. Of a candidate's windows BLOCK at a time are passed so, with
    the counts and the stretches found as state; stretches are joined where blocks meet."""
    kind = _class(candidate)
    limit = F.when(kind == "hex", LIMIT["hex"]).when(kind == "upper", LIMIT["upper"]).otherwise(LIMIT["mixed"]).cast("long")
    table = F.array(*map(F.lit, CLOG))
    put = lambda n, at, by: F.concat(F.slice(n, F.lit(1), at), F.array(F.get(n, at) + by), F.slice(n, at + 2, F.lit(128)))
    none = F.expr("cast(array() as array<struct<a:int,b:int>>)")

    def step(acc: Column, x: Column) -> Column:
        new, old = x["new"], x["old"]  # old is -1 while the first window fills
        stay = new == old
        c_in, c_out = F.get(acc["n"], new), F.get(acc["n"], old)
        down = F.when((old < 0) | stay, 0).otherwise(F.get(table, c_out - 1) - F.get(table, c_out))
        up = F.when(stay, 0).otherwise(F.get(table, c_in + 1) - F.get(table, c_in))
        s = acc["s"] + down + up
        n = F.when(stay, acc["n"]).when(old < 0, put(acc["n"], new, 1)).otherwise(put(put(acc["n"], old, -1), new, 1))
        last = F.try_element_at(acc["runs"], F.lit(-1))
        start = acc["i"] - (WINDOW - 1)
        more = F.concat(F.when(start <= last["b"], F.slice(acc["runs"], F.lit(1), F.size(acc["runs"]) - 1)).otherwise(acc["runs"]), F.array(F.struct(F.when(start <= last["b"], last["a"]).otherwise(start).alias("a"), (start + WINDOW).alias("b"))))
        runs = F.when((old >= 0) | (acc["fill"] == WINDOW - 1), F.when(s <= acc["limit"], more).otherwise(acc["runs"])).otherwise(acc["runs"])
        return F.struct((acc["i"] + 1).alias("i"), F.least(acc["fill"] + 1, F.lit(WINDOW)).alias("fill"), n.alias("n"), s.alias("s"), runs.alias("runs"), acc["limit"].alias("limit"))

    def in_block(codes: Column, at: Column, limit: Column) -> Column:
        zero = F.struct(at.alias("i"), F.lit(0).alias("fill"), F.expr("array_repeat(0, 128)").alias("n"), F.lit(0).cast("long").alias("s"), none.alias("runs"), limit.alias("limit"))
        steps = F.zip_with(codes, F.concat(F.array_repeat(F.lit(-1), WINDOW), F.slice(codes, F.lit(1), F.greatest(F.size(codes) - WINDOW, F.lit(0)))), lambda a, b: F.struct(a.alias("new"), b.alias("old")))
        return F.aggregate(F.filter(steps, lambda x: x["new"].isNotNull()), zero, step, lambda acc: acc["runs"])

    def passed(known: Column) -> Column:
        codes, limit = known["codes"], known["limit"]
        starts = F.sequence(F.lit(0), F.greatest(F.size(codes) - WINDOW, F.lit(0)), F.lit(BLOCK))
        return F.flatten(F.transform(starts, lambda at: in_block(F.slice(codes, at + 1, F.lit(BLOCK + WINDOW - 1)), at, limit)))

    def joined(runs: Column) -> Column:
        first = F.filter(runs, lambda r, k: (k == 0) | (r["a"] > F.get(runs, k - 1)["b"]))
        last = F.filter(runs, lambda r, k: (k == F.size(runs) - 1) | (F.get(runs, k + 1)["a"] > r["b"]))
        return F.zip_with(first, last, lambda x, y: F.struct(x["a"].alias("a"), y["b"].alias("b")))

    codes = F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return _let(_let(F.struct(codes.alias("codes"), limit.alias("limit")), passed), joined)


def _blanked(text: Column) -> Column:
    """text with spaces, as many, for the matches of the patterns and then for placeholders."""
    for kind, pattern in (*KINDS, ("placeholder", PLACEHOLDER)):
        found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
        if kind == "assign":
            values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
            found = F.zip_with(found, values, lambda m, v: F.when(F.char_length(v) >= MIN_VALUE, F.repeat(F.lit(" "), F.char_length(m))).otherwise(m))
        else:
            found = F.transform(found, lambda m: F.repeat(F.lit(" "), F.char_length(m)))
        pieces = F.flatten(F.zip_with(between, found, lambda b, f: F.array(b, F.coalesce(f, F.lit("")))))
        text = F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)
    return text


def _entropy_spans(text: Column) -> Column:
    found = F.filter(_located(text, CANDIDATE), lambda m: ~m["text"].rlike("|".join(f"(?:{p})" for p in ALLOW)))
    spans = F.flatten(F.transform(found, lambda m: F.transform(hot_runs(m["text"]), lambda r: F.struct((m["start"] + r["a"]).alias("start"), F.lit(len(KINDS)).alias("rank"), F.lit("entropy").alias("kind"), (m["start"] + r["b"]).cast("int").alias("end")))))
    return F.when(text.rlike(CANDIDATE), spans).otherwise(F.expr(f"cast(array() as {SPAN})")).cast(SPAN)


def secret_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base and found: arrays of (start, rank, kind, end) in code points, end exclusive, by
    start and then kind as in KINDS. base: the pattern matches; found: with the entropy spans.

    Base matches and then placeholders are blanked; candidates are runs of MIN_RUN or more characters in
    what is left, unless the allow-list knows the whole run. So a key in a path or next to a base match is
    still found, and nothing of a base match is found again.

    Null text is scanned as empty and stays null in docs. Texts are scanned whole, row by row: no row
    moves, repeated rows return as often as they come, an empty table returns none. Columns of docs
    named base or found are replaced."""
    rows = docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    t = F.col("__text")
    base = F.concat(*(_spans(t, kind, rank, pattern) for rank, (kind, pattern) in enumerate(KINDS)))
    rows = rows.withColumns({"base": F.array_sort(base), "__text": F.when(t.rlike(CANDIDATE), _blanked(t)).otherwise("")})
    return rows.withColumn("found", F.array_sort(F.concat("base", _entropy_spans(t)))).drop("__text")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def oracle() -> str:
    """DuckDB SQL for the digest: each window's entropy is computed anew."""
    q = lambda s: s.replace("'", "''")
    blank, last = "", "d"
    for k, (kind, p) in enumerate((*KINDS, ("placeholder", PLACEHOLDER))):
        p = q(p)
        values = f"regexp_extract_all(text, '{p}', 2)" if kind == "assign" else f"regexp_extract_all(text, '{p}')"
        pieces = f"list_zip(string_split_regex(text, '{p}'), regexp_extract_all(text, '{p}'), {values})"
        fails = f"length(x[3]) < {MIN_VALUE if kind == 'assign' else 0}"
        blank += f"bl{k} AS (SELECT doc_id, CASE WHEN regexp_matches(text, '{p}') THEN array_to_string(list_transform({pieces}, lambda x: x[1] || CASE WHEN x[2] IS NULL THEN '' WHEN {fails} THEN x[2] ELSE repeat(' ', length(x[2])) END), '') ELSE text END AS text FROM {last}),\n"
        last = f"bl{k}"
    base = "\nUNION ALL ".join(
        f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, regexp_extract_all(text, '{q(p)}') AS f, string_split_regex(text, '{q(p)}') AS g, {f'regexp_extract_all(text, {chr(39)}{q(p)}{chr(39)}, 2)' if kind == 'assign' else 'NULL'} AS v FROM d WHERE regexp_matches(text, '{q(p)}')"
        for rank, (kind, p) in enumerate(KINDS)
    )
    limit = " ".join(f"WHEN regexp_matches(s, '{p}') THEN {LIMIT[k]}" for k, p in (("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$"), ("upper", "^[0-9A-Z]+$")))
    allow = "|".join(f"(?:{p})" for p in ALLOW)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({base}),
o AS (SELECT doc_id, rank, kind, unnest(range(1, len(f) + 1)) AS i, f, g, v FROM m),
b AS (SELECT doc_id, rank, kind, list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[:i - 1], lambda x: length(x))), 0) AS a, length(f[i]) AS n FROM o WHERE v IS NULL OR length(v[i]) >= {MIN_VALUE}),
base AS (SELECT doc_id, rank, kind, a::BIGINT AS a, (a + n)::BIGINT AS z FROM b),
{blank}c0 AS (SELECT doc_id, regexp_extract_all(text, '{CANDIDATE}') AS f, string_split_regex(text, '{CANDIDATE}') AS g FROM {last} WHERE regexp_matches(text, '{CANDIDATE}')),
c1 AS (SELECT doc_id, unnest(range(1, len(f) + 1)) AS i, f, g FROM c0),
c2 AS (SELECT doc_id, f[i] AS s, (list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[:i - 1], lambda x: length(x))), 0))::BIGINT AS a FROM c1),
c3 AS (SELECT * FROM c2 WHERE NOT regexp_matches(s, '{q(allow)}')),
w AS (SELECT doc_id, a, s, CASE {limit} ELSE {LIMIT["mixed"]} END AS lim, unnest(range(0, length(s) - {WINDOW} + 1)) AS k FROM c3),
x AS (SELECT doc_id, a, k FROM w WHERE list_sum(list_transform(list_distinct(string_split(substr(s, k + 1, {WINDOW}), '')), lambda y: {CLOG}[1 + {WINDOW} - length(replace(substr(s, k + 1, {WINDOW}), y, ''))])) <= lim),
y AS (SELECT *, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id, a ORDER BY k) + {WINDOW} THEN 0 ELSE 1 END AS fresh FROM x),
z AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, a ORDER BY k) AS run FROM y),
e AS (SELECT doc_id, {len(KINDS)} AS rank, 'entropy' AS kind, a + min(k) AS a, a + max(k) + {WINDOW} AS z FROM z GROUP BY doc_id, a, run),
al AS (SELECT * FROM base UNION ALL SELECT * FROM e),
bs AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(concat(kind, ':', a, ':', z), ',' ORDER BY a, rank) AS l FROM base GROUP BY doc_id),
sp AS (SELECT doc_id, string_agg(concat(kind, ':', a, ':', z), ',' ORDER BY a, rank) AS l FROM al GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(bs.l, '')) AS base_sha256, coalesce(sp.l, '') AS spans
FROM d LEFT JOIN bs ON d.doc_id = bs.doc_id LEFT JOIN sp ON d.doc_id = sp.doc_id"""
