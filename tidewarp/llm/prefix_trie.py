"""Conversation prefix trie: the Cartesian tree over the LCP array of sorted conversations, by all nearest smaller
values inside blocks and across them by what a block leaves open."""
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialized

SYMBOL = 16  # bytes of a turn in a sorting key
BLOCK_BYTES = 16 << 20  # of keys in a block, about
BLOCK_ROWS = 50_000  # different sequences in a block, about
NONE = hashlib.sha256(b"").hexdigest()
SHARED_TURNS, EVERY = 6, 100


def sequences(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """conv_id, turns: array of (h, n), the hash of role and text and the text's code points, in order of turn (null first,
    equal turns by h). Null role or text is empty; rows without an id are left out. A conversation is one row,
    of 40 bytes a turn here and of 16 in the sorting key, so up to some ten million turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    h = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    turns = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("conv_id"), F.struct("turn", h.alias("h"), F.char_length(text).cast("long").alias("n")).alias("t"))
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return gathered.select("conv_id", F.transform("t", lambda t: F.struct(t["h"].alias("h"), t["n"].alias("n"))).alias("turns"))


def rebuilt(seqs: DataFrame) -> DataFrame:
    """Each conversation with its first h turns replaced by those of the first conversation of its hundred; h is the
    CRC-32 of its decimal id modulo 6. At most 100 rows join one head."""
    seqs = materialized(seqs, "conversations")
    heads = seqs.filter(F.col("conv_id") % EVERY == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, SHARED_TURNS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % SHARED_TURNS).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % EVERY
    first = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), h))
    rows = seqs.join(broadcast_if_small(heads, 100_000), base == F.col("base"), "left")
    return rows.select("conv_id", F.concat(first, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (s, conv_id) in this order to one row per run of s in a batch: s, first, n, ids (comma-joined)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        s, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        cuts = [0, *(i for i in range(1, len(s)) if s[i] != s[i - 1]), len(s)]
        runs = [(s[a], ids[a], b - a, ",".join(map(str, ids[a:b]))) for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*runs), (pa.binary(), pa.int64(), pa.int64(), pa.string()))], ["s", "first", "n", "ids"])


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of packed(), in order of (s, first), to one row per s: conv_id (the smallest), n, ends (SHA-256 of all ids). The
    digest takes in one row after the other, so a group of any size needs no more memory than a row."""
    out: list[tuple] = []
    last = digest = None
    n = first = 0

    def flush() -> pa.RecordBatch:
        rows, out[:] = list(out), []
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["conv_id", "n", "ends"])

    for batch in batches:
        for s, at, count, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if s != last:
                if digest:
                    out.append((first, n, digest.hexdigest()))
                last, digest, n, first = s, hashlib.sha256(ids.encode()), count, at
            else:
                digest.update(b"," + ids.encode())
                n += count
        if len(out) >= 4096:
            yield flush()
    if digest:
        out.append((first, n, digest.hexdigest()))
    if out:
        yield flush()


def distinct_sequences(seqs: DataFrame) -> DataFrame:
    """key, chars, conv_id (smallest), n, ends of each different sequence. Ids of equal sequences are sorted in range partitions and
    packed there, so a sequence that a third of all conversations share is spread over tasks before its digest."""
    key = F.unhex(F.array_join(F.col("turns.h"), ""))
    rows = materialized(seqs.select("conv_id", key.alias("key"), F.col("turns.n").alias("chars")).withColumn("s", F.unhex(F.md5("key"))), "sequences")
    ids = rows.select("s", "conv_id").repartitionByRange("s", "conv_id").sortWithinPartitions("s", "conv_id")
    ids = ids.mapInArrow(packed, "s binary, first long, n long, ids string").repartition("s").sortWithinPartitions("s", "first")
    stats = materialized(ids.mapInArrow(digested, "conv_id long, n long, ends string"), "members")
    return rows.select("conv_id", "key", "chars").join(stats, "conv_id")


def common_symbols(a: bytes, b: bytes) -> int:
    """How many symbols two keys share at their start, by steps that double until one differs."""
    n, at, step = min(len(a), len(b)) // SYMBOL, 0, 1
    while at < n:
        upto = min(at + step, n)
        if a[at * SYMBOL : upto * SYMBOL] == b[at * SYMBOL : upto * SYMBOL]:
            at, step = upto, step * 2
        elif upto - at == 1:
            break
        else:
            step = 1
    return at


def nearest_smaller(values: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """left, right, head of each value: the nearest places with smaller values, -1 and len(values) where none is, and the
    first of the equal values that no smaller one parts it from."""
    n = len(values)
    left, right, head = np.full(n, -1), np.full(n, n), np.arange(n)
    stack: list[int] = []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[head[stack.pop()]] = i
        if stack and values[stack[-1]] == v:
            head[i], left[i], stack[-1] = head[stack[-1]], left[stack[-1]], i
        else:
            left[i] = stack[-1] if stack else -1
            stack.append(i)
    return left, right[head], head


def range_minimum(values: np.ndarray):
    """A function of arrays (start, end) with the least value of each range, none of them empty."""
    table = [values]
    while 2 << len(table) - 1 <= len(values):
        step = 1 << len(table) - 1
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))

    def least(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        level = np.frexp(end - start)[1] - 1
        out = np.empty(len(start), values.dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(table[k][start[at]], table[k][end[at] - (1 << k)])
        return out

    return least


#: kind: 0 a whole node, 1 one that the next block goes on with, 2 what a block adds to a node of an earlier one.
#: up: 0 parent holds the parent's id (null for the root), 1 or 2 the parent is the row of that kind, this block and depth - 1.
PART = "p int, kind int, depth long, conv_id long, n long, leaves long, spoken long, fresh long, before long, above long, children long, ends string, up int, parent long"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
_FIELDS = [tuple(f.split()) for f in PART.split(", ")]


def block_nodes(block: pa.Table) -> pa.Table:
    """The trie nodes that begin in a block of neighbouring sequences, and what the block adds to nodes that it goes on with
    (PART). block: p, edge (-1 the key before, 1 the key after, 0 a row), key, chars, conv_id, n, ends."""
    block = block.sort_by([("edge", "ascending"), ("key", "ascending")])
    edge = block.column("edge").to_pylist()
    rows = block.filter(pc.equal(block.column("edge"), 0))
    keys = block.column("key").to_pylist()
    own = rows.column("key").to_pylist()
    n = len(own)
    lcp = [common_symbols(a, b) for a, b in zip(own, own[1:])]
    lcp = np.array([common_symbols(keys[0], own[0]) if edge[0] < 0 else -1, *lcp, common_symbols(own[-1], keys[-1]) if edge[-1] > 0 else -1])
    size = np.array([len(k) // SYMBOL for k in own])
    conv = rows.column("conv_id").to_numpy()
    m = rows.column("n").to_numpy()
    ends = np.array(rows.column("ends").to_pylist(), dtype=object)
    offset = np.concatenate([[0], np.cumsum(size)])
    flat = rows.column("chars").combine_chunks().flatten().to_numpy()
    upto = np.concatenate([[0], np.cumsum(flat)])
    said = lambda i, k: upto[offset[i] + np.maximum(k, 0)] - upto[offset[i]]  # noqa: E731  code points of the first k turns of row i
    every = np.arange(n)
    total = said(every, size)
    sums = lambda a: np.concatenate([[0], np.cumsum(a)])
    members, leaves, spoken, fresh = sums(m), sums(lcp[1:] < size), sums(m * total), sums(total - said(every, lcp[:n]))
    left, right, head = nearest_smaller(lcp.tolist())
    times = np.bincount(head[:n], minlength=n + 1)  # how often a head's value stands there, the block's end not counted
    least = range_minimum(conv)

    # Compressed nodes: one of each group of equal values, and one per row that goes on below its neighbours.
    heads = np.flatnonzero((head == np.arange(n + 1)) & (left >= 0))
    single = np.flatnonzero(np.maximum(lcp[:n], lcp[1:]) < size)
    start = np.concatenate([left[heads], single])
    stop = np.concatenate([np.minimum(right[heads], n), single + 1])
    is_open = np.concatenate([right[heads] > n, np.zeros(len(single), bool)])
    bottom = np.concatenate([lcp[heads], size[single]])
    after = np.concatenate([np.where(right[heads] > n, -1, lcp[np.minimum(right[heads], n)]), lcp[single + 1]])
    children = np.concatenate([times[heads] + (size[left[heads]] > lcp[heads]), np.zeros(len(single), int)])
    top = np.maximum(lcp[start], after) + 1
    # The parent of the topmost depth: the group of the value right of the interval if that is the larger one, else of the left one.
    beyond = np.concatenate([np.minimum(right[heads], n), single + 1])
    above = np.where(after > lcp[start], beyond, head[start])
    low = least(start, stop)
    low_of = np.full(n + 1, 0)
    low_of[heads] = low[: len(heads)]
    up = np.where(top == 0, 0, np.where(left[above] < 0, 2, np.where(right[above] > n, 1, 0)))

    # Each compressed node stands for the depths from top to bottom, all with its members.
    k = np.repeat(np.arange(len(start)), bottom - top + 1)
    depth = np.arange(len(k)) - np.repeat(np.cumsum(bottom - top + 1) - (bottom - top + 1), bottom - top + 1) + top[k]
    first = depth == top[k]
    l_, r_ = start[k], stop[k]
    parent = np.where(first, low_of[above[k]], low[k])
    out = {
        "kind": is_open[k].astype(int), "depth": depth, "conv_id": low[k], "n": members[r_] - members[l_], "leaves": leaves[r_] - leaves[l_], "spoken": spoken[r_] - spoken[l_], "fresh": fresh[r_] - fresh[l_],
        "before": said(l_, depth - 1), "above": said(l_, lcp[l_]), "children": np.where(depth == bottom[k], children[k], 1), "ends": np.where(depth == size[l_], ends[l_], NONE),
        "up": np.where(first, up[k], is_open[k].astype(int)),
    }
    no_parent = (out["up"] > 0) | (depth == 0)

    # What the block adds to nodes of depth 0 to lcp[0] that began before it.
    depth = np.arange(lcp[0] + 1)
    stop = np.minimum(np.searchsorted(-np.minimum.accumulate(lcp), -depth, side="right"), n)
    begin = np.zeros(len(depth), int)
    again = np.zeros(len(depth), int)
    outer = np.flatnonzero((head == np.arange(n + 1)) & (left < 0) & (lcp >= 0))
    again[lcp[outer]] = times[outer]
    more = {"kind": begin + 2, "depth": depth, "conv_id": least(begin, stop), "n": members[stop], "leaves": leaves[stop], "spoken": spoken[stop], "fresh": fresh[stop], "before": begin, "above": begin, "children": again, "ends": np.full(len(depth), NONE, object), "up": begin}
    p = block.column("p")[0].as_py()
    both = {c: np.concatenate([out[c], more[c]]) for c in out}
    both["p"] = np.full(len(both["kind"]), p)
    arrays = {c: pa.array(both[c], _TYPES[t]) for c, t in _FIELDS if c != "parent"}
    arrays["parent"] = pa.array(np.concatenate([parent, begin]), pa.int64(), mask=np.concatenate([no_parent, begin == 0]))
    return pa.table([arrays[c] for c, _ in _FIELDS], names=[c for c, _ in _FIELDS])


def blocks_of(distinct: DataFrame, rows: int = BLOCK_ROWS, size: int = BLOCK_BYTES) -> DataFrame:
    """The sequences dealt to blocks p in their order, with the neighbouring keys of each block (see block_nodes)."""
    distinct = materialized(distinct, "distinct-sequences")
    n, total = distinct.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()
    count = 1 + n // rows + total // size
    blocks = materialized(distinct.repartitionByRange(count, "key").withColumn("p", F.spark_partition_id()), "trie-blocks")
    ends = blocks.groupBy("p").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    by_block = Window.orderBy("p")  # over one row a block
    ends = ends.withColumns({"last": F.lag("hi").over(by_block), "next": F.lead("lo").over(by_block)})
    near = [ends.select("p", F.lit(edge).alias("edge"), F.col(c).alias("key")).filter("key IS NOT NULL") for edge, c in ((-1, "last"), (1, "next"))]
    near = near[0].unionByName(near[1])
    return blocks.withColumn("edge", F.lit(0)).unionByName(near, allowMissingColumns=True).select("p", "edge", "key", "chars", "conv_id", "n", "ends")


def prefix_trie(seqs: DataFrame, rows: int = BLOCK_ROWS, size: int = BLOCK_BYTES) -> DataFrame:
    """One row per node of the trie of all sequences: conv_id (smallest member), depth, parent_conv_id (null for the
    root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256. seqs: conv_id (unique), turns (see sequences).

    A node of depth d is a sequence of d turns that one conversation or more starts with; its members are those. (conv_id, depth) is
    unique. n_leaves counts childless nodes of its subtree, itself included; saved_tokens sums, over the subtree, the members but
    one of each node times the code points of its last text; ends_sha256 is that of the comma-joined ids, in numerical
    order, of members that end there. A conversation without turns ends at the root. Without conversations there is no
    node. Equal turns are told by a 128-bit hash of role and text.

    Different sequences are sorted in blocks of bounded rows and bytes (a longer sequence is a block of its own). In a block, nearest
    smaller values of the LCP array give the nodes: groups of equal values are merged, missing depths expanded, and interval
    sums give the figures. A block's least values say how far nodes reach: what it leaves open, and what it adds to open nodes of earlier blocks, is a row a
    depth, joined by a window per depth over those rows."""
    blocks = blocks_of(distinct_sequences(seqs), rows, size)
    parts = materialized(blocks.groupBy("p").applyInArrow(block_nodes, PART), "trie-parts")
    crossing = parts.filter("kind > 0")
    opened = F.last(F.when(F.col("kind") == 1, F.col("p")), ignorenulls=True).over(Window.partitionBy("depth").orderBy("p", F.col("kind").desc()))
    crossing = materialized(crossing.withColumn("owner", opened), "trie-crossing")
    at_start = lambda c: F.max(F.when(F.col("kind") == 1, F.col(c))).alias(c)
    joined = crossing.groupBy("depth", "owner").agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n", "leaves", "spoken", "fresh", "children")), *(at_start(c) for c in ("before", "above", "ends", "up", "parent")))
    joined = materialized(joined.withColumn("p", F.col("owner")), "trie-joined")
    refs = crossing.select("p", "depth", "kind", "owner").join(joined.select("depth", "owner", F.col("conv_id").alias("ref")), ["depth", "owner"])
    refs = materialized(refs.select(F.col("p").alias("rp"), (F.col("depth") + 1).alias("rdepth"), F.col("kind").alias("rkind"), "ref"), "trie-refs")
    names = ["p", "depth", "conv_id", "n", "leaves", "spoken", "fresh", "before", "above", "children", "ends", "up", "parent"]
    nodes = parts.filter("kind = 0").select(*names).unionByName(joined.select(*names))
    known, asked = nodes.filter("up = 0").withColumn("ref", F.col("parent")), nodes.filter("up > 0")
    asked = asked.join(broadcast_if_small(refs), (F.col("p") == F.col("rp")) & (F.col("depth") == F.col("rdepth")) & (F.col("up") == F.col("rkind")), "left").select(*names, "ref")
    saved = F.col("spoken") - (F.col("n") - 1) * F.col("before") - F.col("fresh") - F.col("above")
    return known.unionByName(asked).select(
        "conv_id", "depth", F.col("ref").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


def oracle() -> str:
    """SQL has no CRC-32, so it is folded over the digits of an id, with a table that a recursive query makes."""
    return f"""WITH RECURSIVE crc(i, c) AS (SELECT 0, range(256)::BIGINT[] UNION ALL SELECT i + 1, list_transform(c, lambda x: xor(x >> 1, 3988292384 * (x & 1))) FROM crc WHERE i < 8),
tab AS MATERIALIZED (SELECT c AS tab FROM crc WHERE i = 8),
r AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS s FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, n, s, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, s) AS k FROM r),
c AS (SELECT conv_id, conv_id - conv_id % {EVERY} AS base, xor(list_reduce(list_transform(range(len(conv_id::VARCHAR)), lambda i: ascii(substr(conv_id::VARCHAR, i + 1, 1))::BIGINT), lambda a, x: xor(a >> 8, tab[1 + (xor(a, x) & 255)]), 4294967295::BIGINT), 4294967295) % {SHARED_TURNS} AS h FROM (SELECT DISTINCT conv_id FROM r), tab),
q AS (SELECT c.conv_id, 0 AS part, k, n, s FROM c JOIN o ON o.conv_id = c.base AND k <= h UNION ALL SELECT c.conv_id, 1, k, n, s FROM c JOIN o ON o.conv_id = c.conv_id AND k > h),
z AS (SELECT conv_id, row_number() OVER w AS depth, n, string_agg(s, '') OVER w AS path FROM q WINDOW w AS (PARTITION BY conv_id ORDER BY part, k)),
a AS (SELECT conv_id, depth, n, path FROM z UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS (SELECT conv_id, max(depth) AS depth FROM a GROUP BY conv_id),
v AS (SELECT min(a.conv_id) AS conv_id, a.depth, a.path, any_value(n) AS n, count(*) AS n_convs,
  sha256(coalesce(string_agg(a.conv_id::VARCHAR, ',' ORDER BY a.conv_id) FILTER (a.depth = e.depth), '')) AS ends_sha256 FROM a JOIN e ON a.conv_id = e.conv_id GROUP BY a.depth, a.path),
p AS (SELECT v.conv_id, v.depth, u.conv_id AS parent FROM v JOIN a ON a.conv_id = v.conv_id AND a.depth = v.depth - 1 JOIN v u ON u.path = a.path AND u.depth = a.depth),
l AS (SELECT v.*, coalesce(k.children, 0) AS children FROM v LEFT JOIN (SELECT parent, depth - 1 AS depth, count(*) AS children FROM p GROUP BY ALL) k ON k.parent = v.conv_id AND k.depth = v.depth),
sub AS (SELECT a.path, a.depth, count(*) FILTER (l.children = 0) AS n_leaves, sum((l.n_convs - 1) * l.n) AS saved FROM l JOIN a ON a.conv_id = l.conv_id AND a.depth <= l.depth GROUP BY a.path, a.depth)
SELECT l.conv_id, l.depth, p.parent AS parent_conv_id, n_convs, children AS n_children, n_leaves, saved::BIGINT AS saved_tokens, ends_sha256
FROM l JOIN sub ON sub.path = l.path AND sub.depth = l.depth LEFT JOIN p ON p.conv_id = l.conv_id AND p.depth = l.depth"""
