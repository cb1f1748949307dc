"""Wavelet compression: transforms, pruning, and a graph of shared subtrees."""
import heapq
from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import haar as h
from ..functions.series import lists, matrix, transformed
from ..model import check_length
from ..plans.scratch import materialized
from ..sources.ngrams import numbered
from . import knn, merge, metrics

CHUNK_ROWS = 16_384  # series that one task merges by default, about
CHUNK_BITS = 40  # a node's id is its chunk shifted by these, and its number there


def _mapped(series: DataFrame, function) -> DataFrame:
    def run(parts):
        for batch in parts:
            at = batch.schema.get_field_index("series")
            rows = matrix(batch.column(at)).astype(np.float64)
            yield batch.set_column(at, "series", lists(function(rows)) if len(rows) else batch.column(at))

    out = series.withColumn("series", F.col("series").cast("array<double>"))
    return out.mapInArrow(run, out.schema)


def haar(series: DataFrame) -> DataFrame:
    """series as Haar coefficients (see functions.haar)."""
    return _mapped(series, h.haar)


def inverse_haar(series: DataFrame) -> DataFrame:
    return _mapped(series, h.inverse)


def haar_long(series: DataFrame, length: int) -> DataFrame:
    """id, level, pos, x: the scaled coefficients as rows, in the JVM: every value adds to or subtracts
    from one block per level."""
    check_length(length)
    d = h.levels(length)
    values = series.select("id", F.posexplode("series").alias("y", "v"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("level")
    rows = values.select("id", "y", "v", levels)
    bit = F.expr(f"shiftright(y, {d - 1} - level) & 1")
    return rows.groupBy("id", "level", F.expr(f"shiftright(y, {d} - level)").alias("pos")).agg(F.sum(F.when(bit == 0, F.col("v")).otherwise(-F.col("v"))).alias("x"))


def prune(series: DataFrame, threshold: float, by: str = "signed", seed: int = 0) -> DataFrame:
    """id, series (restored after pruning), kept (details that are not 0, to nine digits), error (largest squared relative
    error of log10(1 + value)). The budget is threshold times the sum of log10(1 + value)."""
    if by not in ("signed", "abs"):
        raise ValueError("by is signed or abs")

    def run(parts):
        import pyarrow as pa

        for batch in parts:
            rows = np.log10(1 + matrix(batch.column(1)).astype(np.float64))
            if not len(rows):
                continue
            total = rows.sum(axis=1)
            cut = np.array([h.pruned(c, threshold * t, by, seed, i) for c, t, i in zip(h.haar(rows), total, batch.column(0).to_pylist())])
            back = h.inverse(cut)
            error = (((rows - back) / np.where(total == 0, 1, total)[:, None]) ** 2).max(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(10**back - 1), pa.array((np.abs(cut[:, 1:]) > h.TINY).sum(axis=1).astype(np.int32)), pa.array(error)], names=["id", "series", "kept", "error"])

    return series.select("id", F.col("series").cast("array<double>")).mapInArrow(run, "id long, series array<double>, kept int, error double")


def pruning_report(series: DataFrame, length: int, thresholds: Sequence[float], by: str = "signed", seed: int = 0) -> DataFrame:
    """threshold, level, n (series), kept (details that are not 0), share (of all of the level), mean_error, max_error (of the
    threshold): what prune() leaves at each threshold, as a frame to draw. Series (id, series) go through Python once; each is
    transformed once, and leaves a row of counts per threshold, which the JVM sums. Null series are left out; without
    series there are no rows."""
    check_length(length)
    if by not in ("signed", "abs"):
        raise ValueError("by is signed or abs")
    depth, steps = h.levels(length), sorted(set(map(float, thresholds)))

    def run(parts):
        import pyarrow as pa

        for batch in parts:
            rows = np.log10(1 + matrix(batch.column(1)).astype(np.float64))
            if not len(rows):
                continue
            ids, total, coefficients = batch.column(0).to_pylist(), rows.sum(axis=1), h.haar(rows)
            for t in steps:
                cut = np.array([h.pruned(c, t * s, by, seed, i) for c, s, i in zip(coefficients, total, ids)])
                error = (((rows - h.inverse(cut)) / np.where(total == 0, 1, total)[:, None]) ** 2).max(axis=1)
                kept = np.stack([(np.abs(cut[:, 1 << k : 2 << k]) > h.TINY).sum(axis=1) for k in range(depth)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t)), lists(kept.astype(np.float64)), pa.array(error)], names=["threshold", "kept", "error"])

    found = series.filter("series IS NOT NULL").select("id", F.col("series").cast("array<double>")).mapInArrow(run, "threshold double, kept array<double>, error double")
    levels = found.select("threshold", "error", F.posexplode("kept").alias("level", "k"))
    sums = levels.groupBy("threshold", "level").agg(F.count("*").alias("n"), F.sum("k").cast("long").alias("kept"), F.avg("error").alias("mean_error"), F.max("error").alias("max_error"))
    share = F.col("kept") / (F.col("n") * F.pow(F.lit(2.0), F.col("level")))
    return sums.select("threshold", "level", "n", "kept", share.alias("share"), "mean_error", "max_error")


#: How the absolute differences of a series' values are one error: the largest, their mean (e1), the mean of
#: their squares (e2), the largest less the smallest (e3).
METRICS = {"largest": lambda d: float(d.max()), "mean": lambda d: float(d.mean()), "mean_square": lambda d: float((d * d).mean()), "range": lambda d: float(d.max() - d.min())}


class Merger:
    """Merges the coefficient trees of one series after another into a graph of shared nodes.

    A node holds a scaled coefficient (as a half float) and its two children. It can take the place of
    another node of the same level with the same children (on the finest level: of the same position).
    Per series the nodes with the smallest estimated growth of the error are replaced first, while the error
    stays under max_error; then their parents may be. metric: how the differences of a series' values are
    one error (see METRICS). seed: leaves with equal growth are tried in a seeded order, another per series;
    None: from left to right."""

    def __init__(self, length: int, max_error: float, metric: str = "largest", seed: int | None = None):
        self.length, self.depth, self.max_error = length, h.levels(length), max_error
        self.metric, self.seed = METRICS[metric], seed
        self.buckets: dict[tuple, list[tuple[float, int]]] = {}
        self.nodes: list[tuple[int, int, float, int, int]] = []  # level, pos, x, children (-1: none)
        self.roots: list[tuple[int, int, float, float, int]] = []  # series, node, approximation, error, nodes so far

    def nearest(self, key: tuple, x: float) -> tuple[float, int] | None:
        """(distance, node); of equally near ones the lower."""
        bucket = self.buckets.get(key)
        if not bucket:
            return None
        at = bisect_left(bucket, (x, -1))
        near = [bucket[i] for i in (at - 1, at) if 0 <= i < len(bucket)]
        value, node = min(near, key=lambda t: abs(t[0] - x))  # the first, lower one of equals
        return abs(value - x), node

    def nearest_many(self, key: tuple, x: float, max_dist: float, size: int) -> list[tuple[float, int]]:
        """Up to size (distance, node) within max_dist, the nearest first; of equally near ones the lower."""
        bucket = self.buckets.get(key, [])
        up = bisect_left(bucket, (x, -1))
        down, out = up - 1, []
        while len(out) < size and (up < len(bucket) or down >= 0):
            above = bucket[up][0] - x if up < len(bucket) else np.inf
            below = x - bucket[down][0] if down >= 0 else np.inf
            if min(above, below) > max_dist:
                break
            out.append((float(min(above, below)), bucket[up if above < below else down][1]))
            up, down = (up + 1, down) if above < below else (up, down - 1)
        return out

    def add(self, i: int, values: np.ndarray) -> None:
        depth, length = self.depth, self.length
        row = values[None, :]
        x = [np.float16(level[0]).astype(np.float64) for level in h.scaled(row)]
        approximation = float(np.float16(values.sum() / np.sqrt(length)))
        linked: list[list[int | None]] = [[None] * len(level) for level in x]

        def exact() -> np.ndarray:
            return np.abs(h.from_scaled(np.array([approximation * np.sqrt(length)]), [level[None, :] for level in x], length)[0] - values)

        delta, rough = exact(), False
        error = self.metric(delta)
        order = np.arange(length) if self.seed is None else np.random.default_rng([self.seed, len(self.roots)]).permutation(length)
        queue: list[tuple[float, int, int, int, float, int]] = []

        def key(level: int, at: int) -> tuple:
            return (at,) if level == depth - 1 else (level, linked[level + 1][2 * at], linked[level + 1][2 * at + 1])

        def grown(level: int, at: int, distance: float) -> float:
            block = length >> level
            if self.metric is METRICS["largest"]:
                return max(error, float(delta[block * at : block * (at + 1)].max()) + distance / block)
            more = delta.copy()
            more[block * at : block * (at + 1)] += distance / block
            return self.metric(more)

        def offer(level: int, at: int) -> None:
            if (found := self.nearest(key(level, at), float(x[level][at]))) is not None:
                heapq.heappush(queue, (grown(level, at, found[0]) - error, level, int(order[at]), at, *found))

        for at in range(length // 2):
            offer(depth - 1, at)
        while queue:
            _, level, _, at, distance, node = heapq.heappop(queue)
            if linked[level][at] is not None:
                continue
            if not grown(level, at, distance) < self.max_error:
                if not rough:
                    continue
                delta, rough = exact(), False
                error = self.metric(delta)
                if not grown(level, at, distance) < self.max_error:
                    continue
            block = length >> level
            error = grown(level, at, distance)
            delta[block * at : block * (at + 1)] += distance / block
            rough = True
            x[level][at] = self.nodes[node][2]
            linked[level][at] = node
            if level and linked[level][at ^ 1] is not None:
                offer(level - 1, at // 2)
        for level in reversed(range(depth)):
            for at in range(1 << level):
                if linked[level][at] is None:
                    children = (-1, -1) if level == depth - 1 else (linked[level + 1][2 * at], linked[level + 1][2 * at + 1])
                    linked[level][at] = node = len(self.nodes)
                    self.nodes.append((level, at, float(x[level][at]), *children))
                    insort(self.buckets.setdefault(key(level, at), []), (float(x[level][at]), node))
        self.roots.append((i, linked[0][0], approximation, self.metric(exact()), len(self.nodes)))


def build_dag(series: DataFrame, length: int, max_error: float, chunks: int | None = None, seed: int = 0, metric: str = "largest", shuffle_leaves: bool = False) -> tuple[DataFrame, DataFrame]:
    """nodes (node_id, level, pos, x, c0, c1) and roots (i, root_id, approx, error, nodes_so_far: of its chunk).

    Merging is sequential, so series are dealt to chunks by a hash of their ids, each merged by one task
    in a seeded order that keeps blocks of 16 neighbouring ids together. One chunk shares most; more
    share less and run in parallel. By default a chunk has about CHUNK_ROWS series, so no task grows with the
    table. Ids of nodes hold their chunk."""
    check_length(length)
    if metric not in METRICS:
        raise ValueError(f"metric is one of {sorted(METRICS)}")
    if chunks is None:
        chunks = max(1, -(-series.count() // CHUNK_ROWS))
    if chunks < 1:
        raise ValueError("there is one chunk at least")
    schema = "node_id long, level int, pos int, x double, c0 long, c1 long, i long, root_id long, approx double, error double, nodes_so_far long"
    keyed = series.select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(chunks)).alias("chunk"), F.xxhash64(F.floor(F.col("id") / 16), F.lit(seed)).alias("block"), "id", F.col("series").cast("array<double>"))

    def run(table):
        import pyarrow as pa

        table = table.sort_by([("block", "ascending"), ("id", "ascending")])
        base = (table.column("chunk")[0].as_py() if len(table) else 0) << CHUNK_BITS
        merger = Merger(length, max_error, metric, seed if shuffle_leaves else None)
        rows = matrix(table.column("series").combine_chunks()) if len(table) else []
        for i, values in zip(table.column("id").to_pylist(), rows):
            merger.add(i, values)
        n, m = len(merger.nodes), len(merger.roots)
        node = lambda v: None if v < 0 else base + v
        cols = [[base + k for k in range(n)], [r[0] for r in merger.nodes], [r[1] for r in merger.nodes], [r[2] for r in merger.nodes], [node(r[3]) for r in merger.nodes], [node(r[4]) for r in merger.nodes]]
        more = [[r[0] for r in merger.roots], [base + r[1] for r in merger.roots], [r[2] for r in merger.roots], [r[3] for r in merger.roots], [r[4] for r in merger.roots]]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        columns = [c + [None] * m for c in cols] + [[None] * n + c for c in more]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["node_id", "level", "pos", "x", "c0", "c1", "i", "root_id", "approx", "error", "nodes_so_far"])

    both = materialized(keyed.groupBy("chunk").applyInArrow(run, schema), "dag")
    return both.filter("node_id IS NOT NULL").select("node_id", "level", "pos", "x", "c0", "c1"), both.filter("i IS NOT NULL").select("i", "root_id", "approx", "error", "nodes_so_far")


def shared_dag(series: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """build_dag without error: subtrees become one node if they are at the same place and equal, and so with
    equal children and coefficients. Nothing is sequential here: a subtree is known by the steps between the
    values of its block (by their 128-bit hash), so equal ones meet in one distinct, in the JVM."""
    check_length(length)
    d = h.levels(length)
    s = F.col("series").cast("array<double>")
    steps = F.zip_with(F.slice(s, 2, length - 1), F.slice(s, 1, length - 1), lambda a, b: a - b + F.lit(0.0))
    rows = series.select("id", s.alias("series"), steps.alias("steps"))

    def key(level: int, pos: Column) -> Column:
        block = length >> level
        return F.concat_ws(":", F.lit(level), pos, F.md5(F.to_json(F.slice("steps", pos * block + 1, F.lit(block - 1)))))

    trees = None
    for level in range(d):
        block = length >> level
        at = rows.select("id", "series", "steps", F.explode(F.sequence(F.lit(0), F.lit((1 << level) - 1))).alias("pos"))
        half = lambda k: F.aggregate(F.slice("series", F.col("pos") * block + 1 + k * (block // 2), F.lit(block // 2)), F.lit(0.0), lambda t, v: t + v)  # noqa: E731, B023
        child = lambda k: key(level + 1, 2 * F.col("pos") + k) if level < d - 1 else F.lit(None).cast("string")  # noqa: E731, B023
        now = at.select("id", F.lit(level).alias("level"), "pos", key(level, F.col("pos")).alias("key"), (half(0) - half(1)).alias("x"), child(0).alias("k0"), child(1).alias("k1"))
        trees = now if trees is None else trees.unionByName(now)
    trees = materialized(trees, "subtrees")
    unique = materialized(trees.groupBy("key").agg(F.min("level").alias("level"), F.min("pos").alias("pos"), F.min("x").alias("x"), F.min("k0").alias("k0"), F.min("k1").alias("k1")), "nodes")
    ids = materialized(numbered(unique.select(F.col("key").alias("ngram"))).withColumnsRenamed({"id": "node_id", "ngram": "key"}), "node-ids")
    of = lambda name, key: ids.select(F.col("node_id").alias(name), F.col("key").alias(key))
    nodes = unique.join(ids, "key").join(of("c0", "k0"), "k0", "left").join(of("c1", "k1"), "k1", "left").select("node_id", "level", "pos", "x", "c0", "c1")
    roots = trees.filter("level = 0").select("id", "key").join(ids, "key").join(rows.select("id", (F.aggregate("series", F.lit(0.0), lambda t, v: t + v) / float(length) ** 0.5).alias("approx")), "id")
    return materialized(nodes, "shared-nodes"), materialized(roots.select(F.col("id").alias("i"), F.col("node_id").alias("root_id"), "approx", F.lit(0.0).alias("error")), "shared-roots")


def reconstruct(nodes: DataFrame, roots: DataFrame, length: int) -> DataFrame:
    """id, series of every root, restored level by level (see merge.restored)."""
    return merge.restored(nodes, roots, length)


def dag_levels(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """level, nodes, ratio: nodes kept per level against those of the trees before merging."""
    n = roots.agg(F.count("*").alias("n"))
    return nodes.groupBy("level").agg(F.count("*").alias("nodes")).join(F.broadcast(n)).select("level", "nodes", (F.col("nodes") / (F.col("n") * F.pow(F.lit(2.0), F.col("level")))).alias("ratio"))


def compression_rate(nodes: DataFrame, roots: DataFrame, length: int, node_bytes: int = 14, root_bytes: int = 20) -> float:
    """Bytes of the graph over those of the series as doubles."""
    n = roots.count()
    return (nodes.count() * node_bytes + n * root_bytes) / (n * length * 8) if n else 0.0


def node_growth(roots: DataFrame) -> DataFrame:
    """chunk, step (from 1), nodes, grown: how many nodes a chunk has after each series, and how many of them
    the series brought."""
    chunk = F.shiftright("root_id", CHUNK_BITS).alias("chunk")
    # a series that shares its whole tree brings none: such series stand together, in any order
    order = Window.partitionBy("chunk").orderBy("nodes_so_far", "i")
    rows = roots.select(chunk, "i", "nodes_so_far")
    return rows.select("chunk", F.row_number().over(order).alias("step"), F.col("nodes_so_far").alias("nodes"), (F.col("nodes_so_far") - F.coalesce(F.lag("nodes_so_far").over(order), F.lit(0))).alias("grown"))


def nearest_join(left: DataFrame, right: DataFrame, max_dist: float, size: int) -> DataFrame:
    """id, other, dist, rank: for each row of left (id, bucket, x) the up to size rows of right (id, bucket, x)
    of the same bucket whose x is nearest, at most max_dist away; of equally near ones the lower x, then
    the smaller id.

    Values meet in strips a little wider than max_dist: a row of left lies in one, a row of right in three. There right's values
    stand in order, each with those next to it, and a row of left takes them from the value before it. So rows grow with
    left and right and not with pairs, and a bucket is as many keys as it has strips. Values so near each other
    that their rounded distances to a row are equal can hide one; such rows are joined with their strip."""
    if not 0 < max_dist < float("inf") or size < 1:
        raise ValueError("max_dist is positive and finite, and size at least 1")
    strip, x, y = F.floor(F.col("x") / (max_dist * 1.001)), F.col("x"), F.col("y")
    finite = "bucket IS NOT NULL AND abs(x) < double('infinity')"
    a = left.filter(finite).select("id", "bucket", (x + F.lit(0.0)).alias("x"), strip.alias("strip"))
    b = right.filter(finite).select(F.col("id").alias("other"), "bucket", (x + F.lit(0.0)).alias("y"))
    few = b.withColumn("place", F.row_number().over(Window.partitionBy("bucket", "y").orderBy("other"))).filter(F.col("place") <= size)
    values = few.groupBy("bucket", "y").agg(F.sort_array(F.collect_list(F.struct("other"))).alias("others"))
    values = values.withColumn("strip", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(y / (max_dist * 1.001)) + k)))
    order = Window.partitionBy("bucket", "strip").orderBy("y")
    values = values.withColumns({"near": F.collect_list(F.struct("y", "others")).over(order.rowsBetween(-size, size)), "first": F.row_number().over(order) == 1})
    # the first value of a strip also stands before all rows of left
    values = values.select("bucket", "strip", "near", F.explode(F.when(F.col("first"), F.array(F.lit(float("-inf")), y)).otherwise(F.array(y))).alias("x"))
    rows = a.withColumn("asks", F.lit(True)).unionByName(values.withColumn("asks", F.lit(False)), allowMissingColumns=True)
    before = Window.partitionBy("bucket", "strip").orderBy("x", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("near", F.last("near", ignorenulls=True).over(before)).filter(F.col("asks") & F.col("near").isNotNull())
    distance = lambda v: F.abs(x - v["y"])
    found = F.flatten(F.transform("near", lambda v: F.transform(v["others"], lambda o: F.struct(distance(v).alias("dist"), v["y"].alias("y"), o["other"].alias("other")))))
    rows = rows.withColumn("found", F.slice(F.array_sort(F.filter(found, lambda v: v["dist"] <= max_dist)), 1, size))
    hidden = (F.size(F.filter("near", lambda v: v["y"] <= x)) > size) & (F.size("found") == size) & (distance(F.get("near", F.lit(0))) == F.get("found", F.lit(size - 1))["dist"])
    rows = materialized(rows.select("id", "bucket", "x", "strip", "found", hidden.alias("hidden")), "nearest")
    near = rows.filter("NOT hidden").select("id", F.explode("found").alias("v")).select("id", "v.other", "v.dist", "v.y")
    if not rows.filter("hidden").isEmpty():
        there = values.select("bucket", "strip", F.explode("near").alias("v")).select("bucket", "strip", "v.y", F.explode("v.others").alias("o")).select("bucket", "strip", "y", "o.other").distinct()
        joined = rows.filter("hidden").select("id", "bucket", "x", "strip").join(there, ["bucket", "strip"]).withColumn("dist", F.abs(x - y))
        near = near.unionByName(joined.filter(F.col("dist") <= max_dist).select("id", "other", "dist", "y"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("dist", "y", "other")) - 1
    return near.withColumn("rank", rank).filter(F.col("rank") < size).select("id", "other", "dist", "rank")


def compression_round_trip(series: DataFrame, length: int, max_error: float, ngram: str, r: int, limit: int = 20, transform: str = "gradient_smooth1", chunks: int | None = None) -> dict:
    """What compressing does to a query: the series are compressed and restored, both are transformed, and
    distances to one n-gram compared. levels (of the graph), rate, changes (a summary of relative changes)
    and ranks (rank_similarity and so on), the last three as values."""
    nodes, roots = build_dag(series.select("id", "series"), length, max_error, chunks)
    back = reconstruct(nodes, roots, length)
    restored = series.select("id", "ngram").join(back, "id")
    a, b = (materialized(transformed(rows.select("id", "ngram", "series"), transform), "round-trip") for rows in (series, restored))
    changes = metrics.summary(metrics.relative_changes(*(knn.dtw_distances(rows, ngram, r) for rows in (a, b)))).first().asDict()
    ranks = metrics.rank_changes(*(knn.knn_dtw(rows, [ngram], r, limit) for rows in (a, b)), limit).first().asDict()
    return {"levels": dag_levels(nodes, roots), "rate": compression_rate(nodes, roots, length), "changes": changes, "ranks": ranks}
