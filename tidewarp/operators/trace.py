"""Tracing: similar series by the nodes that they share in the graph of subtrees."""
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import check_range, series_of
from .knn import ranked, squared_sums


def start_nodes(nodes: DataFrame, root: int, depth: int, maxdepth: int, begin: int, end: int, keep: Callable[[int, DataFrame], DataFrame] | None = None) -> dict[int, list[int]]:
    """The nodes of a tree by level down to maxdepth whose spans overlap [begin, end); the root always is
    one. They are fewer than the series has values."""
    length = 1 << depth
    out, now = {0: [root]}, [(root, 0)]
    for level in range(1, min(maxdepth, depth - 1) + 1):
        wanted = dict(now)
        width = length >> level
        found = nodes.filter(F.col("node_id").isin(list(wanted))).select("node_id", "c0", "c1").collect()
        children = [(c, 2 * wanted[r.node_id] + k) for r in found for k, c in enumerate((r.c0, r.c1)) if c is not None]
        now = [(c, j) for c, j in children if end > width * j and begin < width * (j + 1)]
        if keep and now:
            kept = keep(level, nodes.sparkSession.createDataFrame(now, "node_id long, pos int"))
            now = [(r.node_id, r.pos) for r in kept.select("node_id", "pos").collect()]
        if not now:
            break
        out[level] = [c for c, _ in now]
    return out


@dataclass
class Hooks:
    """What a caller adds to a trace. keep_down(level, rows): which of the query's nodes (node_id, pos) a
    walk may start from and go on below. up(level, rows): the rows (start, node, w) that have come up to a
    level, filtered or changed. found(rows): the series found (start, i, weight). Each takes and returns a
    DataFrame, and is part of the plan."""

    keep_down: Callable[[int, DataFrame], DataFrame] | None = None
    up: Callable[[int, DataFrame], DataFrame] | None = None
    found: Callable[[DataFrame], DataFrame] | None = None


def trace(nodes: DataFrame, roots: DataFrame, i: int, length: int, maxdepth: int, begin: int = 0, end: int | None = None, minweight: float = 0.0, combine: str = "product", hooks: Hooks | None = None) -> DataFrame:
    """start (level), i, weight: series that share nodes with series i. From the nodes of each level a walk
    goes up to the roots; a node's weight is dealt evenly to its parents, and weights that meet in a node
    multiply (or add, with combine="sum"). Nodes of less than minweight are left. hooks: see Hooks.

    The walks of all levels go up together, a join with the parents per level; filters come before the
    joins. Nothing is collected but the query's own nodes."""
    check = {"product": F.product, "sum": F.sum}[combine]
    end = length if end is None else end
    check_range(begin, end, length, 0)
    depth = length.bit_length() - 1
    if not 0 <= maxdepth <= depth or minweight < 0:
        raise ValueError(f"0 <= maxdepth <= {depth} and minweight >= 0 must hold, not {maxdepth}, {minweight}")
    hooks = hooks or Hooks()
    own = roots.filter(F.col("i") == i).select("root_id").first()
    if own is None:
        raise KeyError(f"series {i} has no root")
    starts = start_nodes(nodes, own.root_id, depth, maxdepth, begin, end, hooks.keep_down)
    edges = nodes.select(F.explode(F.array("c0", "c1")).alias("node"), F.col("node_id").alias("parent"), "level").filter("node IS NOT NULL")
    edges = edges.join(edges.groupBy("node").agg(F.count("*").alias("n")), "node")
    spark = nodes.sparkSession
    now = spark.createDataFrame([], "start int, node long, w double")
    for level in range(max(starts), -1, -1):
        own_level = spark.createDataFrame([(level, n, 1.0) for n in starts.get(level, [])], "start int, node long, w double")
        now = now.unionByName(own_level).filter(F.col("w") >= minweight)
        if level:
            up = now.join(edges.filter(F.col("level") == level - 1), "node").select("start", F.col("parent").alias("node"), (F.col("w") / F.col("n")).alias("w"))
            now = up.groupBy("start", "node").agg(check("w").alias("w"))
            now = hooks.up(level - 1, now) if hooks.up else now
    out = now.join(roots.select("i", F.col("root_id").alias("node")), "node").select("start", "i", F.col("w").alias("weight"))
    return hooks.found(out) if hooks.found else out


def traceback(found: DataFrame, dictionary: DataFrame, limit: int = 20) -> DataFrame:
    """start (level; null: all levels together), rank, ngram, id, weight: the best of each level and in
    all, by the sum of weights. Each task passes on only its own best of each."""
    sums = found.groupBy("start", "i").agg(F.sum("weight").alias("weight"))
    sums = sums.unionByName(sums.groupBy("i").agg(F.sum("weight").alias("weight")).withColumn("start", F.lit(None).cast("int")))
    place = F.row_number().over(Window.partitionBy("start").orderBy(F.col("weight").desc(), "i"))
    best = sums.withColumn("place", place).filter(F.col("place") <= limit).withColumn("rank", F.col("place") - 1)
    return best.join(dictionary.select(F.col("id").alias("i"), "ngram"), "i").select("start", "rank", "ngram", F.col("i").alias("id"), "weight")


def knn_dtw_candidates(series: DataFrame, nodes: DataFrame, roots: DataFrame, ngram: str, r: int, limit: int, maxdepth: int, begin: int = 0, end: int | None = None, minweight: float = 0.0) -> DataFrame:
    """knn_dtw among the series that trace() finds."""
    i, query = series_of(series, [ngram])[ngram]
    end = len(query) if end is None else end
    ids = trace(nodes, roots, i, len(query), maxdepth, begin, end, minweight).select(F.col("i").alias("id")).distinct()
    some = series.select("id", "ngram", "series").join(ids, "id", "left_semi")
    return ranked(squared_sums(some, [query], r, begin, end), limit, end - begin)
