"""The graph of merged subtrees over a whole table: level by level from the finest, as joins and aggregates."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import haar as h
from ..model import check_length
from ..plans.scratch import materialized

STEP = 0.5  # a cell of coefficients that may share a node is as wide as half the error bound allows


def coefficients(series: DataFrame, length: int) -> DataFrame:
    """id, total, x0, x1, ...: the sum of each series and, per level, the array of its scaled coefficients (left half less
    right half of each block). Sums of halves are added up from the finest blocks on, in the JVM, without a shuffle."""
    depth = h.levels(length)
    rows = series.select("id", F.col("series").cast("array<double>").alias("s"))
    pair = lambda sums, level, sign: F.transform(F.sequence(F.lit(0), F.lit((1 << level) - 1)), lambda j: F.get(sums, 2 * j) + sign * F.get(sums, 2 * j + 1))
    for level in reversed(range(depth)):
        rows = rows.select("id", *(f"x{k}" for k in range(level + 1, depth)), pair(F.col("s"), level, -1).alias(f"x{level}"), pair(F.col("s"), level, 1).alias("s"))
    return rows.withColumn("total", F.get("s", 0)).drop("s")


def merged_dag(series: DataFrame, length: int, max_error: float, step: float = STEP) -> tuple[DataFrame, DataFrame]:
    """nodes (node_id, level, pos, x, c0, c1) and roots (i, root_id, approx, error) of one graph for all series (id, series).

    From the finest level up, the nodes of all series with the same two children (on the finest level: of the same position) and
    coefficients in the same cell can share one node, that with the cell's smallest coefficient. A series carries, per block, the
    error that it has taken on so far; it takes a shared node if that stays within max_error, and else keeps its own coefficient,
    which it shares only with equal ones. So no value of a restored series is off by more than its root's error, and
    that never exceeds max_error. A cell is step * max_error * (values of the block) wide: a smaller step leaves more for the
    coarser levels. With max_error 0, equal subtrees are shared.

    Nothing depends on the order of series: a node's id is the smallest place (id * 2 * length + place in the tree) that has it, so ids lie
    in [0, 2**62 / length). A series with null id or series is left out; of rows that repeat an id the tree is undefined, as ids are keys. An empty table
    gives empty tables.

    Each level is three shuffles of the rows of its blocks, two of them with sums made in each task first; all tables that join
    them are written before, so that adaptive execution broadcasts small ones and splits skewed keys (all-zero blocks). The finest level has half
    of all rows, each coarser one half of the one before."""
    check_length(length)
    if not max_error >= 0 or not 0 < step <= 1:
        raise ValueError("max_error >= 0 and 0 < step <= 1 must hold")
    depth = h.levels(length)
    rows = materialized(coefficients(series.filter("id IS NOT NULL AND series IS NOT NULL"), length), "merge-coefficients")
    nodes, state = None, None
    for level in reversed(range(depth)):
        now = materialized(_with_children(rows, state, level, depth), f"merge-{level}")
        valued = _valued(now, max_error, length >> level, step)
        place = F.col("id") * (2 * length) + (1 << level) + F.col("pos")
        ids = materialized(valued.groupBy("c0", "c1", "v").agg(F.min(place).alias("node_id")), f"merge-ids-{level}")
        state = valued.join(ids, ["c0", "c1", "v"]).select("id", "pos", "node_id", "error")
        child = lambda c: F.when(F.col(c) >= 0, F.col(c)).alias(c)
        pos = (F.col("node_id") % (2 * length) - (1 << level)).cast("int").alias("pos")
        here = ids.select("node_id", F.lit(level).alias("level"), pos, F.col("v").alias("x"), child("c0"), child("c1"))
        nodes = here if nodes is None else nodes.unionByName(here)
    roots = state.join(rows.select("id", "total"), "id")
    roots = roots.select(F.col("id").alias("i"), F.col("node_id").alias("root_id"), (F.col("total") / float(length) ** 0.5).alias("approx"), "error")
    return nodes, materialized(roots, "merge-roots")


def _with_children(rows: DataFrame, state: DataFrame | None, level: int, depth: int) -> DataFrame:
    """id, pos, x, c0, c1, error of a level's blocks: the nodes of their halves, and the larger error. Coefficients and
    halves meet in one grouping. On the finest level the position stands in for children, as a negative number."""
    own = rows.select("id", F.posexplode(f"x{level}").alias("pos", "x"))
    if state is None:
        key = (-1 - F.col("pos")).cast("long")
        return own.select("id", "pos", "x", key.alias("c0"), key.alias("c1"), F.lit(0.0).alias("error"))
    half = lambda k: F.when(F.col("pos") % 2 == k, F.col("node_id"))
    kids = state.select("id", F.shiftright("pos", 1).alias("pos"), F.lit(None).cast("double").alias("x"), half(0).alias("c0"), half(1).alias("c1"), "error")
    none = F.lit(None).cast("long")
    both = own.select("id", "pos", "x", none.alias("c0"), none.alias("c1"), F.lit(0.0).alias("error")).unionByName(kids)
    return both.groupBy("id", "pos").agg(*(F.max(c).alias(c) for c in ("x", "c0", "c1", "error")))


def _valued(now: DataFrame, max_error: float, block: int, step: float) -> DataFrame:
    """now with v, the coefficient of the node that a block takes, and the error after that."""
    width = step * max_error * block
    plain = F.col("x") + F.lit(0.0)  # no -0.0, which groups would tell from 0.0
    if not width:
        return now.select("id", "pos", "c0", "c1", plain.alias("v"), "error")
    cell = F.floor(plain / width).alias("cell")
    least = materialized(now.groupBy("c0", "c1", cell).agg(F.min(plain).alias("low")), "merge-cells")
    near = now.withColumn("cell", F.floor(plain / width)).join(least, ["c0", "c1", "cell"])
    more = F.col("error") + F.abs(F.col("x") - F.col("low")) / block
    return near.select("id", "pos", "c0", "c1", F.when(more <= max_error, F.col("low")).otherwise(plain).alias("v"), F.when(more <= max_error, more).otherwise(F.col("error")).alias("error"))


def restored(nodes: DataFrame, roots: DataFrame, length: int, only: DataFrame | None = None) -> DataFrame:
    """id, series of every root, or of those that `only` (i) names, with as little work as the graph has nodes.

    From the finest level up, each node gets the values of its block around their mean: those of its halves, moved by its share of
    the coefficient. A node that many trees use is restored once. A root adds its mean. Each level is two joins of nodes with
    those of the level below, on unique ids; values never meet in a group. Of `only` some trees, nodes are first
    followed down from their roots, so others are not restored."""
    check_length(length)
    depth = h.levels(length)
    if only is not None:
        roots = roots.join(only.select("i").distinct(), "i", "left_semi")
        nodes = _reached(nodes, roots, depth)
    below: DataFrame | None = None
    for level in reversed(range(depth)):
        share = F.col("x") / (length >> level)
        here = nodes.filter(F.col("level") == level)
        if below is None:
            values = here.select("node_id", F.array(share, -share).alias("around"))
        else:
            side = lambda c: below.select(F.col("node_id").alias(c), F.col("around").alias(f"{c}_around"))  # noqa: E731, B023
            moved = lambda c, by: F.transform(f"{c}_around", lambda v: v + by)
            values = here.select("node_id", "c0", "c1", "x").join(side("c0"), "c0").join(side("c1"), "c1")
            values = values.select("node_id", F.concat(moved("c0", share), moved("c1", -share)).alias("around"))
        below = materialized(values, f"restored-{level}")
    mean = F.col("approx") / float(length) ** 0.5
    out = roots.join(below.select(F.col("node_id").alias("root_id"), "around"), "root_id")
    return out.select(F.col("i").alias("id"), F.transform("around", lambda v: v + mean).alias("series"))


def _reached(nodes: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    now = roots.select(F.col("root_id").alias("node_id")).distinct()
    found = None
    for level in range(depth):
        here = materialized(nodes.filter(F.col("level") == level).join(now, "node_id", "left_semi"), "restored-path")
        found = here if found is None else found.unionByName(here)
        now = here.select(F.explode(F.array("c0", "c1")).alias("node_id")).filter("node_id IS NOT NULL").distinct()
    return found

