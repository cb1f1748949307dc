"""Similarity graphs, and the graph of subtrees as frames and drawings."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import series_of
from ..plans.scratch import materialized
from . import many

AHEAD = 4  # known series whose neighbours one pass finds


def similarity_graph(series: DataFrame, ngram: str, r: int, limit: int, howmany: int, begin: int = 0, end: int | None = None, ahead: int = AHEAD) -> tuple[DataFrame, DataFrame]:
    """edges (a > b, dist) and vertices (id, ngram). From one series on, the known one that is nearest to
    those expanded is expanded: its limit nearest series (itself among them) become known, at their
    distances over that of the nearest other one; howmany are expanded. The first distance of an edge
    stays. If the nearest other series is identical, distances over 0 count as infinite, and 0 over 0 as 0.

    One pass over all series finds the neighbours of the `ahead` known series that are nearest at the time; then series are
    expanded in their order for as long as their neighbours are at hand, so edges do not hang on `ahead`. The walk
    itself is over howmany * limit rows at most, which the caller states."""
    start = series_of(series, [ngram])[ngram][0]
    backlog: dict[int, float] = {start: 0.0}
    done: set[int] = set()
    edges: dict[tuple[int, int], float] = {}
    near: dict[int, list[tuple[int, float]]] = {}
    while backlog and len(done) < howmany:
        order = sorted(backlog, key=lambda k: (backlog[k], k))
        i = order[0]
        if i not in near:
            wanted = [k for k in order if k not in near][: max(1, min(ahead, howmany - len(done)))]
            queries = series.filter(F.col("id").isin(wanted)).select("id", "series")
            near.update({k: [] for k in wanted})
            for row in many.knn_many(series.select("id", "ngram", "series"), queries, r, max(2, limit), begin, end).orderBy("query", "rank").collect():
                near[row.query].append((row.id, row.distance))
        unit = near[i][1][1] if len(near[i]) > 1 else 0.0
        del backlog[i]
        done.add(i)
        for j, d in near.pop(i)[:limit]:
            dist = d / unit if unit else (float("inf") if d else 0.0)
            edges.setdefault((max(i, j), min(i, j)), dist)
            if j not in done:
                backlog[j] = min(dist, backlog.get(j, dist))
    spark = series.sparkSession
    frame = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a long, b long, dist double")
    seen = spark.createDataFrame([(v,) for v in sorted(done | set(backlog))], "id long")
    return frame, series.select("id", "ngram").join(F.broadcast(seen), "id")


def graph_dot(edges: DataFrame, vertices: DataFrame) -> str:
    """An undirected DOT graph without self-loops. Rows come to the driver: it is a drawing."""
    names = [f"  n{v.id} [label={quoted(v.ngram)}];" for v in vertices.orderBy("id").collect()]
    links = [f"  n{e.a} -- n{e.b} [weight={e.dist:.6g}];" for e in edges.filter("a <> b").orderBy("a", "b").collect()]
    return "\n".join(["graph similar {", *names, *links, "}"])


def quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def dag_frames(nodes: DataFrame, roots: DataFrame, ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """used (node_id, level, pos, x, scaled_x, uses) and links (parent, child, side): the nodes of some
    series' trees, how many of the trees use each, and x scaled to [0, 1] among the nodes of its level and
    position. A join per level."""
    now = roots.filter(F.col("i").isin(ids)).select(F.col("root_id").alias("node_id"), "i").distinct()
    children = nodes.select("node_id", F.posexplode(F.array("c0", "c1")).alias("side", "child")).filter("child IS NOT NULL")
    all_used, links = now, None
    for _ in range(nodes.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]):
        down = materialized(now.join(children, "node_id"), "dag-level")
        links = down if links is None else links.unionByName(down)
        now = down.select(F.col("child").alias("node_id"), "i").distinct()
        all_used = all_used.unionByName(now)
    uses = all_used.groupBy("node_id").agg(F.count_distinct("i").alias("uses"))
    used = uses.join(nodes.select("node_id", "level", "pos", "x"), "node_id")
    ends = used.groupBy("level", "pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    used = used.join(ends, ["level", "pos"]).withColumn("scaled_x", F.coalesce(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.5))).drop("lo", "hi")
    if links is None:
        links = nodes.sparkSession.createDataFrame([], "parent long, child long, side int")
        return used, links
    return used, links.select(F.col("node_id").alias("parent"), "child", "side").distinct()


def dag_dot(used: DataFrame, links: DataFrame) -> str:
    names = [f'  n{n.node_id} [label="{n.x:.4g}"];' for n in used.orderBy("level", "pos", "node_id").collect()]
    arrows = [f"  n{e.parent} -> n{e.child};" for e in links.orderBy("parent", "side").collect()]
    return "\n".join(["digraph tree {", *names, *arrows, "}"])


def dag_tikz(used: DataFrame, links: DataFrame, width: float = 16.0) -> str:
    """A TikZ picture: levels from top to bottom, positions from left to right, x within its place."""
    lines = [r"\begin{tikzpicture}"]
    for n in used.orderBy("level", "pos", "node_id").collect():
        place = width / 2**n.level
        lines.append(rf"\node[circle,draw,inner sep=1pt] (n{n.node_id}) at ({place * (n.pos + 0.1 + 0.8 * n.scaled_x):.3f},{-n.level}) {{}};")
    lines += [rf"\draw[->] (n{e.parent}) -- (n{e.child});" for e in links.orderBy("parent", "side").collect()]
    return "\n".join([*lines, r"\end{tikzpicture}"])
