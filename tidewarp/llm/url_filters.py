"""URL filters: host rules, then a path-template tree judged by smoothed labelled purity. Native."""
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, broadcast_if_small, materialized

#: (verdict, host and path prefix).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
DEPTH = 3  # segments that the tree tells apart; what is deeper is one wildcard, **
MIN_CHILDREN = 8  # children from which a node's segments can be variable
MAX_REPEAT = 4.0  # ... if a child has at most so many rows on average
MERGE_Z = 1.96  # siblings whose block rates differ by less than so many standard errors merge
MIN_LABELS = 5  # labelled rows from which a branch has a rate to compare, and a host's templates can be rejected
PRIOR_ROWS = 4.0  # rows as which a node's purity counts that of the node above
PURITY = 0.8  # smoothed purity from which a template is rejected


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, UPPER.lower()), F.regexp_extract(F.substr(rest, F.char_length(host) + 1), "^[^?#]*", 0)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits host (or a domain above it) and the start of path, and its verdict;
    null where none fits. rules is a short list that becomes one expression."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):  # the last that fits is outermost
        name, _, prefix = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{prefix}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def templates(paths: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The path-template tree. paths: host, path, labelled, blocked, n (one row per host and path). Adds
    template, purity and support (labelled rows of the host).

    From the host down, at every level: the segments below a node are variable if they are MIN_CHILDREN or
    more with MAX_REPEAT rows or fewer on average, and become one branch, *. Otherwise those branches with
    MIN_LABELS labelled rows whose block rate is within MERGE_Z standard errors of that of all such siblings
    together merge to {*}; the others stay apart. Below depth all segments are one branch, **.

    A node's purity is (blocked + PRIOR_ROWS * purity above) / (labelled + PRIOR_ROWS), and above the hosts it
    is the rate of all labelled rows. So a branch without labels is judged by its siblings, through
    the node above.

    Each level sums the children first (in each task, then by node and segment), and joins what they became
    to the paths: a broadcast if that is small, else a join that is split where one branch is hot."""
    labelled, blocked = paths.agg(F.sum("labelled"), F.sum("blocked")).first()
    overall = blocked / labelled if labelled else 0.0
    purity = lambda above: (F.sum("b") + PRIOR_ROWS * above) / (F.sum("l") + PRIOR_ROWS)
    hosts = paths.groupBy(F.col("host").alias("h")).agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b")).groupBy("h").agg(purity(F.lit(overall)).alias("purity"), F.sum("l").alias("support"))
    hosts = materialized(hosts, "url-hosts")
    tree = paths.join(broadcast_if_small(hosts, 50_000), F.col("host") == F.col("h")).withColumns({"parts": F.split(F.regexp_replace("path", "^/", ""), "/"), "node": F.col("host")}).drop("h")
    for level in range(1, depth + 2):
        segment = F.get("parts", F.lit(level - 1)) if level <= depth else F.when(F.size("parts") > depth, "**")
        tree = tree.withColumn("s", segment)  # null where the path has ended: such rows stay at their node
        children = tree.filter("s IS NOT NULL").groupBy(F.col("node").alias("at"), F.col("purity").alias("above"), F.col("s").alias("child")).agg(F.sum("n").alias("rows"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
        children = materialized(children, "url-children")
        enough = F.col("l") >= MIN_LABELS
        stats = children.groupBy("at").agg(
            ((F.count("*") >= MIN_CHILDREN) & (F.sum("rows") <= F.count("*") * MAX_REPEAT)).alias("variable"),
            F.sum(F.when(enough, F.col("l"))).alias("pool_l"), F.sum(F.when(enough, F.col("b"))).alias("pool_b"), F.count(F.when(enough, 1)).alias("siblings"),
        )
        rate, p = F.try_divide("b", "l"), F.try_divide("pool_b", "pool_l")
        close = (rate - p) * (rate - p) * F.col("l") <= MERGE_Z * MERGE_Z * p * (1.0 - p)
        name = F.when(F.col("variable") & (F.col("child") != ""), "*").when(enough & (F.col("siblings") > 1) & close, "{*}").otherwise(F.col("child"))
        stats = materialized(stats, "url-stats")
        named = materialized(children.join(broadcast_if_small(stats, 50_000), "at").withColumn("name", name).select("at", "above", "child", "name", "l", "b"), "url-names")
        nodes = materialized(named.groupBy("at", "above", "name").agg(purity(F.col("above")).alias("own")).drop("above"), "url-nodes")
        became = materialized(named.select("at", "child", "name").join(broadcast_if_small(nodes, 50_000), ["at", "name"]), "url-became")
        tree = tree.join(broadcast_if_small(became, 50_000), (F.col("node") == F.col("at")) & (F.col("s") == F.col("child")), "left")
        tree = tree.withColumns({"node": F.when(F.col("own").isNull(), F.col("node")).otherwise(F.concat_ws("/", "node", "name")), "purity": F.coalesce("own", "purity")}).drop("s", "at", "child", "name", "own")
    return tree.withColumn("template", F.substr("node", F.char_length("host") + 1)).drop("node", "parts")


def url_filter(urls: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES, depth: int = DEPTH) -> DataFrame:
    """Adds host, path, rule, verdict (allow or block), template and rejected to every row of urls.

    Labels are the verdicts of the rules: the templates of a host are learnt from the urls that a rule
    judges, and judge those that no rule fits. A template is rejected if its purity reaches PURITY and its
    host has MIN_LABELS labelled rows: no host is judged by others alone. Null urls and urls without :// have
    an empty host and path, fit no rule and are judged like any other. Repeated rows each count and each
    return; an empty table returns no rows. Columns of urls with the names added are replaced.

    Only counts per host and path are shuffled. A hot host's rows are summed in each task before every
    exchange, and what its branches became is broadcast or joined with skew split."""
    host, path = host_and_path(F.col(url))
    rows = urls.withColumns({"__host": host, "__path": path})
    rule, verdict = rule_for(F.col("__host"), F.col("__path"), rules)
    rows = rows.withColumns({"__rule": rule, "__by_rule": verdict})
    paths = rows.groupBy(F.col("__host").alias("host"), F.col("__path").alias("path")).agg(F.count("*").alias("n"), F.count("__by_rule").alias("labelled"), F.count(F.when(F.col("__by_rule") == "block", 1)).alias("blocked"))
    tree = templates(materialized(paths, "url-paths"), depth)
    rejected = (F.col("purity") >= PURITY) & (F.col("support") >= MIN_LABELS)
    judged = materialized(tree.select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("template").alias("__template"), rejected.alias("__rejected")), "url-templates")
    out = rows.join(broadcast_if_small(judged, 50_000), ["__host", "__path"])
    clean = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict", "template", "rejected")]
    return out.select(
        *clean, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"),
        F.coalesce("__by_rule", F.when(F.col("__rejected"), "block").otherwise("allow")).alias("verdict"), F.col("__template").alias("template"), F.col("__rejected").alias("rejected"),
    )


def oracle() -> str:
    """DuckDB SQL for url_filter over pages, without the template."""
    u = "coalesce(url, '')"
    rest = f"CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) ELSE '' END"
    ordered = sorted(RULES, key=lambda r: -len(r[1]))
    fits = lambda text: f"(host = '{text.partition('/')[0]}' OR suffix(host, '.{text.partition('/')[0]}')) AND prefix(path, '/{text.partition('/')[2]}')"
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(r[1])} THEN '{r[k]}'" for r in ordered) + " END"
    smooth = lambda above: f"(sum(b) + {PRIOR_ROWS} * {above}) / (sum(l) + {PRIOR_ROWS})"
    levels = ""
    for k in range(1, DEPTH + 2):
        segment = f"parts[{k}]" if k <= DEPTH else f"CASE WHEN len(parts) > {DEPTH} THEN '**' END"
        levels += f""", s{k} AS (SELECT *, {segment} AS s FROM t{k - 1}),
c{k} AS (SELECT node, purity, s, sum(n) AS c, sum(labelled) AS l, sum(blocked) AS b FROM s{k} WHERE s IS NOT NULL GROUP BY node, purity, s),
v{k} AS (SELECT node, count(*) >= {MIN_CHILDREN} AND sum(c) <= count(*) * {MAX_REPEAT} AS variable, sum(l) FILTER (l >= {MIN_LABELS}) AS pl, sum(b) FILTER (l >= {MIN_LABELS}) AS pb, count(*) FILTER (l >= {MIN_LABELS}) AS siblings FROM c{k} GROUP BY node),
m{k} AS (SELECT c.*, CASE WHEN variable AND s <> '' THEN '*' WHEN l >= {MIN_LABELS} AND siblings > 1 AND (b / l - pb / pl) * (b / l - pb / pl) * l <= {MERGE_Z * MERGE_Z} * (pb / pl) * (1.0 - pb / pl) THEN '{{*}}' ELSE s END AS name FROM c{k} c JOIN v{k} USING (node)),
n{k} AS (SELECT node, name, {smooth("any_value(purity)")} AS own FROM m{k} GROUP BY node, name),
t{k} AS (SELECT s.* EXCLUDE (s, node, purity), CASE WHEN own IS NULL THEN s.node ELSE concat(s.node, '/', m.name) END AS node, coalesce(own, s.purity) AS purity
  FROM s{k} s LEFT JOIN m{k} m ON s.node = m.node AND s.s = m.s LEFT JOIN n{k} o ON m.node = o.node AND m.name = o.name)"""
    return f"""WITH r AS (SELECT page_id, {rest} AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM r),
u AS (SELECT page_id, translate(raw, '{UPPER}', '{UPPER.lower()}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
j AS (SELECT *, {case(1)} AS rule, {case(0)} AS by_rule FROM u),
p0 AS (SELECT host, path, string_split(regexp_replace(path, '^/', ''), '/') AS parts, count(*) AS n, count(by_rule) AS labelled, count(*) FILTER (by_rule = 'block') AS blocked FROM j GROUP BY host, path),
overall AS (SELECT CASE WHEN sum(labelled) > 0 THEN sum(blocked) / sum(labelled) ELSE 0 END AS p FROM p0),
hosts AS (SELECT host, {smooth("any_value(p)")} AS purity, sum(l) AS support FROM (SELECT host, labelled AS l, blocked AS b FROM p0), overall GROUP BY host),
t0 AS (SELECT p0.*, purity, support, host AS node FROM p0 JOIN hosts USING (host)){levels},
judged AS (SELECT host, path, purity >= {PURITY} AND support >= {MIN_LABELS} AS rejected FROM t{DEPTH + 1})
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict
FROM j JOIN judged USING (host, path)"""
