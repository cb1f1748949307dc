"""Cumulative-link (proportional odds) regression: P(grade <= j) = sigmoid(theta_j - w.x), one weight
vector for all ordered thresholds. Fitted on the driver from a bounded sample of labelled rows (fit), or on
all of them, whose gradients are summed on the executors (fit_all)."""
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialized

BLOCK = 1 << 20  # entries of sparse rows that are passed at once
HELD = 1 << 16  # entries of sparse rows in a row of the table of features, about
GROUP_BYTES = 16 << 20  # a row group of that table, which a reading task holds
STEPS = 60  # of fit_all, at most
ENOUGH = 1e-3  # by this share of itself the loss has to fall in PATIENCE steps, or fit_all ends
PATIENCE = 5
PAIRS = 20  # of steps and changes of the gradient that fit_all keeps


def _graded(labels: DataFrame, grade: Column) -> DataFrame:
    """doc_id, grade: one row per labelled id (the worst quality and the highest toxicity of contradicting
    ones); rows with nulls are left out."""
    by_id = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return by_id.select("doc_id", grade.cast("int").alias("grade"))


def labelled_sample(docs: DataFrame, labels: DataFrame, grade: Column, n_grades: int, per_grade: int) -> DataFrame:
    """doc_id, text, grade: at most per_grade rows of each grade, those with the smallest hashes of
    their ids, of labels as _graded() takes them. The bounded rows are broadcast, so that no text
    moves that the sample does not hold. Of rows of docs that share an id the smallest text counts, so the
    bound holds for rows too."""
    graded = _graded(labels, grade)
    picked = None
    for g in range(n_grades):
        part = graded.filter(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade)
        picked = part if picked is None else picked.unionByName(part)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))


def labelled(docs: DataFrame, labels: DataFrame, grade: Column) -> DataFrame:
    """doc_id, grade, text: every labelled id of docs, of labels as _graded() takes them. Of rows of docs that
    share an id the smallest text counts."""
    graded = materialized(_graded(labels, grade), "labels")
    return docs.select("doc_id", "text").join(broadcast_if_small(graded), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))


def feature_blocks(rows: DataFrame, features: Callable[[bytes], np.ndarray]) -> DataFrame:
    """grade, n, sizes (int32), ids (uint16), x (float32): the sparse features of all rows (grade, text), n
    rows of one grade in each, as a table that is written once and read for each step of a fit. features
    gives a dense vector of at most 2^16."""
    import pyarrow as pa

    def run(batches):
        held: dict[int, list] = {}
        size: dict[int, int] = {}

        def row(g):
            some = held.pop(g)
            del size[g]
            sizes = np.array([len(x) for _, x in some], dtype=np.int32)
            ids, x = (np.concatenate([r[k] for r in some]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([len(some)], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in (sizes, ids, x))], names=["grade", "n", "sizes", "ids", "x"])

        for batch in batches:
            for g, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                x = features(t.as_py() or b"")
                at = np.flatnonzero(x)
                held.setdefault(g, []).append((at.astype(np.uint16), x[at].astype(np.float32)))
                size[g] = size.get(g, 0) + len(at)
                if size[g] >= HELD:
                    yield row(g)
        for g in sorted(held):
            yield row(g)

    blocks = rows.select("grade", "text").mapInArrow(run, "grade int, n long, sizes binary, ids binary, x binary")
    return materialized(blocks, "features", **{"parquet.block.size": GROUP_BYTES, "compression": "zstd"})


def _summed(blocks: DataFrame, add: Callable, size: int) -> np.ndarray:
    """The sum of what add(total, grade, row, n, ids, x) adds to a vector of that size for each block of n rows; row
    is the number of each entry's row in the block. A task per core, so the driver gets a vector from each."""
    import pyarrow as pa

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            for g, *parts in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
                sizes, ids, x = (np.frombuffer(p.as_py(), kind) for p, kind in zip(parts, (np.int32, np.uint16, np.float32)))
                add(total, g, np.repeat(np.arange(len(sizes)), sizes), len(sizes), ids.astype(np.intp), x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    tasks = blocks.sparkSession.sparkContext.defaultParallelism
    parts = blocks.select("grade", "sizes", "ids", "x").coalesce(tasks).mapInArrow(run, "total binary").toArrow().column(0)
    return sum((np.frombuffer(p.as_buffer(), np.float64) for p in parts), np.zeros(size))


def fit_all(blocks: DataFrame, dim: int, n_grades: int, l2: float = 1e-4, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (dim) and thresholds (n_grades - 1, ascending) of the model that fit() approaches, on all rows of
    feature_blocks(): the same loss, in which grades weigh alike, by L-BFGS. A step is one pass over the
    blocks, in which each task sums the gradient of its rows, or more where it has to be shortened.

    The features are centred and scaled by the fourth root of their variances: so some 40 passes bring the loss
    lower than 250 steps of fit(). A grade without rows leaves its threshold next to its neighbour's;
    without rows all weights are 0."""
    spark = blocks.sparkSession
    count = np.zeros(n_grades)
    for r in blocks.groupBy("grade").agg(F.sum("n").alias("n")).collect():  # a row per grade
        count[r.grade] = r.n
    here = count > 0
    weight = np.where(here, 1.0 / np.maximum(count, 1) / max(1, here.sum()), 0.0)

    def moments(total, g, row, n, ids, x):
        total[:dim] += weight[g] * np.bincount(ids, x, dim)
        total[dim:] += weight[g] * np.bincount(ids, x.astype(np.float64) ** 2, dim)

    mean, square = _summed(blocks, moments, 2 * dim).reshape(2, dim)
    scale = (0.2 * np.maximum(square - mean * mean, 0) + l2) ** 0.25

    def thresholds(theta0, gaps):
        return theta0 + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(gaps, -6, 4)))])[: n_grades - 1]

    def model(p):
        w = p[:dim] / scale
        return w, p[dim] + mean @ w, p[dim + 1 :]

    def loss(p):
        w, theta0, gaps = model(p)
        now = spark.sparkContext.broadcast((w, np.concatenate([[-np.inf], thresholds(theta0, gaps), [np.inf]])))

        def add(total, g, row, n, ids, x):
            w, edges = now.value
            score = np.bincount(row, x * w[ids], n)
            upper, lower = sigmoid(edges[g + 1] - score), sigmoid(edges[g] - score)
            q = np.maximum(upper - lower, 1e-9)
            total[:dim] += np.bincount(ids, x * (weight[g] * (1.0 - upper - lower))[row], dim)
            if g + 1 < n_grades:
                total[dim + g] -= weight[g] * (upper * (1 - upper) / q).sum()
            if g:
                total[dim + g - 1] += weight[g] * (lower * (1 - lower) / q).sum()
            total[-1] -= weight[g] * np.log(q).sum()

        got = _summed(blocks, add, dim + n_grades)
        now.destroy()  # each step has its own
        g_theta = got[dim:-1]
        g_gaps = np.array([g_theta[j + 1 :].sum() * np.exp(gaps[j]) if -6 < gaps[j] < 4 else 0.0 for j in range(len(gaps))])
        g_w = got[:dim] + l2 * w + mean * g_theta.sum()
        return got[-1] + 0.5 * l2 * (w @ w), np.concatenate([g_w / scale, [g_theta.sum()], g_gaps])

    p = np.concatenate([np.zeros(dim), [-1.0], np.zeros(max(0, n_grades - 2))])
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    f, g = loss(p) if here.any() else (0.0, np.zeros(len(p)))
    losses = [f]
    while len(losses) <= steps and g.any() and (len(losses) <= PATIENCE or losses[-1 - PATIENCE] - f > ENOUGH * f):
        way, along = -g, []
        for s, y in reversed(pairs):
            along.append((s @ way) / (s @ y))
            way = way - along[-1] * y
        way = way * ((pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1.0 / np.sqrt(g @ g))
        for (s, y), a in zip(pairs, reversed(along)):
            way = way + (a - (y @ way) / (s @ y)) * s
        far = 1.0
        while (new := loss(p + far * way))[0] > f + 1e-4 * far * (g @ way) and far > 1e-3:
            far /= 2
        if new[0] >= f:
            break
        s, y = far * way, new[1] - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-PAIRS:]
        p, (f, g) = p + s, new
        losses.append(f)
    w, theta0, gaps = model(p)
    return w, thresholds(theta0, gaps)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def fit(ids: np.ndarray, values: np.ndarray, starts: np.ndarray, grades: np.ndarray, dim: int, n_grades: int, balance: dict[int, float] | None = None, l2: float = 1e-4, steps: int = 250, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights (dim) and thresholds (n_grades - 1, ascending) by full-batch Adam. Rows are sparse: row
    r has ids and values from starts[r] to starts[r + 1]. Grades weigh alike, however many rows they have, or
    as balance says.
    A grade without rows leaves its threshold next to its neighbour's; without rows all weights are 0."""
    n = len(grades)
    theta0, gaps, w = -1.0, np.zeros(max(0, n_grades - 2)), np.zeros(dim)
    if not n:
        return w, np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
    count = np.bincount(grades, minlength=n_grades)
    weight = (np.array([(balance or {}).get(g, 1.0) for g in range(n_grades)]) / np.maximum(count, 1))[grades]
    weight /= weight.sum()
    cuts = np.unique(np.concatenate([[0, n], np.searchsorted(starts, np.arange(BLOCK, starts[-1], BLOCK))]))
    blocks = [(slice(a, z), slice(starts[a], starts[z]), np.repeat(np.arange(z - a, dtype=np.int32), np.diff(starts[a : z + 1]))) for a, z in zip(cuts[:-1], cuts[1:])]
    m = [np.zeros(dim + n_grades - 1), np.zeros(dim + n_grades - 1)]
    for t in range(1, steps + 1):
        theta = theta0 + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        score = np.concatenate([np.bincount(at, weights=values[e] * w[ids[e]], minlength=r.stop - r.start) for r, e, at in blocks])
        upper = sigmoid(np.concatenate([theta, [np.inf]])[grades] - score)
        lower = sigmoid(np.concatenate([[-np.inf], theta])[grades] - score)
        p = np.maximum(upper - lower, 1e-9)
        slope = weight * (1.0 - upper - lower)
        g_w = l2 * w + sum(np.bincount(ids[e], weights=values[e] * slope[r][at], minlength=dim) for r, e, at in blocks)
        up, low = weight * upper * (1 - upper) / p, weight * lower * (1 - lower) / p
        g_theta = np.array([low[grades == j + 1].sum() - up[grades == j].sum() for j in range(n_grades - 1)])
        g_gaps = np.array([g_theta[j + 1 :].sum() * np.exp(gaps[j]) for j in range(len(gaps))])
        g = np.concatenate([g_w, [g_theta.sum()], g_gaps])
        m[0] = 0.9 * m[0] + 0.1 * g
        m[1] = 0.999 * m[1] + 0.001 * g * g
        step = rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)
        w, theta0, gaps = w - step[:dim], theta0 - step[dim], np.clip(gaps - step[dim + 1 :], -6, 4)
    return w, theta0 + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def tails(score: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """P(grade >= j) for j = 1, 2, ..., a column each; their sum is the expected grade."""
    return sigmoid(score[:, None] - theta[None, :])


def csr(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All entries, and where each list starts (with the end last)."""
    return (np.concatenate(lists) if lists else np.zeros(0)), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)


def scored(docs: DataFrame, score: Callable[[bytes], float], theta: np.ndarray, column: str, keep: str, choose: Callable[[np.ndarray], np.ndarray], only: bool = False) -> DataFrame:
    """docs with column (the expected grade), the tail probability of grade 1 and keep (choose of that
    probability); with only, just the rows that choose takes, as they were."""
    import pyarrow as pa

    names = list(docs.columns) if only else [c for c in docs.columns if c not in ("text", column, f"{column}_tail", keep)]
    source = docs if only else docs.select(*names, "text")

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
            s = np.array([score(t.as_py() or b"") for t in texts], dtype=np.float64)
            p = tails(s, theta)
            taken = choose(p[:, 0])
            if only:
                yield batch.filter(pa.array(taken))
            else:
                cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(taken)], names=[*names, column, f"{column}_tail", keep])

    if only:
        return source.mapInArrow(run, source.schema)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    return source.mapInArrow(run, f"{head}, {column} double, {column}_tail double, {keep} boolean")
