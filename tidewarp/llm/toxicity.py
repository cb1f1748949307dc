"""Toxicity: ordinal severity from sparse word features."""
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordinal

PER_GRADE = 3_000  # labelled rows of each label that the model is fitted on, at most
GRADES = 3  # none, some, much
BITS = 20  # of the hashed features: words, and beginnings of words
STARTS = (4, 5, 6, 7, 8, 9)  # bytes of such a beginning
MIN_EVIDENCE = 5.0  # a bucket is a feature from this log-likelihood ratio (G) between toxic and other rows on
MIN_RATIO, MIN_ROWS = 3.0, 2  # ... if so many times more of the toxic rows have it, and this many at least
L2 = 1e-4
CUT = 0.5  # P(severity >= 1) from which a document is toxic
#: ASCII punctuation and digits part words.
PARTS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


class Buckets(dict):
    """word -> hash buckets of the word and of its beginnings, remembered; forgets all when it holds a
    million words. With features (bucket -> position, or -1): the positions instead."""

    def __init__(self, features: np.ndarray | None = None):
        self.features = features

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        import xxhash

        if len(self) >= 1_000_000:
            self.clear()
        parts = {word, *(word[:k] + b"-" for k in STARTS if len(word) >= k)}
        found = tuple(xxhash.xxh32_intdigest(p) & ((1 << BITS) - 1) for p in sorted(parts))
        if self.features is not None:
            found = tuple(int(p) for b in found if (p := self.features[b]) >= 0)
        self[word] = found
        return found


def words(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(PARTS).split()


def hashed(text: bytes, buckets: Buckets) -> np.ndarray:
    return np.fromiter(chain.from_iterable(map(buckets.__getitem__, words(text))), np.int32)


def least_shingle(ids: np.ndarray) -> int:
    """The smallest hash of three words that follow each other: mostly the same in copies."""
    if len(ids) < 3:
        return int(ids.sum())
    x = ids.astype(np.uint64)
    h = (x[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (x[2:] * np.uint64(0x165667B19E3779F9))
    return int(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(1)).min())


def telling(n1: np.ndarray, rows1: int, n0: np.ndarray, rows0: int) -> np.ndarray:
    """Buckets that toxic rows have more often than others do, by a log-likelihood ratio. n1, n0: how many of
    the toxic and of the other rows have each bucket."""
    expected = (n1 + n0) * rows1 / (rows1 + rows0)
    part = lambda n, e: np.where(n > 0, n * np.log(np.maximum(n, 1) / np.maximum(e, 1e-9)), 0.0)
    g = 2 * (part(n1, expected) + part(n0, n1 + n0 - expected))
    return np.flatnonzero((g >= MIN_EVIDENCE) & (n1 >= MIN_ROWS) & (n1 / rows1 >= MIN_RATIO * (n0 + 0.5) / rows0))


def graded(rows: list[np.ndarray], toxic: np.ndarray, half: np.ndarray) -> np.ndarray:
    """0 for rows that are not toxic; 1 or 2 for those that are, by how toxic the words are that they hold.
    What a word says is counted on the labels of the other half of the rows (half: 0 or 1), as its log-odds
    there, so no row grades itself; 2 from the median of the toxic rows on."""
    much = np.zeros(len(rows))
    count = lambda at: np.bincount(np.concatenate([rows[r] for r in at] or [np.zeros(0, np.int32)]), minlength=1 << BITS)
    for h in (0, 1):
        yes, no = np.flatnonzero((half != h) & toxic), np.flatnonzero((half != h) & ~toxic)
        n1 = count(yes)
        odds = np.log((n1 + 0.5) / (len(yes) + 1)) - np.log((count(no) + 0.5) / (len(no) + 1))
        odds[(n1 < MIN_ROWS) | (odds < 1)] = 0
        for r in np.flatnonzero((half == h) & toxic):
            much[r] = odds[rows[r]].sum()
    return np.where(toxic, np.where(much >= np.median(much[toxic]), 2, 1), 0) if toxic.any() else np.zeros(len(rows), dtype=np.int64)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_GRADE) -> dict:
    """The model, from at most per_label toxic and as many other labelled rows.

    Labels are 0 or 1, so the grades of toxic rows come from the labels of other rows: see graded(). The
    features are the hashed words and beginnings of words that tell toxic from other rows; copies of a toxic
    text count once for that. Their weights are shared by both thresholds. Without toxic or without other rows
    nothing is toxic."""
    import pyarrow as pa

    sample = ordinal.labelled_sample(docs, labels, F.col("toxic"), 2, per_label).select("grade", "text", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half"))

    def run(batches):
        buckets = Buckets()
        for batch in batches:
            ids = [hashed(t.as_py() or b"", buckets) for t in batch.column(1).cast(pa.binary())]
            pairs = [np.unique(x, return_counts=True) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p[0] for p in pairs], pa.list_(pa.int32())), pa.array([p[1].astype(np.int32) for p in pairs], pa.list_(pa.int32())), pa.array([least_shingle(x) for x in ids], pa.int64()), batch.column(2)], names=["grade", "ids", "n", "first", "half"])

    got = sample.mapInArrow(run, "grade int, ids array<int>, n array<int>, first long, half int").toArrow()
    toxic, half = got.column("grade").to_numpy() == 1, got.column("half").to_numpy()
    features = np.full(1 << BITS, -1, dtype=np.int32)
    none = {"features": features, "w": np.zeros(1), "theta": np.array([9.0, 10.0])}
    if not toxic.any() or toxic.all():
        return none
    ids, counts = ([x.values.to_numpy(zero_copy_only=False) for x in got.column(c)] for c in ("ids", "n"))
    firsts = got.column("first").to_pylist()
    seen: set[int] = set()
    apart = [ids[r] for r in np.flatnonzero(toxic) if firsts[r] not in seen and not seen.add(firsts[r])]
    n1, n0 = (np.bincount(np.concatenate(x), minlength=1 << BITS) for x in (apart, [x for x, y in zip(ids, toxic) if not y]))
    chosen = telling(n1, len(apart), n0, int((~toxic).sum()))
    if not len(chosen):
        return none
    features[chosen] = np.arange(len(chosen))
    rows = [(features[i][features[i] >= 0], np.log1p(c[features[i] >= 0])) for i, c in zip(ids, counts)]
    flat, starts = ordinal.csr([r[0] for r in rows])
    shares = dict(labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("toxic").count().collect())
    balance = {0: shares.get(0, 1), 1: shares.get(1, 1) / 2, 2: shares.get(1, 1) / 2}  # as in all labels
    w, theta = ordinal.fit(flat.astype(np.int64), ordinal.csr([r[1] for r in rows])[0], starts, graded(ids, toxic, half), len(chosen), GRADES, balance, l2=L2)
    return {"features": features, "w": w, "theta": theta}


def score_of(model: dict):
    marks, w = Buckets(model["features"]), model["w"]

    def score(text: bytes) -> float:
        found = [p for t in map(marks.__getitem__, words(text)) if t for p in t]
        if not found:
            return 0.0
        at, n = np.unique(found, return_counts=True)
        return float(w[at] @ np.log1p(n))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, per_label: int = PER_GRADE, cut: float = CUT) -> DataFrame:
    """docs without text, with severity (expected, from 0 to 2), severity_tail (P(severity >= 1)) and
    toxic (from cut on). Null and empty texts have no features and the severity of a text without any;
    texts are read whole. Rows return as often as they come; an empty table returns none; columns of
    docs with the names added are replaced. Nothing is shuffled but the sample."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_label))
    theta = model.value["theta"]
    cache: dict = {}

    def score(text: bytes) -> float:
        if not cache:
            cache["f"] = score_of(model.value)
        return cache["f"](text)

    return ordinal.scored(docs, score, theta, "severity", "toxic", lambda p: p >= cut)
