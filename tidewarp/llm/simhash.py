"""SimHash near-dedup with vantage-point trees."""
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vantage
from .common import broadcast_if_small, materialized
from .components import components

SEED = 42
SHARD = 40_000  # distinct fingerprints in a shard, about
SAMPLE = 8_192  # fingerprints from which the top of the tree is fitted, or PER_SHARD for each shard if that is more
PER_SHARD = 16
# The wide form, for similarities: at a Jaccard similarity of 0.8 fingerprints differ in arccos(8/9)/pi,
# 0.15, of their bits, with a deviation of 0.016 for 512 bits.
WIDE, WIDE_SHINGLE, WIDE_RADIUS = 8, 5, 94
BANDS, ROWS = 12, 3  # of min-hashes: at 0.8 a pair shares a band but for (1 - 0.8^3)^12, 2 in 10,000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of all runs of so many words, joined by spaces; of all words if there are fewer."""
    import xxhash

    words = text.translate(LOWER).split()  # bytes.split() parts at 0x20 and 0x09-0x0D, as asked
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, n)
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:z], SEED) for a, z in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64, n - k + 1)


def mix(h: np.ndarray, salt: int) -> np.ndarray:
    """Another hash from a hash (the finalizer of SplitMix64)."""
    h = h + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(h: np.ndarray, words: int = 1) -> np.ndarray:
    """Bits set in over half of the hashes; zero without hashes. Word 0 is of the hashes themselves."""
    out = np.zeros(words, dtype=np.uint64)
    for k in range(words):
        count = np.zeros(64, dtype=np.int64)
        for at in range(0, len(h), 16_384):
            part = h[at : at + 16_384]
            part = mix(part, k) if k else part
            count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        out[k] = np.packbits(2 * count > len(h), bitorder="little").view(np.uint64)[0]
    return out


def bands(h: np.ndarray) -> np.ndarray:
    """Hashes of BANDS groups of ROWS min-hashes; a document without words has those of zero."""
    low = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    odd = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64), 7) | np.uint64(1)
    h = mix(h if len(h) else np.zeros(1, dtype=np.uint64), 11)
    for at in range(0, len(h), 1_024):
        low = np.minimum(low, (h[at : at + 1_024, None] * odd[None, :]).min(axis=0))
    out = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        out = mix(out ^ low[r::ROWS], r + 1)
    return out.view(np.int64)


def groups(batches, key: str) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each key that has two or more, from batches sorted by key."""
    kept: dict[str, list[np.ndarray]] | None = None
    for batch in batches:
        cols = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        n = batch.num_rows
        if not n:
            continue
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(cols[key])) + 1, [n]])
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            part = {k: v[a:z] for k, v in cols.items()}
            if kept is not None and kept[key][0][0] == part[key][0]:
                for k, v in part.items():
                    kept[k].append(v)
            else:
                if kept is not None and sum(map(len, kept[key])) > 1:
                    yield {k: np.concatenate(v) for k, v in kept.items()}
                kept = {k: [v] for k, v in part.items()}
    if kept is not None and sum(map(len, kept[key])) > 1:
        yield {k: np.concatenate(v) for k, v in kept.items()}


def _linked(rows: DataFrame, key: str, node: str, words: list[str], radius: int) -> DataFrame:
    """a, b: in each key's rows, every node with the first of its class. Rows of a key come sorted to one
    task, which holds one key at a time, as numbers."""
    import pyarrow as pa

    def run(batches):
        for g in groups(batches, key):
            points = np.stack([g[w].view(np.uint64) for w in words], axis=1)
            top = vantage.link_all(points, radius)
            a, b = g[node], g[node][top]
            differ = a != b
            if differ.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[differ]), pa.array(b[differ])], names=["a", "b"])

    rows = rows.select(key, node, *words).repartition(key).sortWithinPartitions(key)
    return rows.mapInArrow(run, "a long, b long")


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, fp (64 bits as a long). Null text has no words."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            fp = [fingerprint(shingle_hashes(t.as_py() or b"", shingle))[0] for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fp, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def near_dedup(docs: DataFrame, shingle: int = 3, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id
    that links of radius or fewer differing bits reach.

    Null and empty texts have the fingerprint zero and link like others; null ids are members but no
    component's id, unless it has no other; repeated rows share a component; an empty table gives no rows.
    Only doc_id and text are looked at.

    Equal fingerprints are one point, so copies cost nothing further. The top of a vantage-point tree,
    fitted on about SAMPLE points or PER_SHARD for each shard (8 bytes each), deals the points to shards of about shard
    points; a point just outside a cut also goes inside, so no pair is lost. Each shard finds its pairs with a tree of its
    own and returns each point once, with the first of its class, never the pairs."""
    import pyarrow as pa

    spark = docs.sparkSession
    rows = materialized(fingerprints(docs, shingle), "fingerprints")
    points = materialized(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    n = points.count()
    levels = max(0, int(np.ceil(np.log2(max(1, n / shard)))))
    sample = np.zeros((0, 1), dtype=np.uint64)
    if levels:
        size = max(SAMPLE, PER_SHARD << levels)
        part = points.filter(F.pmod(F.xxhash64("fp"), F.lit(max(1, n // size))) == 0).select("fp").limit(2 * size).toArrow()
        sample = np.sort(part.column(0).to_numpy().view(np.uint64)).reshape(-1, 1)
    heap = spark.sparkContext.broadcast(vantage.fit_shards(sample, levels, radius))

    def deal(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            at, shards = vantage.shards_of(fp.view(np.uint64).reshape(-1, 1), heap.value, radius)
            yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array(fp[at])], names=["shard", "fp"])

    dealt = points.select("fp").mapInArrow(deal, "shard long, fp long").withColumn("node", F.col("fp"))
    linked = components(_linked(dealt, "shard", "node", ["fp"], radius))
    tops = points.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    tops = materialized(tops, "roots")
    ids = tops.groupBy("root").agg(F.min("least").alias("component_id"))
    tops = materialized(tops.join(ids, "root").select("fp", "component_id"), "classes")
    return rows.join(broadcast_if_small(tops), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_copies(docs: DataFrame, shingle: int = WIDE_SHINGLE, radius: int = WIDE_RADIUS) -> DataFrame:
    """doc_id, root: documents to drop because root, the smallest id of their group, stays. Documents
    link if their fingerprints of 64 * WIDE bits differ in radius bits or fewer, which at the defaults is
    a similarity of 0.8 or more of the sets of shingles, up to the deviation given above.

    At such radii no tree prunes: points that have nothing in common lie at half the bits, give or take
    few. So shards are those of min-hash bands, in several of which each point lies, and the trees search
    inside a shard. Null ids are left out; repeated ids count once; null texts have no words, and documents
    without words are one group."""
    import pyarrow as pa

    names = [f"w{k}" for k in range(WIDE)]

    def run(batches):
        for batch in batches:
            fps, keys = [], []
            for t in batch.column(1).cast(pa.binary()):
                h = np.unique(shingle_hashes(t.as_py() or b"", shingle))  # the set: a repeat would weigh with its count
                fps.append(fingerprint(h, WIDE))
                keys.append(bands(h))
            fp = np.array(fps, dtype=np.uint64).reshape(-1, WIDE).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(fp[:, k].copy()) for k in range(WIDE)), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", *names, "bands"])

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", bands array<long>"
    docs = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    rows = materialized(docs.mapInArrow(run, schema), "wide-fingerprints")
    # a point for each fingerprint and list of bands: texts of one fingerprint can lie in different shards
    points = materialized(rows.groupBy(*names, "bands").agg(F.min("doc_id").alias("least")), "wide-points")
    same = rows.join(points.groupBy(*names).agg(F.min("least").alias("least")), names).select(F.col("doc_id").alias("a"), F.col("least").alias("b")).filter("a > b")
    shards = points.select(F.explode("bands").alias("band"), "least", *names)
    near = _linked(shards, "band", "least", names, radius)
    linked = components(near.unionByName(same))
    return linked.filter("node > root").select(F.col("node").alias("doc_id"), "root")
