"""Benchmark decontamination: latent semantic retrieval of passages, then longest-common-subsequence
and answer checks."""
import re
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import materialized

WINDOW, STRIDE = 32, 16  # words of a passage, and between the starts of two
STOP = 0.25  # terms in a larger share of all passages weigh nothing
COSINE = 0.35  # from which a passage is a candidate
LEAK, LIKELY, ANSWER = 0.6, 0.4, 0.8  # shares of an item (with its answer: of the answer) in common order
ITEMS = 4_096  # items that are searched at once
QUERIES = 8_192  # query vectors that are searched at once, but for one item that has more
SPAN = 192  # query vectors that share a latent space: its rank must span them
SPARE = 64  # ranks of a space beyond its vectors
GROUP = 8  # query vectors of a space that share a bound
LOST = 1e-3  # share of a query vector that its space may miss
HELD = 1 << 16  # terms of passages in a row of the table of passages, about
CELLS = 1 << 23  # products of two terms that a task sums at once
UNIT = 2.0**20  # sums of products are whole numbers of 1 / UNIT, so that their order changes nothing
#: What is no letter or digit parts terms; A-Z become a-z.
PARTS = bytes(b if b >= 128 else b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode()
    return text.translate(PARTS).split()


def term_ids(text: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The terms of a text by their numbers, -1 for others."""
    found = terms(text)
    return np.fromiter(map(vocabulary.get, found, repeat(-1)), np.int64, len(found))


def answer(text: str) -> list[bytes]:
    """An item's answer: its last sentence, or its last five terms if that is shorter than three."""
    last = [s for s in re.split(r"[.?!]\s*", text) if terms(s.encode())][-1:]
    found = terms(last[0].encode()) if last else []
    return found if len(found) >= 3 else terms(text.encode())[-5:]


def common(item: list[int], region: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    at: dict[int, int] = {}
    for i, t in enumerate(item):
        at[t] = at.get(t, 0) | (1 << i)
    full = (1 << len(item)) - 1
    v = full
    for t in region:
        if t in at:
            u = v & at[t]
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """term, df: passages that hold each term of the vocabulary, over all documents (term -1: all
    passages); and all passages that hold one (df null): ids, the terms of each in order of their numbers
    and as often as they come (int32), and sizes, how many each has (uint8)."""
    import pyarrow as pa

    words = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = ["term", "df", "ids", "sizes"]

    def run(batches):
        size = len(words.value)
        df, passages, ids_, sizes, held = np.zeros(size, dtype=np.int64), 0, [], [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([np.concatenate(ids_).tobytes()], pa.binary()), pa.array([np.concatenate(sizes).tobytes()], pa.binary())], names=names)

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                ids = term_ids(text.as_py() or b"", words.value)
                passages += -(-len(ids) // WINDOW)
                known = np.flatnonzero(ids >= 0)
                if not len(known):
                    continue
                at = np.sort(known // WINDOW * size + ids[known])
                term = at % size
                df += np.bincount(term[np.append(True, at[1:] != at[:-1])], minlength=size)
                n = np.bincount(known // WINDOW)
                ids_.append(term.astype(np.int32))
                sizes.append(n[n > 0].astype(np.uint8))
                held += len(term)
                if held >= HELD:
                    yield row()
                    ids_, sizes, held = [], [], 0
        if held:
            yield row()
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], passages)), pa.nulls(len(at) + 1, pa.binary()), pa.nulls(len(at) + 1, pa.binary())], names=names)

    return docs.select("text").mapInArrow(run, "term int, df long, ids binary, sizes binary")


def _triangle(n: int) -> int:
    return n * (n + 1) // 2


def products(shared: dict, own: np.ndarray) -> DataFrame:
    """row, cols (int32), products (int64, in 1 / UNIT): the upper triangle of A'A over some terms (own,
    sorted; row and cols are places in it), a row of it each, without cells of no passage. A has a row for
    each passage of all documents, its TF-IDF over all terms of the items, L2-normalised. A task per core
    sums CELLS products at once; further rows of a larger triangle are other tasks'."""
    import pyarrow as pa

    spark, n = shared["passages"].sparkSession, len(own)
    schema = "row int, cols binary, products binary"
    first = np.concatenate([[0], np.cumsum(n - np.arange(n))])  # cells before each row
    number = np.full(len(shared["vocabulary"]), -1)
    number[own] = np.arange(n)
    now = spark.sparkContext.broadcast((shared["idf"], number, first))

    def packed(rows):
        """Rows of the triangle, each from its diagonal on."""
        for some in iter(lambda: list(islice(rows, 256)), []):
            some = [(r, at, v[at]) for r, v in some if len(at := np.flatnonzero(v))]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in some], pa.int32()), pa.array([(r + at).astype(np.int32).tobytes() for r, at, _ in some], pa.binary()), pa.array([v.tobytes() for _, _, v in some], pa.binary())], names=["row", "cols", "products"])

    def added(batches):
        def rows():
            at, total = -1, None
            for batch in batches:
                for r, cols, values in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                    if r != at:
                        if total is not None:
                            yield at, total
                        at, total = r, np.zeros(n - r, dtype=np.int64)
                    total[np.frombuffer(cols.as_py(), np.int32) - r] += np.frombuffer(values.as_py(), np.int64)
            if total is not None:
                yield at, total

        return packed(rows())

    def summed(lo: int, hi: int) -> DataFrame:
        def run(batches):
            idf, number, first = now.value
            base = first[:-1] - np.arange(n) - first[lo]
            total = np.zeros(first[hi] - first[lo])
            for batch in batches:
                for ids, sizes in zip(batch.column(0), batch.column(1)):
                    t, sizes = np.frombuffer(ids.as_py(), np.int32), np.frombuffer(sizes.as_py(), np.uint8)
                    row = np.repeat(np.arange(len(sizes)), sizes)
                    new = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (row[1:] != row[:-1])))
                    t, row, tf = t[new], row[new], np.diff(np.append(new, len(t)))
                    v = tf * idf[t]
                    v /= np.maximum(np.sqrt(np.bincount(row, v * v)), 1e-9)[row]
                    t = number[t]
                    kept = np.flatnonzero((t >= 0) & (v > 0))
                    t, row, v = t[kept], row[kept], v[kept]
                    left = np.cumsum(np.bincount(row))[row] - np.arange(len(row))  # pairs of each term with itself and later ones of its passage
                    # By rows of the triangle, which stay in the cache: in the order of passages adding took 18 times as long.
                    order = np.argsort(t.astype(np.uint16) if n <= 1 << 16 else t, kind="stable")
                    order = order[slice(*np.searchsorted(t[order], [lo, hi]))]
                    left = left[order]
                    later = np.arange(left.sum()) + np.repeat(order - np.cumsum(left) + left, left)
                    np.add.at(total, np.repeat(base[t[order]], left) + t[later], np.repeat(v[order], left) * v[later])
            total = np.rint(total * UNIT).astype(np.int64)
            yield from packed((r, total[first[r] - first[lo] : first[r + 1] - first[lo]]) for r in range(lo, hi))

        return shared["passages"].coalesce(spark.sparkContext.defaultParallelism).mapInArrow(run, schema)

    lo, out = 0, None
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + CELLS, "right")) - 1)
        part = summed(lo, hi)
        lo, out = hi, part if out is None else out.unionByName(part)
    return materialized(out.repartition("row").sortWithinPartitions("row").mapInArrow(added, schema), "term-products")


def _weighted(rows: list[np.ndarray], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for row in rows:
        at, tf = np.unique(row, return_counts=True)
        out.append((at, tf * idf[at]))
    return out


def _product(rows: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """A'(A x) of L2-normalised rows A."""
    out = np.zeros_like(x)
    for at, v in rows:
        norm = float(np.sqrt(v @ v))
        if norm:
            v = v / norm
            out[at] += v[:, None] * (v @ x[at])[None, :]
    return out


def latent_terms(cells: DataFrame, passages: int, items: list[np.ndarray], local: np.ndarray, idf: np.ndarray, rank: int, rounds: int = 2) -> np.ndarray:
    """Term vectors of the latent space (terms x rank or more, orthonormal columns): the right singular
    vectors of the TF-IDF matrix A of all passages and of the items by a randomised SVD. Executors multiply
    X by rows of A'A, which products() has summed; the driver holds X (terms x rank) and orthonormalises.
    Items weigh as much as the passages together, so that the space spans what is searched for; of an item
    that it still does not span the missing part becomes a direction of its own.

    local: the space's number of each term of the cells, -1 of terms that are not in it."""
    import pyarrow as pa

    rng = np.random.default_rng(7)
    x = np.linalg.qr(rng.standard_normal((len(idf), rank)))[0]
    spark = cells.sparkSession
    own = _weighted(items, idf)
    share = max(1.0, passages / max(1, len(items)))
    for _ in range(rounds + 1):
        now = spark.sparkContext.broadcast((x.astype(np.float32), local))

        def run(batches):
            basis, number = now.value
            total = np.zeros_like(basis)
            for batch in batches:
                at = number[batch.column(0).to_numpy()]
                kept = np.flatnonzero(at >= 0)
                for i in range(0, len(kept), 256):
                    some = at[kept[i : i + 256]]
                    dense = np.zeros((len(some), len(basis)), dtype=np.float32)
                    for k, row in enumerate(kept[i : i + 256].tolist()):
                        col = number[np.frombuffer(batch.column(1)[row].as_py(), np.int32)]
                        dense[k, col[col >= 0]] = np.frombuffer(batch.column(2)[row].as_py(), np.int64)[col >= 0] / UNIT
                    total[some] += dense @ basis
                    dense[np.arange(len(some)), some] = 0  # the diagonal counts once
                    total += dense.T @ basis[some]
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

        parts = cells.coalesce(4).mapInArrow(run, "total binary").toArrow().column(0)
        y = share * _product(own, x)
        for part in parts:
            y += np.frombuffer(part.as_buffer(), dtype=np.float32).reshape(x.shape)
        now.destroy()  # each round has its own
        x = np.linalg.qr(y)[0]
    v = _unit(own, len(idf))
    left = v - (v @ x) @ x.T
    left = left[np.sqrt((left * left).sum(axis=1)) > LOST]
    return np.linalg.qr(np.concatenate([x, left.T], axis=1))[0] if len(left) else x


def _unit(rows: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """The rows as a dense matrix, L2-normalised."""
    out = np.zeros((len(rows), size))
    for r, (at, v) in enumerate(rows):
        out[r, at] = v / max(1e-9, float(np.sqrt(v @ v)))
    return out


def weighed(docs: DataFrame, items: list[Row]) -> dict | None:
    """What the spaces of a block of items share: their terms, the vocabulary and its weights, and all
    passages (n: how many, those without a term of the items too)."""
    texts = [(r[0], terms((r[1] or "").encode()), answer(r[1] or "")) for r in items]
    texts = [t for t in texts if t[1]]
    if not texts:
        return None
    vocabulary: dict[bytes, int] = {}
    rows = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in t[1]]) for t in texts]
    got = materialized(counted(docs, vocabulary), "passage-counts")
    df = np.zeros(len(vocabulary))
    passages = 0
    for r in got.filter("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row per term of the items
        if r.term < 0:
            passages = r.df
        else:
            df[r.term] = r.df
    idf = np.where(df > STOP * passages, 0.0, np.log((passages + 1) / (df + 1)) + 1.0)
    if not idf.any():  # every term of the items is everywhere
        idf[:] = 1.0
    other = float(np.log(passages + 1) * 0.5 + 1.0)  # of terms that no item has: halfway between rare and common
    held = got.filter("ids IS NOT NULL").select("ids", "sizes")
    return {"vocabulary": vocabulary, "idf": idf, "other": other, "weight2": np.append(idf, other) ** 2, "ids": [t[0] for t in texts], "items": [r.tolist() for r in rows], "answers": [[vocabulary[w] for w in t[2]] for t in texts], "passages": held, "n": passages}


def cuts(n: int) -> np.ndarray:
    """Starts of the passages of a text of n words."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


def queries(items: list[list[int]]) -> list[tuple[int, np.ndarray]]:
    """(item, terms) of the query vectors: the whole items first, then the passages of those that are
    longer than one. A passage of a document is far from a long item, not from the item's passages."""
    out = [(i, np.array(item)) for i, item in enumerate(items)]
    return out + [(i, np.array(item[a : a + WINDOW])) for i, item in enumerate(items) if len(item) > WINDOW for a in cuts(len(item)).tolist()]


def _own(vectors: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The terms of some query vectors, sorted."""
    return np.unique(np.concatenate([v for _, v in vectors]))


def together(parts: list[list[tuple[int, np.ndarray]]]) -> list[tuple[np.ndarray, list[list[tuple[int, np.ndarray]]]]]:
    """(terms, spaces) whose products of terms are summed together: neighbours, as long as that is within
    CELLS or no more than apart."""
    out: list[tuple[np.ndarray, list]] = []
    for part in parts:
        own = _own(part)
        if out:
            both = np.union1d(out[-1][0], own)
            if _triangle(len(both)) <= max(CELLS, _triangle(len(out[-1][0])) + _triangle(len(own))):
                out[-1] = (both, [*out[-1][1], part])
                continue
        out.append((own, [part]))
    return out


def space(shared: dict, cells: DataFrame, terms_: np.ndarray, vectors: list[tuple[int, np.ndarray]]) -> dict:
    """The latent space of some query vectors, by the products of terms_ (theirs and maybe others): x, the
    latent vectors of its terms (local: their numbers), z, those of the queries (of: their items), most,
    what each term of the vocabulary gives at most, and groups, what each gives at most to a query of each
    GROUP of them."""
    size = len(shared["vocabulary"])
    own = _own(vectors)
    local = np.full(size + 1, -1)
    local[own] = np.arange(len(own))
    rows, idf = [local[v] for _, v in vectors], shared["idf"][own]
    x = latent_terms(cells, shared["n"], rows, local[terms_], idf, min(len(own), len(vectors) + SPARE))
    z = _unit(_weighted(rows, idf), len(own)) @ x
    x = x * idf[:, None]
    most = np.zeros(size + 1)  # the last: of other terms
    gives = np.maximum(x @ z.T, 0) * (1 + 1e-5)
    most[own] = gives.max(axis=1)
    groups = np.maximum.reduceat(gives, np.arange(0, len(z), GROUP), axis=1)
    return {"x": np.append(x, np.zeros((1, x.shape[1])), axis=0).astype(np.float32), "z": z.astype(np.float32), "of": np.array([i for i, _ in vectors]), "local": local, "most": most, "groups": np.append(groups, np.zeros((1, groups.shape[1])), axis=0).astype(np.float32)}


def fitted(docs: DataFrame, items: list[Row]) -> dict | None:
    """The index of a block of items: vocabulary, idf, the items, and spaces, each of at most SPAN query
    vectors, so that its rank spans them however many items there are. x and z are of the first space."""
    if (shared := weighed(docs, items)) is None:
        return None
    vectors = queries(shared["items"])
    spaces = []
    for terms_, parts in together([vectors[i : i + SPAN] for i in range(0, len(vectors), SPAN)]):
        cells = products(shared, terms_)
        spaces += [space(shared, cells, terms_, part) for part in parts]
    del shared["passages"], shared["n"]
    return shared | {"spaces": spaces, "most": np.maximum.reduce([s["most"] for s in spaces]), "x": spaces[0]["x"], "z": spaces[0]["z"]}


def over_passages(x: np.ndarray, local: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Sums of the terms' rows of x over some passages. A passage is a stride and the next one (rows of
    local), which is the first of the next passage and summed once."""
    held = np.union1d(part, part + 1)
    total = x[local[held]].sum(axis=1)
    at = np.searchsorted(held, part)
    return total[at] + total[at + 1]


def leaks_in(text: bytes, index: dict, cosine: float = COSINE) -> Iterator[tuple[int, float, float, bool, int]]:
    """(item, cosine, share of the item in common order, whether the answer is there, first word) of
    the items that a text leaks, each by its best passage."""
    ids = term_ids(text, index["vocabulary"])
    if not len(ids):
        return
    starts = cuts(len(ids))
    ends = np.minimum(starts + WINDOW, len(ids))
    sums = lambda v: (c := np.concatenate([[0.0], np.cumsum(v)]))[ends] - c[starts]
    norm = np.sqrt(np.maximum(sums(index["weight2"][ids]), 1e-9))
    # The product of a passage with an item is a sum over its terms, so for no item it exceeds the sum of
    # what each term gives to the item that it gives most to; nor for items of a group what it gives most
    # to one of them. Most passages go here, and no candidate.
    if not (sums(index["most"][ids]) >= cosine * norm).any():
        return
    best: dict[int, tuple[float, float, bool, int]] = {}
    strides = np.concatenate([ids, np.full((len(starts) + 1) * STRIDE - len(ids), -1)]).reshape(-1, STRIDE)
    for one in index["spaces"]:
        might = np.flatnonzero(sums(one["most"][ids]) >= cosine * norm)
        if not len(might):
            continue
        local = one["local"][strides]  # -1 takes the last row, of zeros
        parts = [might[at : at + 1_024] for at in range(0, len(might), 1_024)]
        might = np.concatenate([p[over_passages(one["groups"], local, p).max(axis=1) >= cosine * norm[p]] for p in parts])
        for at in range(0, len(might), 128):
            part = might[at : at + 128]
            z = over_passages(one["x"], local, part)
            cos = (z @ one["z"].T) / np.maximum(norm[part], np.sqrt((z * z).sum(axis=1)))[:, None]
            near: dict[tuple[int, int], float] = {}
            for r, k in zip(*np.nonzero(cos >= cosine)):
                pair = (int(r), int(one["of"][k]))
                near[pair] = max(float(cos[r, k]), near.get(pair, 0.0))
            for (r, item), c in near.items():
                if item in best and best[item][1] == 1.0:  # nothing can be better
                    continue
                a, z_, n = int(starts[part[r]]), int(ends[part[r]]), len(index["items"][item])
                region = ids[max(0, a - n) : z_ + n].tolist()
                if (share := common(index["items"][item], region) / n) < LIKELY:
                    continue
                told = common(index["answers"][item], region) >= ANSWER * len(index["answers"][item])
                if share >= LEAK or told:
                    now = (c, share, bool(told), a)
                    if item not in best or (now[1], now[0]) > (best[item][1], best[item][0]):
                        best[item] = now
    for item, found in best.items():
        yield (item, *found)


def _blocks(bench: DataFrame) -> Iterator[list[Row]]:
    """The items in blocks of at most ITEMS items and QUERIES query vectors, sorted by id, one row per id
    and text."""
    rows = bench.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    low = None
    while True:
        more = rows if low is None else rows.filter((F.col("item_id") > low[0]) | ((F.col("item_id") == low[0]) & (F.col("text") > low[1])))
        block = more.orderBy("item_id", "text").limit(ITEMS).collect()
        part: list[Row] = []
        held = 0
        for row in block:
            n = len(terms(row[1].encode()))
            n = 1 + (len(cuts(n)) if n > WINDOW else 0)
            if part and held + n > QUERIES:
                yield part
                part, held = [], 0
            part.append(row)
            held += n
        if part:
            yield part
        if len(block) < ITEMS:
            return
        low = (block[-1][0], block[-1][1])


def benchmark_leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answered, first_word: one row per document and item that it
    leaks. Every passage of every whole document is compared with every item, in blocks of ITEMS items
    (a stated query set).

    A passage of WINDOW words is a candidate from a cosine of COSINE to an item, or to a passage of an
    item, in the latent space. The item leaks if LEAK of its words stand around the passage in the item's order, or LIKELY of them with
    ANSWER of its answer's. Null or empty texts and items leak nothing; items with null ids are left out;
    repeated rows of documents return as often as they come; ids may be null; empty tables give no rows."""
    import pyarrow as pa

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, cosine double, lcs_share double, answered boolean, first_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(bench):
        if (index := fitted(docs, block)) is None:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                rows = [(i, *found) for i, t in enumerate(batch.column(1).cast(pa.binary())) for found in leaks_in(t.as_py() or b"", shared.value)]
                at = lambda k, kind: pa.array([r[k] for r in rows], kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at(0, pa.int32())), pa.array([shared.value["ids"][r[1]] for r in rows], pa.int64()), at(2, pa.float64()), at(3, pa.float64()), at(4, pa.bool_()), at(5, pa.int64())], names=["doc_id", "item_id", "cosine", "lcs_share", "answered", "first_word"])

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def without_leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of docs that leak no item, as they were: filtered where they are, nothing shuffles."""
    import pyarrow as pa

    for block in _blocks(bench):
        if (index := fitted(docs, block)) is None:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
                yield batch.filter(pa.array([next(leaks_in(t.as_py() or b"", shared.value), None) is None for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
