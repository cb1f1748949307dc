"""Line dedup: documents that share runs of lines are aligned pairwise with patience diff, and blocks that
they have in common are deleted from the later one."""
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialized

MIN_WORDS = 20  # of an aligned block that is deleted


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first, in which both rise strictly."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, y) in sorted(enumerate(pairs), key=lambda t: (t[1][0], -t[1][1])):
        k = bisect_left(tails, y)
        back[i] = ends[k - 1] if k else -1
        tails[k : k + 1], ends[k : k + 1] = [y], [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """An alignment of (line here, equal line there): first lines that are unique on both sides, in their
    longest common order, then the same between each two of them for the other lines."""
    here, there = {}, {}
    for x, y in pairs:
        here[x] = here.get(x, 0) + 1
        there[y] = there.get(y, 0) + 1
    fixed = increasing([(x, y) for x, y in pairs if here[x] == 1 and there[y] == 1])
    out, taken = list(fixed), set(fixed)
    rest = [p for p in pairs if p not in taken]
    lows, highs = [(-1, -1), *fixed], [*fixed, (1 << 60, 1 << 60)]
    if rest:
        starts = [x for x, _ in highs]
        gaps: dict[int, list[tuple[int, int]]] = {}
        for x, y in rest:
            k = bisect_left(starts, x)
            if lows[k][0] < x < highs[k][0] and lows[k][1] < y < highs[k][1]:
                gaps.setdefault(k, []).append((x, y))
        for gap in gaps.values():
            out += increasing(gap)
    return sorted(out)


def common_blocks(pairs: list[tuple[int, int]], words: dict[int, int], least: int) -> list[tuple[int, int]]:
    """(first, last) lines here of common blocks of at least so many words that the alignment reaches. A block
    is of neighbouring lines on both sides, as far as they are equal; pairs in smaller ones take no part. What
    is aligned goes with the block around it. What stands in another order is aligned anew after that is taken
    out, until all lines left are in no block."""
    block: dict[tuple[int, int], list[int]] = {}  # first line, last line and words of the block around a pair
    for x, y in sorted(set(pairs)):
        at = block[x, y] = block.get((x - 1, y - 1)) or [x, x, 0]
        at[1], at[2] = x, at[2] + words[x]
    pairs = [p for p in block if block[p][2] >= least]
    blocks: list[tuple[int, int]] = []
    gone: set[int] = set()
    while pairs:
        for p in patience(pairs):
            if p[0] not in gone:
                first, last, _ = block[p]
                blocks.append((first, last))
                gone.update(range(first, last + 1))
        pairs = [p for p in pairs if p[0] not in gone]
    return sorted(blocks)


def runs(words: list[int], least: int) -> list[tuple[int, int]]:
    """(first, last) of the shortest runs of at least so many words from each line on, and up to each line.
    Together those inside a block of so many words cover all of it: a line that the block's first run does
    not reach is the end of one."""
    ends = [0]
    for n in words:
        ends.append(ends[-1] + n)
    found = set()
    z = a = 0
    for i in range(len(words)):
        z = max(z, i + 1)
        while z < len(words) and ends[z] - ends[i] < least:
            z += 1
        if ends[z] - ends[i] >= least:
            found.add((i, z - 1))
        while a < i and ends[i + 1] - ends[a + 1] >= least:
            a += 1
        if ends[i + 1] - ends[a] >= least:
            found.add((a, i))
    return sorted(found)


def blocks_of(shared: list[tuple[int, int, int]], words: dict[int, int], least: int) -> list[tuple[int, int]]:
    """(first, last) lines here to delete for one partner, of runs (first, last, first there) that it has."""
    return common_blocks([(a + k, y + k) for a, z, y in shared for k in range(z - a + 1)], words, least)


def overlaps(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """doc_id, part (xxhash64 of the text), blocks: array of (partner, first, last): lines of a document to
    delete because an earlier document, partner, has them too. Documents are in the order of (doc_id, part).

    Overlapping documents are found through what they share that is rare. A line alone can be frequent
    ("read more"), so it is joined with its neighbours until the run has enough words: the shortest such
    runs from each line on and up to each line, each as rare as the passage that it stands in. A run's
    partner is the first document that has it, at its first place there: so a frequent run costs no more than
    a rare one, one partner for each document that has it. Document and partner are then aligned by patience
    diff over all lines of the runs that they share, and only what the alignment reaches is deleted. Their other
    equal lines are in no block of enough words.

    Every block of enough words that any earlier document has consists of such runs, wherever else its
    lines stand, so none is lost; rows grow with the lines and not with pairs of documents, and the first
    document keeps every run. Runs are compared by 128-bit hashes of the hashes of their lines; frequent ones are summed in each task
    before the exchange, and the join with their first places is between two plain exchanges, which adaptive
    execution splits where one run has very many rows.

    Lines without words are not counted: they part no run, and go with a block that they are in."""
    import pyarrow as pa

    def hashed(batches):
        import xxhash

        for batch in batches:
            at, words, digests = [], [], []
            for text in batch.column(2).cast(pa.binary()):
                lines = [(k, n, x) for k, x in enumerate(text.as_py().split(b"\n")) if (n := len(x.split()))]  # bytes.split() parts as WORD
                at.append([k for k, _, _ in lines])
                words.append([n for _, n, _ in lines])
                digests.append(b"".join([xxhash.xxh3_128_digest(x) for _, _, x in lines]))
            columns = [batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(words, pa.list_(pa.int32())), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "at", "words", "digests"])

    def cut(batches):
        import xxhash

        for batch in batches:
            of, hashes, first, infos = [], [], [], []
            for i in range(batch.num_rows):
                at, words, digests = (batch.column(c)[i].as_py() for c in (2, 3, 4))
                for a, z in runs(words, least):
                    of.append(i)
                    hashes.append(xxhash.xxh3_128_digest(digests[16 * a : 16 * (z + 1)]))
                    first.append(a)
                    infos.append([v for k in range(a, z + 1) for v in (at[k], words[k])])
            rows = pa.array(of, pa.int32())
            columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(hashes, pa.binary()), pa.array(first, pa.int32()), pa.array(infos, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "h", "line", "info"])

    docs = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("part"), "text")
    # texts are read and lines hashed once; runs are cut from the hashes, for their first places and for the join
    digests = materialized(docs.mapInArrow(hashed, "doc_id long, part long, at array<int>, words array<int>, digests binary"), "line-hashes")
    # info: line of the text and words of each line of the run
    lines = digests.mapInArrow(cut, "doc_id long, part long, h binary, line int, info array<int>")
    first = lines.groupBy("h").agg(F.min(F.struct("doc_id", "part", "line")).alias("at"), F.max(F.struct("doc_id", "part")).alias("last"))
    first = first.filter("last > named_struct('doc_id', at.doc_id, 'part', at.part)").select("h", F.col("at.doc_id").alias("partner"), F.col("at.part").alias("partner_part"), F.col("at.line").alias("there"))
    first = materialized(first, "first-runs")
    shared = lines.join(first, "h").filter("doc_id > partner OR (doc_id = partner AND part > partner_part)")
    # rows that repeat an id and a text are one document: of its equal runs one is enough
    listed = shared.groupBy("doc_id", "part").agg(F.collect_set(F.struct("partner", "partner_part", "line", "there", "info")).alias("shared"))

    def run(batches):
        for batch in batches:
            rows, out = [], []
            for i in range(batch.num_rows):
                by: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
                words, at = {}, {}
                for s in batch.column(2)[i].as_py():
                    a, info = s["line"], s["info"]
                    by.setdefault((s["partner"], s["partner_part"]), []).append((a, a + len(info) // 2 - 1, s["there"]))
                    at.update(enumerate(info[::2], a))
                    words.update(enumerate(info[1::2], a))
                found = [{"partner": p, "first": at[a], "last": at[z]} for (p, _), part in sorted(by.items()) for a, z in blocks_of(part, words, least)]
                if found:
                    rows.append(i)
                    out.append(found)
            blocks = pa.array(out, pa.list_(pa.struct([("partner", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])))
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), blocks], names=["doc_id", "part", "blocks"])

    return listed.mapInArrow(run, "doc_id long, part long, blocks array<struct<partner:long,first:int,last:int>>")


def line_dedup(docs: DataFrame, least: int = MIN_WORDS, column: str = "blocks") -> DataFrame:
    """docs with the blocks deleted from text, and column with the blocks (empty where nothing was deleted).
    n_chars, if docs has it, is that of the new text where that changed.

    Ids order documents. Rows without an id stay as they are and are nobody's partner. Rows that repeat an
    id and a text are one document, not each other's partners; other texts of an id are documents of their
    own, in the order of their hashes. Null texts stay null; lines without words are never aligned, and go
    with a block around them. A text whose lines all go becomes empty. Texts are read whole; an empty table
    returns none; a column of docs with the name of column is replaced.

    What is deleted is found on hashes of runs of lines; texts shuffle once, to meet it."""
    found = overlaps(docs, least).withColumnsRenamed({"doc_id": "__id", "part": "__part", "blocks": "__blocks"})
    same = (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64("text") == F.col("__part"))
    rows = docs.drop(column).join(found, same, "left").drop("__id", "__part")
    gone = F.array_distinct(F.flatten(F.transform("__blocks", lambda b: F.sequence(b["first"], b["last"]))))
    lines = F.split("text", "\n", -1)
    # one flag per line, so that each line is looked up once
    flags = F.aggregate(F.array_sort(gone), F.array_repeat(F.lit(True), 0), lambda acc, i: F.concat(acc, F.array_repeat(F.lit(True), i - F.size(acc)), F.array(F.lit(False))))
    rows = rows.withColumn("__keep", F.when(F.col("__blocks").isNotNull(), flags))
    # Zipped, not looked up in the lambda: an expression in there would be computed for each line.
    text = F.array_join(F.transform(F.filter(F.zip_with(lines, "__keep", lambda x, k: F.struct(x.alias("x"), k.alias("k"))), lambda z: F.coalesce(z["k"], F.lit(True))), lambda z: z["x"]), "\n")
    text = F.when(F.col("__keep").isNotNull(), text).otherwise(F.col("text"))
    out = {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("__keep").isNotNull(), F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return rows.withColumns(out).withColumn(column, F.coalesce("__blocks", F.expr("cast(array() as array<struct<partner:long,first:int,last:int>>)"))).drop("__blocks", "__keep")
