"""Token counts: whole documents encoded once, token spans joined to sections."""
import base64
import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's tokens part a text before merging (fixed by the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "last", "most")
SECTIONS = {"lines": rb"\n", "paragraphs": rb"\n(?:[ \t\r\x0b\x0c]*\n)+"}  # what ends a section; it belongs to the section
JOINER = "\n"  # between the fields of a document


def token_bytes(encoder, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of a whole text and the byte offsets where they start, with the end last."""
    ids = encoder["encode"](text)
    return ids, np.concatenate([[0], np.cumsum(encoder["lengths"][ids])]).astype(np.int64)


def section_spans(text: bytes, ends: re.Pattern) -> np.ndarray:
    """Byte offsets where the sections of a text start, with the end last. A section holds the break that
    ends it; a break at the very end starts no further section; an empty text is one empty section."""
    found = np.array([m.end() for m in ends.finditer(text)], dtype=np.int64)
    return np.concatenate([[0], found[found < len(text)], [len(text)]]).astype(np.int64)


def field_spans(fields: list[str]) -> tuple[str, np.ndarray]:
    """Fields joined to one text, and the byte offsets where they start, with the end last. The joiner
    belongs to the field before it."""
    raw = [(f + JOINER).encode() for f in fields[:-1]] + [fields[-1].encode()]
    return JOINER.join(fields), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def allocate(tokens: np.ndarray, sections: np.ndarray, rule: str) -> np.ndarray:
    """Tokens per section. Both are offsets with the end last; sections follow each other without gaps.
    A token that crosses a boundary counts for the section of its first byte (first), of its last byte
    (last), or the one with most of its bytes, the earlier of equal ones (most)."""
    n = len(sections) - 1
    if len(tokens) < 2:
        return np.zeros(n, dtype=np.int64)
    start, end = tokens[:-1], tokens[1:]
    first = np.searchsorted(sections, start, side="right") - 1
    if rule == "first":
        at = first
    else:
        at = last = np.searchsorted(sections, end - 1, side="right") - 1
        if rule == "most":
            at = first.copy()
            for i in np.flatnonzero(last > first):
                cut = np.clip(sections[first[i] : last[i] + 2], start[i], end[i])
                at[i] = first[i] + int(np.argmax(np.diff(cut)))
    return np.bincount(np.minimum(at, n - 1), minlength=n)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, rule: str = "first", sections: str | Sequence[str] = "lines") -> DataFrame:
    """One row per section of each document: doc_id, section (from 0), char_start, char_end (code points of
    the whole document, end exclusive, the break or joiner included) and tokens.

    sections: "lines" or "paragraphs" of the column text, or the names of string columns, the fields, which
    are joined by JOINER to one document (null fields are empty) and are a section each.

    The document is encoded as a whole, so counts are those of its own encoding, not of its sections
    encoded apart; they sum to the document's tokens. rule: see allocate(). A byte-level token can
    start inside a character; offsets are compared in bytes. Null and empty texts give one section
    without tokens. Strings of special tokens are ordinary text. Rows that repeat a doc_id each give
    their sections; an empty table gives none; other columns are not looked at.

    vocabulary is read by the driver and sent to the executors. No row is shuffled."""
    import pyarrow as pa

    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    if isinstance(sections, str) and sections not in SECTIONS:
        raise ValueError(f"sections is one of {sorted(SECTIONS)}, or a list of columns")
    fields = ["text"] if isinstance(sections, str) else list(sections)
    ends = re.compile(SECTIONS[sections]) if isinstance(sections, str) else None
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    cache: dict = {}

    def encoder() -> dict:
        if not cache:
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines()) if a}
            enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
            lengths = np.zeros(max(table.values()) + 1, dtype=np.int64)
            for piece, k in table.items():
                lengths[k] = len(piece)
            cache.update(encode=lambda t: enc.encode_to_numpy(t, disallowed_special=()), lengths=lengths)
        return cache

    def run(batches):
        enc = encoder()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out: list[list[np.ndarray]] = [[], [], [], []]
                counts = []
                for parts in zip(*(c.to_pylist() for c in batch.columns[1:])):
                    text, spans = field_spans([p or "" for p in parts])
                    raw = text.encode()
                    if ends:
                        spans = section_spans(raw, ends)
                    tokens = token_bytes(enc, text)[1]
                    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)])[spans]
                    n = len(spans) - 1
                    counts.append(n)
                    for x, y in zip(out, (np.arange(n), chars[:-1], chars[1:], allocate(tokens, spans, rule))):
                        x.append(y)
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), counts)))
                cols = [np.concatenate(x) for x in out]
                yield pa.RecordBatch.from_arrays([ids, pa.array(cols[0].astype(np.int32)), *(pa.array(c.astype(np.int64)) for c in cols[1:])], names=["doc_id", "section", "char_start", "char_end", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", *fields).mapInArrow(run, f"doc_id {kind}, section int, char_start long, char_end long, tokens long")
