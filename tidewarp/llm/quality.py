"""Quality classifier: ordinal regression of graded ratings on hashed text."""
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordinal

GRADES = 3  # low, usable (good but toxic), good
BITS = 13  # of the hashed features
CUT = 0.5  # P(grade >= 1) from which a document is selected
MASK = (1 << BITS) - 1


def token(name: str, *parts: int) -> int:
    return zlib.crc32(f"{name}:{':'.join(map(str, parts))}".encode()) & MASK


def features(text: bytes) -> np.ndarray:
    """A dense vector of 2^BITS: character n-grams of 1 to 3 bytes, hashed, as square roots of their
    shares; and bucketed measures of repetition and length as hashed tokens."""
    x = np.zeros(1 << BITS, dtype=np.float32)
    b = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
    n = len(b)
    for k, salt in ((1, 0x9E37), (2, 0x85EB), (3, 0xC2B2)):
        if n < k:
            break
        h = np.full(n - k + 1, salt, dtype=np.uint32)
        for j in range(k):
            h = (h ^ b[j : n - k + 1 + j]) * np.uint32(0x01000193)
        x += np.sqrt(np.bincount((h ^ (h >> np.uint32(15))) & np.uint32(MASK), minlength=1 << BITS) / (n - k + 1)).astype(np.float32)
    words = text.split()
    m = len(words)
    length = min(12, m.bit_length())
    if m:
        again = sum(map(bytes.__eq__, words[1:], words)) / m
        distinct = len(set(words)) / m
        lines = text.split(b"\n")
        for name, share in (("again", again), ("distinct", distinct), ("lines", len(set(lines)) / len(lines))):
            x[token(name, int(10 * share))] += 0.5
            x[token(name, int(10 * share), length)] += 0.5
    x[token("length", length)] += 0.3
    return x


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """From all labels (quality and toxic, 0 or 1): grade 0 is low quality, 1 good but toxic, 2 good."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    blocks = ordinal.feature_blocks(ordinal.labelled(docs, labels, grade), features)
    grades = {r.grade for r in blocks.select("grade").distinct().collect()}
    if 0 not in grades or len(grades) == 1:
        return {"w": np.zeros(1 << BITS), "theta": np.array([-9.0, -8.0])}  # nothing to tell apart: all stay
    w, theta = ordinal.fit_all(blocks, 1 << BITS, GRADES)
    return {"w": w, "theta": theta}


def quality(docs: DataFrame, labels: DataFrame, cut: float = CUT, only: bool = False) -> DataFrame:
    """docs without text, with grade (expected, from 0 to 2), grade_tail (P(grade >= 1)) and selected
    (from cut on); with only, the selected rows of docs as they were.

    Null and empty texts have the features of length 0. Texts are read whole; rows return as often as
    they come; an empty table returns none; without labelled rows on both sides every row is selected;
    columns of docs with the names added are replaced. The model is fitted on all labelled rows; only their
    texts are shuffled, if the labels are few enough to be broadcast."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    theta = model.value["theta"]
    cache: dict = {}

    def score(text: bytes) -> float:
        if not cache:
            cache["w"] = model.value["w"].astype(np.float32)
        return float(cache["w"] @ features(text))

    return ordinal.scored(docs, score, theta, "grade", "selected", lambda p: p >= cut, only)
