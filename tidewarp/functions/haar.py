"""The Haar transform of series whose length is a power of two, a series per row.

Coefficients are laid out as [approximation, detail of level 0, level 1 (2), level 2 (4), ...]; level 0
halves the whole series. Everything is orthonormal. A detail times the root of its block's length is the
sum of the left half less that of the right one: the scaled coefficient."""
import hashlib

import numpy as np

TINY = 1e-9  # differences that come from the order of sums


def levels(length: int) -> int:
    return length.bit_length() - 1


def scaled(rows: np.ndarray) -> list[np.ndarray]:
    """Scaled coefficients per level: left sums less right sums of each block."""
    n, length = rows.shape
    return [(half := rows.reshape(n, 1 << k, 2, length >> (k + 1)).sum(axis=3))[:, :, 0] - half[:, :, 1] for k in range(levels(length))]


def haar(rows: np.ndarray) -> np.ndarray:
    length = rows.shape[1]
    parts = [x / np.sqrt(length >> k) for k, x in enumerate(scaled(rows))]
    return np.concatenate([rows.sum(axis=1, keepdims=True) / np.sqrt(length), *parts], axis=1)


def from_scaled(total: np.ndarray, details: list[np.ndarray], length: int) -> np.ndarray:
    """Series from their sums and scaled coefficients: each block's mean plus or minus its share."""
    out = np.repeat(total[:, None] / length, length, axis=1)
    for k, x in enumerate(details):
        block = length >> k
        sign = np.where(np.arange(length) % block < block // 2, 1.0, -1.0)
        out += sign * np.repeat(x, block, axis=1) / block
    return out


def inverse(coefficients: np.ndarray) -> np.ndarray:
    length = coefficients.shape[1]
    details = [coefficients[:, 1 << k : 2 << k] * np.sqrt(length >> k) for k in range(levels(length))]
    return from_scaled(coefficients[:, 0] * np.sqrt(length), details, length)


def tie_order(key: object, places: np.ndarray, seed: int) -> np.ndarray:
    """A seeded order among equal coefficients of a series: the first 60 bits of the MD5 of seed:key:place, which
    SQL has too."""
    return np.array([int(hashlib.md5(f"{seed}:{key}:{i}".encode()).hexdigest()[:15], 16) for i in places], dtype=np.int64)


def pruned(coefficients: np.ndarray, budget: float, by: str = "signed", seed: int = 0, key: object = "") -> np.ndarray:
    """One series' coefficients with small details set to 0, from the finest level up. A detail goes if
    the two below it are gone and its absolute scaled value is under what is left of the budget, which it
    uses up. Within a level they are tried in ascending order (by: signed or abs; equal ones, to nine digits, in tie_order of the series' key);
    the level ends when the budget does. The approximation always stays. What is within TINY of the budget counts as equal to it."""
    out = coefficients.copy()
    length = len(out)
    gone = np.zeros(2 * length, dtype=bool)
    gone[length:] = True  # below the finest level
    for k in reversed(range(levels(length))):
        at = np.arange(1 << k, 2 << k)
        value = np.round(out[at] if by == "signed" else np.abs(out[at]), 9) + 0.0
        ties = tie_order(key, at, seed) if len(np.unique(value)) < len(value) else at
        for i in at[np.lexsort((ties, value))]:
            cost = np.sqrt(length >> k) * abs(out[i])
            if gone[2 * i] and gone[2 * i + 1] and cost < budget - TINY:
                out[i], gone[i] = 0.0, True
                budget -= cost
                if budget <= TINY:
                    break
    return out
