"""Functions of series. Columns are arrays of doubles; matrices hold a series per row."""
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gauss(half: int, sigma: float) -> list[float]:
    """A Gaussian kernel of 2 * half + 1 weights with sum 1."""
    x = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    return (x / x.sum()).tolist()


def smoothed(rows: np.ndarray, kernel: list[float]) -> np.ndarray:
    """Centred weighted mean; at the ends the weights that are left are scaled to sum 1."""
    half, n = len(kernel) // 2, rows.shape[1]
    total, weight = np.zeros_like(rows), np.zeros(n)
    for d, k in zip(range(-half, half + 1), kernel):
        a, z = max(0, -d), min(n, n - d)
        if a < z:
            total[:, a:z] += k * rows[:, a + d : z + d]
            weight[a:z] += k
    return total / weight


def gradient(rows: np.ndarray) -> np.ndarray:
    """Half the difference of both neighbours; at the ends the difference to the one."""
    if rows.shape[1] < 2:
        return np.zeros_like(rows)
    inner = (rows[:, 2:] - rows[:, :-2]) / 2
    return np.concatenate([rows[:, 1:2] - rows[:, :1], inner, rows[:, -1:] - rows[:, -2:-1]], axis=1)


SMOOTH1, SMOOTH2 = gauss(10, 1.0), gauss(10, 2.0)
_STEPS = {"log": np.log1p, "smooth1": lambda x: smoothed(x, SMOOTH1), "smooth2": lambda x: smoothed(x, SMOOTH2), "gradient": gradient}
#: Names of transforms, and the steps that they take in order.
TRANSFORMS: dict[str, tuple[str, ...]] = {
    "id": (), "log": ("log",), "smooth1": ("smooth1",), "smooth2": ("smooth2",), "log_smooth1": ("log", "smooth1"), "log_smooth2": ("log", "smooth2"),
    "gradient": ("gradient",), "loggradient": ("log", "gradient"), "gradient_smooth1": ("smooth1", "gradient"), "gradient_smooth2": ("smooth2", "gradient"),
    "loggradient_smooth1": ("log", "smooth1", "gradient"), "loggradient_smooth2": ("log", "smooth2", "gradient"),
}
NORMS = {
    "id": lambda x: x,
    "max": lambda x: x / np.where((m := x.max(axis=1, keepdims=True)) == 0, 1, m),
    "avg": lambda x: x / np.where((m := x.mean(axis=1, keepdims=True)) == 0, 1, m),
}


def transform_rows(rows: np.ndarray, transform: str = "id", norm: str = "id") -> np.ndarray:
    for step in TRANSFORMS[transform]:
        rows = _STEPS[step](rows)
    return NORMS[norm](rows)


def matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists without nulls, as a matrix; no copy per value."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def lists(rows: np.ndarray):
    """A matrix as an Arrow column of lists."""
    import pyarrow as pa

    offsets = np.arange(0, rows.size + 1, rows.shape[1] or 1, dtype=np.int32)[: len(rows) + 1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows, dtype=np.float64).ravel()))


def sliced(batches: Iterable, rows: int = 1024) -> Iterator:
    """Arrow batches in pieces of so many rows at most, for functions that make many values of each. No piece is empty."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def transformed(series: DataFrame, transform: str = "id", norm: str = "id", column: str = "series") -> DataFrame:
    """series with every array of column transformed by name, then normalised, in Arrow batches."""
    if transform not in TRANSFORMS or norm not in NORMS:
        raise ValueError(f"transform is one of {sorted(TRANSFORMS)}, norm one of {sorted(NORMS)}")

    def run(parts):
        for batch in sliced(parts):
            at = batch.schema.get_field_index(column)
            rows = matrix(batch.column(at)).astype(np.float64)
            yield batch.set_column(at, column, lists(transform_rows(rows, transform, norm)))

    return series.withColumn(column, F.col(column).cast("array<double>")).mapInArrow(run, series.withColumn(column, F.col(column).cast("array<double>")).schema)


# Column functions: plans that stay in the JVM.


def squared_distance(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def paa(x: Column, segments: int, length: int) -> Column:
    """Means of equal segments."""
    rate = length // segments
    return F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda k: F.aggregate(F.slice(x, k * rate + 1, F.lit(rate)), F.lit(0.0), lambda s, v: s + v) / rate)


def downsampled(x: Column, segments: int, length: int, start, merge: Callable[[Column, Column], Column], finish: Callable[[Column], Column] = lambda v: v) -> Column:
    """Equal segments folded by any function: start, merge(so far, value), and finish. paa is the mean."""
    rate = length // segments
    return F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda k: F.aggregate(F.slice(x, k * rate + 1, F.lit(rate)), F.lit(start), merge, finish))


def power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def spectrum(series: DataFrame) -> DataFrame:
    """id, series: the amplitudes of the real Fourier transform of each series scaled to sum 1, without
    the constant. A series with sum 0 is left as it is."""

    def run(parts):
        import pyarrow as pa

        for batch in sliced(parts):
            rows = matrix(batch.column(1))
            if len(rows):
                total = rows.sum(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), lists(np.abs(np.fft.rfft(rows / np.where(total == 0, 1, total), axis=1))[:, 1:])], names=["id", "series"])

    return series.select("id", F.col("series").cast("array<double>")).mapInArrow(run, "id long, series array<double>")


def gradient_colors(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """RGB (0 to 1) of pairs of gradients: the two gradients are the opponent axes of CIE Lab, their
    strength the lightness. Values are cut to [-1, 1] and boosted by the power 0.3."""
    boost = lambda g: np.sign(g) * np.abs(np.clip(g, -1, 1)) ** 0.3
    a, b = boost(first), boost(second)
    light = 100 * np.minimum(1, np.hypot(a, b))
    fy = (light + 16) / 116
    inverse = lambda t: np.where(t > 6 / 29, t**3, 3 * (6 / 29) ** 2 * (t - 4 / 29))
    xyz = np.stack([0.95047 * inverse(fy + 100 * a / 500), inverse(fy), 1.08883 * inverse(fy - 100 * b / 200)])
    linear = np.array([[3.2406, -1.5372, -0.4986], [-0.9689, 1.8758, 0.0415], [0.0557, -0.2040, 1.0570]]) @ xyz.reshape(3, -1)
    linear = np.clip(linear, 0, 1)
    rgb = np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * linear ** (1 / 2.4) - 0.055)
    return rgb.reshape(xyz.shape)
