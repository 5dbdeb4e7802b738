"""Embedding whitening from exact bit-sliced cross-products.

Entries become integers x = floor(1024 * entry) + 100000. In every block of rows each dimension is
shifted by its smallest value and cut into bit planes, packed across rows into 64-bit words. The
cross-product of two dimensions is then a sum of AND-popcounts of their planes, weighted by powers of
two: exact, whatever the offset. Blocks are brought to one origin and added up as integers, the
covariance is centred as an integer, and only its quotient meets floating point before eigh.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from itertools import combinations_with_replacement
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import stage

COMPONENTS = 8
# Fixed values of the integer scale.
SCALE, ORIGIN = 1024, 100_000
LIMIT = 2.0**62
BLOCK_ROWS, BLOCK_VALUES = 8192, 1 << 22
LIMB = 48
#: Components with less than this share of the largest variance are numerically without variance.
RANK = 1e-11


class Whitening(NamedTuple):
    """Of the fit list: rows, sums per dimension; per component its unit vector, variance and share of all variance."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    explained: np.ndarray


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows with non-empty vectors of finite entries only."""
    values = F.col("embedding").cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))  # NaN is larger than any
    return vectors.select("vec_id", values.alias("embedding")).where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)


def common_width(rows: DataFrame) -> int:
    """The length that most vectors have, of equally frequent ones the smallest; 0 without vectors."""
    top = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    return top["width"] if top else 0


def integers(column: pa.ListArray, width: int) -> np.ndarray:
    values = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * SCALE), -LIMIT, LIMIT).astype(np.int64) + ORIGIN


def bit_planes(y: np.ndarray) -> np.ndarray:
    """Planes (dimension, bit, word) of the unsigned values y (row, dimension), 64 rows to a word."""
    rows, width = y.shape
    bits = int(y.max()).bit_length()
    packed = np.zeros((width, bits, -(-rows // 64) * 8), np.uint8)
    for bit in range(bits):
        plane = ((y >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8)
        packed[:, bit, : -(-rows // 8)] = np.packbits(plane, axis=0).T
    return packed.view(np.uint64)


def cross_products(planes: np.ndarray) -> np.ndarray:
    """Sums over rows of the products of two dimensions, j >= i, from the planes."""
    width, bits, words = planes.shape
    kind = np.int64 if 2 * bits + (64 * words).bit_length() < 62 else object
    weight = np.array([1 << b for b in range(bits)], dtype=kind)
    out = np.zeros((width, width), dtype=object)
    for i in range(width):
        row = np.zeros(width - i, dtype=kind)
        for bit in range(bits):
            shared = np.bitwise_count(planes[i:] & planes[i, bit]).sum(axis=-1, dtype=np.int64).astype(kind)
            row = row + (shared @ weight) * weight[bit]
        out[i, i:] = row
    return out


def block_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of x - ORIGIN over the rows of a block, as Python integers."""
    least = x.min(axis=0)
    planes = bit_planes(x.view(np.uint64) - least.view(np.uint64))
    counts = np.bitwise_count(planes).sum(axis=-1, dtype=np.int64).astype(object)
    shifted = counts @ np.array([1 << b for b in range(planes.shape[1])], dtype=object) if planes.shape[1] else np.zeros(x.shape[1], dtype=object)
    offset = least.astype(object) - ORIGIN
    cross = cross_products(planes) + np.outer(offset, shifted) + np.outer(shifted, offset) + len(x) * np.outer(offset, offset)
    return shifted + len(x) * offset, cross


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    place = 0
    while not -(1 << 62) <= value < 1 << 62:
        yield place, value & ((1 << LIMB) - 1)
        value >>= LIMB
        place += 1
    if value or not place:
        yield place, value


def scatter(rows: DataFrame, width: int) -> dict[tuple[int, int], int]:
    """Exact sums of x - ORIGIN over all rows: (i, j) products, (-1, i) values, (-1, -1) rows.

    A task adds up its blocks and hands over width * (width + 3) / 2 + 1 integers, in limbs that a long holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, np.zeros(width, dtype=object), np.zeros((width, width), dtype=object)
        step = max(64, min(BLOCK_ROWS, BLOCK_VALUES // width))
        for batch in batches:
            x = integers(batch.column("embedding"), width)
            for start in range(0, len(x), step):
                block = np.ascontiguousarray(x[start : start + step])
                s, c = block_sums(block)
                n, sums, cross = n + len(block), sums + s, cross + c
        if n:
            entries = [(-1, -1, n)] + [(-1, i, int(s)) for i, s in enumerate(sums)]
            entries += [(i, j, int(cross[i, j])) for i, j in combinations_with_replacement(range(width), 2)]
            cells = [(i, j, place, limb) for i, j, value in entries for place, limb in _limbs(value)]
            i, j, place, limb = zip(*cells)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(place, pa.int32()), pa.array(limb, pa.int64())], ["i", "j", "place", "limb"])

    parts = rows.where(F.size("embedding") == width).select("embedding").mapInArrow(run, "i int, j int, place int, limb long")
    total: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("i", "j", "place").agg(F.sum(F.col("limb").cast("decimal(20,0)")).alias("limb")).collect():
        total[r.i, r.j] = total.get((r.i, r.j), 0) + (int(r.limb) << (LIMB * r.place))
    return total


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``usable`` rows, from those of the ``common_width``; None without rows."""
    width = common_width(rows)
    total = scatter(rows, width) if width else {}
    if not total:
        return None
    n, z = total[-1, -1], [total[-1, i] for i in range(width)]
    v = np.empty((width, width))
    for i, j in combinations_with_replacement(range(width), 2):
        v[i, j] = v[j, i] = (n * total[i, j] - z[i] * z[j]) / (n * n)  # integers up to this correctly rounded quotient
    variances, vectors = np.linalg.eigh(v)
    variances, axes = variances[::-1][:components], vectors.T[::-1][:components]
    varied = variances > RANK * max(variances[0], 0.0)
    variances, axes = variances[varied], axes[varied]
    if len(axes):
        strongest = axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)]
        axes = axes * np.sign(strongest)[:, None]
    explained = variances / np.trace(v) if len(axes) else variances
    return Whitening(n, [s + n * ORIGIN for s in z], axes, variances, explained)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, pa.Array]:
    """x - S/n as doubles, and the exact sums of (n*x - S)^2; null where 38 digits don't hold one."""
    largest = max(abs(int(x.min())), abs(int(x.max()))) * n + max(map(abs, sums))
    if largest < 1 << 62:
        centred = x * n - np.array(sums, dtype=np.int64)
        top = int(np.abs(centred).max())
        if top * top * x.shape[1] < 1 << 62:
            return centred / n, pa.array((centred * centred).sum(axis=1)).cast(pa.decimal128(38, 0))
        exact = (centred.astype(object) ** 2).sum(axis=1)
        return centred / n, _decimals(exact)
    centred = x.astype(object) * n - np.array(sums, dtype=object)
    return np.array([[value / n for value in row] for row in centred]), _decimals((centred**2).sum(axis=1))


def _decimals(values: np.ndarray) -> pa.Array:
    return pa.array([Decimal(int(v)) if v < 10**38 else None for v in values], pa.decimal128(38, 0))


def transform(rows: DataFrame, fitted: Whitening) -> DataFrame:
    """(vec_id, deviation decimal(38,0), whitened array<double>) of the ``usable`` rows as long as the fitted ones."""
    n, sums, axes, variances, _ = fitted
    width = len(sums)
    scaled = (axes / np.sqrt(variances)[:, None]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = integers(batch.column("embedding"), width)
                centred, deviation = _deviations(x, n, sums)
                white = centred @ scaled
                offsets = np.arange(0, white.size + 1, white.shape[1], dtype=np.int32) if white.shape[1] else np.zeros(len(x) + 1, np.int32)
                whitened = pa.ListArray.from_arrays(offsets, white.ravel())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, whitened], ["vec_id", "deviation", "whitened"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.where(F.size("embedding") == width).mapInArrow(run, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(white: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity; two passes, so centred before multiplying."""
    if not components:
        return 0.0
    value = [F.col("whitened")[k] for k in range(components)]
    means = white.agg(*[F.avg(v).alias(f"m{k}") for k, v in enumerate(value)]).first()
    centred = [v - F.lit(m) for v, m in zip(value, means)]
    pairs = list(combinations_with_replacement(range(components), 2))
    found = white.agg(*[F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per vector and component.

    ``vectors`` has vec_id and embedding; further columns are ignored. Rows whose vector is null or
    empty or holds null, NaN or infinite entries are left out, and so are vectors of another length than
    most have (of equally frequent lengths the smallest counts). Repeated rows and ids count and are
    returned as often as they occur. Fewer rows per vector are returned where it has fewer dimensions,
    and components without variance (single or constant vectors) are left out. Entries beyond 2^62 / 1024
    count as that. deviation is null where 38 digits don't hold it. An empty table gives no rows.
    """
    rows = usable(vectors)
    fitted = fit(rows, components)
    if fitted is None or not len(fitted.axes):
        return rows.where(F.lit(False)).select(
            "vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("deviation"),
            F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"),
        )
    white = stage(transform(rows, fitted), "whitened")
    error = identity_error(white, len(fitted.axes))
    shares = F.array(*[F.lit(float(e)) for e in fitted.explained])
    return white.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "value")).select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation",
        F.col("value").alias("whitened"), F.get(shares, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"),
    )
