"""Whitening embeddings with exact integer products: digit-slice GEMM.

Entries become integers, ``floor(64 * c) + 1000000``, so that the sum S of the n distinct vectors and the centred vectors
``n * x - S`` are exact. Their products are made by float64 BLAS without rounding: each integer is cut into signed limbs
of ``LIMB`` bits, and of so few rows at a time that a sum of limb products stays below 2**53. The products of
limbs are recombined as big integers, which go as 32-bit digits with a sign through an ordinary Spark sum, so that any number
of tasks merge without a float or an overflow. The covariance is then an exact fraction, rounded once per entry, and its
eigenvectors whiten all rows. The driver sees one row per cell of the covariance and digit, whatever the number of vectors.

Defined results: a row whose vector is null, or holds a null or an entry that is not finite, is left out, as is one without
entries, one with an entry that as an integer does not fit 62 bits, and one whose length is not the most common (of ties, the larger) one;
repeated vectors count once in the fit and are whitened each; components without variance do not exist, so
a table of one distinct vector, or of none, gives no rows; a deviation that does not fit a long is null; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import materialize

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
#: Bits of a limb, and rows of a block: 2**13 products of less than 2**(2 * 20) sum to less than 2**53.
LIMB = 20
ROWS = 1 << 13
#: Bits of the digits in which big integers are summed up.
DIGIT = 32
#: Whole numbers below this are exact as float64, and what fits 62 bits can be cut and centred as int64.
WIDE = 62


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """The rows that can be used, with the vector as integers x (array<long>)."""
    entries = F.transform("embedding", lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")))
    most = float(1 << WIDE)
    fits = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * SCALE + 2 * OFFSET < most))
    usable = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(fits, F.lit(False)))
    return usable.select("vec_id", F.transform(entries, lambda c: c.cast("long") + OFFSET).alias("x"))


def limbs(whole: np.ndarray, count: int) -> list[np.ndarray]:
    """Signed limbs of integers (int64 or object), lowest first, each below 2**(LIMB - 1) in size but the last."""
    out, half, base = [], 1 << (LIMB - 1), 1 << LIMB
    for _ in range(count - 1):
        low = (whole + half) % base - half
        out.append(low.astype(np.float64))
        whole = (whole - low) // base
    out.append(whole.astype(np.float64))
    return out


def limb_count(bits: int) -> int:
    """Limbs for signed integers below 2**bits in size, so that the last one stays below 2**LIMB too."""
    return max(1, -(-(bits + 1) // LIMB))


def gram(block: np.ndarray, count: int) -> np.ndarray:
    """The exact products block.T @ block of up to ROWS rows, as big integers."""
    parts = limbs(block, count)
    out = np.zeros((block.shape[1], block.shape[1]), object)
    for i in range(count):
        for j in range(i, count):
            exact = (parts[i].T @ parts[j]).astype(np.int64).astype(object)
            out += (exact if i == j else exact + exact.T) << (LIMB * (i + j))
    return out


def digits_of(n: int) -> list[int]:
    """Digits, lowest first, each with the number's sign."""
    sign, n, out = (1 if n >= 0 else -1), abs(n), []
    while n:
        out.append(sign * (n & ((1 << DIGIT) - 1)))
        n >>= DIGIT
    return out


def number_of(digits: list[tuple[int, int]]) -> int:
    """The integer of summed (place, digit) pairs, which may be larger than a digit by now."""
    return sum(d << (DIGIT * k) for k, d in digits)


@dataclass(frozen=True)
class Model:
    """n vectors with the sums S; components are columns, eigenvalues fall. bits bounds the centred integers n * x - S of the fit list."""

    n: int
    sums: tuple[int, ...]
    bits: int
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: int64 where that holds it, else Python integers."""
        small = self.bits <= WIDE and (len(x) == 0 or self.n * int(np.abs(x).max()) < 1 << WIDE)
        return x * np.int64(self.n) - np.array(self.sums, np.int64) if small else x.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) / self.n) @ self.vectors / np.sqrt(self.values)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            yield batch, _matrix(batch.column("x"), width)


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int], int]:
    """The number of vectors, the sums by dimension, and the largest entry by size; sums as digits, so that none overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, most = np.zeros(width, object), 0, 0
        for _, x in _blocks(batches, width):
            total += x.astype(object).sum(axis=0) if np.abs(x).max(initial=0) >= 1 << 48 else x.sum(axis=0).astype(object)
            n, most = n + len(x), max(most, int(np.abs(x).max(initial=0)))
        yield _digit_rows([*total, n], [most])

    merged = fit.select("x").mapInArrow(run, "cell int, digit int, value long, most long").groupBy("cell", "digit").agg(F.sum("value").alias("value"), F.max("most").alias("most"))
    found = merged.collect()  # a few digits for each dimension
    number = [number_of([(r.digit, r.value) for r in found if r.cell == c and r.digit >= 0]) for c in range(width + 1)]
    return number[-1], number[:-1], max((r.most for r in found if r.most is not None), default=0)


def _digit_rows(numbers: list[int], extra: list[int] | None = None) -> pa.RecordBatch:
    rows = [(c, k, d) for c, n in enumerate(numbers) for k, d in enumerate(digits_of(int(n)))]
    names, columns = ["cell", "digit", "value"], [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], []]
    arrays = [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())]
    if extra is not None:
        names, arrays = [*names, "most"], [*arrays, pa.array([extra[0]] * len(rows), pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _products(fit: DataFrame, n: int, sums: list[int], bits: int, width: int) -> list[int]:
    """The exact sums of products of the centred vectors, cell by cell of the upper triangle, row by row."""
    model = Model(n, tuple(sums), bits, np.empty(0), np.empty((0, 0)), 0.0)
    above = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), object)
        for _, x in _blocks(batches, width):
            total += gram(model.centred(x), limb_count(bits))
        yield _digit_rows(list(total[above]))

    merged = fit.select("x").mapInArrow(run, "cell int, digit int, value long").groupBy("cell", "digit").agg(F.sum("value").alias("value"))
    cells: dict[int, int] = {}
    for r in merged.collect():  # cells times digits rows
        cells[r.cell] = cells.get(r.cell, 0) + (r.value << (DIGIT * r.digit))
    return [cells.get(c, 0) for c in range(len(above[0]))]


def fitted(fit: DataFrame, width: int, components: int = COMPONENTS) -> Model:
    """The model of the distinct vectors x (array<long>) of a length; the table is read twice and never shuffled."""
    n, sums, most = _sums(fit, width)
    if n == 0:
        return Model(0, tuple(sums), 1, np.empty(0), np.empty((width, 0)), 0.0)
    bits = (2 * n * most).bit_length()
    cells = _products(fit, n, sums, bits, width)
    covariance = np.zeros((width, width))
    covariance[np.triu_indices(width)] = [float(Fraction(c, n**3)) for c in cells]
    covariance = np.triu(covariance) + np.triu(covariance, 1).T
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values.max(), 0) * width * np.finfo(float).eps]
    return Model(n, tuple(sums), bits, values[order], vectors[:, order], float(np.trace(covariance)))


def _identity_error(fit: DataFrame, model: Model, width: int) -> float:
    """The largest entry by size of the covariance of the whitened fit list, less the identity: a pass over the data."""
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for _, x in _blocks(batches, width):
            w = model.whitened(model.centred(x))  # centred exactly, so its mean is 0
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k), pa.int32()), pa.array(total.reshape(-1))], names=["cell", "value"])

    found = fit.select("x").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()  # k * k rows
    products = np.zeros(k * k)
    for r in found:
        products[r.cell] = r.value
    return float(np.abs(products.reshape(k, k) / model.n - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable row of (vec_id, embedding) and component.

    The distinct vectors are one shuffle, pre-aggregated, so that a vector that repeats without end costs no task more than another.
    """
    rows = materialize(whole_numbers(vectors), "whiten-rows")
    spark, kind = rows.sparkSession, rows.schema["vec_id"].dataType.simpleString()
    ddl = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if lengths is None:
        return spark.createDataFrame([], ddl)
    width = lengths.width
    rows = rows.where(F.size("x") == width)
    fit = materialize(rows.select("x").distinct(), "whiten-fit")
    model = fitted(fit, width, components)
    k = len(model.values)
    if k == 0:
        return spark.createDataFrame([], ddl)
    error, share = _identity_error(fit, model, width), model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, width):
            centred = model.centred(x)
            m = len(x)
            small = centred.dtype != object and int(np.abs(centred).max()) ** 2 * width < 1 << 63
            exact = (centred * centred).sum(axis=1) if small else (centred.astype(object) ** 2).sum(axis=1)
            deviation = pa.array([d if d < 1 << 63 else None for d in exact.tolist()], pa.int64())
            times = pa.array(np.repeat(np.arange(m), k))
            columns = [
                batch.column("vec_id").take(times), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n), pa.int64()), deviation.take(times),
                pa.array(model.whitened(centred).reshape(-1)), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, ddl)
