"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become integers x = floor(256 c).  The fit list holds each distinct
integer vector once; its size n and column sums S are exact, so the centred rows
are (n x - S) / n.  On these rows A the bidiagonalisation alternates products
A v and A^T u: in each step the tasks multiply their blocks of rows by the new
direction and at once by its transpose, and one row of sums a task is added up
by Spark.  Left vectors are never stored: u = A w with w as long as a row, so
their inner products, and with them the reorthogonalisation of both sides (done
twice, against all vectors before), need no pass of their own.  The small
bidiagonal matrix is decomposed on the driver, which holds nothing larger than
dimension x dimension numbers.

The bidiagonalisation runs over the whole space: one pass a dimension.  When a
product vanishes it goes on from a new direction orthogonal to all before it, so
equal eigenvalues and dependent columns are found too.  Directions and their
order depend on the data alone; a component's largest entry is made positive.

Defined cases: a vector that is null or holds a null or non-finite entry gives
no rows; vectors shorter than the longest are taken to end in zeros; a null id
stays; repeated rows are each returned, while the fit list has them once;
components of no variance (rank below ``components``, one distinct vector) are
not returned; an empty table gives an empty table; other columns are not read.
Integers stay within the range of a long: entries beyond it are set to its ends.
A ``deviation`` beyond a long, possible from about 10^8 rows, is exact in
``deviation_digits`` (a string of digits) and null in ``deviation``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazetteer.llm.common import written

SCALE, COMPONENTS = 256, 4
BLOCK_ROWS = 4096
NOTHING = 1e-13  # a product this small beside the largest singular value is rounding


def integer_vectors(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, x) of the usable rows, x an array of longs."""
    entries = F.col("vector")
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(entries.isNotNull() & finite)
    largest = float(2**63 - 1024)
    whole = lambda c: F.floor(F.greatest(F.lit(-largest), F.least(F.lit(largest), c * SCALE))).cast("long")
    return rows.select("key", F.transform(entries, whole).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix of longs, short ones ending in zeros."""
    lengths = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    result = np.zeros((len(lengths), width), np.int64)
    result[np.arange(width) < lengths[:, None]] = flat
    return result


def _blocks(width: int):
    """Rows packed into blocks of little-endian longs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                x = _matrix(batch.column(0).slice(low, BLOCK_ROWS), width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.astype("<i8").tobytes()], pa.binary()), pa.array([len(x)])], names=["x", "rows"])

    return run


def _each_block(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for block in batch.column(0):
            yield np.frombuffer(block.as_buffer(), "<i8").reshape(-1, width)


def _summed(fit: DataFrame, width: int, size: int, work) -> np.ndarray:
    """Sum over all blocks of ``work(x)``, ``size`` numbers: added within a task, then by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for x in _each_block(batches, width):
            total += work(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["i", "v"])

    parts = fit.select("x").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    result = np.zeros(size)
    for row in parts:
        result[row["i"]] = row["v"]
    return result


def _column_sums(fit: DataFrame, width: int) -> list[int]:
    """Exact sums of the columns; halves of the numbers keep the partial sums of a task in a long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _each_block(batches, width):
            for half, part in enumerate((x & 0xFFFFFFFF, x >> 32)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(width) * 2 + half), pa.array(part.sum(axis=0))], names=["i", "v"])

    parts = fit.select("x").mapInArrow(run, "i long, v long")
    parts = parts.groupBy("i").agg(F.sum(F.col("v").cast("decimal(19,0)")).alias("v")).collect()
    halves = {row["i"]: int(row["v"]) for row in parts}
    return [halves.get(2 * i, 0) + (halves.get(2 * i + 1, 0) << 32) for i in range(width)]


def _orthogonal(v: np.ndarray, before: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v = v - before @ (before.T @ v)
    return v


def _fresh(before: np.ndarray, width: int) -> np.ndarray:
    """A unit vector orthogonal to the columns of ``before``: from a fixed stream of random directions."""
    stream = np.random.default_rng(before.shape[1])
    while True:
        v = _orthogonal(stream.standard_normal(width), before)
        size = np.linalg.norm(v)
        if size > 1e-3:
            return _orthogonal(v / size, before) / np.linalg.norm(_orthogonal(v / size, before))


def bidiagonalise(product, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper bidiagonal B and right vectors V with A V = U B.

    ``product(w)`` gives A^T A w and |A w|^2 from one pass over the rows of A.
    """
    right = np.zeros((width, 0))
    ways, seen = np.zeros((width, 0)), np.zeros((width, 0))  # u = A way and A^T u of the left vectors
    at: list[int] = []  # the step each left vector belongs to
    small = np.zeros((width, width))
    v, coupling, largest = _fresh(right, width), 0.0, 0.0
    for step in range(width):
        right = np.column_stack([right, v])
        way = v - coupling * ways[:, -1] if coupling else v.copy()
        back, length2 = product(way)  # A^T A way, |A way|^2
        for _ in range(2):  # against the left vectors: inner products are way' A^T A way
            overlap = ways.T @ back
            way, back = way - ways @ overlap, back - seen @ overlap
            length2 = max(0.0, length2 - float(overlap @ overlap))
        length = math.sqrt(length2)
        if coupling:
            small[at[-1], step] = coupling
        largest = max(largest, length)
        coupling = 0.0
        if length > NOTHING * largest and length > 0:
            way, back = way / length, back / length
            ways, seen = np.column_stack([ways, way]), np.column_stack([seen, back])
            at.append(step)
            small[step, step] = length
            if step + 1 < width:
                v = _orthogonal(back, right)
                size = float(np.linalg.norm(v))
                if size > NOTHING * largest:
                    coupling, v = size, v / size
                    largest = max(largest, size)
                    v = _orthogonal(v, right)
                    v = v / np.linalg.norm(v)
                    continue
        if step + 1 < width:
            v = _fresh(right, width)
    return small, right


def fit_components(fit: DataFrame, width: int, sums: list[int], n: int, components: int = COMPONENTS):
    """Eigenvalues (falling), components as columns, and the trace of the covariance of the fit list."""
    mean = np.array([s / n for s in sums])

    def product(way: np.ndarray) -> tuple[np.ndarray, float]:
        def work(x: np.ndarray) -> np.ndarray:
            centred = x.astype(np.float64) - mean
            along = centred @ way
            return np.append(centred.T @ along, along @ along)

        total = _summed(fit, width, width + 1, work)
        return total[:-1], float(total[-1])

    small, right = bidiagonalise(product, width)
    trace = float(_summed(fit, width, 1, lambda x: np.array([np.square(x.astype(np.float64) - mean).sum()]))[0]) / n
    _, values, turned = np.linalg.svd(small)
    values = values**2 / n
    found = min(components, int((values > max(trace, 0.0) * 1e-12).sum()) if trace > 0 else 0)
    vectors = right @ turned[:found].T
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(found)]) if found else np.ones(0)
    return values[:found], vectors * signs, trace


def _whitened(x: np.ndarray, mean: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return (x.astype(np.float64) - mean) @ vectors / np.sqrt(values)


def _deviations(x: np.ndarray, sums: list[int], n: int) -> list[int]:
    """Exact sums of (n x - S)^2 for each row."""
    rough = np.square(n * x.astype(np.float64) - np.array([float(s) for s in sums])).sum(axis=1)
    if len(rough) and rough.max() < 2.0**61 and n < 2**31 and np.abs(x).max() < 2**31:
        return np.square(n * x - np.array(sums, np.int64)).sum(axis=1).tolist()
    return [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """Rows (key, component, n, deviation, deviation_digits, whitened, explained, identity_error)."""
    rows = integer_vectors(df, vector, key)
    schema = T.StructType([
        T.StructField("key", rows.schema["key"].dataType), T.StructField("component", T.IntegerType()),
        T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
        T.StructField("deviation_digits", T.StringType()), T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not width:
        return df.sparkSession.createDataFrame([], schema)
    # Zeros at the end make vectors of unequal length comparable.
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))))
    fit = written(rows.select("x").distinct().mapInArrow(_blocks(width), "x binary, rows long"))
    n = fit.agg(F.sum("rows")).first()[0]
    sums = _column_sums(fit, width)
    values, vectors, trace = fit_components(fit, width, sums, n, components)
    found = len(values)
    mean = np.array([s / n for s in sums])
    if found:
        def moments(x: np.ndarray) -> np.ndarray:
            white = _whitened(x, mean, values, vectors)
            return (white.T @ white).ravel()

        covariance = _summed(fit, width, found * found, moments).reshape(found, found) / n
        error = float(np.abs(covariance - np.eye(found)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not found:
                continue
            x = _matrix(batch.column(1), width)
            white = _whitened(x, mean, values, vectors)
            far = _deviations(x, sums, n)
            every = np.repeat(np.arange(len(x)), found)
            size = len(every)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(every)),
                pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), len(x))), pa.array(np.full(size, n)),
                pa.array([d if d < 2**63 else None for d in far], pa.int64()).take(pa.array(every)),
                pa.array([str(d) for d in far], pa.string()).take(pa.array(every)),
                pa.array(white.ravel()), pa.array(np.tile(values / trace, len(x))), pa.array(np.full(size, error)),
            ], names=schema.names)

    return rows.mapInArrow(run, schema)
