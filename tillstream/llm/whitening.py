"""Whitening of embeddings by a bit-sliced scatter matrix.

Entries become whole numbers, floor(``scale`` * entry). Each distinct vector counts once. A task packs,
for every dimension, the bits of equal weight of 64 rows into one word, after a shift that makes all
numbers at least 0; the weighted popcounts of the words' conjunctions are the sums of products, exactly.
The tasks' sums are whole numbers too, so the total doesn't depend on how rows were dealt. It is
centred as whole numbers, n * sum(xy) - sum(x) * sum(y), and only then divided, for ``eigh``.

A vector that is null, or has a null or non-finite entry, is dropped; so is one whose length isn't the
most frequent (of several, the longest). Entries beyond 2^62 / ``scale`` count as that. Directions
without variance (below ``RANK`` of the largest) can't be whitened and give no component; with one
distinct vector there is none. ``deviation`` is null where it doesn't fit a long. Repeated rows and rows
without id have results of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstream.session import materialise

SCALE = 64
#: Added to every number, for the reports; sums are built without it.
ORIGIN = 1_000_000
COMPONENTS = 16
RANK = 1e-12
#: Numbers of a task packed together.
CELLS = 1 << 20
_LARGEST = 2.0**62


def whole_vectors(table: DataFrame, vec_col: str, scale: int, *others: Column) -> tuple[DataFrame, int]:
    """``others`` and y, the vector in whole numbers, of the rows kept; and its length."""
    entry = F.col(vec_col)
    finite = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    rows = table.where(entry.isNotNull()).where(F.coalesce(finite, F.lit(False)))
    lengths = rows.groupBy(F.size(entry).alias("d")).count()  # a row for every length
    most = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    width = most["d"] if most else 0
    whole = F.transform(entry, lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-_LARGEST)), F.lit(_LARGEST))).cast("bigint"))
    return rows.where(F.size(entry) == width).select(*others, whole.alias("y")), width


def _blocks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, numbers) for pieces of a batch of bounded size."""
    flat = batch["y"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    step = max(64, CELLS // width)
    for lo in range(0, len(flat), step):
        yield lo, flat[lo : lo + step]


def cross_products(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of entries and of products of entries over all rows, as Python's whole numbers."""
    rows, width = y.shape
    low = y.min(0)
    shifted = y.view(np.uint64) - low.view(np.uint64)
    planes = [max(1, int(top).bit_length()) for top in shifted.max(0)]  # of each dimension
    first = np.concatenate([[0], np.cumsum(planes)[:-1]])
    dim = np.repeat(np.arange(width), planes)
    bit = (np.arange(len(dim)) - first[dim]).astype(np.uint64)
    packed = np.zeros((len(dim), -(-rows // 64) * 8), np.uint8)
    for k in range(len(dim)):
        bits = np.packbits(((shifted[:, dim[k]] >> bit[k]) & np.uint64(1)).astype(np.uint8))
        packed[k, : len(bits)] = bits
    packed = packed.view(np.uint64)
    both = np.zeros((len(dim), len(dim)), np.int64)
    for k in range(len(dim)):
        both[k, k:] = both[k:, k] = np.bitwise_count(packed[k] & packed[k:]).sum(1, dtype=np.int64)
    # Weights and sums in 64 bits where they fit, else in numbers of any size.
    fits = 2 * max(planes) + int(rows).bit_length() <= 62
    weight = np.array([1 << int(b) for b in bit], np.int64 if fits else object)
    own = np.add.reduceat(np.diag(both) * weight, first).astype(object)
    cross = np.add.reduceat(np.add.reduceat(both * weight[:, None] * weight, first, 0), first, 1).astype(object)
    shift = low.astype(object)
    sums = own + rows * shift
    return sums, cross + np.multiply.outer(shift, own) + np.multiply.outer(own, shift) + rows * np.multiply.outer(shift, shift)


def scatter(fit: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums of entries and of products of entries; the driver gets one number for each pair of dimensions."""
    upper = [(i, j) for i in range(width) for j in range(i, width)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            for _, y in _blocks(batch, width):
                s, c = cross_products(np.ascontiguousarray(y))
                n, sums, cross = n + len(y), sums + s, cross + c
        if n:
            i = [-1, *range(width), *(a for a, _ in upper)]
            j = [-1, *[-1] * width, *(b for _, b in upper)]
            value = [Decimal(int(v)) for v in [n, *sums, *(cross[a, b] for a, b in upper)]]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(value, pa.decimal128(38, 0))], names=["i", "j", "value"])

    parts = fit.mapInArrow(add, "i int, j int, value decimal(38, 0)").groupBy("i", "j").agg(F.sum("value").alias("value"))
    n, sums, cross = 0, np.zeros(width, object), np.zeros((width, width), object)
    for i, j, value in parts.collect():
        if i < 0:
            n = int(value)
        elif j < 0:
            sums[i] = int(value)
        else:
            cross[i, j] = cross[j, i] = int(value)
    return n, sums, cross


class Whitening:
    """Components of the covariance, and what they make of a vector."""

    def __init__(self, n: int, sums: np.ndarray, cross: np.ndarray, components: int):
        self.n, self.sums = n, sums
        centred = n * cross - np.multiply.outer(sums, sums)
        self.covariance = np.array([[int(v) / (n * n) for v in row] for row in centred], float).reshape(centred.shape)
        value, vector = np.linalg.eigh(self.covariance)
        value, vector = value[::-1], vector[:, ::-1]
        kept = np.flatnonzero(value > RANK * max(value[0], 0.0))[:components] if value[0] > 0 else []
        self.value, vector = value[kept], vector[:, kept]
        # the entry of largest size is positive
        self.vector = vector * np.sign(vector[np.abs(vector).argmax(0), np.arange(len(kept))])
        self.explained = self.value / np.trace(self.covariance)
        self.mean = np.array([int(s) / n for s in sums])

    def apply(self, y: np.ndarray) -> np.ndarray:
        return (y - self.mean) @ self.vector / np.sqrt(self.value)

    def deviation(self, y: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, the same for x with and without the origin."""
        reach = int(np.abs(y).max(initial=0)) * self.n + max(abs(int(s)) for s in self.sums)
        if reach * reach * y.shape[1] < 2**63:
            off = self.n * y - self.sums.astype(np.int64)
            return (off * off).sum(1).tolist()
        off = self.n * y.astype(object) - self.sums
        return [v if v < 2**63 else None for v in map(int, (off * off).sum(1))]


def _identity_error(fit: DataFrame, shared, width: int) -> float:
    """Largest entry of the whitened fit list's covariance less the identity."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(shared.value.value)
        total = np.zeros((size + 1, size))
        for batch in batches:
            for _, y in _blocks(batch, width):
                z = shared.value.apply(y)
                total += np.concatenate([z.sum(0)[None], z.T @ z])
        i, j = np.indices(total.shape).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "value"])

    size, n = len(shared.value.value), shared.value.n
    total = np.zeros((size + 1, size))
    for i, j, value in fit.mapInArrow(add, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value")).collect():
        total[i, j] = value
    mean = total[0] / n
    return float(np.abs(total[1:] / n - np.outer(mean, mean) - np.eye(size)).max(initial=0.0))


def whitening_report(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every kept row and component."""
    rows, width = whole_vectors(table, vec_col, scale, F.col(id_col).cast("bigint").alias("vec_id"))
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not width:
        return table.sparkSession.createDataFrame([], schema)
    fit = materialise(rows.select("y").distinct(), "vectors")
    shared = table.sparkSession.sparkContext.broadcast(Whitening(*scatter(fit, width), components))  # a number for each pair of dimensions
    error = _identity_error(fit, shared, width)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        size = len(model.value)
        for batch in batches:
            for lo, y in _blocks(batch, width):
                rows = len(y)
                each = pa.array(np.repeat(np.arange(rows), size))
                arrays = [
                    batch["vec_id"].slice(lo, rows).take(each),
                    pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * size, model.n)),
                    pa.array(model.deviation(y), pa.int64()).take(each),
                    pa.array(model.apply(y).ravel()),
                    pa.array(np.tile(model.explained, rows)),
                    pa.array(np.full(rows * size, error)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(emit, schema)
