"""Whitening of embeddings from an exact, bit-sliced scatter matrix.

Every entry c becomes the integer x = floor(64 c) + 1,000,000. A task shifts each dimension of a block by the block's
least value, cuts the shifted numbers into bit planes, packs a plane's bits of 64 rows into one word, and gets every
cross-product of two dimensions as the weighted sum of the bits set in the AND of their planes. Shifts are undone in
integers, so counts, sums and cross-products of the whole table are exact whatever way its rows are dealt out. They are
centred as integers too, n * sum(x y) - sum(x) sum(y), and only then divided and handed to ``eigh``.

What reaches the driver are sums for each pair of dimensions; nothing there grows with the rows.

Defined results: rows with a null vector, or a vector with a null, NaN or infinite entry, are dropped; an empty table, or
one without vectors left, gives no rows; repeated rows and null ids are rows of their own; further columns are not read.
Equal eigenvalues share their plane, in which any basis is right. A component without variance (its eigenvalue is zero
to double precision, as where vectors are fewer than dimensions or a dimension is constant) cannot be whitened and has no rows. ``deviation``
is null where the exact number exceeds a long, and ``deviation_exact`` has it then, null beyond 38 digits. Vectors of different widths have no
covariance: the query fails and says so, and so it does for an entry whose x leaves the range of a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: bits of a limb, in which tasks hand over integers of any size
LIMB = 30
#: rows packed at a time
BLOCK = 8192
LONG = 1 << 62


def clean_vectors(table: DataFrame, vector: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """``vec_id, vector`` (doubles) of the rows whose vector is whole and finite."""
    entries = F.col(vector).cast("array<double>")
    broken = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return table.where(F.col(vector).isNotNull()).where(~broken).select(F.col(id_column).cast("long").alias("vec_id"), entries.alias("vector"))


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch as a matrix of doubles."""
    widths = np.unique(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    if len(widths) > 1:
        raise ValueError(f"vectors of different widths ({', '.join(map(str, widths))}) have no common covariance")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), int(widths[0]) if len(widths) else 0)


def _integers(vectors: np.ndarray) -> np.ndarray:
    """x - OFFSET of every entry, exact: a multiple of 64 loses no bit of a double."""
    scaled = np.floor(vectors * SCALE)
    if scaled.size and np.abs(scaled).max() >= LONG:
        raise OverflowError("an entry is too large for an x of 64 bits")
    return scaled.astype(np.int64)


def bit_planes(numbers: np.ndarray, bits: int) -> np.ndarray:
    """``[dimension * bits, words]``: plane p of dimension i holds bit p of each row of column i, 64 rows to a word."""
    rows, dims = numbers.shape
    words = -(-rows // 64)
    planes = np.zeros((dims, bits, words * 8), np.uint8)
    columns = np.ascontiguousarray(numbers.T)
    for p in range(bits):
        planes[:, p, : -(-rows // 8)] = np.packbits(((columns >> p) & 1).astype(np.uint8), axis=1)
    return planes.reshape(dims * bits, words * 8).view(np.uint64)


def scatter(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of the columns and of the products of columns, as Python integers, from ANDs of bit planes."""
    rows, dims = numbers.shape
    low = numbers.min(axis=0)
    if any(int(h) - int(b) >= LONG for h, b in zip(numbers.max(axis=0), low)):
        raise OverflowError("the entries of a dimension lie too far apart")
    shifted = numbers - low
    bits = max(1, int(shifted.max()).bit_length())
    planes = bit_planes(shifted, bits)
    both = np.zeros((len(planes), len(planes)), np.int64)
    for a, plane in enumerate(planes):
        both[a, a:] = np.bitwise_count(planes[a:] & plane).sum(axis=1, dtype=np.int64)
    # counts of plane pairs are symmetric; a diagonal pair counts once
    both += np.triu(both, 1).T
    kind = np.int64 if 2 * bits + rows.bit_length() < 62 else object
    weight = np.array([1 << p for p in range(bits)], object).astype(kind)
    products = ((both.astype(kind).reshape(dims, bits, dims, bits) * weight[:, None, None]).sum(axis=1) * weight).sum(axis=2).astype(object)
    ones = np.array([int(v) for v in (np.diagonal(both).reshape(dims, bits).astype(kind) * weight).sum(axis=1)], object)
    origin = np.array([int(v) for v in low], object)
    sums = ones + rows * origin
    return sums, products + np.outer(origin, ones) + np.outer(ones, origin) + rows * np.outer(origin, origin)


def _limbs(value: int) -> list[int]:
    """A signed integer below 2^180 as six signed parts whose sums over tasks stay far inside a long."""
    sign, value = (-1, -value) if value < 0 else (1, value)
    if value >> (6 * LIMB):
        raise OverflowError("a sum of products exceeds 180 bits")
    return [sign * ((value >> (LIMB * k)) & ((1 << LIMB) - 1)) for k in range(6)]


PARTS = [f"p{k}" for k in range(6)]


class Totals(NamedTuple):
    """Exact totals of the table around the origin OFFSET."""

    n: int
    sums: list[int]
    products: list[list[int]]

    def covariance(self) -> np.ndarray:
        """Centred as integers, divided last; true division of Python integers rounds once."""
        d = range(len(self.sums))
        return np.array([[(self.n * self.products[i][j] - self.sums[i] * self.sums[j]) / (self.n * self.n) for j in d] for i in d], float).reshape(len(d), len(d))


def totals(vectors: DataFrame) -> Totals | None:
    """Number of rows, sums and cross-products over all vectors; None without any."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, products = 0, None, None
        for batch in batches:
            whole = _matrix(batch.column(0))
            for at in range(0, len(whole), BLOCK):
                part = _integers(whole[at : at + BLOCK])
                if sums is None:
                    sums, products = np.zeros(part.shape[1], object), np.zeros((part.shape[1],) * 2, object)
                if len(sums) != part.shape[1]:
                    raise ValueError(f"vectors of different widths ({len(sums)}, {part.shape[1]}) have no common covariance")
                count += len(part)
                if len(sums):
                    s, p = scatter(part)
                    sums, products = sums + s, products + p
        if count:
            d = len(sums)
            # i = -2: rows and width, i = -1: sums, otherwise the upper triangle of the products
            rows = [(-2, d, count)] + [(-1, j, sums[j]) for j in range(d)] + [(i, j, products[i, j]) for i in range(d) for j in range(i, d)]
            limbs = list(zip(*(_limbs(int(v)) for *_, v in rows)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), *[pa.array(x, pa.int64()) for x in limbs]], ["i", "j", *PARTS])

    parts = vectors.select("vector").mapInArrow(add, "i int, j int, " + ", ".join(f"{p} long" for p in PARTS))
    found = {(r["i"], r["j"]): sum(r[p] << (LIMB * k) for k, p in enumerate(PARTS)) for r in parts.groupBy("i", "j").agg(*[F.sum(p).alias(p) for p in PARTS]).collect()}
    widths = [j for i, j in found if i == -2]
    if len(widths) > 1:
        raise ValueError(f"vectors of different widths ({', '.join(map(str, sorted(widths)))}) have no common covariance")
    if not widths:
        return None
    d = range(widths[0])
    return Totals(found[-2, widths[0]], [found[-1, j] for j in d], [[found[min(i, j), max(i, j)] for j in d] for i in d])


class Basis(NamedTuple):
    """What a row needs: exact sums, and the map to whitened components."""

    n: int
    sums: list[int]
    mean: np.ndarray
    whitener: np.ndarray
    explained: np.ndarray

    def whiten(self, numbers: np.ndarray) -> np.ndarray:
        return (numbers - self.mean) @ self.whitener

    def deviations(self, numbers: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, exact: machine integers while they suffice, Python's beyond."""
        if not numbers.size:
            return [0] * len(numbers)
        largest = max(self.n * max(abs(int(numbers.max())), abs(int(numbers.min()))) + max(map(abs, self.sums)), 1)
        kind = np.int64 if len(self.sums) * largest * largest < LONG else object
        gap = self.n * numbers.astype(kind) - np.array(self.sums, object).astype(kind)
        return (gap * gap).sum(axis=1).tolist()


def basis(found: Totals, components: int = COMPONENTS) -> Basis:
    """Eigenvectors of the covariance by falling eigenvalue; the sign makes the largest entry positive."""
    covariance = found.covariance()
    values, vectors = np.linalg.eigh(covariance) if len(covariance) else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    trace = sum(covariance[k, k] for k in range(len(covariance)))
    kept = [k for k in range(min(components, len(values))) if values[k] > trace * len(values) * np.finfo(float).eps]
    values, vectors = values[kept], vectors[:, kept]
    if len(kept):
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), range(len(kept))] < 0, -1.0, 1.0)
    mean = np.array([s / found.n for s in found.sums], float)
    return Basis(found.n, found.sums, mean, vectors / np.sqrt(values), values / trace if len(kept) else values)


def identity_error(vectors: DataFrame, fitted: Basis) -> float:
    """Largest entry of the covariance of the whitened rows less the identity, from the rows themselves."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = fitted.whitener.shape[1]
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            white = fitted.whiten(_integers(_matrix(batch.column(0))))
            sums += white.sum(axis=0)
            products += white.T @ white
        at = [(-1, j) for j in range(k)] + [(i, j) for i in range(k) for j in range(i, k)]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in at], pa.int32()), pa.array([b for _, b in at], pa.int32()), pa.array([sums[j] if i < 0 else products[i, j] for i, j in at], pa.float64())], ["i", "j", "v"])

    rows = vectors.select("vector").mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    mean = {r["j"]: r["v"] / fitted.n for r in rows if r["i"] < 0}
    return max((abs(r["v"] / fitted.n - mean[r["i"]] * mean[r["j"]] - (r["i"] == r["j"])) for r in rows if r["i"] >= 0), default=0.0)


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


def whiten(table: DataFrame, components: int = COMPONENTS, vector: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """One row per whole vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    ``deviation_exact`` holds the deviation as a decimal, also where it exceeds a long.
    """
    vectors = clean_vectors(table, vector, id_column)
    found = totals(vectors)
    if found is None:
        return table.sparkSession.createDataFrame([], SCHEMA)
    fitted = basis(found, components)
    k = len(fitted.explained)
    if not k:
        return table.sparkSession.createDataFrame([], SCHEMA)
    error = identity_error(vectors, fitted)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = 10**38
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = _integers(_matrix(batch.column(1)))
            rows = np.repeat(np.arange(len(numbers)), k)
            exact = fitted.deviations(numbers)
            longs = pa.array([v if v < 2 * LONG else None for v in exact], pa.int64()).take(pa.array(rows))
            decimals = pa.array([Decimal(v) if v < digits else None for v in exact], pa.decimal128(38, 0)).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(numbers))),
                    pa.array(np.full(len(rows), fitted.n)),
                    longs,
                    pa.array(fitted.whiten(numbers).ravel()),
                    pa.array(np.tile(fitted.explained, len(numbers))),
                    pa.array(np.full(len(rows), error)),
                    decimals,
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"],
            )

    return vectors.mapInArrow(project, SCHEMA)
