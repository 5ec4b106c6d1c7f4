"""Whitening of embeddings by the principal components of their integer-scaled vectors.

An entry c counts as x = floor(scale * c) + offset. Three passes over the vectors: every partition condenses its rows to
count, mean and centred scatter, which are merged pairwise (Chan, Golub and LeVeque) in a tree on the executors, and the
driver decomposes the merged matrix; a second pass whitens all rows and merges the moments of the results the same way,
which gives the largest deviation of their covariance from the identity; the third returns the rows. What the driver gets is
one dimension x dimension matrix for each of the last few merges, whatever the number of rows.

Sums are exact integers. The covariance does not depend on ``offset``, so scatter is taken of floor(scale * c), whose means are
small, and rows are centred before anything is multiplied.

Defined results: vectors that are null or hold null, NaN or infinite entries are dropped. Vectors of another length than the
most frequent one (of equally frequent ones, the greatest) share no space with the others and are dropped as well; empty vectors
have no components and give no rows, as does an empty table. A component without variance (its eigenvalue is at most ``FLAT``
of the largest) has whitened and explained 0 and is left out of the identity; so are all components of a single row. A scaled entry
beyond 2^62 counts as that bound; a deviation that no long can hold is null. Repeated rows and ids count and are returned as often
as they occur.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, small_batches

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
FLAT = 1e-13
TOP = 1 << 62
FAN = 64  # partitions' results that one merging task takes


class Moments(NamedTuple):
    """Of some rows: their count, exact sums, means, and scatter about the means."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scatter: np.ndarray


def moments(rows: np.ndarray, exact: bool = True) -> Moments:
    n = len(rows)
    mean = rows.mean(axis=0)
    off = rows - mean
    rest = off.mean(axis=0)  # what rounding left in the mean
    return Moments(n, exact_sums(rows) if exact else [], mean + rest, off.T @ off - n * np.outer(rest, rest))


def exact_sums(rows: np.ndarray) -> list[int]:
    """Column sums of whole numbers held as doubles."""
    if len(rows) * np.abs(rows).max(initial=0) < TOP:
        return rows.astype(np.int64).sum(axis=0).tolist()
    return [sum(map(int, column)) for column in rows.T]


def merge(a: Moments | None, b: Moments | None) -> Moments | None:
    """The moments of both together, by Chan's pairwise formula."""
    if a is None or b is None:
        return b if a is None else a
    n, step = a.n + b.n, b.mean - a.mean
    return Moments(n, [x + y for x, y in zip(a.sums, b.sums)], a.mean + step * (b.n / n), a.scatter + b.scatter + np.outer(step, step) * (a.n * b.n / n))


class Whitener(NamedTuple):
    """The fitted components: ``sums`` of the scaled entries without the offset, ``axes`` with one column per component."""

    n: int
    sums: list[int]
    mean: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    explained: list[float]

    def whiten(self, rows: np.ndarray) -> np.ndarray:
        live = self.values > 0
        return (rows - self.mean) @ (self.axes * np.where(live, 1 / np.sqrt(np.where(live, self.values, 1)), 0))

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n * x - S)^2; the offset cancels out."""
        if (self.n * np.abs(rows).max(initial=0) + max(map(abs, self.sums), default=0)) ** 2 * rows.shape[1] < TOP:
            return ((self.n * rows.astype(np.int64) - np.array(self.sums)) ** 2).sum(axis=1).tolist()
        out = [sum((self.n * int(x) - s) ** 2 for x, s in zip(row, self.sums)) for row in rows]
        return [x if x < 1 << 63 else None for x in out]


def decompose(m: Moments, components: int) -> Whitener:
    """Unit eigenvectors of the covariance by falling eigenvalue; the entry of greatest size in each is positive."""
    values, axes = np.linalg.eigh(m.scatter / m.n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    values = np.where(values > FLAT * max(values[0], 0), values, 0.0)
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    trace = float(np.trace(m.scatter) / m.n)
    return Whitener(m.n, m.sums, np.array([s / m.n for s in m.sums]), axes, values, [float(v / trace) if v else 0.0 for v in values])


def scaled(vectors: pa.Array, scale: int, dim: int) -> np.ndarray:
    """floor(scale * c) of lists of ``dim`` doubles, as doubles."""
    entries = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.clip(np.floor(entries * float(scale)), -float(TOP), float(TOP))


def _merged(vectors: DataFrame, of_rows) -> Moments | None:
    """The merged moments of ``of_rows`` applied to every batch of vectors: one row per partition, then a tree of merges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                total = merge(total, of_rows(b.column(0)))
        if total is not None:
            sums = pa.array([[Decimal(s) for s in total.sums]], pa.list_(pa.decimal128(38, 0)))
            yield pa.RecordBatch.from_arrays([pa.array([total.n]), sums, pa.array([total.mean.tobytes()]), pa.array([total.scatter.tobytes()])], ["n", "sums", "mean", "scatter"])

    def read(row) -> Moments:
        d = len(row.mean) // 8
        return Moments(row.n, [int(s) for s in row.sums], np.frombuffer(row.mean), np.frombuffer(row.scatter).reshape(d, d))

    parts = vectors.mapInArrow(run, "n long, sums array<decimal(38,0)>, mean binary, scatter binary").rdd.map(read)
    depth = max(2, math.ceil(math.log(max(parts.getNumPartitions(), 2), FAN)))
    return parts.treeAggregate(None, merge, merge, depth)


def whiten(table: DataFrame, id_col: str, vector_col: str, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``id_col``, component int, n long, deviation long, whitened, explained, identity_error double: a row for every vector and component.

    ``components`` is how many of the leading ones are returned (at most the vectors' length). ``offset`` moves x and its sums
    alike and so changes none of these.
    """
    small_batches(table.sparkSession)
    rows = table.select(quoted(id_col).alias("id"), quoted(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False)))
    longest = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = longest["d"] if longest else 0
    if not dim:
        return _returned(rows.where("false").selectExpr("id", "0L AS n", "0L AS deviation", "array(0D) AS w"), id_col, [0.0], 0.0)
    rows = rows.where(F.size("v") == dim)
    fit = decompose(_merged(rows.select("v"), lambda v: moments(scaled(v, scale, dim))), components)
    found = _merged(rows.select("v"), lambda v: moments(fit.whiten(scaled(v, scale, dim)), exact=False))
    error = np.abs(found.scatter / found.n - np.eye(len(fit.values)))[fit.values > 0][:, fit.values > 0].max(initial=0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = scaled(b.column(1), scale, dim)
            w = fit.whiten(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fit.n] * len(w), pa.int64()), pa.array(fit.deviations(x), pa.int64()), lists], ["id", "n", "deviation", "w"])

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n long, deviation long, w array<double>")
    return _returned(out, id_col, fit.explained, float(error))


def _returned(out: DataFrame, id_col: str, explained: list[float], error: float) -> DataFrame:
    each = out.select("id", "n", "deviation", F.posexplode("w").alias("k", "whitened"))
    share = F.get(F.array(*[F.lit(e) for e in explained]), F.col("k"))
    return each.select(F.col("id").alias(id_col), (F.col("k") + 1).alias("component"), "n", "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
