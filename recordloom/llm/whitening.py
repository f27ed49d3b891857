"""Whitening of embeddings by the singular values of the centred rows.

Components become integers floor(scale * c) + shift, so sums, the mean and every vector's
deviation from it are exact. Spark MLlib's ``RowMatrix.computeSVD`` runs on the rows less the mean
(a distributed Gram matrix of dimensions x dimensions); its singular values, squared and divided
by n, are the eigenvalues of the covariance with divisor n, its right vectors the components. The
total variance, which the explained shares refer to, is computed apart, from the exact deviations.
What a component gives is a row's product with it over the square root of the eigenvalue.

The driver holds a few matrices of dimensions x dimensions. Vectors are read four times and never
shuffled; partial sums and Gram matrices are.

Cases: vectors that are null or hold null or non-finite components take no part, nor do those of
another length than most (ties: the longer); a null id stays; repeated rows count each; components
without variance (below 1e-9 of the largest singular value) are left out, so equal rows or a
single one give none; an empty table gives an empty result; further columns are ignored. A
deviation that doesn't fit into 64 bits is null; totals use exact decimals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sort_means import finite

SCALE, SHIFT = 64, 1_000_000


@dataclass
class Model:
    n: int
    sums: list[int]  # of the integers, by dimension
    components: np.ndarray  # dimensions x components, unit columns
    eigenvalues: np.ndarray  # of the covariance, falling
    total: float  # its trace

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def integers(df: DataFrame, key: str, vector: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """id and x, the integers of the vectors that take part."""
    rows = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("v")).filter(finite(F.col("v")) & (F.size("v") > 0))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dims = lengths[0]["d"] if lengths else 0
    scaled = F.transform("v", lambda c: F.floor(c.cast("double") * F.lit(float(scale))) + F.lit(shift).cast("long"))
    return rows.filter(F.size("v") == dims).select("id", scaled.alias("x"))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sums of squares of n * x - S: in 64 bits where they surely fit, else in Python's integers."""
    most = max(max(abs(int(v)) for v in (x.min(), x.max())) * n, max(abs(s) for s in sums))
    if 2 * most < 1 << 62:
        apart = n * x - np.array(sums, dtype=np.int64)
        if x.shape[1] * int(np.abs(apart).max()) ** 2 < 1 << 63:
            return (apart**2).sum(axis=1).tolist()
    return [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]


def _centred(batch: pa.RecordBatch, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The integers of a batch and what they are over the mean, as doubles: (n * x - S) / n."""
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return x, (x - whole) - rest  # the difference of integers is exact and small


def _vectors(rows: DataFrame, column: str) -> RowMatrix:
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v"))


def fit(rows: DataFrame, most: int = 32) -> Model | None:
    """``rows``: what ``integers`` gives."""
    if not (some := rows.select(F.size("x").alias("d")).head()):
        return None
    dims = some["d"]
    one = rows.agg(F.count("*").alias("n"), *[F.sum(F.get("x", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]).first()
    n, sums = one["n"], [int(one[f"s{i}"]) for i in range(dims)]

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = _centred(batch, n, sums)[1]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * dims, y.ravel())], ["y"])

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array([str(sum(_deviations(x, n, sums)))])], ["d"])

    total = rows.select("x").mapInArrow(squares, "d string").agg(F.sum(F.col("d").cast("decimal(38,0)"))).first()[0]
    found = _vectors(rows.select("x").mapInArrow(centred, "y array<double>"), "y").computeSVD(min(most, dims), computeU=False) if total else None
    if found is None:
        return Model(n, sums, np.zeros((dims, 0)), np.zeros(0), 0.0)
    e = found.s.toArray() ** 2 / n  # singular values belong to the sum over rows; the covariance divides it by n
    return Model(n, sums, found.V.toArray(), e, float(total) / float(n) ** 3)


def whitened(rows: DataFrame, model: Model) -> DataFrame:
    """id, deviation and w, the whitened values of each row by component."""
    n, sums, to = model.n, model.sums, model.components / np.sqrt(model.eigenvalues)
    width = to.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = _centred(batch, n, sums)
                w = pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * width, (y @ to).ravel())
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([d if d < 1 << 63 else None for d in _deviations(x, n, sums)], pa.int64()), w], ["id", "deviation", "w"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, deviation bigint, w array<double>")


def identity_error(white: DataFrame, n: int, width: int) -> float:
    """The largest absolute entry of the covariance (divisor n) of ``w`` less the identity."""
    if n < 2 or not width:
        return 0.0
    covariance = _vectors(white, "w").computeCovariance().toArray() * ((n - 1) / n)  # MLlib centres and divides by n - 1
    return float(np.abs(covariance - np.eye(width)).max())


def components(df: DataFrame, key: str, vector: str, most: int = 32) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained and identity_error of each row."""
    rows = integers(df, key, vector)
    model = fit(rows, most)
    if model is None or not len(model.eigenvalues):
        white, error, n, shares = rows.limit(0).select("id", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("w")), 0.0, 0, []
    else:
        white, n = whitened(rows, model), model.n
        error, shares = identity_error(white, n, len(model.eigenvalues)), (model.eigenvalues / model.total).tolist()
    each = white.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    explained = F.get(F.array(*map(F.lit, shares)).cast("array<double>"), F.col("at"))
    return each.select(F.col("id").alias(key), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
