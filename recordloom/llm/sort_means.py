"""Centroid clustering by sort-means, exact in integers.

Each round sorts, for every centroid, the other centroids by their distance from it. A vector
starts from the centroid it had before and looks at the others in that order; it stops where a
centroid is strictly further from the start than twice the vector's own distance, since by the
triangle inequality no later one can be nearer. The result is that of looking at all of them,
ties (to the smaller number) included: squares are compared as integers.

Tasks get centroids and orders (k x dimensions and k x k numbers) and vectors in Arrow batches.
New centroids are floors of exact sums, which every task adds up for its own vectors before they
are shuffled, so a cluster that holds most rows costs k rows a task. Each round is written to
the shared folder, so a lost executor repeats its part of one round; the round before goes.

Cases: vectors that are null, of another length, or hold null or non-finite components take no
part; a null id counts as ''; repeated rows count each; equal seeds are equal centroids, of which
the smaller number wins; fewer vectors than centroids make fewer centroids; an empty table gives
an empty result; further columns are ignored. Components of 2^27 / scale or more raise an error,
as their squares wouldn't be exact in 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, forget

#: Integers from here on could overflow the sum of 64 squares of differences.
TOO_LARGE = 1 << 27


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    sound = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(sound, F.lit(False))


def orders(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances between centroids, and for each the numbers of all by distance from it."""
    gaps = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    return gaps, np.argsort(gaps, axis=1, kind="stable")


def assign(x: np.ndarray, before: np.ndarray, centroids: np.ndarray, gaps: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its squared distance, from the ``before`` ones on."""
    own = ((x - centroids[before]) ** 2).sum(axis=1)
    best, far = before.copy(), own.copy()
    for start in np.unique(before):
        rows = np.flatnonzero(before == start)
        rows = rows[np.argsort(-own[rows], kind="stable")]  # those that look furthest come first
        reach = -4 * own[rows]
        for other in order[start]:
            live = rows[: np.searchsorted(reach, -gaps[start, other], side="right")]
            if not len(live):
                break
            if other != start:
                d = ((x[live] - centroids[other]) ** 2).sum(axis=1)
                nearer = (d < far[live]) | ((d == far[live]) & (other < best[live]))
                best[live[nearer]], far[live[nearer]] = other, d[nearer]
    return best, far


def _assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    gaps, order = orders(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.int64)
                best, far = assign(x, batch.column("cluster").to_numpy().astype(np.int64), centroids, gaps, order)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array(best, pa.int32()), pa.array(far)], ["id", "x", "cluster", "distance"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:2])
    return rows.select("id", "x", "cluster").mapInArrow(run, f"{fields}, cluster int, distance bigint")


def clusters(df: DataFrame, key: str, vector: str, k: int = 16, dims: int = 64, rounds: int = 3, scale: int = 64, seed: str = "1:") -> tuple[DataFrame, np.ndarray]:
    """id, x (the integers floor(scale * component)), cluster and squared distance of each vector
    with ``dims`` components, and the centroids. The k vectors with the smallest SHA-256 of
    ``seed`` and key (ties: smaller components) are the first centroids."""
    rows = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("v")).filter((F.size("v") == dims) & finite(F.col("v")))
    scaled = F.transform("v", lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    fits = F.forall(scaled, lambda c: F.abs(c) < TOO_LARGE)
    checked = F.when(fits, scaled.cast("array<int>")).otherwise(F.raise_error(F.lit(f"components of {TOO_LARGE // scale} and more can't be clustered exactly")).cast("array<int>"))
    rows = rows.select("id", checked.alias("x"), F.lit(0).alias("cluster"))
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.select(digest.alias("digest"), "x").orderBy("digest", "x").limit(k).collect()  # k rows
    centroids = np.array([r["x"] for r in first], dtype=np.int64).reshape(-1, dims)
    if not len(centroids):
        return rows.withColumn("distance", F.lit(0).cast("long")), centroids
    sums = [F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(dims)]
    for _ in range(rounds):
        done = cut(_assigned(rows, centroids), "sort-means")
        forget(rows)
        for r in done.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # k rows
            centroids[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
        rows = done
    done = cut(_assigned(rows, centroids), "sort-means")
    forget(rows)
    return done, centroids


def digest_of(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(c)) for c in centroid).encode()).hexdigest()


def report(done: DataFrame, centroids: np.ndarray, key: str) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector."""
    totals = {r["cluster"]: r["d"] for r in done.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    pick = lambda kind, of: F.element_at(F.array(F.lit(None).cast(kind), *[F.lit(of(c)).cast(kind) for c in range(len(centroids))]), F.col("cluster") + 2)
    return done.select(
        F.col("id").alias(key), "cluster", "distance",
        pick("long", lambda c: totals.get(c, 0)).alias("cluster_inertia"), F.lit(sum(totals.values())).cast("long").alias("inertia"),
        pick("string", lambda c: digest_of(centroids[c])).alias("centroid_sha256"),
    )
