"""Centroid clustering of whole-number vectors; nearest centroids come from the threshold algorithm.

For every dimension the centroids are listed by their value in it.  A vector's own value marks a place in each
list, and the walk takes, in all dimensions at once, the next nearest entry on either side.  A centroid met for the
first time gets its exact distance.  What has not been met yet lies beyond the frontier in every dimension, so the
walk ends as soon as the squares of the frontier's gaps add up to strictly more than the best exact distance
(at an equal sum an unmet centroid with a smaller number could still tie).

The centroids are the model: their count and width are parameters, and their bytes are checked before they go to
the tasks.  Vectors stay in one written table that every round reads; a round shuffles the tasks' partial sums only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwise.llm import common, vectors

#: Cells of distances and differences that a task works on at a time.
CELLS = 1 << 21


@dataclass(frozen=True)
class Lists:
    """Centroids and, for each dimension, their numbers and values in ascending order of the value."""

    centroids: np.ndarray
    order: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray) -> Lists:
        order = np.argsort(centroids, axis=0, kind="stable").T
        return cls(centroids, np.ascontiguousarray(order), np.ascontiguousarray(np.take_along_axis(centroids.T, order, 1)))


def walk(points: np.ndarray, lists: Lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each point its nearest centroid (of equal ones the smaller number), that squared distance, and how many
    centroids the walk met before it could stop."""
    count, dims = lists.centroids.shape
    n = len(points)
    far = np.int64(1) << 62
    beyond = 2 * vectors.widest(dims) + 1
    best, found, met_all = np.zeros(n, np.int64), np.full(n, far), np.zeros(n, np.int64)
    place = np.arange(n)
    high = np.stack([np.searchsorted(lists.values[d], points[:, d]) for d in range(dims)], 1)
    low = high - 1
    exact = np.full((n, count), far)
    met = np.zeros((n, count), bool)
    dim = np.arange(dims)[None, :]

    def gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left = np.where(low >= 0, points - lists.values[dim, np.maximum(low, 0)], beyond)
        right = np.where(high < count, lists.values[dim, np.minimum(high, count - 1)] - points, beyond)
        return left, right

    while len(place):
        left, right = gaps(points, low, high)
        take_left = left <= right
        entry = lists.order[dim, np.clip(np.where(take_left, low, high), 0, count - 1)]
        low, high = low - take_left, high + ~take_left
        fresh = np.zeros_like(met)
        np.put_along_axis(fresh, entry, True, 1)
        fresh &= ~met
        row, centroid = np.nonzero(fresh)
        away = points[row] - lists.centroids[centroid]
        exact[row, centroid] = np.einsum("ij,ij->i", away, away)
        met |= fresh
        left, right = gaps(points, low, high)
        frontier = np.minimum(left, right)
        least = exact.min(1)
        done = (np.einsum("ij,ij->i", frontier, frontier) > least) | met.all(1)
        out = place[done]
        best[out], found[out], met_all[out] = vectors.nearest(exact[done]), least[done], met[done].sum(1)
        going = ~done
        place, points, low, high, exact, met = (a[going] for a in (place, points, low, high, exact, met))
    return best, found, met_all


def _blocks(batch: pa.RecordBatch, lists: Lists) -> Iterator[tuple[int, np.ndarray]]:
    count, dims = lists.centroids.shape
    size = max(1, CELLS // (count * dims))
    for at in range(0, len(batch), size):
        yield at, vectors.matrix(batch.column("vector")[at : at + size], dims).astype(np.int64)


def _summing(lists: Lists):
    """A task's sums: one row per centroid and dimension that it met, however many vectors it read."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(lists.centroids.shape, np.int64)
        counts = np.zeros(len(sums), np.int64)
        for batch in parts:
            for _, points in _blocks(batch, lists):
                cluster, _, _ = walk(points, lists)
                np.add.at(sums, cluster, points)
                counts += np.bincount(cluster, minlength=len(counts))
        used = np.flatnonzero(counts)
        dims = sums.shape[1]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(used, dims), pa.int32()),
                pa.array(np.tile(np.arange(dims), len(used)), pa.int32()),
                pa.array(np.repeat(counts[used], dims), pa.int64()),
                pa.array(sums[used].ravel(), pa.int64()),
            ],
            names=["cluster", "dim", "n", "total"],
        )

    return batches


def _labelling(lists: Lists):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for at, points in _blocks(batch, lists):
                cluster, distance, met = walk(points, lists)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id")[at : at + len(points)],
                        pa.array(cluster, pa.int32()),
                        pa.array(distance, pa.int64()),
                        pa.array(met, pa.int32()),
                    ],
                    names=["vec_id", "cluster", "distance", "met"],
                )

    return batches


def starting(table: DataFrame, count: int, seed: str, dims: int) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``seed`` and the id in decimal, in that order; null ids last."""
    first = (
        table.withColumn("hash", F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256))
        .orderBy(F.col("hash").asc_nulls_last(), "vector")
        .limit(count)
    )
    return np.array([np.frombuffer(bytes(r["vector"]), "<i4") for r in first.collect()], np.int64).reshape(-1, dims)


def fit(table: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """``rounds`` of assigning every vector and moving each centroid that has any to the floor of their mean.

    A round that moves nothing ends the work early: all later ones would repeat it.
    """
    for _ in range(rounds):
        sums = (
            table.select("vector")
            .mapInArrow(_summing(Lists.of(centroids)), "cluster int, dim int, n long, total long")
            .groupBy("cluster", "dim")
            .agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        )
        moved = centroids.copy()
        for r in sums.collect():  # at most one row per centroid and dimension
            moved[r["cluster"], r["dim"]] = r["total"] // r["n"]
        if (moved == centroids).all():
            break
        centroids = moved
    return centroids


def clusters(
    rows: DataFrame,
    count: int = 8,
    dims: int = 64,
    rounds: int = 10,
    scale: int = 1024,
    seed: str = "3:",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, met.

    Kept are vectors of exactly ``dims`` components, none of them null or not finite; each component becomes
    ``floor(scale * x)``.  One that would make a distance exceed a long raises an error.  ``met`` is the number of
    centroids that the last walk met.  Rows that share an id, and null ids, are vectors like any other; among
    starting centroids null ids come last and equal ids go by their numbers.  With fewer vectors than ``count`` each
    starts one centroid; an empty table gives no rows.  Other columns play no part.
    """
    if count * dims * 24 > vectors.MODEL_BYTES:
        raise ValueError(f"{count} centroids of {dims} dimensions do not fit into a task's model")
    named = common.narrow(rows, vec_id=id_col, vector=vector_col)
    table = vectors.whole(named.where((F.size("vector") == dims) & vectors.usable(F.col("vector"))), scale, dims, "cluster_vectors")
    centroids = starting(table, count, seed, dims)
    kind = table.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return common.empty_like(
            rows.sparkSession,
            f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, met int",
        )
    centroids = fit(table, centroids, rounds)
    labelled = common.keep_table(
        table.mapInArrow(_labelling(Lists.of(centroids)), f"vec_id {kind}, cluster int, distance long, met int"), "clusters"
    )
    sums = {r["cluster"]: r["n"] for r in labelled.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    model = [(k, int(sums.get(k, 0)), int(sum(sums.values())), d) for k, d in enumerate(digests)]
    totals = rows.sparkSession.createDataFrame(model, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return labelled.join(F.broadcast(totals), "cluster").select(  # one row per centroid
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "met"
    )
