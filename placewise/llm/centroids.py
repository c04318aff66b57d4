"""Rounds of centroid clustering whose nearest centroid is found by equal-average equal-variance search.

Vectors become integers (floor of 256 x). Centroids are sorted by their component mean; a
vector looks at them outward from its own mean. With k components, means m and deviations s,
a squared distance is at least k * (m - m')^2 + k * (s - s')^2: the scan of a vector ends where
the first term alone exceeds its best distance, and a centroid is skipped where the sum does.
What remains is measured in integers, so rounding decides nothing; equal distances go to the
centroid with the smaller number.

A round ships the centroids to the tasks and gets back one sum for each centroid and task,
combined before the shuffle; the driver sees ``clusters`` rows.

Vectors that are null, of another length, or hold null or non-finite components are left out. A
component's integer beyond 2^23 in size counts as 2^23. Repeated ids and equal vectors are rows
of their own; of equal first ids the smaller vector starts. Rows with a null id are clustered
like others and start last. Fewer vectors than clusters give fewer centroids; no vectors, no
rows. A zero vector is a vector. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.llm.shared import settled
from placewise.llm.vectors import finite, integers

_SLACK = 1 + 1e-9


class Search:
    """Centroids in the order of their means, with what the two inequalities need."""

    def __init__(self, centroids: np.ndarray):
        total = centroids.sum(axis=1)
        self.number = np.lexsort((np.arange(len(centroids)), total))
        self.points = centroids[self.number]
        self.total, self.deviation = _mean_and_deviation(self.points)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each row of integers."""
        total, deviation = _mean_and_deviation(x)
        best = np.full(len(x), np.iinfo(np.int64).max)
        chosen = np.zeros(len(x), np.int64)
        # The next centroid above and the next below each vector's mean; the nearer of the two comes first.
        up = np.searchsorted(self.total, total)
        down = up - 1
        active = np.arange(len(x))
        while len(active):
            u, d = up[active], down[active]
            above = np.where(u < len(self.points), self.total[np.minimum(u, len(self.points) - 1)] - total[active], np.inf)
            below = np.where(d >= 0, total[active] - self.total[np.maximum(d, 0)], np.inf)
            take_up = above <= below
            gap = np.where(take_up, above, below)
            alive = gap * gap <= best[active] * _SLACK
            active, at, gap, take_up = active[alive], np.where(take_up, u, d)[alive], gap[alive], take_up[alive]
            up[active] += take_up
            down[active] -= ~take_up
            spread = deviation[active] - self.deviation[at]
            open_ = gap * gap + spread * spread <= best[active] * _SLACK
            rows, at = active[open_], at[open_]
            away = x[rows] - self.points[at]
            distance = np.einsum("ij,ij->i", away, away)
            number = self.number[at]
            better = (distance < best[rows]) | ((distance == best[rows]) & (number < chosen[rows]))
            best[rows[better]], chosen[rows[better]] = distance[better], number[better]
        return chosen, best


def _mean_and_deviation(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each row, both times the root of the row's length."""
    scaled = x.astype(np.float64)
    root = np.sqrt(x.shape[1])
    mean = scaled.mean(axis=1, keepdims=True)
    return mean[:, 0] * root, np.sqrt(np.square(scaled - mean).sum(axis=1))


def _rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def assigned(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of each row of ``points`` (vec_id, x)."""
    width = centroids.shape[1]
    held = points.sparkSession.sparkContext.broadcast(Search(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = held.value.nearest(_rows(batch, width))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return points.mapInArrow(run, "vec_id long, cluster int, distance long")


def moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the floor of the mean of each one's vectors; those without vectors stay."""
    width = centroids.shape[1]
    held = points.sparkSession.sparkContext.broadcast(Search(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            x = _rows(batch, width)
            cluster, _ = held.value.nearest(x)
            np.add.at(sums, cluster, x)
            counts += np.bincount(cluster, minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = points.mapInArrow(run, "cluster int, n long, sums array<long>")
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)]).collect()
    out = centroids.copy()
    for row in found:
        out[row.cluster] = [row[f"s{k}"] // row.n for k in range(width)]
    return out


def clustered(
    table: DataFrame, clusters: int = 40, rounds: int = 5, width: int = 64, salt: str = "2", id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of each vector, the final centroids) after ``rounds`` rounds."""
    points = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    points = settled(points.filter(finite(F.col("v")) & (F.size("v") == width)).select("vec_id", integers(F.col("v")).alias("x")))
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = points.orderBy(key.asc_nulls_last(), "x").limit(clusters).select("x").collect()
    centroids = np.array([r.x for r in first], np.int64).reshape(len(first), width)
    if not len(first):
        return points.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        centroids = moved(points, centroids)
    return settled(assigned(points, centroids)), centroids


def report(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``rows`` of ``clustered`` with cluster_inertia, inertia and centroid_sha256."""
    spark = rows.sparkSession
    names = [(k, sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = [(k, sums.get(k, 0), sum(sums.values()), name) for k, name in names]
    # One row for each centroid.
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
