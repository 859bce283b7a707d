"""Centroid clustering in integers, with centroids ruled out by leading rotated coordinates and residual norms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rotated coordinates that are stored of each vector.
LEADING = 16
#: Integers below this size keep a squared distance within 64 bits; vectors with larger ones take no part.
LARGEST = 1 << 27
#: Bounds are formed in double precision; so much of the vectors' size is left to its errors.
SLACK = 1e-9


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str, width: int, scale: int) -> DataFrame:
    """``vec_id, v``: vectors of exactly ``width`` finite components as ``floor(scale * x)``."""
    v = F.col(vec_col).cast("array<double>")
    kept = (F.size(v) == width) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(x * float(scale)))
    small = F.forall(v, lambda x: F.abs(x * float(scale)) < float(LARGEST - 1))
    return rows.filter(F.coalesce(kept, F.lit(False)) & F.coalesce(small, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), whole.cast("array<long>").alias("v"))


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind, copy=False)


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Orthonormal axes, most variance first, of the covariance of all vectors.

    A batch gives one row of ``width * width`` sums; Spark adds them up by
    place, so the driver gets one matrix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((width + 1, width)), 0
        for batch in batches:
            x = _matrix(batch.column(0), width, np.float64)
            total[:width] += x.T @ x
            total[width] += x.sum(axis=0)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size + 1)), pa.array(np.append(total.ravel(), n))], names=["place", "part"])

    sums = vectors.select("v").mapInArrow(run, "place long, part double").groupBy("place").agg(F.sum("part").alias("part")).toArrow().sort_by("place")  # width * (width + 1) + 1 numbers
    if not sums.num_rows:
        return np.eye(width)
    part = sums["part"].to_numpy()
    n, mean = part[-1], part[-1 - width : -1] / part[-1]
    _, axes = np.linalg.eigh(part[: width * width].reshape(width, width) / n - np.outer(mean, mean))
    return axes[:, ::-1]


def rotated(vectors: DataFrame, axes: np.ndarray, leading: int) -> DataFrame:
    """Adds ``lead``, the leading rotated coordinates, and ``rest``, the norm of what they leave."""
    width, shared = len(axes), vectors.sparkSession.sparkContext.broadcast(axes[:, :leading])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width, np.float64)
            lead = x @ shared.value
            rest = np.sqrt(np.maximum((x * x).sum(axis=1) - (lead * lead).sum(axis=1), 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, lead.size + 1, leading), pa.int32()), pa.array(lead.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(rest)], names=["vec_id", "v", "lead", "rest"])

    return vectors.mapInArrow(run, "vec_id long, v array<long>, lead array<double>, rest double")


def nearest_centroids(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance, distances that were computed) of each row, exact, ties to the smaller number.

    With leading coordinates p and residual norm r, a squared distance is at
    least ``|p - p'|^2 + (r - r')^2``. The centroid of the least bound is
    measured first; of the others only those whose bound does not exceed it.
    """
    leading = lead.shape[1]
    c = centroids.astype(np.float64)
    c_lead = c @ axes[:, :leading]
    c_rest = np.sqrt(np.maximum((c * c).sum(axis=1) - (c_lead * c_lead).sum(axis=1), 0))
    size, c_size = (lead * lead).sum(axis=1) + rest * rest, (c_lead * c_lead).sum(axis=1) + c_rest * c_rest
    bound = np.stack([((lead - p) ** 2).sum(axis=1) + (rest - r) ** 2 for p, r in zip(c_lead, c_rest, strict=True)], axis=1)
    bound -= SLACK * (size[:, None] + c_size[None, :]) + 1e-6

    def measured(rows: np.ndarray, which: np.ndarray) -> np.ndarray:
        gap = x[rows] - centroids[which]
        return np.einsum("ij,ij->i", gap, gap)

    every = np.arange(len(x))
    best = bound.argmin(axis=1)
    first, distance = best.copy(), measured(every, best)
    work = len(x)
    for k in range(len(centroids)):
        rows = np.flatnonzero((bound[:, k] <= distance) & (first != k))
        d = measured(rows, np.full(len(rows), k))
        work += len(rows)
        closer = (d < distance[rows]) | ((d == distance[rows]) & (k < best[rows]))
        best[rows[closer]], distance[rows[closer]] = k, d[closer]
    return best, distance, work


def _sums(vectors: DataFrame, centroids: np.ndarray, axes: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """``cluster: (count, componentwise sums)``; every task hands on one row per cluster."""
    k, width = centroids.shape
    shared = vectors.sparkSession.sparkContext.broadcast((centroids, axes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, full = shared.value
        total, n = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x, lead, rest = _matrix(batch.column(0), width, np.int64), _matrix(batch.column(1), min(LEADING, width), np.float64), batch.column(2).to_numpy()
            best, _, _ = nearest_centroids(x, lead, rest, own, full)
            order = np.argsort(best, kind="stable")
            counts = np.bincount(best, minlength=k)
            starts = np.concatenate(([0], counts.cumsum()[:-1]))
            met = np.flatnonzero(counts)
            total[met] += np.add.reduceat(x[order], starts[met], axis=0) if len(met) else 0
            n += counts
        met = np.flatnonzero(n)
        place = (met[:, None] * (width + 1) + np.arange(width + 1)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.column_stack((total[met], n[met])).ravel())], names=["place", "part"])

    parts = vectors.select("v", "lead", "rest").mapInArrow(run, "place long, part long").groupBy("place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))
    found = {r["place"]: int(r["part"]) for r in parts.collect()}  # k * (width + 1) numbers
    return {j: (found[j * (width + 1) + width], [found[j * (width + 1) + i] for i in range(width)]) for j in range(k) if j * (width + 1) + width in found}


def first_centroids(vectors: DataFrame, k: int, width: int, salt: str) -> np.ndarray:
    """The ``k`` vectors of the smallest SHA-256 of salt and id, in that order; ties of repeated ids by the vector."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    chosen = vectors.select("v", digest.alias("digest")).orderBy("digest", "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in chosen], np.int64).reshape(len(chosen), width)


def cluster(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, salt: str = "3:") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that takes part.

    Rounds assign each vector to its nearest centroid and move every centroid
    that has vectors to ``floor(sum / count)``; all of it in integers. A round
    sends out the centroids and gets back a count and sums per cluster, so what
    moves does not grow with the rows.

    Vectors that are null, of another length, or hold null or non-finite
    components take no part, nor do such whose components reach 2^27 / scale
    in size, as their distance might not fit 64 bits. Repeated rows count as
    often as they stand; a null id is an id like any other. Fewer vectors than
    ``k`` make as many clusters. An empty table gives no rows; other columns
    are never read. Sums of distances beyond 64 bits are null.
    """
    vectors = integer_vectors(rows, id_col, vec_col, width, scale)
    vectors = cut(vectors)
    axes = rotation(vectors, width)
    vectors = cut(rotated(vectors, axes, min(LEADING, width)))
    centroids = first_centroids(vectors, k, width, salt)
    for _ in range(rounds if len(centroids) else 0):
        for j, (n, total) in _sums(vectors, centroids, axes).items():
            centroids[j] = [t // n for t in total]
    shared = rows.sparkSession.sparkContext.broadcast((centroids, axes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, full = shared.value
        for batch in batches:
            if batch.num_rows:
                x, lead, rest = _matrix(batch.column(1), width, np.int64), _matrix(batch.column(2), min(LEADING, width), np.float64), batch.column(3).to_numpy()
                best, distance, _ = nearest_centroids(x, lead, rest, own, full)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    found = vectors.mapInArrow(run, "vec_id long, cluster int, distance long")
    sums = cut(found.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia")))  # a row per cluster
    whole = sums.agg(F.try_sum("cluster_inertia").alias("inertia")).first()["inertia"]
    names = {j: ",".join(map(str, c)) for j, c in enumerate(centroids.tolist())}
    digest = F.sha2(F.element_at(F.array(*[F.lit(names[j]) for j in sorted(names)] or [F.lit("")]), F.col("cluster") + 1).cast("binary"), 256)
    return found.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(whole).cast("long").alias("inertia"), digest.alias("centroid_sha256"))
