"""Centroid clustering with n-simplex projection bounds (operator 11).

Components become integers floor(1024 * x); k start vectors are those with the
smallest sha256 of ``3:<vec_id>``. Distances of every vector to a few pivots are
measured once and stored as the apex coordinates of a simplex over the pivots: the
place of the vector within the pivots' span, and its height above it. The Euclidean
distance of two apexes is a lower bound of the distance of the vectors, and with the
second height turned down it is an upper bound. In every round the centroids become
apexes as well, centroids whose lower bound exceeds the least upper bound are left
out, and the others are compared by exact squared integer distances, ties to the
smaller number. Sums are exact: partial sums per task, then decimal sums in Spark.

Pivots are chosen from the ``SAMPLE`` vectors next in hash order, each the one highest
above the span of those before, so the simplex is well conditioned; bounds keep a
slack for rounding, so a filter never decides a tie. The sample only sets how sharp the
bounds are: every vector is compared with every centroid that the bounds leave.

Cases: vectors that are null, hold null or non-finite components or have another number
of components than ``dim`` take no part; repeated rows are separate vectors; equal
hashes (repeated ids) are ordered by components, null ids come last; with fewer than k
vectors there are as many centroids as vectors; pivots that add no height (equal
vectors) are left out, down to none; an empty table gives an empty result. Components of
2**25 or more in size are compared as Python integers, without bounds; a squared
distance or inertia that doesn't fit a long is null. Only the columns named are read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import stored

PIVOTS = 24
SAMPLE = 256
WIDE = 1 << 25     # components of this size are handled as Python integers
LONG = (1 << 63) - 1
LIMB = 10 ** 18


def kept_vectors(table: DataFrame, dim: int, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x) of the vectors that take part."""
    ok = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
            .where(F.col("x").isNotNull() & (F.size("x") == dim) & ok))


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): int64 where all fit the fast path, Python integers otherwise."""
    if not len(x) or np.abs(x).max() * scale < WIDE:
        return np.floor(scale * x).astype(np.int64)
    # beyond 2**53 a double is an integer already
    exact = lambda v: scale * int(v) if abs(v) >= 2 ** 53 else math.floor(scale * v)
    return np.array([[exact(float(v)) for v in row] for row in x], dtype=object)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every centroid."""
    if v.dtype == object or c.dtype == object:
        v, c = v.astype(object), c.astype(object)
    return np.stack([((v - one) ** 2).sum(axis=1) for one in c], axis=1)


class Simplex:
    """Apex coordinates over the pivots, from distances alone."""

    def __init__(self, sample: np.ndarray, most: int):
        """Picks pivots from a sample of integer vectors, highest above the span first."""
        self.pivots = np.empty((0, sample.shape[1]))
        self.base = np.empty((0, 0))  # apexes of the pivots: row i has i coordinates
        points = sample.astype(float)
        scale = np.abs(points).max() if points.size else 0.0
        while len(self.pivots) < most and len(points):
            height = self.apexes(points)[:, -1] if len(self.pivots) else np.ones(len(points))
            i = int(height.argmax())
            if len(self.pivots) and height[i] <= 1e-3 * max(1.0, scale):
                break
            apex = self.apexes(points[i:i + 1])[0] if len(self.pivots) else np.empty(0)
            n = len(self.pivots)
            base = np.zeros((n + 1, n))
            base[:n, :max(0, n - 1)] = self.base
            base[n] = apex
            self.base, self.pivots = base, np.vstack([self.pivots, points[i]])

    def apexes(self, v: np.ndarray) -> np.ndarray:
        """One row per vector: coordinates in the pivots' span, then the height."""
        v = v.astype(float)
        d2 = np.stack([((v - p) ** 2).sum(axis=1) for p in self.pivots], axis=1)
        n = len(self.pivots)
        out = np.zeros((len(v), n))
        for i in range(1, n):  # pivot i lies at base[i]; pivot 0 is the origin
            b = self.base[i]
            rest = (d2[:, 0] - d2[:, i] + (b ** 2).sum()) / 2 - out[:, :i - 1] @ b[:i - 1]
            out[:, i - 1] = rest / b[i - 1]
        out[:, n - 1] = np.sqrt(np.maximum(d2[:, 0] - (out[:, :n - 1] ** 2).sum(axis=1), 0))
        return out


def bounds(a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances of every vector to every centroid."""
    flat = ((a[:, None, :-1] - c[None, :, :-1]) ** 2).sum(axis=2)
    return (np.sqrt(flat + (a[:, None, -1] - c[None, :, -1]) ** 2),
            np.sqrt(flat + (a[:, None, -1] + c[None, :, -1]) ** 2))


def nearest(v: np.ndarray, apex: np.ndarray, centroids: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid number, exact squared distance) of every vector, and how many of the
    comparisons the bounds left out."""
    if v.dtype == object or centroids.dtype == object or not apex.shape[1]:
        d = squared(v, centroids)
        at = np.array([min(range(len(row)), key=lambda j: (row[j], j)) for row in d.tolist()], np.int64)
        return at, d[np.arange(len(d)), at], 0
    low, high = bounds(apex, tops)
    slack = 1e-6 * (1 + np.abs(apex).max() + np.abs(tops).max())
    open_ = low <= high.min(axis=1, keepdims=True) + slack
    best = np.full(len(v), np.iinfo(np.int64).max)
    at = np.zeros(len(v), np.int64)
    for j, c in enumerate(centroids):
        rows = np.flatnonzero(open_[:, j])
        d = ((v[rows] - c) ** 2).sum(axis=1)
        closer = d < best[rows]
        at[rows[closer]], best[rows[closer]] = j, d[closer]
    return at, best, int((~open_).sum())


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _packed(c: np.ndarray) -> np.ndarray:
    """Integers as int64 where they are small, else as Python integers."""
    small = all(abs(int(x)) < WIDE for x in c.ravel())
    return c.astype(np.int64) if small else c.astype(object)


def clusters(table: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3:",
             pivots: int = PIVOTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    kept = kept_vectors(table, dim, id_col, vec_col)
    key = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.orderBy(key.asc_nulls_last(), "x").limit(k + SAMPLE).collect()  # k + SAMPLE rows
    sample = integers(np.array([r["x"] for r in first]).reshape(len(first), dim), scale)
    centroids = sample[:k]
    pool = sample[k:] if len(sample) > k else sample
    simplex = Simplex(pool if sample.dtype != object else np.empty((0, dim)), pivots)
    width = len(simplex.pivots)

    def measure(batches):
        for batch in batches:
            v = integers(_matrix(batch.column(1), dim), scale)
            apex = simplex.apexes(v) if width and v.dtype != object else np.zeros((len(v), width))
            apex = pa.FixedSizeListArray.from_arrays(pa.array(apex.ravel()), width).cast(
                pa.list_(pa.float64())) if width else pa.array([[]] * len(v), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, apex], names=["vec_id", "x", "apex"])

    vectors = stored(kept.mapInArrow(measure, "vec_id long, x array<double>, apex array<double>"), "apexes")

    def assigned(batch, centroids, tops):
        v = integers(_matrix(batch.column("x"), dim), scale)
        at, d, _ = nearest(v, _matrix(batch.column("apex"), width) if width else np.zeros((len(v), 0)), centroids, tops)
        return v, at, d

    def tops_of(centroids):
        return simplex.apexes(centroids) if width and centroids.dtype != object else np.zeros((len(centroids), width))

    for _ in range(rounds if len(centroids) else 0):
        tops = tops_of(centroids)

        def partial_sums(batches, centroids=centroids, tops=tops):
            sums = np.zeros((len(centroids), dim + 1), dtype=object)  # the last is the count
            for batch in batches:
                if batch.num_rows:
                    v, at, _ = assigned(batch, centroids, tops)
                    for j in np.unique(at):
                        sums[j, :dim] += v[at == j].sum(axis=0).astype(object)
                        sums[j, dim] += int((at == j).sum())
            cells = []
            for j, i in np.ndindex(sums.shape):
                rest, limb = int(sums[j, i]), 0
                while rest:  # digits to the base LIMB, all with the sum's sign
                    digit = abs(rest) % LIMB
                    cells.append((j, i, limb, digit if rest > 0 else -digit))
                    rest = (abs(rest) // LIMB) * (1 if rest > 0 else -1)
                    limb += 1
            j, i, limb, value = zip(*cells) if cells else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(j, pa.int32()), pa.array(i, pa.int32()), pa.array(limb, pa.int32()), pa.array(value, pa.int64())],
                names=["j", "i", "limb", "value"])

        cells = vectors.mapInArrow(partial_sums, "j int, i int, limb int, value long")
        total = np.zeros((len(centroids), dim + 1), dtype=object)
        for r in cells.groupBy("j", "i", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("s")).collect():
            total[r["j"], r["i"]] += int(r["s"]) * LIMB ** r["limb"]  # k * (dim + 1) cells, a few limbs each
        moved = centroids.astype(object)
        for j in range(len(moved)):
            if total[j, dim]:
                moved[j] = [x // total[j, dim] for x in total[j, :dim]]
        centroids = _packed(moved)

    tops = tops_of(centroids)

    def final(batches):
        for batch in batches:
            if batch.num_rows:
                _, at, d = assigned(batch, centroids, tops)
                exact = [int(x) for x in d]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(at.astype(np.int32)),
                     pa.array([x if x <= LONG else None for x in exact], pa.int64())],
                    names=["vec_id", "cluster", "distance"])

    out = stored(vectors.mapInArrow(final, "vec_id long, cluster int, distance long"), "assigned")
    # a sum with a null distance, or beyond a long, is null
    fits = lambda n, s: F.when((n == 0) & (s <= LONG), s.cast("long"))
    per = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"),
                                     F.count_if(F.col("distance").isNull()).alias("gaps"))
    per = stored(per, "inertia")  # k rows
    whole = per.agg(fits(F.sum("gaps"), F.sum("s")).alias("inertia"))
    names = [(j, hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest()) for j, c in enumerate(centroids)]
    digests = table.sparkSession.createDataFrame(names, "cluster int, centroid_sha256 string")
    per = per.select("cluster", fits(F.col("gaps"), F.col("s")).alias("cluster_inertia")).withColumn(
        "inertia", whole.scalar())
    return out.join(F.broadcast(per.join(digests, "cluster")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
