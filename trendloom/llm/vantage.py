"""Centroid clustering of integer vectors, with a vantage-point tree over the centroids.

Each round the tree is built anew on the driver from the few centroids and broadcast; every vector walks it best-first by lower bounds,
many vectors side by side. Bounds are floating point and leave room for rounding, radii prune inclusively, and leaf distances
are exact integers, so ties go to the smaller number and the result does not depend on the tree. Only sums and counts by centroid leave a task.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trendloom.session import written

#: Components beyond it stand for it, so that squared distances of 64 components fit in a long.
LARGEST = 1 << 27
_ROOM = 1e-9
_ROWS = 4096


def squared(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of all ``vectors`` to a few ``points``."""
    out = np.empty((len(vectors), len(points)), dtype=np.int64)
    for j, p in enumerate(points):
        apart = vectors - p
        np.einsum("ij,ij->i", apart, apart, out=out[:, j])
    return out


class VantageTree:
    """Points by number. A node holds its vantage point, or its points if it is a leaf, and for both halves of the rest the
    nearest and farthest distance from the vantage point."""

    def __init__(self, points: np.ndarray, leaf: int = 4):
        self.points = np.asarray(points, dtype=np.int64)
        self.numbers: list[np.ndarray] = []                              # of the points that a node compares
        self.children: list[list[tuple[int, float, float]]] = []          # node, nearest, farthest
        self._grow(np.arange(len(self.points)), leaf)

    def _grow(self, numbers: np.ndarray, leaf: int) -> int:
        node = len(self.numbers)
        self.numbers.append(numbers)
        self.children.append([])
        if len(numbers) > max(leaf, 1):
            rest = numbers[1:]
            apart = np.sqrt(squared(self.points[rest], self.points[numbers[:1]])[:, 0].astype(np.float64))
            order = np.argsort(apart, kind="stable")
            middle = (len(rest) + 1) // 2
            self.numbers[node] = numbers[:1]
            for half in (order[:middle], order[middle:]):
                if len(half):
                    child = self._grow(np.sort(rest[half]), leaf)
                    self.children[node].append((child, float(apart[half].min()), float(apart[half].max())))
        return node

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest point, the smaller on ties, the squared distance, and how many distances were computed."""
        n, computed = len(vectors), 0
        best = np.full(n, np.iinfo(np.int64).max, dtype=np.int64)
        number = np.full(n, len(self.points), dtype=np.int64)
        bound = np.full((n, len(self.numbers)), np.inf)
        bound[:, 0] = 0.0
        open_rows = np.arange(n)
        while len(open_rows):
            node = bound[open_rows].argmin(axis=1)
            low = bound[open_rows, node]
            # A branch whose bound equals the best distance may hold an equal point of a smaller number.
            go = low <= np.sqrt(best[open_rows].astype(np.float64)) * (1 + _ROOM) + _ROOM
            open_rows, node, low = open_rows[go], node[go], low[go]
            for which in np.unique(node):
                here = node == which
                rows, floor = open_rows[here], low[here]
                bound[rows, which] = np.inf
                own = self.numbers[which]
                apart = squared(vectors[rows], self.points[own])
                computed += apart.size
                at = apart.argmin(axis=1)
                found = apart[np.arange(len(rows)), at]
                better = (found < best[rows]) | ((found == best[rows]) & (own[at] < number[rows]))
                best[rows[better]], number[rows[better]] = found[better], own[at[better]]
                if self.children[which]:
                    away = np.sqrt(apart[:, 0].astype(np.float64))
                    for child, near, far in self.children[which]:
                        reach = np.maximum(near - away, away - far) - _ROOM * (away + far) - _ROOM
                        bound[rows, child] = np.maximum(floor, reach)
        return number, best, computed


def quantised(vectors: DataFrame, dims: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, cells``: vectors of ``dims`` components, none of them null or not finite, each as floor(scale * x)."""
    x = F.col("_vector")
    usable = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    cell = lambda c: F.greatest(F.least(F.floor(c * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("_vector"))
    return rows.where(F.coalesce(usable, F.lit(False))).select("vec_id", F.transform(x, cell).alias("cells"))


def first_centroids(cells: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of seed and id; of equal hashes the smaller vector first."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = cells.orderBy(mark, "cells").limit(k).collect()
    return np.array([r.cells for r in rows], dtype=np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int64)


def _assigned(cells: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    tree = cells.sparkSession.sparkContext.broadcast(VantageTree(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, _ROWS):
                part = batch.slice(low, _ROWS)
                number, distance, _ = tree.value.nearest(_matrix(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return cells.select("vec_id", "cells").mapInArrow(run, "vec_id long, cluster int, distance long")


def _moved(cells: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of means; empty ones stay."""
    k, dims = centroids.shape
    tree = cells.sparkSession.sparkContext.broadcast(VantageTree(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, _ROWS):
                vectors = _matrix(batch.column(0).slice(low, _ROWS))
                number, _, _ = tree.value.nearest(vectors)
                order = np.argsort(number, kind="stable")
                own, starts = np.unique(number[order], return_index=True)
                sums[own] += np.add.reduceat(vectors[order], starts, axis=0)
                counts += np.bincount(number, minlength=k)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(list(sums[some]), type=pa.list_(pa.int64()))],
                                         ["cluster", "n", "sums"])

    partial = cells.select("cells").mapInArrow(run, "cluster int, n long, sums array<long>")
    totals = (partial.select("cluster", "n", F.posexplode("sums").alias("pos", "x"))
              .groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x")))
    after = centroids.copy()
    for r in totals.collect():  # as many rows as the centroids have components
        after[r.cluster, r.pos] = r.x // r.n
    return after


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2",
            id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of every usable vector after ``rounds`` rounds and a last assignment, and the final centroids.

    Centroids start as the ``k`` vectors with the smallest lower-case hexadecimal sha256 of ``seed:id``, fewer if there are fewer
    vectors. The driver holds ``k`` centroids of ``dims`` numbers, nothing that grows with the vectors.

    Vectors that are null, of another length, or hold a null or a number that is not finite are left out. A null id is hashed as empty
    text and comes back as null; repeated rows are vectors of their own, equal hashes go by the smaller vector. Components
    whose integer is beyond ``LARGEST`` stand for that bound. Equal distances go to the smaller centroid number. No
    usable vector: no rows, no centroids. Other columns are not used.
    """
    cells = written(quantised(vectors, dims, scale, id_col, vector_col), "cells")
    centroids = first_centroids(cells, k, seed)
    if not len(centroids):
        return cells.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), np.zeros((0, dims), dtype=np.int64)
    for _ in range(rounds):
        centroids = _moved(cells, centroids)
    return written(_assigned(cells, centroids), "nearest-centroids"), centroids


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def report(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with the sum of distances of its cluster and of all, and its centroid's digest."""
    spark = assigned.sparkSession
    marks = spark.createDataFrame([(i, digest(c)) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total: Column = assigned.select(F.sum("distance")).scalar()
    # One row a centroid on the right.
    return (assigned.join(F.broadcast(sums.join(marks, "cluster")), "cluster")
            .select("vec_id", "cluster", "distance", "cluster_inertia", total.alias("inertia"), "centroid_sha256"))
