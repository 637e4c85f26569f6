"""Centroid clustering with a vantage-point tree over the centroids.

Vectors become whole numbers, so that sums, distances and ties are exact. Each
round the driver builds a vantage-point tree over the centroids (of a stated number,
so it is small) and broadcasts it; tasks search it for every vector of a batch and sum
the vectors of each centroid; Spark adds the sums of the tasks.

The search is best first for each vector: of its open nodes it takes the one
with the least lower bound on the distance. A node's bound comes from the triangle
inequality at its parent's vantage point and the range of distances on the node's
side. A node goes only if its bound is above the best distance found; one that just
reaches it is looked into, since a centroid of a smaller number may lie there at the
same distance. Bounds are square roots in double precision, lowered by a margin
far above their rounding; distances are whole numbers, and of equal ones the smaller
centroid wins.
The vectors of a batch go through the tree together: those with the same node next are
looked at as one block, which changes the order of work but no vector's search.

Defined cases: vectors that are null, of another length, or hold a null or
non-finite component are left out; repeated rows are vectors of their own; fewer
vectors than `k` give so many centroids; ties of the first centroids' hash go by the
vector; a null vec_id hashes as `null`; an empty table gives no rows; columns
besides id and vector are not read. A component whose whole number reaches LIMIT
in size stops the run with a message: distances would not fit in 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave.llm.common import stored

DIMENSIONS = 64
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
#: Whole numbers stay below it, so that 64 squared differences fit in 63 bits.
LIMIT = 1 << 27
#: Centroids in a leaf of the tree.
LEAF = 2
#: Vectors searched together.
BLOCK = 4096


@dataclass
class Node:
    """A ball of centroids. Inner nodes have a vantage point and two children with their ranges of distances from it."""

    members: np.ndarray
    vantage: int = -1
    children: tuple[int, ...] = ()
    low: tuple[float, ...] = ()
    high: tuple[float, ...] = ()


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number vectors from one centroid."""
    apart = vectors - centroid
    return np.einsum("ij,ij->i", apart, apart)


class VantageTree:
    """Vantage-point tree over whole-number centroids."""

    def __init__(self, centroids: np.ndarray, leaf: int = LEAF):
        self.centroids, self.nodes = centroids, []
        if len(centroids):
            self._grow(np.arange(len(centroids)), leaf)

    def _grow(self, members: np.ndarray, leaf: int) -> int:
        at = len(self.nodes)
        node = Node(members)
        self.nodes.append(node)
        if len(members) <= leaf:
            return at
        # the vantage point is the member farthest from the first one; the rest is halved by its distance from it
        vantage = int(members[np.argmax(squared(self.centroids[members], self.centroids[members[0]]))])
        rest = members[members != vantage]
        away = np.sqrt(squared(self.centroids[rest], self.centroids[vantage]).astype(float))
        order = np.argsort(away, kind="stable")
        halves = [half for half in np.array_split(order, 2) if len(half)]
        node.vantage = vantage
        node.low = tuple(float(away[half].min()) for half in halves)
        node.high = tuple(float(away[half].max()) for half in halves)
        node.children = tuple(self._grow(rest[half], leaf) for half in halves)
        return at

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest centroid, its squared distance, distances worked out) for each vector."""
        n = len(vectors)
        best = np.full(n, np.iinfo(np.int64).max)
        number = np.full(n, len(self.centroids))
        bound = np.full((n, len(self.nodes)), np.inf)
        bound[:, 0] = 0.0
        looked = 0

        def meet(rows: np.ndarray, centroid: int) -> np.ndarray:
            apart = squared(vectors[rows], self.centroids[centroid])
            better = (apart < best[rows]) | ((apart == best[rows]) & (centroid < number[rows]))
            best[rows[better]], number[rows[better]] = apart[better], centroid
            return apart

        searching = np.arange(n)
        while len(searching):
            following = np.argmin(bound[searching], axis=1)
            least = bound[searching, following]
            # inclusive: a node whose bound equals the best distance may hold a tie
            going = least <= np.sqrt(best[searching].astype(float))
            searching, following = searching[going], following[going]
            bound[searching, following] = np.inf
            for at in np.unique(following):
                rows, node = searching[following == at], self.nodes[at]
                if not node.children:
                    for centroid in node.members:
                        looked += len(rows)
                        meet(rows, int(centroid))
                    continue
                looked += len(rows)
                away = np.sqrt(meet(rows, node.vantage).astype(float))
                for child, low, high in zip(node.children, node.low, node.high):
                    # double precision errs by some 1e-16 of the distances: the margin keeps the bound below the truth
                    bound[rows, child] = np.maximum(0.0, np.maximum(low - away, away - high) - 1e-9 * (away + high) - 1e-9)
        return number, best, looked


def whole_numbers(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that are kept, v with whole components."""
    value = F.col(vector)
    sound = (F.size(value) == DIMENSIONS) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = F.transform(value, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    fits = F.forall(value, lambda x: F.abs(F.lit(float(SCALE)) * x.cast("double")) < LIMIT)
    checked = F.when(fits, scaled).otherwise(F.raise_error(F.lit(f"a component of {SCALE} times {LIMIT // SCALE} or more: distances would not fit in 64 bits")))
    return vectors.where(value.isNotNull() & sound).select(F.col(id_column).alias("vec_id"), checked.cast("array<bigint>").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), DIMENSIONS)


def _assigned(frame: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    tree = frame.sparkSession.sparkContext.broadcast(VantageTree(centroids))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block = batch.slice(at, BLOCK)
                number, best, _ = tree.value.nearest(_matrix(block.column(1)))
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(number, pa.int32()), pa.array(best, pa.int64())], names=["vec_id", "cluster", "distance"])

    kind = frame.schema["vec_id"].dataType.simpleString()
    return frame.mapInArrow(of, f"vec_id {kind}, cluster int, distance bigint")


def _sums(frame: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, at, n, total): number of vectors of each centroid, and the sum of each component."""
    tree = frame.sparkSession.sparkContext.broadcast(VantageTree(centroids))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                vectors = _matrix(batch.slice(at, BLOCK).column(1))
                number, _, _ = tree.value.nearest(vectors)
                found = np.unique(number)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found, pa.int32()),
                        pa.array([int((number == c).sum()) for c in found], pa.int64()),
                        pa.array([vectors[number == c].sum(axis=0).tolist() for c in found], pa.list_(pa.int64())),
                    ],
                    names=["cluster", "n", "sums"],
                )

    parts = frame.select("vec_id", "v").mapInArrow(of, "cluster int, n bigint, sums array<bigint>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("at", "part"))
    # decimals, so that no number of vectors overflows
    return each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(20,0)")).alias("total"))


def first_centroids(frame: DataFrame, k: int, seed: int = 3) -> np.ndarray:
    """The `k` vectors whose id has the smallest hash."""
    order: list[Column] = [F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256), F.col("v")]
    rows = frame.orderBy(*order).limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), DIMENSIONS)


def cluster_vectors(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 3) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    frame = stored(whole_numbers(vectors))
    centroids = first_centroids(frame, k, seed)
    for _ in range(rounds):
        after = centroids.copy()
        for row in _sums(frame, centroids).collect():
            after[row["cluster"], row["at"]] = int(row["total"]) // row["n"]
        if (after == centroids).all():
            break  # further rounds would change nothing
        centroids = after
    assigned = stored(_assigned(frame, centroids))
    hashes = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    named = frame.sparkSession.createDataFrame(hashes, "cluster int, centroid_sha256 string")
    inertia = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    # at most k rows
    sums = {r["cluster"]: int(r["own"]) for r in inertia.collect()}
    totals = frame.sparkSession.createDataFrame([(c, own, sum(sums.values())) for c, own in sums.items()], "cluster int, cluster_inertia bigint, inertia bigint")
    return assigned.join(F.broadcast(totals.join(named, "cluster")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
