"""Lloyd's clustering of whole-number vectors that moves only what changed.

The assignments of all vectors and the sums of all clusters are tables that a
round takes over and writes anew.  After a round few centroids differ.  A vector
whose own centroid stands still is held against the changed ones alone, as every
other is as far as it was; so is one whose centroid came no further away.  Only
the rest is held against all.  A vector that moves is taken off one cluster's
sums and added to another's, whole numbers with a sign, which tasks add up
before they send them.  No vector is shuffled, and the driver sees one row for
each cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrain.llm.common import forget, need, stored
from tidegrain.llm.vectors import finite, matrix, products, whole

CLUSTERS, ROUNDS, WIDTH, SCALE = 16, 3, 64, 64

STATE = "vec_id long, q array<int>, cluster int, distance long, was int"
MOVES = "cluster int, n long, sums array<long>"

Centroids = dict[int, list[int]]


def kept(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id and q (whole components) of the vectors with width finite components."""
    need(vectors, "vec_id", "embedding")
    good = (F.size("embedding") == width) & finite(F.col("embedding"))
    return vectors.filter(good).select(F.col("vec_id").cast("long"), whole(F.col("embedding"), scale).alias("q"))


def first_centroids(rows: DataFrame, k: int = CLUSTERS) -> Centroids:
    """The k vectors with the smallest sha256 of "1:<vec_id>", in that order; vectors without an id are none."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = rows.filter("vec_id is not null").select(key.alias("key"), "q").orderBy("key", "q").limit(k)
    return {i: list(r["q"]) for i, r in enumerate(first.collect())}


def nearest(x: np.ndarray, centroids: Centroids, among: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Number of, and squared distance to, each row's nearest centroid among those named; ties: the smaller number."""
    names = np.array(sorted(among), np.int64)
    c = np.array([centroids[int(i)] for i in names], np.float64)
    d = products(x * x, np.ones((1, x.shape[1]))) - 2 * products(x, c) + products(np.ones((1, x.shape[1])), c * c)
    at = d.argmin(axis=1)
    return names[at], d[np.arange(len(x)), at]


def reassigned(state: DataFrame, centroids: Centroids, changed: list[int]) -> DataFrame:
    """state after its vectors went to their nearest centroid; was names the cluster that each one left (-1: none).

    A row with cluster -1 is new and is held against all centroids.
    """

    width = len(next(iter(centroids.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("q"), width)
            was = b.column("cluster").to_numpy().astype(np.int64)
            old = b.column("distance").to_numpy().astype(np.int64)
            now, distance = was.copy(), old.copy()
            free = was < 0
            moving = np.isin(was, changed) & ~free
            own = np.zeros_like(old)
            for c in np.unique(was[moving]):
                at = was == c
                own[at] = nearest(x[at], centroids, [int(c)])[1]
            # A centroid that went away may lose its vector to any other.
            everything = free | (moving & (own > old))
            if everything.any():
                now[everything], distance[everything] = nearest(x[everything], centroids, list(centroids))
            rest = ~everything
            if changed and rest.any():
                distance[rest & moving] = own[rest & moving]
                other, far = nearest(x[rest], centroids, changed)
                better = (far < distance[rest]) | ((far == distance[rest]) & (other < now[rest]))
                now[rest] = np.where(better, other, now[rest])
                distance[rest] = np.where(better, far, distance[rest])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("q"), pa.array(now.astype(np.int32)), pa.array(distance), pa.array(was.astype(np.int32))], names=["vec_id", "q", "cluster", "distance", "was"])

    return state.select("vec_id", "q", "cluster", "distance").mapInArrow(run, STATE)


def transfers(state: DataFrame) -> DataFrame:
    """What the round's moves add to the count and the sums of each cluster, one row for each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            width = len(b.column("q")[0])
            x = matrix(b.column("q"), width).astype(np.int64)
            for name, sign in (("cluster", 1), ("was", -1)):
                owner = b.column(name).to_numpy()
                for c in np.unique(owner[owner >= 0]):
                    mine = x[owner == c]
                    own = sign * np.concatenate([[len(mine)], mine.sum(axis=0)])
                    sums[int(c)] = sums[int(c)] + own if int(c) in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([int(s[0]) for s in sums.values()], pa.int64()), pa.array([s[1:].tolist() for s in sums.values()], pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return state.filter("cluster != was").select("q", "cluster", "was").mapInArrow(run, MOVES)


def added(sums: DataFrame) -> DataFrame:
    """One row for each cluster: counts and sums of its rows added."""
    one = sums.select("cluster", "n", F.posexplode("sums").alias("at", "x"))
    by_place = one.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    return by_place.groupBy("cluster").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("sums"))


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> tuple[DataFrame, Centroids]:
    """vec_id, q, cluster and distance of every kept vector, and the centroids, after some rounds and one more assignment.

    Vectors that are null, of another width, or with null or non-finite
    components are left out; equal vectors, and rows that repeat, are vectors
    each; of equally near centroids the smaller number counts, of equal ids the
    smaller vector starts; a null vec_id is no start.  With fewer vectors than
    k there are as many centroids; an empty table gives an empty one.  Other
    columns are not read.
    """
    rows = kept(vectors, width, scale)
    centroids = first_centroids(rows, k)
    state = rows.select("vec_id", "q", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    if not centroids:
        return state.limit(0), {}
    changed, sums = list(centroids), None
    for r in range(rounds + 1):
        before, state = state, stored(reassigned(state, centroids, changed))
        if r:
            forget(before)
        if r == rounds:
            return state, centroids
        moved = transfers(state)
        total = stored(added(moved if sums is None else sums.unionByName(moved)).coalesce(1))
        if sums is not None:
            forget(sums)
        sums, changed = total, []
        for row in sums.filter("n > 0").collect():  # one row for each cluster
            new = [s // row["n"] for s in row["sums"]]
            if new != centroids[row["cluster"]]:
                centroids[row["cluster"]] = new
                changed.append(row["cluster"])
    raise AssertionError("unreachable")


def digests(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, the distances summed over the cluster and over all, and the centroid's digest."""
    state, centroids = clustered(vectors)
    spark = vectors.sparkSession
    of = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in centroids.items()]
    named = spark.createDataFrame(of, "cluster int, centroid_sha256 string")
    each = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole_ = each.agg(F.sum("cluster_inertia").alias("inertia"))
    # One row for each cluster.
    small = each.join(named, "cluster").withColumn("inertia", whole_.select("inertia").scalar())
    return state.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
