"""Centroid clustering of integer vectors by k-means with sorted centroids.

In every round the other centroids are put in order of their distance from each centroid. A vector starts at the
centroid it had and goes along that order, which it leaves at the first centroid that is farther than twice its
distance: none behind it can be nearer. All arithmetic is in whole numbers, so results don't depend on the order of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.store import Tables

#: Largest component, after scaling, of a vector that is kept: squared distances of 64 components are 2 ** 60 at most, and
#: four times that is still a whole 64-bit number.
LARGEST = 1 << 26

#: Vectors that a task looks at together.
CHUNK = 16384


def kept_vectors(vectors: DataFrame, components: int = 64, scale: int = 64) -> DataFrame:
    """``vec_id, v``: vectors of exactly so many finite components, each as the floor of ``scale`` times it."""
    x = F.transform("embedding", lambda e: e.cast("double") * scale)
    sound = F.forall("s", lambda e: e.isNotNull() & (F.abs(e) <= LARGEST))  # not true for NaN, which is above all numbers
    scaled = vectors.select("vec_id", x.alias("s")).filter((F.size("s") == components) & sound)
    return scaled.select("vec_id", F.transform("s", lambda e: F.floor(e).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest keyed hashes, in order of the hash; a null id has none."""
    own = vectors.filter("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    return np.array([r["v"] for r in own.orderBy("h", "v").limit(k).collect()], np.int64)


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    away = vectors - centroid
    return np.einsum("ij,ij->i", away, away)


def nearest(vectors: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector and its squared distance; ties go to the smaller number.

    ``before`` is where each vector was. The bound is the distance from that centroid, four times of it in squares.
    """
    between = np.array([squared(centroids, c) for c in centroids])
    best, least = before.copy(), np.empty(len(vectors), np.int64)
    for c in np.unique(before):
        rows = np.flatnonzero(before == c)
        own = squared(vectors[rows], centroids[c])
        least[rows], bound = own, 4 * own
        for other in np.argsort(between[c], kind="stable"):
            if other == c:
                continue
            going = bound >= between[c, other]
            rows, bound = rows[going], bound[going]
            if not len(rows):
                break
            d = squared(vectors[rows], centroids[other])
            nearer = (d < least[rows]) | ((d == least[rows]) & (other < best[rows]))
            least[rows[nearer]], best[rows[nearer]] = d[nearer], other
    return best, least


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, v, cluster, distance`` of rows ``vec_id, v, cluster``, whose cluster is where they start."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                best, least = nearest(_matrix(batch.column(1), width), batch.column(2).to_numpy(), centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best.astype(np.int32)), pa.array(least)], names=["vec_id", "v", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "v", "cluster").mapInArrow(run, f"vec_id {kind}, v array<int>, cluster int, distance long")


def cluster_sums(rows: DataFrame, k: int, width: int) -> DataFrame:
    """``cluster, place, n, total``: componentwise sums, one of each cluster for each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            own = batch.column(0).to_numpy()
            n += np.bincount(own, minlength=k)
            vectors = _matrix(batch.column(1), width)
            for c in np.unique(own):
                total[c] += vectors[own == c].sum(axis=0)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(list(total[at]), pa.list_(pa.int64()))], names=["cluster", "n", "totals"])

    parts = rows.select("cluster", "v").mapInArrow(run, "cluster int, n long, totals array<long>")
    split = parts.select("cluster", "n", F.posexplode("totals").alias("place", "total"))
    return split.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids at the floored means of their vectors; those without any stay. Only sums reach the driver: clusters times components."""
    out = centroids.copy()
    for r in cluster_sums(rows, *centroids.shape).collect():
        out[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    return out


def sort_means(vectors: DataFrame, k: int = 16, rounds: int = 3, components: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that is kept.

    Kept are vectors of exactly ``components`` components, none of which is null, NaN or infinite. A component whose
    scaled size is beyond ``LARGEST`` counts as infinite, as squares of it aren't whole 64-bit numbers. Repeated rows are
    vectors of their own; a row without an id is no first centroid, but takes part. With fewer than ``k`` vectors with an
    id there are fewer clusters; with none, or an empty table, no rows. Other columns are left out. Memory of a task is a
    batch of vectors, the centroids and their sums; each round's assignment is a table in the shared folder.
    """
    spark, tables = vectors.sparkSession, Tables(vectors.sparkSession)
    rows = tables.write(kept_vectors(vectors, components, scale).withColumn("cluster", F.lit(0)), "vectors")
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return rows.limit(0).selectExpr("vec_id", "cluster", "0L distance", "0L cluster_inertia", "0L inertia", "'' centroid_sha256")
    for n in range(rounds + 1):
        before, rows = rows, tables.write(assigned(rows, centroids), f"round{n}")
        tables.drop(before)
        if n < rounds:
            centroids = moved(rows, centroids)
    prints = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())]
    own = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    every = own.agg(F.sum("cluster_inertia").alias("inertia"))
    facts = spark.createDataFrame(prints, "cluster int, centroid_sha256 string").join(own, "cluster").crossJoin(F.broadcast(every))  # a row a cluster
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
