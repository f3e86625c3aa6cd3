"""Centroids of vectors, with the dot products of every vector kept from round to round.

The squared distance of a vector v from centroid c is v·v - 2 v·c + c·c.  Each
vector's exact products v·c are a column of a stored table; when centroids have
moved, only the components that changed are read: v·c grows by the sum of v_i
times the change of c_i.  A round reads the table of the round before and writes
its own, which is all that a lost executor needs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.vectors import floor_means, matrix, whole_vectors
from basketry.plans.scratch import discard, scratch_path


def update_products(vectors: np.ndarray, products: np.ndarray, change: np.ndarray) -> np.ndarray:
    """``products`` (a row a vector, a column a centroid) after the centroids moved by ``change``."""
    out = products.copy()
    for k, moved in enumerate(change):
        at = np.flatnonzero(moved)
        if len(at):
            out[:, k] += vectors[:, at] @ moved[at]
    return out


def _moved(state: DataFrame, change: np.ndarray, centroids: np.ndarray) -> DataFrame:
    """``state`` with products after ``change`` and each vector's nearest of ``centroids``."""
    k, width = centroids.shape
    norms = np.einsum("ij,ij->i", centroids, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column("vector"), width)
            products = update_products(vectors, matrix(batch.column("products"), k), change)
            away = norms - 2 * products
            cluster = np.argmin(away, axis=1)  # the first of equal ones
            away = away[np.arange(len(vectors)), cluster] + np.einsum("ij,ij->i", vectors, vectors)
            bounds = pa.array(np.arange(0, products.size + 1, k, dtype=np.int32))
            lists = pa.ListArray.from_arrays(bounds, pa.array(products.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("vector"), lists, pa.array(cluster.astype(np.int32)), pa.array(away)],
                names=["key", "vector", "products", "cluster", "distance"],
            )

    kind = state.schema["key"].dataType.simpleString()
    schema = f"key {kind}, vector array<int>, products array<bigint>, cluster int, distance bigint"
    return state.select("key", "vector", "products").mapInArrow(run, schema)


def _centroids(state: DataFrame, old: np.ndarray) -> np.ndarray:
    """floor(mean) of each cluster's vectors; a cluster without vectors keeps its centroid."""
    k, width = old.shape
    sums = [F.sum(F.get("vector", F.lit(i)).cast("bigint")) for i in range(width)]
    means = state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*sums).alias("sums"))
    count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
    for row in means.collect():  # a row a cluster
        count[row["cluster"]], total[row["cluster"]] = row["n"], row["sums"]
    return floor_means(total, count, old)


def cluster_vectors(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    width: int = 64,
    k: int = 8,
    rounds: int = 10,
    scale: int = 1024,
    seed: str = "3",
) -> DataFrame:
    """Per vector (key, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256).

    Kept are vectors of ``width`` components, none null or non-finite; each
    component x becomes floor(``scale`` * x).  The first centroids are the ``k``
    vectors with the smallest SHA-256 of "``seed``:key", in that order.  Each of
    ``rounds`` rounds gives every vector to its nearest centroid (ties: the
    smaller number) and puts every centroid that has vectors at their floor(mean);
    then vectors are given once more.  ``distance`` is squared, the inertias are
    its sums over the cluster and over all.

    Fewer than ``k`` vectors make as many centroids.  Repeated rows count each;
    equal keys are put in the order of their vectors, null keys last.  An empty
    table gives no rows.  Other columns are not read.  Products, at most 2^48
    times ``width``, stay exact in 64 bits.
    """
    spark = df.sparkSession
    kept = whole_vectors(df, vector, scale, {"key": F.col(key)}).where(F.size("vector") == width)
    path = scratch_path(spark, "vectors")
    kept.write.parquet(path)
    state = spark.read.schema(kept.schema).parquet(path)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    first = state.orderBy(digest.asc_nulls_last(), "vector").limit(k).select("vector").collect()
    centroids = np.array([r["vector"] for r in first], np.int64).reshape(-1, width)
    if not len(centroids):
        names = "cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>, centroid_sha256 string"
        kind = state.schema["key"].dataType.simpleString()
        return spark.createDataFrame([], f"key {kind}, {names}")
    # from no products and centroids at 0, the first move is that to the first centroids
    state = state.withColumn("products", F.array_repeat(F.lit(0).cast("bigint"), len(centroids)))
    change = centroids
    for turn in range(rounds + 1):
        moved = _moved(state, change, centroids)
        before, path = path, scratch_path(spark, "products")
        moved.write.parquet(path)
        state = spark.read.schema(moved.schema).parquet(path)
        discard(spark, before)  # nothing reads it any more
        if turn < rounds:
            new = _centroids(state, centroids)
            change, centroids = new - centroids, new
    inertia = {r["cluster"]: r["inertia"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    rows = [
        (c, inertia.get(c), sum(inertia.values()), values, hashlib.sha256(",".join(map(str, values)).encode()).hexdigest())
        for c, values in enumerate(centroids.tolist())
    ]
    schema = "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>, centroid_sha256 string"
    known = F.broadcast(spark.createDataFrame(rows, schema))  # k rows
    return state.select("key", "cluster", "distance").join(known, "cluster").select(
        "key", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"
    )
