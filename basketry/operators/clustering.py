"""Grouping baskets by what they hold."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.operators.baskets import INTEGERS, assign_tids
from basketry.plans.scratch import materialize_with, scratch_path, small_shares


def basket_item_counts(items: DataFrame, tid: str = "tid", item: str = "item") -> DataFrame:
    """How often each item occurs in each basket: (tid, item, n).

    For integer items ``position`` is added, the distance from the smallest.
    """
    rows = items.where(F.col(tid).isNotNull() & F.col(item).isNotNull())
    counts = rows.groupBy(F.col(tid).alias("tid"), F.col(item).alias("item")).agg(F.count("*").alias("n"))
    if dict(rows.dtypes)[item] in INTEGERS:
        low = rows.agg(F.min(item)).first()[0]
        counts = counts.withColumn("position", F.col("item") - F.lit(low))
    return counts


def count_vectors(items: DataFrame, tid: str = "tid", item: str = "item") -> DataFrame:
    """Item counts of each basket as a sparse vector: (tid, features).

    ``items`` has raw item rows; repeats count.  They are summed per (basket,
    item) before a basket is gathered, so a row holds distinct items only.  The
    vector has one cell per distinct item, in item order, none left out; K-means
    keeps centres of that length on the driver, so the catalogue must fit there
    (the baskets need not).

    The cells are written as the four fields a vector is stored as and read
    back as vectors, which keeps the whole step out of Python.
    """
    spark = items.sparkSession
    rows = items.where(F.col(tid).isNotNull() & F.col(item).isNotNull()).select(F.col(tid).alias("tid"), F.col(item).alias("item"))
    with small_shares(spark):
        rows, seen = materialize_with(rows, "item-rows", F.count("*").alias("n"))
    path = scratch_path(spark, "vectors")
    with small_shares(spark, seen["n"]):  # rows are hashed by (basket, item), then sorted by item
        counts = rows.groupBy("tid", "item").agg(F.count("*").alias("n"))
        catalogue = assign_tids(items.select(F.col(item).alias("item")).where("item IS NOT NULL").distinct(), "item")
        size = catalogue.count()
        cells = counts.join(catalogue.select("item", F.col("tid").cast("int").alias("cell")), "item")
        gathered = cells.repartition("tid").groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("cell", "n"))).alias("cells"))
        stored = gathered.select(
            "tid",
            F.struct(
                F.lit(0).cast("tinyint").alias("type"),  # 0 marks a sparse vector
                F.lit(size).cast("int").alias("size"),
                F.col("cells.cell").alias("indices"),
                F.col("cells.n").cast("array<double>").alias("values"),
            ).alias("features"),
        )
        stored.write.parquet(path)
    schema = T.StructType([stored.schema["tid"], T.StructField("features", VectorUDT())])
    return spark.read.schema(schema).parquet(path)


def cluster_baskets(
    items: DataFrame, k: int, max_iter: int, seed: int = 1, tid: str = "tid", item: str = "item"
) -> DataFrame:
    """K-means cluster of each basket's item counts: (tid, cluster)."""
    vectors = count_vectors(items, tid, item)
    model = KMeans(k=k, maxIter=max_iter, seed=seed, predictionCol="cluster").fit(vectors)
    return model.transform(vectors).drop("features")


def cluster_lines(clustered: DataFrame, lines: DataFrame) -> DataFrame:
    """Text lines ``cluster|basket line`` from (tid, cluster) and (tid, line)."""
    return clustered.join(lines, "tid").select(
        F.concat_ws("|", F.col("cluster").cast("string"), "line").alias("value")
    )
