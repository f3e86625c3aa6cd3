"""K-means over baskets with centres that are a table.

A centre is the items of its baskets with their summed counts, and the number of
baskets: nothing is as long as the catalogue and nothing is on the driver.  Baskets
are dealt once, as a table in buckets; a round exchanges no points, only sums.  The
squared distance of a basket x from a centre s / m is x·x - 2 x·s / m + s·s / m²;
x·s is a join on the item, s·s is summed once a round, and x·x is the same for all
centres.  Sums are of whole numbers, so results do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.operators.clustering import basket_item_counts
from basketry.plans.scratch import materialize, materialize_with, scratch_path

CHUNK = 16  # centres that are held against a basket in one row
BUCKET = 1 << 20  # points of a bucket, about


def first_centres(points: DataFrame, k: int, seed: str) -> DataFrame:
    """The ``k`` baskets of the smallest MD5 of "``seed``:tid" as centres (cluster, item, s, m), in that order."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("tid").cast("string")))
    # k rows: their numbers need no exchange of the baskets
    chosen = points.select("tid").distinct().orderBy(digest, "tid").limit(k).collect()
    if not chosen:
        return points.select(F.lit(0).alias("cluster"), "item", F.col("n").alias("s"), F.col("n").alias("m"))
    number = F.element_at(F.create_map(*[x for i, r in enumerate(chosen) for x in (F.lit(r["tid"]), F.lit(i))]), F.col("tid"))
    held = points.where(F.col("tid").isin([r["tid"] for r in chosen]))
    return held.select(number.alias("cluster"), "item", F.col("n").alias("s"), F.lit(1).cast("bigint").alias("m"))


def _double(column: str) -> Column:
    return F.col(column).cast("double")


def _nearest(points: DataFrame, centres: DataFrame, most: int = CHUNK) -> DataFrame:
    """(tid, cluster, away): each basket's nearest centre, ties to the smaller number; ``away`` lacks x·x.

    Centres are held against a basket in chunks of up to ``most`` neighbouring
    numbers, one row per item and chunk with their sums side by side.  Points lie
    together by basket, so the products are summed without an exchange.
    """
    own = centres.groupBy("cluster", "m").agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    own = own.withColumn("own", _double("ss") / (_double("m") * _double("m"))).select("cluster", "m", "own")
    own = materialize(own, "own")
    # of the centres that share nothing with a basket only the one nearest to the origin can be its nearest
    seen = own.agg(
        F.min(F.struct(F.col("own").alias("away"), "cluster")).alias("lone"), F.min("cluster").alias("low"), F.max("cluster").alias("high")
    ).first()
    low, lone = seen["low"], seen["lone"]
    width = min(most, seen["high"] - low + 1)
    chunk = F.floor((F.col("cluster") - F.lit(low)) / F.lit(width)).cast("int").alias("chunk")
    places = [((F.col("cluster") - F.lit(low)) % F.lit(width) == j, f"{j}") for j in range(width)]
    sizes = own.groupBy(chunk).agg(*[F.max(F.when(at, F.struct("own", "m", "cluster"))).alias("c" + j) for at, j in places])
    weighted = centres.groupBy("item", chunk).agg(*[F.sum(F.when(at, F.col("s"))).alias("s" + j) for at, j in places])
    # the left join keeps baskets that share nothing with any centre
    first = F.coalesce("chunk", F.lit(0)).alias("chunk")
    products = [F.coalesce(F.sum(F.col("n") * F.col("s" + j)), F.lit(0)).alias("x" + j) for _, j in places]
    shared = points.join(weighted, "item", "left").groupBy("tid", first).agg(*products)
    shared = shared.join(F.broadcast(sizes), "chunk")  # k rows
    near = [F.struct(F.lit(lone["away"]).alias("away"), F.lit(lone["cluster"]).alias("cluster"))]
    for _, j in places:
        away = F.col(f"c{j}.own") - 2 * _double("x" + j) / F.col(f"c{j}.m")
        near.append(F.when(F.col("c" + j).isNotNull(), F.struct(away.alias("away"), F.col(f"c{j}.cluster").alias("cluster"))))
    shared = shared.select("tid", F.least(*near).alias("near"))
    if width <= seen["high"] - low:
        shared = shared.groupBy("tid").agg(F.min("near").alias("near"))
    return shared.select("tid", "near.cluster", "near.away")


def _moved(points: DataFrame, nearest: DataFrame, centres: DataFrame) -> DataFrame:
    """Centres of the baskets that are nearest to them; one without baskets stays.

    Baskets and their clusters lie in the same buckets.  By hash, as a merge would sort all points.
    """
    given = nearest.select("tid", "cluster").hint("shuffle_hash")
    sums = points.join(given, "tid").groupBy("cluster", "item").agg(F.sum("n").alias("s"), F.sum("first").alias("firsts"))
    sums = materialize(sums, "sums")
    sizes = sums.groupBy("cluster").agg(F.sum("firsts").alias("m"))
    moved = sums.join(F.broadcast(sizes), "cluster").select("cluster", "item", "s", "m")  # k rows
    left = centres.join(F.broadcast(sizes.select("cluster")), "cluster", "left_anti")
    return moved.unionByName(left)


def _stored(points: DataFrame) -> DataFrame:
    """Points (tid, item, n, first) in buckets by basket, so that no round exchanges them; one row of a basket is its ``first``."""
    spark = points.sparkSession
    held, seen = materialize_with(points, "points", F.count("*").alias("n"))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-seen["n"] // BUCKET))
    place = F.row_number().over(Window.partitionBy("tid").orderBy("item"))
    path = scratch_path(spark, "baskets")
    name = f"baskets_{path.rsplit('-', 1)[1]}"
    dealt = held.repartition(buckets, "tid").withColumn("first", (place == 1).cast("bigint"))
    dealt.write.bucketBy(buckets, "tid").option("path", path).saveAsTable(name)
    return spark.table(name)


def cluster_sparse(
    items: DataFrame, k: int, rounds: int, tid: str = "tid", item: str = "item", seed: str = "start", start: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Baskets by what they hold: (tid, cluster, distance), and the centres (cluster, item, s, m).

    Each of ``rounds`` rounds gives every basket to its nearest centre by squared
    distance of item counts and moves centres to the means of their baskets; then
    baskets are given once more.  ``start`` may give the first centres; else they
    are ``k`` baskets chosen by a hash.  Null ids and items are left out; fewer
    baskets than ``k`` make fewer clusters; no baskets give no rows.
    """
    if k < 1 or rounds < 0:
        raise ValueError("k must be at least 1 and rounds not negative")
    points = _stored(basket_item_counts(items, tid, item).select("tid", "item", "n"))
    centres = materialize(first_centres(points, k, seed) if start is None else start.select("cluster", "item", "s", "m"), "centres")
    if centres.isEmpty():
        none = points.select("tid", F.lit(0).alias("cluster"), F.lit(0.0).alias("distance")).limit(0)
        return none, centres
    for _ in range(rounds):
        centres = materialize(_moved(points, _nearest(points, centres), centres), "centres")
    lengths = points.groupBy("tid").agg(F.sum(F.col("n") * F.col("n")).alias("xx"))
    given = _nearest(points, centres).join(lengths.hint("shuffle_hash"), "tid")
    # against rounding of a basket that is its centre
    distance = F.greatest(_double("xx") + F.col("away"), F.lit(0.0))
    return given.select("tid", "cluster", distance.alias("distance")), centres
