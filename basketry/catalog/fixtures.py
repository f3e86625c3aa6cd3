"""The test tables seen as baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.usecases import Attributes, attributes_to_items, bag_of_attributes
from basketry.plans.scratch import materialize, scratch_path


#: rows of a file of a streamed batch, about
FILE_ROWS = 1 << 18


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def brand_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as baskets of brands: few items, every brand frequent."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("l_orderkey").alias("tid"), F.col("p_brand").alias("item")
    )


def part_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as baskets of parts: many items, each of them rare."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("tid"), F.col("l_partkey").alias("item")
    )


def order_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as baskets of attributes; the nation determines the region."""
    joined = (
        table(spark, sf, "orders")
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    names = {"nation": "c_nationkey", "region": "n_regionkey", "seg": "c_mktsegment", "status": "o_orderstatus"}
    return attributes_to_items(joined, names, "o_orderkey")


def order_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as baskets of attributes that do not depend on each other."""
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    names = {"prio": "o_orderpriority", "status": "o_orderstatus", "seg": "c_mktsegment", "nation": "c_nationkey"}
    return attributes_to_items(joined, names, "o_orderkey")


def customer_bags(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as bags of their attributes, their balance's quarter, and of all their orders."""
    orders = table(spark, sf, "orders")
    return bag_of_attributes([
        Attributes(table(spark, sf, "customer"), "c_custkey", {"seg": "c_mktsegment", "balance": "c_acctbal"}, {"balance": 4}),
        Attributes(orders, "o_custkey", {"status": "o_orderstatus", "prio": "o_orderpriority"}),
    ])


def dirty_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines ``order,part part``, one in ten with a semicolon, one with a word for a part, one with a huge id, one without an id."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    items = F.array_join(F.sort_array(F.collect_set("l_partkey")).cast("array<string>"), " ")
    lines = rows.groupBy("l_orderkey").agg(items.alias("items"))
    case, key = F.pmod("l_orderkey", F.lit(10)), F.col("l_orderkey").cast("string")
    line = (
        F.when(case == 3, F.concat(key, F.lit(";"), F.col("items")))
        .when(case == 5, F.concat(key, F.lit(",p "), F.col("items")))
        .when(case == 7, F.concat(F.lit("99999999999999999999"), key, F.lit(","), F.col("items")))
        .when(case == 9, F.concat(F.lit(" ,"), F.col("items")))
        .otherwise(F.concat(key, F.lit(","), F.col("items")))
    )
    return lines.select(line.alias("value"))


def purchases(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with customer, order, date and brand, unmapped."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("shop", F.lit("s1"))
    )


PURCHASE_SPEC = {
    "site": "shop",
    "user": ("o_custkey", "bigint"),
    "group": ("o_orderkey", "bigint"),
    "item": ("p_brand", "string"),
    "timestamp": ("o_orderdate", "timestamp"),
}


def as_events(rows: DataFrame) -> DataFrame:
    """Rows of the events table with the names the streams use, and a time stamp type that they accept."""
    return rows.select(
        "event_id", F.col("ts").cast("timestamp").alias("timestamp"), F.col("user_id").alias("user"),
        F.col("event_type").alias("item"),
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    return as_events(table(spark, sf, "events"))


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table read as a stream of files."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return as_events(stream)


def event_batches(spark: SparkSession, sf: str, parts: int = 4) -> DataFrame:
    """The events as a stream of ``parts`` batches in the order of time, some late and some repeated.

    Of the last half hour before a cut every other event comes with the next
    batch; every tenth event of the last hour comes with both.
    """
    path = scratch_path(spark, "event-batches")
    rows = table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    ends = rows.agg(F.min("us").alias("low"), F.max("us").alias("high")).first()
    half_hour, width = 1_800_000_000, (ends["high"] - ends["low"]) // parts + 1
    part = F.floor((F.col("us") - ends["low"]) / width)
    left = (part + 1) * width + ends["low"] - F.col("us")  # until the cut
    late = (left < half_hour) & (F.col("event_id") % 2 == 0)
    twice = (left < 2 * half_hour) & (F.col("event_id") % 10 == 1)
    first = F.when(late, part + 1).otherwise(part)
    dealt = rows.withColumn("_part", F.explode(F.when(twice, F.array(part, part + 1)).otherwise(F.array(first))))
    dealt = materialize(dealt.withColumn("_part", F.least("_part", F.lit(parts - 1)).cast("int")).drop("us"), "dealt")
    # every batch gets equally many files, as a stream takes so many at a time; one each if one would be without rows
    n_files = dealt.count() // (parts * FILE_ROWS) + 1
    share = F.pmod(F.hash("event_id"), F.lit(n_files))
    if dealt.select("_part", share).distinct().count() < parts * n_files:
        n_files = 1
    for number in range(parts):  # a file stream takes files in the order in which they were written
        one = dealt.where(F.col("_part") == number).drop("_part")
        files = one.repartitionById(n_files, share) if n_files > 1 else one.coalesce(1)
        files.write.mode("append").parquet(path)
    schema = one.schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", n_files).parquet(path)
    return as_events(stream)


def event_halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, str]:
    """The events before and from the middle of their time, as tables, and a folder for a stream of them."""
    rows = table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    ends = rows.agg(F.min("us").alias("low"), F.max("us").alias("high")).first()
    middle = (ends["low"] + ends["high"]) // 2
    return rows.where(F.col("us") < middle).drop("us"), rows.where(F.col("us") >= middle).drop("us"), scratch_path(spark, "halves")


def query_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Words of what users wrote, lower case, one row per turn and word."""
    said = table(spark, sf, "conversations").where(F.col("role") == "user")
    words = F.explode(F.split(F.lower("text"), " ")).alias("item")
    return said.select("conv_id", "turn", words).where(F.length("item") > 0)
