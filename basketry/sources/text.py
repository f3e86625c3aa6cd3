"""Baskets as text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _items(text: Column, item_type: str) -> Column:
    return F.split(F.trim(text), r"\s+").cast(f"array<{item_type}>")


def parse_spmf(lines: DataFrame, item_type: str = "bigint", column: str = "value") -> DataFrame:
    """Baskets (tid, items) from lines ``tid,item item item``.

    Blank lines are skipped; a line of another form fails the job.
    """
    rows = lines.where(F.trim(column) != "")
    form = F.col(column).rlike(r"^\s*\d+\s*,\s*[^,\s]+(\s+[^,\s]+)*\s*$")
    parts = F.split(F.col(column), ",", 2)
    tid = F.when(form, parts[0]).otherwise(
        F.raise_error(F.concat(F.lit("not a transaction line: "), F.col(column)))
    )
    return rows.select(F.trim(tid).cast("bigint").alias("tid"), _items(parts[1], item_type).alias("items"))


def read_spmf(spark: SparkSession, path: str, item_type: str = "bigint") -> DataFrame:
    """Baskets (tid, items) from files of lines ``tid,item item item``."""
    return parse_spmf(spark.read.text(path), item_type)


def read_basket_lines(spark: SparkSession, path: str, item_type: str = "bigint") -> DataFrame:
    """Raw baskets (line, items) from files of lines ``item item item``."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.col("value").alias("line"), _items(F.col("value"), item_type).alias("items"))


def index_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines of text files, numbered 0, 1, 2, ...: (no, line, value).

    The order is that of the file names and of the lines within a file; the
    number after ``part-`` in a name counts as a number.
    ``value`` is ``no,line``.  Lines are numbered within each split as it is
    read, and the number of lines in the splits before it is added, so the text
    is neither sorted nor brought together; one row per split is.
    """
    rows = spark.read.text(path).where(F.length("value") > 0).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("seen"),
    )
    splits = rows.groupBy("file", "start").agg(F.min("seen").alias("first"), F.count("*").alias("n"))
    name = F.regexp_extract("file", r"[^/]*$", 0)
    order = [F.regexp_extract("file", "^(.*/)", 1), F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("bigint"), F.col("file"), F.col("start")]
    # one row per file split, so this window does not grow with the text itself
    before = F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select("file", "start", "first", F.coalesce(before, F.lit(0)).alias("offset"))
    return (
        rows.join(offsets, ["file", "start"])
        .withColumn("no", F.col("offset") + F.col("seen") - F.col("first"))
        .select("no", "line", F.concat_ws(",", F.col("no").cast("string"), "line").alias("value"))
    )
