"""Reading dirty records: the good ones, and the others with the reason why not.

A record is looked at once.  Good and bad ones go to one stored table, so the
source is read a single time and both sides belong to the same reading.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.plans.scratch import materialize_with
from basketry.sources.items import FIELDS, FORMATS, Spec, chosen_fields


@dataclass
class Checked:
    """``good`` rows as the unchecked reader gives them, and ``rejected`` (record, reasons)."""

    good: DataFrame
    rejected: DataFrame
    n_good: int
    n_rejected: int

    def by_reason(self) -> DataFrame:
        """(reason, n): a record of several reasons counts for each."""
        rows = self.rejected.select(F.explode("reasons").alias("reason"))
        return rows.groupBy("reason").agg(F.count("*").alias("n"))


def _split(rows: DataFrame, columns: Sequence[str], label: str) -> Checked:
    """Store ``rows`` (columns..., record, reasons); those without a reason are good."""
    bad = F.size("reasons") > 0
    kept = [F.when(~bad, F.col(c)).alias(c) for c in columns]
    slim = rows.select(*kept, F.when(bad, F.col("record")).alias("record"), "reasons")
    table, seen = materialize_with(slim, label, F.count_if(bad).alias("bad"), F.count_if(~bad).alias("good"))
    return Checked(table.where(~bad).select(*columns), table.where(bad).select("record", "reasons"), seen["good"], seen["bad"])


def _reasons(*found: tuple[Column, Column]) -> Column:
    """The texts whose conditions hold; a condition that is null does not."""
    return F.array_compact(F.array(*[F.when(condition, text) for condition, text in found]))


def check_fields(df: DataFrame, spec: Spec | None = None, required: Sequence[str] = ("user", "group", "item")) -> Checked:
    """``map_fields`` for tables with dirty values.

    A value that cannot become its field's type is a reason ``cast: field``, a
    missing one of a ``required`` field ``null: field``.  The record is kept as
    JSON text of all source columns.  Unknown fields and missing columns are
    errors, as they concern every row.
    """
    unknown = [name for name in required if name not in FIELDS]
    if unknown:
        raise ValueError(f"unknown field {unknown[0]!r}, expected one of {sorted(FIELDS)}")
    fields = chosen_fields(df, spec)
    values = {name: F.col(f"`{source}`").try_cast(kind) for name, (source, kind) in fields.items()}
    given = {name: F.col(f"`{source}`").isNotNull() for name, (source, _) in fields.items()}
    failed = [(given[name] & values[name].isNull(), F.lit(f"cast: {name}")) for name in FIELDS]
    missing = [(~given[name], F.lit(f"null: {name}")) for name in required]
    rows = df.select(
        *[value.alias(name) for name, value in values.items()],
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("record"),
        _reasons(*failed, *missing).alias("reasons"),
    )
    return _split(rows, list(values), "checked-items")


def read_items_checked(
    spark: SparkSession, format: str, mapping: Spec | None = None, required: Sequence[str] = ("user", "group", "item"), **options
) -> Checked:
    """``read_items`` for sources with dirty records."""
    if format not in FORMATS:
        raise ValueError(f"unknown source {format!r}, expected one of {sorted(FORMATS)}")
    reader = spark.read.format(FORMATS[format])
    if (schema := options.pop("schema", None)) is not None:
        reader = reader.schema(schema)
    return check_fields(reader.options(**options).load(), mapping, required)


def check_spmf(lines: DataFrame, item_type: str = "bigint", column: str = "value") -> Checked:
    """``parse_spmf`` for dirty files: good baskets (tid, items), and lines with a reason.

    Reasons are ``no comma``, ``no items``, ``null: tid``, ``cast: tid``, and
    ``cast: item`` if any item of the line cannot become ``item_type``.  Blank lines
    are skipped, as ever.
    """
    rows = lines.where(F.trim(column) != "").select(F.col(column).alias("record"))
    parts = rows.select("record", F.split("record", ",", 2).alias("parts"))
    named = parts.select(
        "record", F.trim(F.get("parts", F.lit(0))).alias("name"), F.trim(F.get("parts", F.lit(1))).alias("rest")
    )
    split = named.select(
        "record", "name", "rest", F.col("name").try_cast("bigint").alias("tid"), F.split("rest", r"\s+").alias("words")
    )
    tried = split.withColumn("items", F.transform("words", lambda w: w.try_cast(item_type)))
    reasons = _reasons(
        (F.col("rest").isNull(), F.lit("no comma")),
        (F.col("rest") == "", F.lit("no items")),
        (F.col("name") == "", F.lit("null: tid")),
        ((F.col("name") != "") & F.col("tid").isNull(), F.lit("cast: tid")),
        ((F.col("rest") != "") & F.exists("items", lambda x: x.isNull()), F.lit("cast: item")),
    )
    return _split(tried.select("tid", "items", "record", reasons.alias("reasons")), ["tid", "items"], "checked-lines")
