"""Ranks and running sums over a whole table, without a single-task window.

Rows are dealt to tasks by ranges of the order and sorted there; each task
numbers its own rows, and only one number per task, its row count or its sums,
is put in order on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.plans.scratch import materialize

#: ``monotonically_increasing_id`` keeps a task's number above this bit, the row's place below
PLACE_BITS = 33
PLACE = (1 << PLACE_BITS) - 1


def in_order(df: DataFrame, keys: Sequence[Column | str], label: str) -> DataFrame:
    """A stored copy of ``df`` in the order of ``keys``, with ``_at``: task number and place."""
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), label)


def _offsets(table: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Per task of ``table``: the sums of ``columns`` over all earlier tasks; one small row a task."""
    rows = (
        table.groupBy(F.shiftright("_at", PLACE_BITS).alias("_task"))
        .agg(*[F.sum(c).cast("bigint").alias(n) for n, c in columns.items()])
        .orderBy("_task")
        .collect()
    )
    before = [list(accumulate((row[n] or 0 for row in rows), initial=0)) for n in columns]
    schema = "_task bigint, " + ", ".join(f"_before_{n} bigint" for n in columns)
    data = [(row["_task"], *[b[k] for b in before]) for k, row in enumerate(rows)]
    return table.sparkSession.createDataFrame(data, schema)


def ranked(df: DataFrame, keys: Sequence[Column | str], label: str, rank: str = "rank") -> DataFrame:
    """``df`` with its row number in the order of ``keys``, from 1."""
    table = in_order(df, keys, label)
    before = _offsets(table, {"rows": F.lit(1)})
    return (
        table.withColumn("_task", F.shiftright("_at", PLACE_BITS))
        .join(F.broadcast(before), "_task")  # one row a task
        .withColumn(rank, F.col("_before_rows") + F.col("_at").bitwiseAND(PLACE) + 1)
        .drop("_task", "_at", "_before_rows")
    )


def with_sums_before(df: DataFrame, keys: Sequence[Column | str], sums: dict[str, str], label: str) -> DataFrame:
    """``df`` with ``rank`` and, per ``name: column`` of ``sums``, the column's sum over all earlier rows."""
    table = in_order(df, keys, label)
    before = _offsets(table, {"rows": F.lit(1)} | {n: F.col(c) for n, c in sums.items()})
    earlier = Window.partitionBy("_task").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    out = table.withColumn("_task", F.shiftright("_at", PLACE_BITS)).join(F.broadcast(before), "_task")
    out = out.withColumn("rank", F.col("_before_rows") + F.col("_at").bitwiseAND(PLACE) + 1)
    for name, column in sums.items():
        within = F.coalesce(F.sum(column).over(earlier), F.lit(0))
        out = out.withColumn(name, F.col(f"_before_{name}") + within)
    return out.select(*df.columns, "rank", *sums)
