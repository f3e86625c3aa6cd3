from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from basketry.operators.baskets import hot_keys, to_baskets
from basketry.operators.clustering import count_vectors
from basketry.operators.recommend import last_transaction
from basketry.operators.support import dealt, itemset_support
from basketry.plans import scratch

ADVISED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def _most_rows(spark, label: str, before: set) -> int:
    """The most rows of a file of the tables ``label`` written since."""
    new = [str(p) for p in _tables(spark) - before if p.name.rsplit("-", 1)[0] == label]
    return spark.read.parquet(*new).groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]


def _tables(spark) -> set:
    return set(Path(scratch.scratch_root(spark).removeprefix("file:"), "basketry").glob("*"))


def test_the_last_transaction_is_found_in_small_shares(spark, monkeypatch):
    monkeypatch.setattr(scratch, "SHARE_ROWS", 10)
    rows = spark.range(100, numPartitions=1).select(
        F.lit("s").alias("site"), (F.col("id") % 7).alias("user"), F.col("id").alias("group"),
        F.col("id").alias("item"), F.timestamp_seconds("id").alias("timestamp"),
    )
    before = _tables(spark)
    assert sorted(r["group"] for r in last_transaction(rows).collect()) == list(range(93, 100))
    assert _most_rows(spark, "held-items", before) <= 10


def test_baskets_are_counted_in_small_shares(spark, monkeypatch):
    monkeypatch.setattr(scratch, "SHARE_ROWS", 10)
    rows = spark.range(100, numPartitions=1).select((F.col("id") % 20).alias("tid"), (F.col("id") % 3).alias("item"))
    before = _tables(spark)
    vectors = count_vectors(rows)
    assert {r["tid"]: sum(r["features"].values) for r in vectors.collect()} == {t: 5 for t in range(20)}
    assert _most_rows(spark, "item-rows", before) <= 10


def test_keys_of_baskets_are_counted_in_small_shares(spark, monkeypatch):
    monkeypatch.setattr(scratch, "SHARE_ROWS", 10)
    rows = spark.range(100, numPartitions=1).select((F.col("id") % 20).alias("tid"), (F.col("id") % 3).alias("item"))
    before = _tables(spark)
    assert {r["tid"]: r["items"] for r in to_baskets(rows, "tid").collect()} == {t: [0, 1, 2] for t in range(20)}
    assert _most_rows(spark, "item-rows", before) <= 10


def test_itemsets_are_looked_up_in_small_shares(spark, monkeypatch):
    monkeypatch.setattr(scratch, "SHARE_ROWS", 10)
    rows = spark.range(100, numPartitions=1).select((F.col("id") % 50).alias("tid"), (F.col("id") % 4).alias("item"))
    given = spark.createDataFrame([([0, 2],), ([1],), ([0, 1],)], "items array<bigint>")
    for more, label in (({}, "baskets"), ({"width": 0}, "item-rows")):
        before = _tables(spark)
        found = itemset_support(rows, given, **more)
        assert {tuple(r["items"]): r.support for r in found.collect()} == {(0, 2): 25, (1,): 25, (0, 1): 0}
        assert _most_rows(spark, label, before) <= 10


def test_wide_rows_are_dealt_by_what_they_find(spark, monkeypatch):
    """Before, a task found as many rows as all sets make of a file's rows, however many those are."""
    monkeypatch.setattr(scratch, "SHARE_ROWS", 10)
    rows = spark.range(30).select(F.col("id").alias("tid"), (F.col("id") % 4).alias("item"))
    assert dealt(rows, 10) is rows
    shares = dealt(rows, 45)
    assert shares.rdd.getNumPartitions() == 5 and sorted(r.tid for r in shares.collect()) == list(range(30))


def test_small_shares_leave_the_session_as_it_was(spark):
    before, parts = spark.conf.get(ADVISED), spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(ValueError):
        with scratch.small_shares(spark, 5 * scratch.SHARE_ROWS):
            assert spark.conf.get(ADVISED) == str(scratch.SHARE_BYTES)
            assert spark.conf.get("spark.sql.shuffle.partitions") == "5"
            raise ValueError
    assert (spark.conf.get(ADVISED), spark.conf.get("spark.sql.shuffle.partitions")) == (before, parts)
    assert [scratch._n_bytes(x) for x in ("8m", "67108864b", "64MB", "12")] == [8 << 20, 64 << 20, 64 << 20, 12]


def test_keys_are_counted_only_where_a_bucket_is_full(spark):
    rows = spark.range(100, numPartitions=1).select((F.col("id") % 20).alias("tid"))
    before = _tables(spark)
    assert hot_keys(rows, ["tid"], 50) is None
    assert {p.name.rsplit("-", 1)[0] for p in _tables(spark) - before} == {"full"}
