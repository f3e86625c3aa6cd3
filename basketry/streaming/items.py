"""Structured Streaming jobs: tracking items, forming baskets, keeping rules fresh.

Each ``foreachBatch`` writes under its batch number and overwrites on a repeat,
so a batch that is run twice after a failure counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from basketry.operators.recommend import match_rules, recommend
from basketry.plans import files
from basketry.plans.border import IncrementalMiner
from basketry.plans.generations import Generations
from basketry.plans.mining import ALGORITHMS, check_parameters, mine, pair_support
from basketry.plans.scratch import materialize
from basketry.sources.items import Spec, map_fields
from basketry.sources.sinks import read_rules_parquet, rule_versions


#: a job ends when all input present is worked off; {"processingTime": "10 seconds"} and the like run on
UNTIL_DONE = {"availableNow": True}


def track_items(
    stream: DataFrame, path: str, checkpoint: str, spec: Spec | None = None, trigger: dict = UNTIL_DONE
) -> StreamingQuery:
    """Append incoming records, mapped to item records, to a Parquet table."""
    items = map_fields(stream, spec)
    return (
        items.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def stream_baskets(
    stream: DataFrame,
    window: str | None = "1 day",
    session: str | None = None,
    late: str = "1 hour",
    user: str = "user",
    item: str = "item",
    timestamp: str = "timestamp",
    event_id: str | None = None,
) -> DataFrame:
    """Closed baskets per user: (start, end, user, items).

    A basket is a tumbling ``window`` or, if ``session`` is given, a run of
    events with no gap as long as that.  Events up to ``late`` behind are
    counted; events repeated under one ``event_id`` count once.  The same call
    on a batch DataFrame gives all baskets.

    The items of a basket are one set in the state, combined before the exchange,
    so that neither holds repeats: a row of state is as long as its basket.
    """
    events = stream.where(F.col(item).isNotNull() & F.col(user).isNotNull())
    if stream.isStreaming:
        events = events.withWatermark(timestamp, late)
        if event_id:
            events = events.dropDuplicatesWithinWatermark([event_id])
    elif event_id:
        # of copies the earliest counts, so the result does not depend on the run
        first = events.groupBy(event_id).agg(F.min(F.struct(timestamp, user, item)).alias("e"))
        events = first.select(event_id, "e.*")
    span = F.session_window(timestamp, session) if session else F.window(timestamp, window)
    closed = events.groupBy(span.alias("w"), F.col(user).alias("user")).agg(
        F.array_sort(F.collect_set(item)).alias("items")
    )
    return closed.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user", "items")


def _each_batch(
    frame: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None], trigger: dict, mode: str = "append"
) -> StreamingQuery:
    return (
        frame.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(work)
        .start()
    )


def _part(root: str, batch: int) -> str:
    return f"{root.rstrip('/')}/batch_id={batch}"


def store_baskets(baskets: DataFrame, root: str, checkpoint: str, trigger: dict = UNTIL_DONE) -> StreamingQuery:
    """Write closed baskets, one folder per batch."""

    def work(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(_part(root, number))

    return _each_batch(baskets, checkpoint, work, trigger)


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("a", "b").agg(F.sum("support").alias("support"))


def stream_pair_support(
    baskets: DataFrame, root: str, checkpoint: str, trigger: dict = UNTIL_DONE, fan: int = 4
) -> StreamingQuery:
    """Keep pair counts of closed baskets: one folder per batch, merged in generations of ``fan`` tables."""

    def work(batch: DataFrame, number: int) -> None:
        keyed = batch.select(F.struct("user", "start").alias("tid"), "items")
        counts = Generations(batch.sparkSession, root, fan)
        if not counts.covers(number):  # a batch that is run again may have been merged before
            counts.add(number, pair_support(keyed, 1), _summed)

    return _each_batch(baskets, checkpoint, work, trigger)


def running_pair_support(spark: SparkSession, root: str, min_count: int = 1) -> DataFrame:
    """Pair supports over all batches so far, from a number of tables that grows with their logarithm."""
    return _summed(Generations(spark, root).read()).where(F.col("support") >= min_count)


def stream_mine(
    baskets: DataFrame, store: str, rules_root: str, checkpoint: str, algorithm: str = "TOPK", trigger: dict = UNTIL_DONE, **params
) -> StreamingQuery:
    """Add closed baskets to the store and bring the rules up to date after each batch that has any.

    The rules of batch n are in ``rules_root/batch_id=n``.  Supports are kept
    from batch to batch (``plans.border``), below ``store`` in a folder that
    readers of the store do not see.  With parameters beyond k, minconf, delta,
    max_len and min_count, or redundancy in a bounded buffer, the whole store is
    mined anew each time.
    """
    kept = set(params) <= {"k", "minconf", "delta", "max_len", "min_count"} and algorithm in ALGORITHMS

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(_part(store, number))
        stored = spark.read.schema(batch.schema).parquet(_part(store, number))
        if kept:
            sizes = {name: params[name] for name in ("max_len", "min_count") if name in params}
            miner = IncrementalMiner(
                spark, f"{store.rstrip('/')}/_supports", params["k"], params["minconf"], algorithm == "TOPKNR", **sizes
            )
            rules = miner.add(number, stored.select(F.struct("user", "start").alias("tid"), "items"))
        elif stored.isEmpty():
            rules = None
        else:
            every = spark.read.schema(batch.schema).parquet(store)
            rules = mine(every.select(F.struct("user", "start").alias("tid"), "items"), algorithm, **params)
        if rules is not None:
            rules.write.mode("overwrite").parquet(_part(rules_root, number))

    check_parameters(algorithm, params)
    return _each_batch(baskets, checkpoint, work, trigger)


def latest_rules(spark: SparkSession, rules_root: str) -> DataFrame:
    """Rules of the last batch mined."""
    table = spark.read.parquet(rules_root)
    last = table.agg(F.max("batch_id")).first()[0]
    return table.where(F.col("batch_id") == F.lit(last)).drop("batch_id")


def _version_for(spark: SparkSession, rules: str, root: str, batch: int) -> int:
    """The rule version of a batch: the latest when it first ran, noted so that a repeat takes the same."""
    note = f"{root.rstrip('/')}/_rules/{batch}"
    if not files.exists(spark, note):
        versions = rule_versions(spark, rules)
        if not versions:
            raise LookupError(f"no rules below {rules}")
        files.publish(spark, note, str(versions[-1]))
    return int(files.read_text(spark, note))


def stream_recommend(
    baskets: DataFrame, rules: DataFrame | str, root: str, checkpoint: str, n: int = 3, min_weight: float = 1.0,
    trigger: dict = UNTIL_DONE,
) -> StreamingQuery:
    """Recommend items for each closed basket, one folder per batch.

    ``rules`` is a rule table, or a folder of versions that ``write_rules_parquet``
    writes while the stream runs.  Then each batch takes the latest version, which
    column ``rules_version`` tells; the choice is noted first, so that a batch that
    is run again gives the same rows.
    """

    def work(batch: DataFrame, number: int) -> None:
        keys = ["user", "start"]
        spark, table, version = batch.sparkSession, rules, None
        if isinstance(rules, str):
            version = _version_for(spark, rules, root, number)
            table = read_rules_parquet(spark, rules, version)
        held = materialize(batch.select(*keys, F.explode("items").alias("item")), "held")
        matched = match_rules(held, table, min_weight, keys)
        offers = recommend(matched, held, n, keys)
        if version is not None:
            offers = offers.withColumn("rules_version", F.lit(version))
        offers.write.mode("overwrite").parquet(_part(root, number))

    return _each_batch(baskets, checkpoint, work, trigger)
