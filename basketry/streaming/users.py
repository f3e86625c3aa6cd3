"""What each user bought last, kept up to date on a stream.

State is per user, so it is spread by user and no task holds more than one
user's recent groups at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from basketry.streaming.items import UNTIL_DONE, _each_batch, _part

#: the state store whose values a processor may read and write one by one
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Recent(StatefulProcessor):
    """Groups of a user by their latest time; the largest (time, group) is the last transaction.

    ``recent`` is all state of a user: the recent groups with their latest time
    and items, the last one first, and when the next timer goes off.  It is read
    and written once a batch, as every access is a round trip to the JVM.  An
    older group is forgotten when the watermark is ``horizon_us`` past its
    latest time.
    """

    def __init__(self, horizon_us: int, item_type: str):
        self.horizon_us, self.item_type = horizon_us, item_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        group = f"struct<name: string, us: bigint, items: array<{self.item_type}>>"
        self.recent = handle.getValueState("recent", f"next_ms bigint, groups array<{group}>")

    def _load(self) -> tuple[int | None, dict]:
        if not self.recent.exists():
            return None, {}
        next_ms, groups = self.recent.get()
        return next_ms, {name: (us, items) for name, us, items in groups}

    def _store(self, next_ms: int | None, groups: dict) -> None:
        """Write ``groups``, the last one first, with a timer for the next of the others to be forgotten."""
        ranked = sorted(((name, us, list(items)) for name, (us, items) in groups.items()), key=lambda g: (g[1], g[0]), reverse=True)
        if len(ranked) > 1:
            due = (ranked[-1][1] + self.horizon_us) // 1000 + 1
            if next_ms is None or due < next_ms:
                self.handle.registerTimer(due)
                next_ms = due
        self.recent.update((next_ms, ranked))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        next_ms, groups = self._load()
        new: dict[str, tuple[int, set]] = {}
        for event in rows:  # of one user in one batch
            latest, items = new.setdefault(event["group"], (event["us"], set()))
            items.add(event["item"])
            if event["us"] > latest:
                new[event["group"]] = (event["us"], items)
        for group, (us, items) in new.items():
            old_us, old_items = groups.get(group, (us, ()))
            groups[group] = (max(us, old_us), sorted(items.union(old_items)))
        self._store(next_ms, groups)
        group, (us, items) = max(groups.items(), key=lambda g: (g[1][0], g[0]))
        yield Row(user=key[0], group=group, us=us, items=list(items))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        _, groups = self._load()
        last = max(groups, key=lambda name: (groups[name][0], name))
        kept = {g: (us, items) for g, (us, items) in groups.items() if g == last or (us + self.horizon_us) // 1000 >= now}
        self._store(None, kept)
        return iter(())

    def close(self) -> None:
        pass


def stream_last_transactions(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    late: str = "1 hour",
    keep: str = "30 days",
    user: str = "user",
    group: str = "group",
    item: str = "item",
    timestamp: str = "timestamp",
    trigger: dict = UNTIL_DONE,
) -> StreamingQuery:
    """Each user's last transaction after each batch that has events of that user: (user, group, timestamp, items).

    ``read_last_transactions`` gives the newest row of every user.  The last
    group is the one of the largest (latest time, name), names compared as
    strings.  Events up to ``late`` behind count, repeated ones change nothing.
    A group that isn't a user's last one may still go on and become it, with all
    its items, until the watermark is ``keep`` past its latest event; then a timer
    forgets it.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = stream.select(
        F.col(user).alias("user"), F.col(group).cast("string").alias("group"), F.col(item).alias("item"),
        F.col(timestamp).alias("timestamp"), F.unix_micros(timestamp).alias("us"),
    ).dropna(subset=["user", "group", "item", "timestamp"])
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    horizon = spark.sql(f"SELECT unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {keep})").first()[0]
    last = (
        rows.withWatermark("timestamp", late)
        .groupBy("user")
        .transformWithState(
            statefulProcessor=_Recent(horizon, types["item"]),
            outputStructType=f"user {types['user']}, group string, us bigint, items array<{types['item']}>",
            outputMode="Update",
            timeMode="EventTime",
        )
    )
    shown = last.select("user", "group", F.timestamp_micros("us").alias("timestamp"), "items")

    def work(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(_part(root, number))

    return _each_batch(shown, checkpoint, work, trigger, "update")


def read_last_transactions(spark: SparkSession, root: str) -> DataFrame:
    """The newest row of every user."""
    rows = spark.read.parquet(root)
    newest = F.max_by(F.struct("group", "timestamp", "items"), "batch_id").alias("last")
    return rows.groupBy("user").agg(newest).select("user", "last.*")
