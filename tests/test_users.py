from __future__ import annotations

import random
import re

from pyspark.sql import Row

from basketry.operators.recommend import last_transaction
from basketry.streaming.users import _Recent, read_last_transactions, stream_last_transactions

# (user, group, minute, item) in the order of arrival, in three batches
BATCHES = [
    [("u", "g1", 10, "a"), ("u", "g1", 12, "b"), ("v", "h1", 20, "a"), ("v", "h1", 20, "a"), ("w", "k", 5, "c")],
    # late: g1 goes on with an older event; g2 starts; v repeats; x has only nulls
    [("u", "g2", 100, "c"), ("u", "g1", 90, "d"), ("v", "h1", 20, "a"), ("v", "h2", 95, "b"), ("x", None, 96, "a"), ("x", "g", 97, None)],
    # g1 becomes the last again, with all its items; v has two groups at one time; w's is late and older
    [("u", "g1", 130, "e"), ("v", "h3", 140, "z"), ("v", "h0", 140, "y"), ("w", "j", 96, "d"), ("w", "k", 150, "e")],
]
COLUMNS = "user string, `group` string, minute bigint, item string"
TIMED = "timestamp'2024-01-01 00:00:00Z' + make_interval(0,0,0,0,0,minute,0) AS timestamp"


def shape(rows):
    return {(r["user"], r["group"], tuple(r["items"])) for r in rows}


def test_last_transactions_follow_the_stream(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "out")
    for batch in BATCHES:
        rows = spark.createDataFrame(batch, COLUMNS).selectExpr("user", "`group`", "item", TIMED)
        rows.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    stream_last_transactions(stream, root, str(tmp_path / "c")).awaitTermination()
    last = read_last_transactions(spark, root).collect()

    every = spark.read.parquet(src).where("`group` IS NOT NULL")
    groups = last_transaction(every, ["user"]).groupBy("user", "group").agg({"item": "collect_set"}).collect()
    want = {(r[0], r[1], tuple(sorted(r[2]))) for r in groups}
    assert shape(last) == want == {("u", "g1", ("a", "b", "d", "e")), ("v", "h3", ("z",)), ("w", "k", ("c", "e"))}
    # each batch shows the state after it
    first = spark.read.parquet(f"{root}/batch_id=0").collect()
    assert shape(first) == {("u", "g1", ("a", "b")), ("v", "h1", ("a",)), ("w", "k", ("c",))}
    second = spark.read.parquet(f"{root}/batch_id=1").collect()
    assert shape(second) == {("u", "g2", ("c",)), ("v", "h2", ("b",))}


def test_old_groups_are_forgotten(spark, tmp_path):
    """g1 is idle for longer than it is kept: when it goes on, its first items are gone."""
    src, root = str(tmp_path / "src"), str(tmp_path / "out")
    for batch in ([("u", "g1", 0, "a")], [("u", "g2", 50, "b")], [("u", "g2", 500, "b")], [("u", "g2", 501, "c")], [("u", "g1", 510, "d")]):
        rows = spark.createDataFrame(batch, COLUMNS).selectExpr("user", "`group`", "item", TIMED)
        rows.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    stream_last_transactions(stream, root, str(tmp_path / "c"), late="10 minutes", keep="2 hours").awaitTermination()
    assert shape(read_last_transactions(spark, root).collect()) == {("u", "g1", ("d",))}


class _Counted:
    """A state handle of one user that counts accesses."""

    def __init__(self):
        self.value, self.timers, self.accesses = None, [], 0

    def getValueState(self, name, schema):
        return self

    def registerTimer(self, ms):
        self.accesses += 1
        self.timers.append(ms)

    def exists(self):
        return self.value is not None

    def get(self):
        self.accesses += 1
        return self.value

    def update(self, value):
        self.accesses += 1
        self.value = value


def test_state_is_read_and_written_once_a_batch_however_many_groups():
    state, days = _Counted(), [f"d{i:03}" for i in range(200)]
    recent = _Recent(10_000_000, "string")
    recent.init(state)
    for item in "ab":
        before = state.accesses
        rows = (Row(group=day, item=item, us=1_000_000 * i) for i, day in enumerate(days))
        (found,) = recent.handleInputRows(("u",), rows, None)
        assert state.accesses - before <= 3
    assert found["group"] == "d199" and found["items"] == ["a", "b"]

    class Expired:
        def getExpiryTimeInMs(self):
            return state.timers[-1]

    recent.handleExpiredTimer(("u",), None, Expired())  # the oldest goes, the next has a timer
    assert len(state.value[1]) == 199 and state.timers == [10_001, 11_001]


def test_only_items_of_last_groups_are_made_distinct(spark):
    rows = [("u", "g1", 1, "a"), ("u", "g2", 5, "b"), ("u", "g2", 3, "b"), ("u", "g2", 3, "c"), ("v", "h", 2, None), ("v", "g", 1, "z")]
    found = last_transaction(spark.createDataFrame(rows, COLUMNS).selectExpr("user", "`group`", "item", TIMED), ["user"])
    assert sorted(map(tuple, found.collect())) == [("u", "g2", "b"), ("u", "g2", "c"), ("v", "g", "z")]
    # before, all items of all groups were made distinct first, in a hash table of each task
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Aggregate") and "LeftSemi" in plan


def test_groups_are_not_listed_nor_rows_sorted_for_the_last(spark):
    """Before, a task held a row for each of its groups, and merge joins sorted all rows."""
    rng = random.Random(3)
    rows = [(rng.choice("uvwx"), rng.choice(["g1", "g2", "g3", None]), rng.choice([1, 2, 3, None]), rng.choice(["a", "b", None])) for _ in range(60)]
    times = "CASE WHEN minute IS NOT NULL THEN " + TIMED.removesuffix(" AS timestamp") + " END AS timestamp"
    found = last_transaction(spark.createDataFrame(rows, COLUMNS).selectExpr("user", "`group`", "item", times), ["user"])

    want = set()
    for user in "uvwx":
        mine = [(t, g, i) for u, g, t, i in rows if u == user and i is not None]
        newest = max((t for t, _, _ in mine if t is not None), default=None)
        last = max((g for t, g, _ in mine if t == newest and g is not None), default=None) if newest else None
        want |= {(user, g, i) for _, g, i in mine if g == last and last is not None}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    logical = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[user#\d+, group#\d+\], \[[^]]*max\(timestamp", logical)
