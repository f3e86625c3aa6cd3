from __future__ import annotations

import random
from itertools import combinations

import pytest

from basketry.plans import files
from basketry.plans.border import IncrementalMiner, advance, trim
from basketry.plans.generations import Generations
from basketry.plans.mining import top_k_rules
from basketry.streaming import items as streams
from tests import brute

SCHEMA = "tid bigint, items array<bigint>"


def batches(seed, n, size):
    """Baskets whose common itemsets change from batch to batch."""
    rng, tid, out = random.Random(seed), 0, []
    for b in range(n):
        rows = []
        for _ in range(size):
            tid += 1
            base = rng.choice([[1, 2, 3], [4, 5, 6], [2, 3, 7]] if b < 2 else [[8, 9, 10], [1, 9], [4, 5, 6, 8]])
            more = {rng.randint(1, 12) for _ in range(rng.randint(0, 3))}
            rows.append((tid, sorted({x for x in base if rng.random() < 0.85} | more) or [1]))
        out.append(rows)
    return out


def counted(rows, longest=3):
    found = {}
    for _, items in rows:
        for n in range(1, longest + 1):
            for s in combinations(items, n):
                found[s] = found.get(s, 0) + 1
    return found


def kept_sets(supports):
    return {tuple(r["items"]): r.support for level in supports.levels for r in level.collect()}


def border(rows, threshold, longest=3):
    """Occurring itemsets whose subsets by one item all reach the threshold."""
    found = counted(rows, longest)
    return {
        s: n for s, n in found.items() if len(s) == 1 or all(found[t] >= threshold for t in combinations(s, len(s) - 1))
    }


def test_supports_and_border_are_those_of_all_baskets(spark, tmp_path):
    parts = batches(3, 3, 30)
    index = Generations(spark, str(tmp_path / "index"))
    kept, seen = None, []
    for number, rows in enumerate(parts):
        seen += rows
        df = spark.createDataFrame(rows, SCHEMA)
        flat = df.selectExpr("explode(items) AS item", "tid", "items")
        index.add(number, flat, lambda x: x)
        kept, looked_up = advance(kept, df, 12, 3, index.read())
        assert kept_sets(kept) == border(seen, 12) and kept.total == len(seen)
        assert (looked_up == 0) == (number == 0)
    assert kept_sets(trim(kept, 20)) == border(seen, 20)


def test_history_is_not_read_if_nothing_crosses(spark, tmp_path):
    rows = [(i, [1, 2, 3] if i % 2 else [1, 4]) for i in range(20)]
    miner = IncrementalMiner(spark, str(tmp_path), 4, 0.5)
    miner.add(0, spark.createDataFrame(rows, SCHEMA))
    for folder in ("index", "baskets"):
        files.delete(spark, f"{tmp_path}/{folder}/batch_id=0")
    more = [(100 + i, [1, 2, 3]) for i in range(4)]
    got = miner.add(1, spark.createDataFrame(more, SCHEMA))
    assert brute.ranked(brute.rows(got)) == brute.rules([items for _, items in rows + more], 0.5)[:4]
    assert miner.note(1)["looked_up"] == 0 and miner.note(1)["total"] == 24


@pytest.mark.parametrize("non_redundant, max_len", [(False, None), (True, 3)])
def test_rules_equal_a_full_mine_after_each_batch(spark, tmp_path, non_redundant, max_len):
    miner, seen = IncrementalMiner(spark, str(tmp_path), 12, 0.4, non_redundant, max_len), []
    for number, rows in enumerate(batches(4, 3, 30)):
        seen += rows
        df = spark.createDataFrame(rows, SCHEMA)
        for _ in range(2 if number == 1 else 1):  # a batch that is run again counts once
            got = miner.add(number, df)
        want = brute.rules([items for _, items in seen], 0.4, max_len)
        assert brute.ranked(brute.rows(got)) == (brute.non_redundant(want) if non_redundant else want)[:12]
        assert miner.note(number)["total"] == len(seen)
    assert miner.add(9, df.limit(0)) is None


def test_rules_that_lose_their_confidence(spark, tmp_path):
    first = [(i, [1, 2]) for i in range(10)] + [(20 + i, [3, 4]) for i in range(4)]
    second = [(100 + i, [1, 50 + i]) for i in range(30)] + [(200 + i, [2, 90 + i]) for i in range(30)]
    miner = IncrementalMiner(spark, str(tmp_path), 2, 0.6)
    miner.add(0, spark.createDataFrame(first, SCHEMA))
    assert miner.note(0)["threshold"] > 4
    got = miner.add(1, spark.createDataFrame(second, SCHEMA))  # 3 -> 4 is below the threshold so far
    assert brute.ranked(brute.rows(got)) == brute.rules([items for _, items in first + second], 0.6)[:2]


def test_a_wide_basket_ends_keeping_supports(spark, tmp_path):
    rows = [(i, [1, 2, 3]) for i in range(5)]
    miner = IncrementalMiner(spark, str(tmp_path), 2, 0.5, width=8)
    miner.add(0, spark.createDataFrame(rows, SCHEMA))
    more = [(10, list(range(20))), (11, [1, 2])]
    for number, new in ((1, more), (2, [(12, [1])])):
        rows = rows + new
        got = miner.add(number, spark.createDataFrame(new, SCHEMA)).collect()
        want = top_k_rules(spark.createDataFrame(rows, SCHEMA), 2, 0.5).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)) and miner.note(number)["wide"]


# -------------------------------------------------------------- generations


def sums(rows):
    return rows.groupBy("a").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")


def test_generations_keep_their_sums(spark, tmp_path):
    log = Generations(spark, str(tmp_path / "t"), fan=2)
    with pytest.raises(LookupError):
        log.read()
    assert log.read("a string, n bigint").count() == 0
    total = 0
    for batch in range(9):
        rows = spark.createDataFrame([("x", batch + 1), ("y", 1)], "a string, n bigint")
        for _ in range(2):  # a repeated batch counts once, merged or not
            log.add(batch, rows, sums)
        total += batch + 1
        found = {r.a: r.n for r in sums(log.read()).collect()}
        assert found == {"x": total, "y": batch + 1}
        assert len(log.runs()) <= 4
    assert [(r.generation, r.low, r.high) for r in log.runs()] == [(3, 0, 7), (0, 8, 8)]


def test_a_merge_that_dies_changes_nothing(spark, tmp_path):
    log = Generations(spark, str(tmp_path / "t"), fan=2)
    one = spark.createDataFrame([("x", 1)], "a string, n bigint")
    for batch in range(3):
        log.add(batch, one, sums)

    def dying(rows):
        sums(rows).write.parquet(f"{log.root}/_merged/half")  # files that no manifest names
        raise RuntimeError("lost")

    before = log.runs()
    with pytest.raises(RuntimeError):
        log.add(3, one, dying)
    assert {r.n for r in sums(log.read()).collect()} == {4}  # the batch itself had been written
    assert log.runs()[: len(before)] == before and not log.covers(3)
    log.add(3, one, sums)  # run again
    assert {r.n for r in sums(log.read()).collect()} == {4} and log.covers(3)
    log.add(4, one, sums)
    log.add(5, one, sums)
    assert not files.exists(spark, f"{log.root}/_merged/half")  # swept by a later manifest
    assert {r.n for r in sums(log.read()).collect()} == {6}


def test_a_reader_of_the_manifest_before_finishes(spark, tmp_path):
    log = Generations(spark, str(tmp_path / "t"), fan=2)
    one = spark.createDataFrame([("x", 1)], "a string, n bigint")
    log.add(0, one, sums)
    log.add(1, one, sums)
    reader = log.read()  # reads the first merged table
    log.add(2, one, sums)
    log.add(3, one, sums)  # merged into the next generation by now
    assert {r.n for r in sums(reader).collect()} == {2}


def test_publish_and_create(spark, tmp_path):
    path = f"{tmp_path}/a b/claim"
    assert files.create(spark, path, "one") and not files.create(spark, path, "two")
    assert files.read_text(spark, path) == "one"
    files.publish(spark, path, "drei ü")
    assert files.read_text(spark, path) == "drei ü" and files.names(spark, f"{tmp_path}/a b") == ["claim"]
    assert files.names(spark, f"{tmp_path}/none") == []


def test_stream_over_several_batches(spark, tmp_path):
    """Closed baskets of each batch, and rules after it equal to a full mine."""
    src = str(tmp_path / "src")
    rng = random.Random(8)
    for day in range(4):
        events = [
            (day * 100 + i, f"u{rng.randint(0, 9)}", day * 1440 + rng.randint(0, 1439), rng.choice("abcd")) for i in range(60)
        ]
        rows = spark.createDataFrame(events + events[:5], "event_id bigint, user string, minute bigint, item string")
        rows.selectExpr(
            "event_id", "user", "timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,minute,0) AS timestamp", "item"
        ).coalesce(1).write.mode("append").parquet(src)
    schema = "event_id bigint, user string, timestamp timestamp, item string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    root = str(tmp_path)
    baskets = streams.stream_baskets(stream, event_id="event_id")
    streams.stream_mine(baskets, f"{root}/b", f"{root}/r", f"{root}/c", k=6, minconf=0.3).awaitTermination()
    stored = spark.read.parquet(f"{root}/b").selectExpr("struct(user, start) AS tid", "items", "batch_id")
    mined = spark.read.parquet(f"{root}/r")
    numbers = sorted(r.batch_id for r in mined.select("batch_id").distinct().collect())
    assert len(numbers) >= 3
    for number in (numbers[1], numbers[-1]):
        want = top_k_rules(stored.where(f"batch_id <= {number}").drop("batch_id"), 6, 0.3)
        got = mined.where(f"batch_id = {number}").drop("batch_id")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
