from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from basketry.catalog import fixtures as fx
from basketry.catalog import queries
from basketry.plans.mining import pair_support, top_k_rules
from basketry.streaming import items as streams

# (event, user, minute of day 1, item); event 3 comes twice, event 6 on day 2, 7 on day 4
EVENTS = [
    (1, "u", 10, "a"), (2, "u", 20, "b"), (3, "u", 30, "a"), (3, "u", 30, "a"), (4, "v", 15, "a"), (5, "v", 16, "c"),
    (6, "u", 1500, "c"), (7, "w", 4400, "a"),
]
SCHEMA = "event_id bigint, user string, timestamp timestamp, item string"


def write_events(spark, path, events):
    rows = spark.createDataFrame(events, "event_id bigint, user string, minute bigint, item string")
    rows.selectExpr(
        "event_id", "user", "timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,minute,0) AS timestamp", "item"
    ).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).parquet(path)


def shape(df):
    return {(r.user, str(r.start.date()), tuple(r["items"])) for r in df.collect()}


def test_baskets_in_two_rounds(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    write_events(spark, src, EVENTS[:6])
    for _ in range(2):
        streams.store_baskets(streams.stream_baskets(stream(spark, src), event_id="event_id"), out, ckpt).awaitTermination()
        if _ == 0:
            assert shape(spark.read.schema(spark.read.parquet(out).schema).parquet(out)) == set()
            write_events(spark, src, EVENTS[6:])
    closed = shape(spark.read.parquet(out))
    batch = shape(streams.stream_baskets(spark.read.parquet(src), event_id="event_id"))
    assert closed == {
        ("u", "2024-01-01", ("a", "b")), ("v", "2024-01-01", ("a", "c")), ("u", "2024-01-02", ("c",)),
    }
    assert batch == closed | {("w", "2024-01-04", ("a",))}


def test_windowed_baskets_keep_two_states(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    write_events(spark, src, EVENTS)
    query = streams.store_baskets(streams.stream_baskets(stream(spark, src), event_id="event_id"), out, ckpt)
    query.awaitTermination()
    names = [op["operatorName"] for op in query.recentProgress[0]["stateOperators"]]
    assert names == ["stateStoreSave", "dedupeWithinWatermark"]  # baskets, ids of events
    rows = query.recentProgress[0]["stateOperators"][0]["numRowsTotal"]
    assert rows == 4  # one a basket, of five pairs of basket and item


def test_sessions(spark, tmp_path):
    src = str(tmp_path / "src")
    write_events(spark, src, EVENTS)
    found = shape(streams.stream_baskets(spark.read.parquet(src), session="8 minutes", event_id="event_id"))
    assert found == {
        ("u", "2024-01-01", ("a",)), ("u", "2024-01-01", ("b",)), ("v", "2024-01-01", ("a", "c")),
        ("u", "2024-01-02", ("c",)), ("w", "2024-01-04", ("a",)),
    }


def test_track(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    spec = {"site": ("site", "string"), "user": "user", "group": "user", "item": ("item", "string"),
            "timestamp": ("timestamp", "timestamp")}
    for part in (EVENTS[:3], EVENTS[3:]):
        write_events(spark, src, part)
        frame = stream(spark, src).selectExpr("*", "'s' AS site")
        streams.track_items(frame, out, ckpt, spec).awaitTermination()
    assert spark.read.parquet(out).count() == len(EVENTS)


def test_pairs_rules_and_offers(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path)
    write_events(spark, src, EVENTS)

    def baskets():
        return streams.stream_baskets(stream(spark, src), event_id="event_id")

    streams.stream_pair_support(baskets(), f"{root}/pairs", f"{root}/c1").awaitTermination()
    found = {(r.a, r.b): r.support for r in streams.running_pair_support(spark, f"{root}/pairs").collect()}
    assert found == {("a", "b"): 1, ("a", "c"): 1}
    # a batch that is run again replaces what it wrote
    closed = spark.createDataFrame([("u", 1, ["a", "b"])], "user string, start int, items array<string>")
    again = pair_support(closed.selectExpr("struct(user, start) AS tid", "items"), 1)
    for _ in range(2):
        again.write.mode("overwrite").parquet(streams._part(f"{root}/pairs", 77))
    assert {r.support for r in streams.running_pair_support(spark, f"{root}/pairs", 2).collect()} == {2}

    streams.stream_mine(
        baskets(), f"{root}/b", f"{root}/r", f"{root}/c2", k=3, minconf=0.5
    ).awaitTermination()
    rules = streams.latest_rules(spark, f"{root}/r")
    stored = spark.read.parquet(f"{root}/b").selectExpr("struct(user, start) AS tid", "items")
    assert sorted(map(str, rules.collect())) == sorted(map(str, top_k_rules(stored, 3, 0.5).collect()))

    offer = spark.createDataFrame(
        [(["a"], ["c"], 1, 2, 3, 0.5)],
        "antecedent array<string>, consequent array<string>, support bigint, antecedent_support bigint, "
        "total bigint, confidence double",
    )
    streams.stream_recommend(baskets(), offer, f"{root}/o", f"{root}/c3").awaitTermination()
    offers = {(r.user, r.item, r["rank"]) for r in spark.read.parquet(f"{root}/o").collect()}
    assert offers == {("u", "c", 1)}


def test_batches_of_several_files_hold_the_same_events(spark, tmp_path, monkeypatch):
    spark.range(400).selectExpr(
        "id AS event_id", "timestamp_seconds(1704067200 + id * 600) AS ts", "id % 5 AS user_id",
        "concat('k', id % 3) AS event_type",
    ).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))

    def batches(name):
        events, seen = fx.event_batches(spark, str(tmp_path)), {}

        def work(batch, number):
            rows = [(r[0], r[1]) for r in batch.select("event_id", F.input_file_name()).collect()]
            seen[number] = (sorted(event for event, _ in rows), len({file for _, file in rows}))

        streams._each_batch(events, str(tmp_path / name), work, streams.UNTIL_DONE).awaitTermination()
        return [seen[number] for number in sorted(seen)]

    whole = batches("c1")
    monkeypatch.setattr(fx, "FILE_ROWS", 20)
    dealt = batches("c2")
    assert [events for events, _ in dealt] == [events for events, _ in whole]
    assert [n for _, n in whole] == [1] * 4 and len({n for _, n in dealt}) == 1 and dealt[0][1] > 1


def test_halves_of_events_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    spark.range(400).selectExpr(
        "id AS event_id", "timestamp_seconds(1704067200 + id * 600) AS ts", "id % 5 AS user_id",
        "concat('k', id % 3) AS event_type",
    ).repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    made, halves = [], fx.event_halves
    monkeypatch.setattr(fx, "event_halves", lambda *args: made.append(halves(*args)) or made[0])

    def stop(*args):
        raise InterruptedError

    monkeypatch.setattr(streams, "stream_recommend", stop)
    with pytest.raises(InterruptedError):
        queries.stream_recommend_versions(spark, str(tmp_path))
    first, _, path = made[0]
    stored = spark.read.parquet(path)
    assert stored.count() == first.count() and len(stored.inputFiles()) > 1
