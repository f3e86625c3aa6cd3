from __future__ import annotations

import random
import re
from concurrent.futures import ThreadPoolExecutor

import pytest

from basketry.operators.recommend import match_rules
from basketry.operators.ruleindex import match_index, open_rule_index, write_rule_index
from basketry.sources.sinks import read_rules_parquet, rule_versions, write_rules_parquet
from basketry.streaming import items as streams

RULES = "antecedent array<string>, consequent array<string>, support bigint, confidence double"


def rule_table(spark, n=60):
    rng, rows = random.Random(1), []
    for i in range(n):  # item a is in every second rule
        sides = rng.sample("abcdefghij", 6)
        ante = sorted(set(sides[: rng.randint(1, 4)]) | ({"a"} if i % 2 else set()))
        rows.append((ante, sorted(set(sides[4:]) - set(ante)), i, i / n))
    rows.append(([], ["a"], 0, 0.5))
    return spark.createDataFrame(rows, RULES)


def held_rows(spark):
    rng = random.Random(2)
    rows = [("s", u, item) for u in range(30) for item in rng.sample("abcdefghijkl", rng.randint(0, 6))]
    return spark.createDataFrame([*rows, rows[0], ("s", 99, None)], "site string, user int, item string")


def test_index_finds_what_match_rules_finds(spark, tmp_path):
    rules, held = rule_table(spark), held_rows(spark)
    index = write_rule_index(rules, str(tmp_path / "i"), "found", buckets=3, longest=7)
    assert index.long.count() > 0  # lists of more than seven rules lie in several parts
    for side, weight in (("antecedent", 1.0), ("antecedent", 0.5), ("consequent", 0.4), ("antecedent", 0.0)):
        got = match_index(held, index, weight, side=side).collect()
        want = match_rules(held, rules, weight, side=side).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)) and got
    with pytest.raises(ValueError):
        match_index(held, index, 1.5)
    with pytest.raises(ValueError):
        match_index(held, index, 1.0, side="total")


def test_look_up_does_not_exchange_the_index(spark, tmp_path):
    rules, held = rule_table(spark), held_rows(spark)
    write_rule_index(rules, str(tmp_path / "i"), "written", buckets=3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = open_rule_index(spark, str(tmp_path / "i"), "opened", buckets=3)  # as another session would
        matched = match_index(held, index, 0.5)
        plan = matched._jdf.queryExecution().executedPlan().toString()
        assert matched.count() == match_rules(held, rules, 0.5).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    for table in ("opened_postings", "opened_rules"):
        at = next(i for i, line in enumerate(lines) if f"FileScan parquet spark_catalog.default.{table}" in line)
        assert "Bucketed: true" in lines[at]
        depth = re.search(r"FileScan", lines[at]).start()
        for line in reversed(lines[:at]):  # from the scan up to its join: no exchange
            here = len(line) - len(line.lstrip(" :+-"))
            if here < depth:
                depth = here
                assert "Exchange" not in line
                if "Join" in line:
                    break
    assert "size" in str(spark.sql("DESCRIBE EXTENDED written_postings").collect()) or "bytes" in str(
        spark.sql("DESCRIBE EXTENDED written_postings").collect()
    )


def test_empty_index(spark, tmp_path):
    index = write_rule_index(rule_table(spark).limit(0), str(tmp_path / "i"), "empty", buckets=2)
    assert match_index(held_rows(spark), index).count() == 0


def test_each_writer_gets_a_version(spark, tmp_path):
    base = str(tmp_path / "v")
    rules = rule_table(spark, 4)
    with pytest.raises(LookupError):
        read_rules_parquet(spark, base)
    with ThreadPoolExecutor(3) as pool:
        found = list(pool.map(lambda _: write_rules_parquet(rules, base), range(3)))
    assert sorted(found) == rule_versions(spark, base) == [0, 1, 2]
    broken = rules.selectExpr("antecedent", "consequent", "IF(support = 3, raise_error('lost'), support) AS support", "confidence")
    with pytest.raises(Exception, match="lost"):
        write_rules_parquet(broken, base)
    assert rule_versions(spark, base) == [0, 1, 2] and read_rules_parquet(spark, base).count() == 5
    assert write_rules_parquet(rules, base) == 4


def test_rules_change_while_the_stream_stands(spark, tmp_path):
    src, root, base = (str(tmp_path / n) for n in ("src", "out", "rules"))
    columns = "user string, start timestamp, end timestamp, items array<string>"

    def arrive(user):
        rows = spark.createDataFrame([(user, ["a"])], "user string, items array<string>")
        rows = rows.selectExpr("user", "timestamp'2024-01-01' AS start", "timestamp'2024-01-02' AS end", "items")
        rows.coalesce(1).write.mode("append").parquet(src)

    def version(item):
        rules = spark.createDataFrame([(["a"], [item], 2, 0.5)], RULES)
        return write_rules_parquet(rules, base)

    def go():
        stream = spark.readStream.schema(columns).parquet(src)
        streams.stream_recommend(stream, base, root, str(tmp_path / "c")).awaitTermination()
        return {(r.user, r["item"], r.rules_version) for r in spark.read.parquet(root).collect()}

    arrive("u")
    with pytest.raises(Exception, match="no rules"):
        go()
    version("x")
    assert go() == {("u", "x", 0)}
    version("y")
    arrive("v")
    assert go() == {("u", "x", 0), ("v", "y", 1)}
    # a batch that is run again after newer rules have come takes those it took first
    assert streams._version_for(spark, base, root, 0) == 0
    version("z")
    assert streams._version_for(spark, base, root, 1) == 1 and streams._version_for(spark, base, root, 2) == 2
