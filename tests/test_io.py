from __future__ import annotations

from unittest import mock

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from basketry import runs
from basketry.operators import clustering
from basketry.sources import items as source_items
from basketry.sources import sinks, text
from tests.test_lookup import RULES, SCHEMA
from tests.test_mining import item_rows


@pytest.fixture()
def rules(spark):
    return spark.createDataFrame(RULES, SCHEMA)


def test_read_items(spark, tmp_path):
    path = str(tmp_path / "in")
    source = "shop string, who string, basket string, sku int, at bigint"
    spark.createDataFrame([("s", "u", "g", 4, 9)], source).write.json(path)
    spec = {"site": "shop", "user": "who", "group": "basket", "item": ("sku", "string"), "timestamp": "at"}
    items = source_items.read_items(spark, "json", spec, path=path, schema=source)
    assert items.dtypes == [
        ("site", "string"), ("user", "string"), ("group", "string"), ("item", "string"), ("timestamp", "bigint"),
    ]
    assert tuple(items.first()) == ("s", "u", "g", "4", 9)
    with pytest.raises(ValueError, match="unknown source"):
        source_items.read_items(spark, "ftp")
    with pytest.raises(ValueError, match="unknown field"):
        source_items.map_fields(items, {"price": "x"})
    with pytest.raises(ValueError, match="columns not found"):
        source_items.map_fields(items, {"site": "nope"})


def test_transaction_lines(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("1,3 4\n\n  \n2, 5\n 7 , 1  2 \n")
    found = {r.tid: list(r["items"]) for r in text.read_spmf(spark, str(path)).collect()}
    assert found == {1: [3, 4], 2: [5], 7: [1, 2]}
    path.write_text("1,3 4\n2;5\n")
    with pytest.raises(Exception, match="not a transaction line"):
        text.read_spmf(spark, str(path)).collect()


def test_index_lines(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    expected = []
    for name in ("a", "b", "c"):
        lines = [f"{name} {i}" for i in range(200)]
        (folder / f"{name}.txt").write_text("\n\n".join(lines) + "\n")
        expected += lines
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")  # several splits per file
    try:
        indexed = text.index_lines(spark, str(folder))
        found = {r.no: (r.line, r.value) for r in indexed.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == {no: (line, f"{no},{line}") for no, line in enumerate(expected)}
    raw = text.read_basket_lines(spark, str(folder / "a.txt"), "string")
    assert raw.count() == 200 and list(raw.first()["items"])[0] == "a"


def test_write_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, [4, 5])], "tid bigint, items array<int>")
    out = str(tmp_path / "out")
    sinks.write_lines(sinks.basket_lines(df), out)
    assert [r.value for r in spark.read.text(out).collect()] == ["1,4 5"]


def test_parquet_versions(spark, rules, tmp_path):
    base = str(tmp_path / "rules")
    with pytest.raises(LookupError):
        sinks.read_rules_parquet(spark, base)
    assert sinks.write_rules(rules, "PARQUET", base=base) == 0
    assert sinks.write_rules(rules.limit(1), "PARQUET", base=base) == 1
    assert sinks.read_rules_parquet(spark, base).count() == 1
    assert sinks.read_rules_parquet(spark, base, 0).count() == len(RULES)
    assert sinks.write_rules(rules, None) is None
    with pytest.raises(ValueError):
        sinks.write_rules(rules, "REDIS")


def test_normal_form(rules):
    head, ante, cons = sinks.normalize_rules(rules, "r1", 5)
    assert head.columns == ["rid", "uid", "timestamp", "support", "total", "confidence"]
    assert head.select("rid").distinct().count() == len(RULES)
    assert ante.count() == sum(len(r[0]) for r in RULES) and cons.count() == sum(len(r[1]) for r in RULES)
    assert ante.select("aid").distinct().count() == ante.count()
    again = sinks.normalize_rules(rules, "r1", 6)[0]
    assert head.join(again, "rid").count() == len(RULES)


def test_jdbc_and_index_writes_go_to_the_right_tables(rules):
    with mock.patch.object(DataFrameWriter, "jdbc", autospec=True) as jdbc:
        sinks.write_rules(rules, "JDBC", url="jdbc:x", uid="r1", timestamp=5)
    assert [call.args[2] for call in jdbc.call_args_list] == ["rules", "antecedent", "consequent"]
    assert {call.kwargs["mode"] for call in jdbc.call_args_list} == {"append"}
    with mock.patch.object(DataFrameWriter, "save", autospec=True) as save:
        sinks.write_rules(rules, "ELASTIC", uid="r1", timestamp=5, resource="rules/doc")
    assert save.call_args.args[1] == "rules/doc"


def test_store_and_log(spark, rules, tmp_path):
    root, log = str(tmp_path / "store"), str(tmp_path / "log")
    with pytest.raises(LookupError):
        runs.get_rules(spark, root, "s", "01")
    runs.store_rules(rules, root, "s", "01")
    runs.store_rules(rules.limit(2), root, "s", "1")
    runs.store_rules(rules.limit(3), root, "s", "1")
    assert runs.get_rules(spark, root, "s", "01").count() == 4
    assert runs.get_rules(spark, root, "s", "1").count() == 3
    with pytest.raises(LookupError):
        runs.get_rules(spark, root, "t", "1")
    assert runs.run_status(spark, log, "x") is None
    baskets = item_rows(spark, [{1, 2}, {1, 2, 3}])
    found = runs.train(baskets, "TOPK", root, log, "x", site="s", k=2, minconf=0.5)
    assert runs.run_status(spark, log, "x") == "finished"
    assert runs.get_rules(spark, root, "s", "x").count() == found.count() == 2
    with pytest.raises(ValueError, match="started before"):
        runs.train(baskets, "TOPK", root, log, "x", k=2, minconf=0.5)
    with pytest.raises(ValueError):
        runs.train(baskets, "TOPK", root, log, "y", k=0, minconf=0.5)
    assert runs.run_status(spark, log, "y") == "failed"
    with pytest.raises(ValueError, match="unknown run fields"):
        runs.log_run(spark, log, "z", "started", colour="red")


def test_clustering(spark):
    lists = [[1, 1, 2], [1, 2, 2], [1, 2], [1, 1], [8, 9], [8, 8, 9], [9, 9], [8, 9, 9]]
    rows = spark.createDataFrame([(t, i) for t, items in enumerate(lists) for i in items], "tid bigint, item int")
    counts = {(r.tid, r.item): (r.n, r.position) for r in clustering.basket_item_counts(rows).collect()}
    assert counts[(0, 1)] == (2, 0) and counts[(5, 8)] == (2, 7)
    vectors = {r.tid: r.features for r in clustering.count_vectors(rows).collect()}
    assert list(vectors[0].toArray()) == [2.0, 1.0, 0.0, 0.0] and list(vectors[7].toArray()) == [0.0, 0.0, 1.0, 2.0]
    clustered = clustering.cluster_baskets(rows, 2, 10)
    found = {r.tid: r.cluster for r in clustered.collect()}
    assert len({found[t] for t in range(4)}) == 1 and len({found[t] for t in range(4, 8)}) == 1
    assert found[0] != found[4]
    lines = spark.createDataFrame([(t, " ".join(map(str, items))) for t, items in enumerate(lists)], "tid bigint, line string")
    assert {r.value for r in clustering.cluster_lines(clustered, lines).collect()} == {
        f"{found[t]}|{' '.join(map(str, items))}" for t, items in enumerate(lists)
    }
