from __future__ import annotations

import random
import re

import numpy as np
import pytest

from basketry.operators import sparse_clustering
from basketry.operators.sparse_clustering import cluster_sparse
from basketry.operators.usecases import Attributes, bag_of_attributes, quantile_cuts
from basketry.sources.items import map_fields
from basketry.sources.rejects import check_fields, check_spmf, read_items_checked
from basketry.sources.text import parse_spmf

LINES = {
    "1,2 3": None, "  7 , 4 ": None, "": "blank", "   ": "blank", "1;2 3": "no comma;cast: tid", "1,": "no items",
    ",5": "null: tid", "x,5": "cast: tid", "1,5 y": "cast: item", "99999999999999999999,1": "cast: tid",
    "x,y": "cast: tid;cast: item", "5,1,2": "cast: item", "5,1 2.5": "cast: item",
}


def test_lines_are_split_in_good_and_bad(spark):
    lines = spark.createDataFrame([(t,) for t in LINES] + [("1,2 3",), (None,)], "value string")
    checked = check_spmf(lines)
    good = [t for t, reason in LINES.items() if reason is None] + ["1,2 3"]
    want = parse_spmf(spark.createDataFrame([(t,) for t in good], "value string"))
    assert sorted(map(str, checked.good.collect())) == sorted(map(str, want.collect()))
    bad = {r.record: ";".join(r.reasons) for r in checked.rejected.collect()}
    assert bad == {t: reason for t, reason in LINES.items() if reason not in (None, "blank")}
    assert (checked.n_good, checked.n_rejected) == (3, len(bad))
    assert {r.reason: r.n for r in checked.by_reason().collect()}["cast: item"] == 4
    assert check_spmf(lines.limit(0)).n_good == 0


def test_records_are_split_in_good_and_bad(spark, tmp_path):
    rows = [("s", "u", "g", "1", "10"), ("s", "u", "g", "one", "10"), (None, None, "g", "2", None), ("s", "u", None, "x", "y"), ("s", "u", "g", "3", "")]
    df = spark.createDataFrame(rows, "site string, user string, `group` string, item string, `time.of` string")
    spec = {"timestamp": "time.of"}
    checked = check_fields(df, spec)
    assert checked.good.columns == map_fields(df, spec).columns and checked.good.dtypes == map_fields(df, spec).dtypes
    assert [tuple(r) for r in checked.good.collect()] == [("s", "u", "g", 1, 10)]
    found = sorted(tuple(r.reasons) for r in checked.rejected.collect())
    assert found == [("cast: item",), ("cast: item", "cast: timestamp", "null: group"), ("cast: timestamp",), ("null: user",)]
    assert all('"group"' in r.record or '"item"' in r.record for r in checked.rejected.collect())
    assert check_fields(df, spec, required=()).n_good == 2
    for wrong in ({"shop": "site"}, {"site": "shop"}):
        with pytest.raises(ValueError):
            check_fields(df, wrong)
    with pytest.raises(ValueError):
        check_fields(df, spec, required=("shop",))
    df.write.parquet(str(tmp_path / "t"))
    assert read_items_checked(spark, "parquet", spec, path=str(tmp_path / "t")).n_rejected == 4
    with pytest.raises(ValueError):
        read_items_checked(spark, "paper")


def test_bags_of_joined_attributes(spark):
    parents = spark.createDataFrame(
        [(1, "a", 1.0), (2, "b", 2.0), (3, None, 3.0), (4, "a", 4.0), (5, "c", None), (None, "z", 9.0)], "id int, kind string, size double"
    )
    children = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (3, None), (9, "x")], "parent int, what string")
    bags = bag_of_attributes([
        Attributes(parents, "id", {"kind": "kind", "size": "size"}, {"size": 2}), Attributes(children, "parent", {"what": "what"}),
    ])
    found = {}
    for r in bags.collect():
        found.setdefault(r.tid, []).append(r["item"])
    cut = quantile_cuts(parents, {"size": 2})["size"][0]
    size = {k: f"size~{int(v > cut)}" for k, v in ((1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0))}
    assert {k: sorted(v) for k, v in found.items()} == {
        1: ["kind=a", size[1], "what=x", "what=y"], 2: ["kind=b", size[2]], 3: [size[3]], 4: ["kind=a", size[4]], 5: ["kind=c"],
        9: ["what=x"],
    }
    assert quantile_cuts(parents.where("size IS NULL"), {"size": 4}) == {"size": []}
    with pytest.raises(ValueError):
        quantile_cuts(parents, {"size": 1})


def lloyd(points, centres, rounds):
    for turn in range(rounds + 1):
        away = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
        index = np.array([min(range(len(centres)), key=lambda c: (round(row[c], 9), c)) for row in away])
        if turn < rounds:
            centres = np.array([points[index == c].mean(axis=0) if (index == c).any() else centres[c] for c in range(len(centres))])
    return index, away[np.arange(len(points)), index]


def test_sparse_centres_equal_dense_ones(spark):
    from pyspark.mllib.clustering import KMeans, KMeansModel

    rng = random.Random(6)
    rows = [(t, rng.choice([1, 2, 3] if t % 3 else [8, 9, 10]), None) for t in range(40) for _ in range(rng.randint(1, 6))]
    rows += [(77, 20, None), (78, 21, None), (None, 1, None), (79, None, None)]  # share nothing with any centre
    items = spark.createDataFrame([r[:2] for r in rows], "tid bigint, item int")
    tids = sorted({t for t, i, _ in rows if t is not None and i is not None})
    points = np.zeros((len(tids), 22))
    for t, i, _ in rows:
        if t is not None and i is not None:
            points[tids.index(t), i] += 1
    start_rows = [0, 1, 5]
    start = [(c, i, int(points[r, i]), 1) for c, r in enumerate(start_rows) for i in range(22) if points[r, i]]
    given = spark.createDataFrame(start, "cluster int, item int, s bigint, m bigint")
    clusters, centres = cluster_sparse(items, 3, 4, start=given)
    index, away = lloyd(points, points[start_rows], 4)
    got = {r.tid: (r.cluster, round(r.distance, 9)) for r in clusters.collect()}
    assert got == {t: (int(c), round(float(d), 9)) for t, c, d in zip(tids, index, away)}
    model = KMeans.train(
        spark.sparkContext.parallelize(points.tolist()), 3, maxIterations=4, epsilon=0.0, initialModel=KMeansModel(points[start_rows].tolist())
    )
    means = np.zeros((3, 22))
    for r in centres.collect():
        means[r.cluster, r["item"]] = r.s / r.m
    assert np.allclose(means, np.array(model.clusterCenters))
    assert cluster_sparse(items.limit(0), 3, 2)[0].count() == 0
    assert {r.cluster for r in cluster_sparse(items, 100, 1)[0].collect()} <= set(range(len(tids)))
    with pytest.raises(ValueError):
        cluster_sparse(items, 0, 1)


def test_a_round_exchanges_no_points(spark):
    """Before, every round exchanged the points by basket twice, a row for each centre that shares an item."""
    rng = random.Random(8)
    items = spark.createDataFrame([(t, rng.randint(1, 9)) for t in range(60) for _ in range(rng.randint(1, 5))] + [(60, 99)], "tid bigint, item int")
    points = sparse_clustering._stored(sparse_clustering.basket_item_counts(items).select("tid", "item", "n"))
    assert points.where("first = 1").groupBy("tid").count().where("count = 1").count() == 61
    centres = sparse_clustering.materialize(sparse_clustering.first_centres(points, 7, "x"), "centres")
    whole = {tuple(r) for r in sparse_clustering._nearest(points, centres).collect()}
    assert len(whole) == 61
    for most in (1, 3):  # centres in several chunks
        assert {tuple(r) for r in sparse_clustering._nearest(points, centres, most).collect()} == whole
    plan = sparse_clustering._moved(points, sparse_clustering._nearest(points, centres), centres)
    nearest = sparse_clustering._nearest(points, centres).join(points, "tid")
    nearest.collect()
    dealt = re.findall(r"Exchange hashpartitioning\((\w+)#", nearest._jdf.queryExecution().executedPlan().toString())
    assert "tid" not in dealt
    assert plan.agg({"m": "max"}).first()[0] <= 61
