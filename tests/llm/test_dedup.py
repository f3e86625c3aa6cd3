from __future__ import annotations

import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm.components import BLOCK, PART, _dealt, components, in_parts
from basketry.llm.minhash import keep_one, near_duplicates, needed
from basketry.llm.suffixes import NAMES_SENT, compared, opened_strings, remove_repeats, sampled
from basketry.plans.scratch import materialize, passing_tables, scratch_root
from tests.llm.plain import SCHEMA, awkward, near_groups, without_repeats


def corpus(n: int = 160) -> list[tuple[int, str]]:
    """Texts with copies, near copies, a passage that many share, and a hot group."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(60)]
    base = [word() for _ in range(120)]
    out = []
    for d in range(n):
        kind = d % 4
        if kind == 0:
            text = list(base)  # near copies of one text
            for _ in range(rng.choice((0, 1, 2, 3, 4, 5, 7, 9))):  # some too far from most others
                text[rng.randrange(len(text))] = word()
        elif kind == 1:
            text = [word() for _ in range(rng.randint(5, 90))]
            at = rng.randrange(len(text))
            text[at:at] = passage
        elif kind == 2 and len(out) > 8:
            text = out[rng.randrange(len(out))][1].split(" ")
            if rng.random() < 0.6 and len(text) > 3:
                text[rng.randrange(len(text))] = word()
        else:
            text = [word() for _ in range(rng.randint(1, 200))]
        out.append((d, " ".join(text)))
    return out


def test_near_duplicates_against_all_pairs(spark):
    rows = corpus()
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = near_groups(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    groups = [w[1] for w in want.values()]
    assert max(map(groups.count, groups)) > 16  # long lists were met


def _tables(spark) -> set[str]:
    return {p.name for p in Path(scratch_root(spark).removeprefix("file:"), "basketry").glob("*")}


def test_near_duplicates_leaves_no_sketches_lists_or_sets(spark):
    before = _tables(spark)
    rows = corpus(40)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    with passing_tables(spark):
        one = materialize(found, "one", lasting=True)
        materialize(one, "two")
    left = {name.rsplit("-", 1)[0] for name in _tables(spark) - before}
    assert left == {"rows", "groups", "labels", "lengths", "one"}
    assert one.count() == len(rows)


def test_shuffle_files_go_with_the_write_that_made_them(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()) if "shuffle" in f.getName()}
    before = held()
    table = materialize(spark.range(1000).groupBy(F.col("id") % 7).count(), "counts")
    end = time.time() + 20
    while held() - before and time.time() < end:
        time.sleep(0.1)
    assert not held() - before and table.count() == 7


def test_near_duplicates_of_awkward_rows(spark):
    df = spark.createDataFrame(awkward(), SCHEMA).withColumnsRenamed({"lang": "code", "source": "value"})
    got = near_duplicates(df)
    by_id = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(awkward())
    want = near_groups([r[:2] for r in awkward() if r[0] is not None])
    assert {d: (r.n_shingles, r.component_id) for d, r in by_id.items() if d is not None} == want
    assert by_id[8].component_id == 7 and not by_id[8].kept
    for d in (4, 5, 6):
        assert (by_id[d].n_shingles, by_id[d].component_id, by_id[d].kept) == (0, d, True)
    assert by_id[12].component_id == 12
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(d for d, w in want.items() if d == w[1])
    assert near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_about_as_large_as_a_sketch(spark):
    rows = []
    for n in range(56, 68):  # shingles of both; 8 differ, so 0.75 to 0.79 of all are shared
        for copy in range(4):
            words = [f"w{n}x{copy}x{i}" for i in range(n + 4)]
            other = list(words)
            other[2] = other[30] = "other"
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = near_groups(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert sum(d != w[1] for d, w in want.items()) == len(rows) // 2


def test_long_lists_are_dealt_over_parts(spark):
    rows = [(7, c, c % 3) for c in range(9 * PART)] + [(v, v, 0) for v in range(100, 160)] + [(v, v + 1, 1) for v in range(100, 150)]
    got = in_parts(spark.createDataFrame(rows + [(None, 1, 1), (None, 2, 2)], "value bigint, code bigint, extra int")).collect()
    want = [r for r in rows if r[0] < 150]
    assert sorted((r.value, r.code, r.extra) for r in got) == sorted(want)
    assert {r.value: (r.length, r.parts) for r in got} == {7: (9 * PART, 9)} | {v: (2, 1) for v in range(100, 150)}
    parts = [r.part for r in got if r.value == 7]
    assert set(parts) == set(range(9)) and max(map(parts.count, range(9))) < 1.3 * PART
    assert in_parts(spark.createDataFrame([], "value bigint, code bigint")).count() == 0


def test_members_are_copied_for_the_blocks_of_outsiders_only(spark):
    n, few = 40 * BLOCK, 10
    members = spark.range(n).selectExpr(
        "1L as hub", "id as code", "9 as n", "id as label", "array(id) as change", f"{n}L as length", f"{few}L as others", f"id < {few} as loose"
    )
    left, right = (side.select("code", "left", "right").collect() for side in _dealt(members))
    assert len(left) == n and len(right) == few * 40  # all against all would copy every member 40 times
    places = {(r.code, r.left): r.right for r in left}
    for outsider in right[:80]:  # every member meets every outsider
        assert all(places[k] == outsider.right for k in places if k[1] == outsider.left)
    assert {r.left for r in left} == {r.left for r in right}


def test_needed_is_below_the_expected_overlap():
    assert 0 < needed(64, 0.75) < 48
    assert needed(8, 0.75) == 1


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(links, "a bigint, b bigint")).distinct().collect())
    assert {got[i] for i in range(41)} == {0}
    assert {got[i] for i in range(100, 140)} == {100}


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_against_all_strings(spark, seed):
    rng = np.random.default_rng(seed)
    unit = lambda n: "".join(rng.choice(list("abé "), n))
    parts = [unit(int(n)) for n in rng.integers(20, 260, 12)]
    rows = []
    for d in range(40):
        chosen = [parts[k] for k in rng.integers(0, len(parts), rng.integers(0, 5))]
        text = unit(int(rng.integers(0, 60))).join(["", *chosen, ""])
        rows.append((d, text if d % 7 else (parts[0][:9] + " ") * int(rng.integers(1, 60))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df).collect()}
    assert got == without_repeats(rows)


def test_repeats_of_awkward_rows(spark):
    rows = awkward()
    df = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"lang": "row", "source": "starts"})
    got = remove_repeats(df, keep=("doc_id", "row", "starts")).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    unique = {d: t for d, t, *_ in rows if d is not None}
    want = without_repeats(list(unique.items()))
    for d, expected in want.items():
        r = by_id[d]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected
    assert by_id[None].n_removed > 150  # later than all
    assert by_id[0].kept_text == unique[0] and by_id[3].kept_text == ""
    assert by_id[3].row == (3, "de", None)
    assert remove_repeats(df.limit(0)).count() == 0


def test_repeats_do_not_depend_on_later_pieces(spark):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice("abcdefgh ") for _ in range(400))
    passage = text()
    rows = [(d, text() + passage if d % 2 else text()) for d in range(30)]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    cut = remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2))
    try:
        spark.conf.set(name, "1")  # from here on every row is a piece of its own
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in cut.collect()}
    finally:
        spark.conf.set(name, before)
    assert got == without_repeats(rows)


def test_repeats_within_equal_keys(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(140)
    # texts of one key come at different places: the passage is earlier in the second
    rows = [(1, text(90) + passage + text(60)), (1, text(20) + passage + text(70)), (2, passage + text(30)), (0, text(200))]
    got = {r.row.text: r.n_removed for r in remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), keep=("text",)).collect()}
    assert [got[t] for _, t in rows] == [140, 0, 140, 0]


def test_a_passage_in_differing_surroundings(spark):
    """One gram has as many names as documents; every piece sends a few, and the strings are named once a piece."""
    rng = random.Random(7)
    text = lambda: "".join(rng.choice("abcdefghijklmnop ") for _ in range(120))
    passage = text() + text()
    rows = [(d, text() + passage + text()) for d in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    given = df.selectExpr("doc_id AS doc", "text", "xxhash64(doc_id, text) AS row").persist()
    dealt = sampled(given)
    assert dealt.where("name IS NOT NULL").groupBy("gram").count().agg({"count": "max"}).first()[0] <= 3 * NAMES_SENT
    spans = compared(dealt).where("open").groupBy("row").agg(F.collect_set(F.struct("low", "more")).alias("spans"))
    strings = opened_strings(given.join(spans, "row").repartition(3, "row"))
    assert strings.where("name IS NOT NULL").groupBy("name").count().agg({"count": "max"}).first()[0] <= 3 * 4
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df).collect()}
    assert got == without_repeats(rows)
    given.unpersist()
