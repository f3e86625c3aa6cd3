from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
from basketry.llm.mixing import mix_sources, take_mix
from basketry.llm.ordering import ranked, with_sums_before
from tests.llm.plain import SCHEMA, awkward, near_groups, without_repeats, words


def water(sizes: dict, weights=(3, 1, 2), share=1.5, cap=2) -> dict:
    """Targets by handing the excess of full sources to the others again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full: set = set()
    while True:
        rest = share * sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        level = rest / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and level * weight[s] > cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in full else level * weight[s] for s in names}
        full |= more


def test_ranks_and_sums(spark):
    df = spark.range(500).selectExpr("(id * 37) % 101 AS k", "id AS v").repartition(4)
    rows = sorted(with_sums_before(df, ["k", "v"], {"before": "v"}, "t").collect())
    total = 0
    for n, r in enumerate(rows, 1):
        assert (r["rank"], r.before) == (n, total)
        total += r.v
    assert [r["rank"] for r in ranked(df, ["k", "v"], "t").orderBy("k", "v").collect()] == list(range(1, 501))


def test_mix_meets_targets(spark):
    sf = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = mix_sources(sf).collect()
    sizes, taken, target, most = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
        most[r.source] = max(most[r.source], r.size)
    want = water(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6
        assert abs(taken[s] - target[s]) <= 2 * most[s]
    assert all(0 <= r.copies <= 2 for r in rows)
    assert sorted(rows) == sorted(mix_sources(sf.repartition(3)).collect())


def test_mix_of_awkward_rows(spark):
    df = spark.createDataFrame(awkward(), SCHEMA).selectExpr("*", "1 AS rank", "'x' AS size", "2 AS target")
    got = mix_sources(df).collect()
    assert len(got) == len(awkward())
    assert sorted(r.size for r in got) == sorted(len(words(t)) for _, t, *_ in awkward())
    copies = take_mix(df)
    assert copies.columns == df.columns
    assert copies.count() == sum(r.copies for r in got)
    assert mix_sources(df.limit(0)).count() == 0 and take_mix(df.limit(0)).count() == 0
    blank = mix_sources(df.where("text = ''")).collect()
    assert [(r.target, r.copies) for r in blank] == [(0.0, 0)]


def test_pipeline_stages_against_plain_python(spark, tmp_path):
    rows = [r for r in awkward() if r[0] is not None]
    rows = rows[:12] + rows[13:]  # without the repeated row
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = df
    texts = {d: t for d, t, *_ in rows}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, str(tmp_path))
        if name != "pieces":
            assert made.columns == df.columns
        made.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        out = docs.collect()
        if name == "language_id":
            texts = {d: t for d, t in texts.items() if any(c.isalpha() for c in t or "")}
        elif name == "near_dedup":
            groups = near_groups(list(texts.items()))
            texts = {d: t for d, t in texts.items() if groups[d][1] == d}
        elif name == "suffix_dedup":
            want = without_repeats(list(texts.items()))
            assert {r.doc_id: len(r.text.encode()) for r in out} == {d: w[0] - w[1] for d, w in want.items()}
            assert all(r.n_chars == len(r.text) for r in out)
            texts = {r.doc_id: r.text for r in out}
        elif name == "mix":
            copies = {r.key: r.copies for r in mix_sources(before).collect()}
            assert sorted((r.doc_id, r.text) for r in out) == sorted((d, t) for d, t in texts.items() for _ in range(copies[d]))
            continue
        else:
            assert all(r.lossless for r in out)
            assert docs.count() == before.count()
            continue
        assert {(r.doc_id, r.text) for r in out} == set(texts.items())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.ids) for r in whole.collect()) == sorted((r.doc_id, r.ids) for r in out)
