from __future__ import annotations

import re

import pytest

from basketry.llm.decontaminate import find_leaks, remove_leaks
from basketry.llm.queries import op11_decontamination
from tests.llm.plain import LOWER

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TEN = "one Two three four five six seven eight nine ten"
ITEMS = [
    (1, TEN + " eleven twelve"),
    (2, "Short item, here!"),
    (3, None),
    (4, " .,- "),
    (5, "zero " + TEN),
    (None, "nobody owns this"),
    (2, "second text of two"),
    (6, "été à l'École"),
    (7, TEN),
]
DOCS = [
    (0, f"Before it. {TEN.upper()}, eleven; twelve! After"),
    (0, f"Before it. {TEN.upper()}, eleven; twelve! After"),
    (1, None),
    (2, ""),
    (3, "\x00 .. \n"),
    (4, "a short\x00ITEM-here and short item there, nobody owns this"),
    (5, "x " + TEN.replace("five", "fifth") + " y"),
    (6, "Un ÉTÉ à l'École; été à l'École? ok"),
    (None, "zero " + TEN + " one two three"),
    (8, ("w " * 3000) + TEN + (" short item here" * 200)),
    (9, "short item"),
]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, n=10):
    windows = {}
    for key, text in items:
        found = words(text)
        size = min(n, len(found))
        for i in range(len(found) - size + 1 if found else 0):
            windows.setdefault(tuple(found[i : i + size]), set()).add(key)
    sizes = {len(w) for w in windows}
    out = []
    for key, text in docs:
        found, hit, held = words(text), set(), set()
        for size in sizes:
            for i in range(len(found) - size + 1):
                if (run := tuple(found[i : i + size])) in windows:
                    hit |= set(range(i + 1, i + size + 1))
                    held |= windows[run]
        spans = [[x, x] for x in sorted(hit)]
        for k in range(len(spans) - 1, 0, -1):
            if spans[k - 1][1] + 1 == spans[k][0]:
                spans[k - 1][1] = spans.pop(k)[1]
        out.append((key, len(found), len(hit), [tuple(s) for s in spans], sorted(str(x) for x in held if x is not None)))
    return sorted(out, key=repr)


def shape(rows):
    return sorted(
        ((r["row"]["doc_id"], r.n_words, r.n_hit, [tuple(s) for s in r.spans], r["items"]) for r in rows.collect()), key=repr
    )


@pytest.fixture
def tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string").selectExpr("*", "1 AS row", "'x' AS items", "2 AS hash")
    return docs, spark.createDataFrame(ITEMS, "item_id bigint, text string").selectExpr("*", "3 AS words")


def test_leaks_equal_brute_force(tables):
    docs, items = tables
    want = plain(DOCS, ITEMS)
    assert shape(find_leaks(docs, items, keep=["doc_id"])) == want
    # windows that outgrow a broadcast are looked up block by block
    assert shape(find_leaks(docs.repartition(3), items, keep=["doc_id"], block_bytes=500)) == want
    assert shape(find_leaks(docs, items, keep=["doc_id"], n=3)) == plain(DOCS, ITEMS, 3)


def test_empty_tables(tables):
    docs, items = tables
    assert find_leaks(docs.limit(0), items).count() == 0
    clean = find_leaks(docs, items.limit(0), keep=["doc_id"])
    assert shape(clean) == plain(DOCS, [])
    assert remove_leaks(docs, items.limit(0)).exceptAll(docs).count() == 0


def test_removal(tables):
    docs, items = tables
    cut = remove_leaks(docs, items)
    assert cut.columns == docs.columns and cut.count() == len(DOCS)
    texts = [r.text for r in cut.collect()]
    assert texts.count("Before it! After") == 2 and None in texts and "" in texts and "\x00 .. \n" in texts
    assert "Un ÉTÉ à l'École? ok" in texts and "a and short item there" in texts
    for r in cut.collect():
        before = next(t for k, t in DOCS if k == r.doc_id)
        hit = {x for k, _, _, spans, _ in plain(DOCS, ITEMS) if k == r.doc_id for a, b in spans for x in range(a, b + 1)}
        assert words(r.text) == [w for i, w in enumerate(words(before), 1) if i not in hit]
    left = remove_leaks(docs, items, how="documents")
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 5, 9]
    with pytest.raises(ValueError):
        remove_leaks(docs, items, how="words")


def test_query(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = op11_decontamination(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in rows if r.doc_id is not None) == sorted(
        (k, n, hit, len(held)) for k, n, hit, _, held in plain(DOCS, ITEMS) if k is not None
    )
    assert all(r.contaminated == (r.n_hit > 0) for r in rows)
