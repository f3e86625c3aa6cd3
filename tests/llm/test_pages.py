from __future__ import annotations

import time

import duckdb
import numpy as np
import pytest

from basketry.llm import boosting
from basketry.llm.dom import BORDER, ENDS_BEFORE, FAR_ENDS, ITEMS, LISTS, NODES, SCOPE, block_text, feature_blocks, features, kept_nodes, parse
from basketry.llm.extract import Builder, extract_texts, labelled, main_text, train
from basketry.llm.urls import Rules, Vocabulary, judge_urls, split_url
from tests.llm.plain import ENGLISH


@pytest.fixture(scope="module")
def trees(spark):
    return train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


def test_parse_keeps_text_in_order():
    page = parse("<p>a <b>b</b>\n c<p>d &amp;amp; <a href='>'>e</a><br>f<script>x</p></script><!-- <p>no</p> --></div><li>g<li>h")
    assert block_text(page, np.ones(len(page.tags), bool)) == "a b c\nd &amp; e\nf\ng\nh"
    assert page.tags == ["#page", "p", "p", "script", "li", "li"]


@pytest.mark.parametrize("source", [None, "", "<", "<p", "a < b", "<a href='x", "</p></p>", "<script>x", "<!--", "<p><p" * 300])
def test_any_markup_gives_a_tree(source):
    page = parse(source)
    assert features(page).shape[0] == len(page.tags)


def plain_tree(events):
    """Tags and parents of block elements, walking the stack at each tag; and the text of each node."""
    tags, parents, texts, stack = ["#page"], [-1], [""], [0]
    for kind, name in events:
        if kind == "text":
            texts[stack[-1]] += name
            continue
        for k in range(len(stack) - 1, 0, -1):
            here = tags[stack[k]]
            if here == name if kind == "end" else name in ENDS_BEFORE.get(here, ()):
                del stack[k:]
                break
            if kind == "end" and here in SCOPE and name not in FAR_ENDS:
                break
            if kind == "start" and (here in BORDER or here in LISTS and name in ITEMS):
                break
        if kind == "start":
            tags.append(name)
            parents.append(stack[-1])
            texts.append("")
            stack.append(len(tags) - 1)
    return tags, parents, texts


@pytest.mark.parametrize("seed", range(5))
def test_trees_against_walking_the_stack(seed):
    rng = np.random.default_rng(seed)
    names = "p div ul li table tr td th tbody dl dt dd select option button head body html h1".split()
    for _ in range(300):
        events = [
            ("text", f"t{k} ") if kind == "text" else (str(kind), str(rng.choice(names)))
            for k, kind in enumerate(rng.choice(["start", "start", "end", "text"], rng.integers(0, 40)))
        ]
        source = "".join(n if k == "text" else f"<{n}>" if k == "start" else f"</{n}>" for k, n in events)
        page = parse(source)
        texts = [""] * len(page.tags)
        for _, node, text, _ in page.runs:
            texts[node] += text
        assert (page.tags, page.parents, texts) == plain_tree(events)
        everything = " ".join(block_text(page, np.ones(len(page.tags), bool)).split())
        assert everything == " ".join(n.strip() for k, n in events if k == "text")


@pytest.mark.parametrize(
    "source",
    ["<div>" * 100_000 + "x", "<div>" * 50_000 + "</p>" * 100_000 + "x", "<ul><li>" * 50_000 + "x", "x> " + "<a " * 200_000, "<!" * 200_000 + "x"],
)
def test_time_and_memory_grow_with_the_page(source):
    begin = time.process_time()
    page = parse(source)
    assert time.process_time() - begin < 8  # a walk of the stack takes half an hour
    blocks = [len(b) for b in feature_blocks(page)]
    assert max(blocks) <= NODES and sum(blocks) == len(page.tags)
    if source.endswith("x") and "<!" not in source:
        assert block_text(page, np.ones(len(page.tags), bool)) == "x"


def test_features_do_not_depend_on_blocks():
    page = parse("<div class='main text'><p id=a>one, two<a href=x>three</a></p><ul><li>b</li></ul></div>" * 9)
    assert np.array_equal(features(page), np.concatenate(list(feature_blocks(page, 7))))


def test_kept_nodes_have_kept_parents():
    page = parse("<div><p>a</p><ul><li>b</li></ul></div><div><p>c</p></div>")
    score = np.array([0, -1, 3, -1, 0.5, -2, 1.0])
    keep = kept_nodes(page, score)
    # the first div is worth its paragraph, the list not its item, the second div not its paragraph
    assert keep.tolist() == [True, True, True, False, False, False, False]
    total = lambda k: score[k].sum()
    for bits in range(64):
        other = np.array([True, *[(bits >> i) & 1 == 1 for i in range(6)]])
        if all(other[p] for k, p in enumerate(page.parents) if other[k] and p >= 0):
            assert total(other) <= total(keep)


def test_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    fitted = boosting.fit(x[:1500], y[:1500], trees=30, depth=3)
    assert ((fitted.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def test_main_text_of_built_pages(trees):
    builder = Builder(ENGLISH.split(), seed=77)
    made = [builder.page() for _ in range(60)]
    right = 0
    for source in made:
        page, main = labelled(source)
        plain = source.replace("<!--on-->", "").replace("<!--off-->", "")
        right += next(extract_texts([plain], trees)) == block_text(page, kept_nodes(page, np.where(main, 1, -1)))
    assert right >= 45


def test_main_text_of_pages(spark, trees):
    source = (
        "<html><head><title>T</title></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class='ad'>Buy now</div>"
        "<article><h1>A title</h1><p>First  line\n goes &lt;on&gt;.</p><p>" + ENGLISH + "</p></article>"
        "<div class=comments><p>Nice one</p></div><footer>&copy; us</footer></body></html>"
    )
    rows = [(1, "u", source), (2, None, None), (3, "v", ""), (None, "w", source), (1, "u", source)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'z' AS key", "1 AS n_chars")
    got = main_text(df, trees=trees).collect()
    want = f"A title\nFirst line goes <on>.\n{ENGLISH}"
    assert [(r.page_id, r.url) for r in got] == [r[:2] for r in rows]
    assert [r.text for r in got] == [want, "", "", want, want]
    assert all(r.n_chars == len(r.text) for r in got)
    assert main_text(df.limit(0), trees=trees).count() == 0


def test_split_url():
    assert split_url("HTTP://Ex.ORG/A?b#c") == ("ex.org", "/A")
    assert split_url("http://x#y") == ("x", "") and split_url("x.org/y") == ("", "") and split_url(None) == ("", "")


def test_longest_rule_wins():
    rules = Rules({"org/": "allow", "ex.org/a": "block", "com/": "block"})
    assert rules.find("ex.org", "/ab") == ("ex.org/a", "block")
    assert rules.find("b.ex.org", "/b") == ("org/", "allow")
    assert rules.find("xex.org", "/a") == ("org/", "allow") and rules.find("xcom", "/") == (None, None)


def test_terms_need_free_borders():
    words = Vocabulary(["casino"], ["bet", "free", "alphabet"])
    assert words.count("http://casino.x/free-bet/bet") == (1, 2)
    assert words.count("http://casinos.x/alphabets/freebet") == (0, 0)
    assert words.count(None) == (0, 0) and Vocabulary([], []).count("a") == (0, 0)


def test_judge_urls(spark):
    urls = ["https://a.org/free-bet", "http://b.net/casino", "http://b.net/free", "http://b.net/free/bet", None, "nothing", "http://B.NET/FREE?bet"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, urls[0], "h")], "page_id bigint, url string, host string")
    got = judge_urls(df, {"org/": "allow"}).collect()
    assert [r.verdict for r in got] == ["allow", "block", "allow", "block", "allow", "allow", "block", "allow"]
    assert got[0].rule == "org/" and got[1].rule is None
    assert judge_urls(df.limit(0), {}).count() == 0


def test_sql_twin_of_the_url_query(spark, tmp_path):
    from basketry.llm.oracles import ORACLES
    from basketry.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got = QUERIES["op10_url_filter"](spark, sf)
    want = db.sql(ORACLES["op10_url_filter"])
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(str(spark.createDataFrame([r], got.select(want.columns).schema).first()) for r in want.fetchall())
