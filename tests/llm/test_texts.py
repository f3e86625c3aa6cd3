from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketry.llm import gru
from basketry.llm.fingerprint import embed, fingerprints, likeness, near_groups, with_edits
from basketry.llm.langid import UNKNOWN, identify, known_rows
from basketry.llm.lm import Settings, score_documents
from basketry.llm.pieces import Dropout, decode, decode_ids, encode, encode_texts, load_vocabulary
from basketry.llm.quality import References, js_distance, quality_rules
from basketry.llm.text import Words, mix64, packed
from tests.llm.plain import BASE, ENGLISH, SCHEMA, awkward, base_statistics, unigram, words

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward rows, with columns whose names the operators use themselves."""
    df = spark.createDataFrame(awkward(), SCHEMA)
    return df.withColumns({"key": F.lit("k"), "row": F.lit(1), "n": F.lit(2), "held_out": F.lit("x"), "part": F.lit(3)}).repartition(2)


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(2)


def test_words_are_those_of_the_pattern():
    texts = [t for _, t, *_ in awkward()]
    buf, at = packed(pa.array(texts, pa.string()))
    found = Words(buf, at)
    got = [[buf[s:e].tobytes().decode() for s, e in zip(found.start[a:b], found.end[a:b])] for a, b in zip(found.first, found.first[1:])]
    assert got == [words(t) for t in texts]


# pieces


def test_pieces_without_dropout_are_the_model_s():
    import sentencepiece

    model, vocab = sentencepiece.SentencePieceProcessor(model_file=MODEL), load_vocabulary(MODEL)
    texts = [t for _, t, *_ in awkward() if t and "▁" not in t] + ["  a  b", "trail ", "a" * 90 + "b"]
    ids, at = encode(texts, mix64(np.arange(len(texts))), vocab, Dropout(0))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == model.encode(texts)


@pytest.mark.parametrize("share", [0.1, 0.7, 1.0])
def test_dropped_merges_decode_to_the_text(share):
    vocab = load_vocabulary(MODEL)
    texts = [t for _, t, *_ in awkward()]
    keys = mix64(np.arange(len(texts)))
    ids, at = encode(texts, keys, vocab, Dropout(share, 3))
    assert [d.decode() for d in decode(ids, at, vocab)] == [t or "" for t in texts]
    again, _ = encode(texts, keys, vocab, Dropout(share, 3))
    other, _ = encode(texts, keys, vocab, Dropout(share, 4))
    assert np.array_equal(ids, again)
    assert share == 1 or not np.array_equal(ids, other)
    if share == 1:
        assert all(len(vocab.pieces[i].lstrip("▁")) <= 1 or vocab.pieces[i].startswith("<0x") for i in ids.tolist())


def test_long_units_are_merged_alike(monkeypatch):
    import basketry.llm.pieces as module

    vocab, keys = load_vocabulary(MODEL), mix64(np.arange(2))
    wide, _ = encode([ENGLISH, BASE], keys, vocab, Dropout(0.2))
    monkeypatch.setattr(module, "LONGEST", 0)
    heaped, _ = encode([ENGLISH, BASE], keys, vocab, Dropout(0.2))
    assert np.array_equal(wide, heaped)


def test_every_occurrence_is_dropped_by_itself(monkeypatch):
    import basketry.llm.pieces as module

    vocab, n = load_vocabulary(MODEL), 2000
    for letter in "abcde":  # units of a single candidate merge
        keys = mix64(np.arange(4))
        ids, at = encode([" ".join(letter * n)] * 4, keys, vocab, Dropout(0.1, 5))
        split = (np.diff(at) - n) / n
        assert all(abs(s - 0.1) < 0.03 for s in split) and len(set(split)) > 1
    texts = [" ".join(["international", "understanding", "bb"] * 100)] * 2
    wide, at = encode(texts, mix64(np.arange(2)), vocab, Dropout(0.1))
    starts = np.flatnonzero([vocab.pieces[i].startswith("▁") for i in wide])
    forms = {tuple(x) for x in np.split(wide, starts)}
    assert len(forms) > 3 * 8
    monkeypatch.setattr(module, "LONGEST", 0)
    heaped, _ = encode(texts, mix64(np.arange(2)), vocab, Dropout(0.1))
    assert np.array_equal(wide, heaped)


def test_piece_tables(spark, docs):
    got = encode_texts(docs, MODEL)
    rows = got.collect()
    assert len(rows) == len(awkward()) and all(r.lossless for r in rows)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[4].ids == [] and by_id[5].n_tokens == 0
    assert by_id[0].decoded_sha256 == hashlib.sha256(BASE.encode()).hexdigest()
    back = {r.doc_id: r.text for r in decode_ids(got, MODEL).collect()}
    assert back[12] == [t for d, t, *_ in awkward() if d == 12][0] and back[4] == ""
    assert encode_texts(docs.limit(0), MODEL).count() == 0


# quality


def test_base_statistics_and_verdict(docs):
    got = quality_rules(docs).collect()
    assert len(got) == len(awkward())
    texts = {d: t for d, t, *_ in awkward()}
    for r in got:
        want = base_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    by_id = {r.doc_id: r for r in got}
    assert by_id[0].kept and not by_id[11].kept and not by_id[4].kept
    assert quality_rules(docs.limit(0)).count() == 0


def test_distance_of_a_strange_text(spark):
    references = References({"en": np.array([0.75, 0.03, 0, 0, 0.18, 0.04, 0, 0])}, {})
    odd = " ".join(f"{w.upper()}***" for w in (ENGLISH * 3).split())
    df = spark.createDataFrame([(1, odd, "en"), (2, ENGLISH * 3, "en"), (3, ENGLISH * 3, None)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in quality_rules(df, references=references, max_char_distance=0.3).collect()}
    assert got[1].char_distance > 0.5 > got[2].char_distance
    assert got[2].char_distance == got[3].char_distance


def test_js_distance():
    p = np.array([[0.5, 0.5, 0], [0, 0, 1.0], [0.25, 0.25, 0.5]])
    got = js_distance(p, p[0])
    assert got[0] == 0 and got[1] == 1
    m = (p[2] + p[0]) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x)
    assert got[2] == pytest.approx(np.sqrt((kl(p[2]) + kl(p[0])) / 2))


# language


def test_language_of_held_out_rows(sample):
    got = identify(sample).join(sample.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 30
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_awkward_rows(docs):
    got = identify(docs, keep=("row", "key")).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(awkward()) and got[0].row == (1, "k")
    assert {d for d, r in by_id.items() if r.lang_pred == UNKNOWN} == {4, 5, 6, 9}
    assert all(by_id[d].score == 0 for d in (4, 5, 6, 9))
    assert {r.lang_pred for r in identify(docs.where("lang IS NULL")).collect()} == {UNKNOWN}
    assert identify(docs.limit(0)).count() == 0


def test_rows_stay_if_no_language_could_be_learned(docs):
    rows = docs.withColumn("lang", F.lit(None).cast("string"))
    want = {r.doc_id for r in known_rows(docs).collect()}
    assert {r.doc_id for r in known_rows(rows).collect()} == want == {d for d, *_ in awkward()} - {4, 5, 6, 9}


# language model


def test_gradients_of_the_network(monkeypatch):
    rng = np.random.default_rng(0)
    shape = gru.Shape(gru.class_bounds(np.array([50, 30, 20, 9, 8, 7, 5, 4, 3, 2]), 3), hidden=5, width=4)
    model = {k: v.astype(float) for k, v in gru.start(shape, np.arange(10, 0, -1.0)).items()}
    tokens, first = rng.integers(0, 10, 60), np.zeros(60, bool)
    first[[0, 13, 14, 37]] = True
    at = np.append(np.flatnonzero(first), 60)
    grads = {}
    monkeypatch.setattr(gru, "_adam", lambda model, g, *rest: grads.update(g))
    gru.train(tokens, first, model, shape, lanes=1, window=60)
    for name, value in model.items():
        place = tuple(rng.integers(0, s) for s in value.shape)
        here, loss = value[place], []
        for step in (1e-3, -1e-3):
            value[place] = here + step
            loss.append(-gru.log_likelihoods(tokens, at, model, shape, lanes=3, window=7).sum())
        value[place] = here
        assert (loss[0] - loss[1]) / 2e-3 == pytest.approx(grads[name][place], rel=1e-3, abs=1e-5)


@pytest.mark.parametrize("n", [1, 2, 7, 16, 17, 300, 511, 512])
def test_every_token_is_learned_once(monkeypatch, n):
    rng = np.random.default_rng(n)
    shape = gru.Shape(gru.class_bounds(np.arange(40, 0, -1), 5), hidden=4, width=3)
    tokens, seen, steps = rng.integers(0, 40, n), [], []
    plain = gru._output

    def output(states, targets, *rest):
        assert states.shape[1] == len(targets)
        seen.append(targets.copy())
        return plain(states, targets, *rest)

    monkeypatch.setattr(gru, "_output", output)
    monkeypatch.setattr(gru, "_adam", lambda model, grads, state, rate, tokens: steps.append(tokens))
    gru.train(tokens, np.arange(n) % 50 == 0, gru.start(shape, np.arange(40, 0, -1.0)), shape, lanes=16, window=6)
    assert np.array_equal(np.sort(np.concatenate(seen)), np.sort(tokens))
    assert sum(steps) == n


def plain_log_likelihood(ids, model, shape):
    """A document's natural log-probability, a token and a number at a time."""
    size, h, before, total = shape.hidden, np.zeros(shape.hidden), 0, 0.0
    of = shape.class_of()
    for word in ids:
        gates = model["embed"][before] @ model["w_in"] + model["b_in"]
        rec = h @ model["w_rec"]
        z, r = (1 / (1 + np.exp(-(gates + rec)[k * size : (k + 1) * size])) for k in (0, 1))
        n = np.tanh(gates[2 * size :] + r * rec[2 * size :])
        h = z * h + (1 - z) * n
        low, high = shape.bounds[of[word]], shape.bounds[of[word] + 1]
        classes = np.exp(h @ model["w_class"] + model["b_class"])
        words = np.exp(model["w_word"][low:high] @ h + model["b_word"][low:high])
        total += np.log(classes[of[word]] / classes.sum()) + np.log(words[word - low] / words.sum())
        before = word
    return total


def test_scores_against_plain_steps():
    rng = np.random.default_rng(4)
    shape = gru.Shape(np.concatenate(([0, 1], 2 + gru.class_bounds(np.arange(30, 0, -1), 4))), hidden=6, width=5)
    model = gru.start(shape, np.arange(32, 0, -1.0))
    docs = [rng.integers(0, 32, n) for n in (1, 40, 3, 77, 12)]
    tokens, at = np.concatenate(docs), np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    gru.train(tokens, np.isin(np.arange(len(tokens)), at), model, shape, lanes=4, window=8)
    got = gru.log_likelihoods(tokens, at, model, shape, lanes=3, window=10)
    assert got == pytest.approx([plain_log_likelihood(d, model, shape) for d in docs], rel=1e-4)


def test_network_is_a_distribution_and_carries_its_state():
    shape = gru.Shape(np.array([0, 1, 2, 4, 7]), hidden=4, width=3)
    model = gru.start(shape, np.array([5, 4, 3, 2, 2, 1, 1.0]))
    prefix = [3, 5, 6, 2] * 9
    docs = [[*prefix, w] for w in range(7)]
    at = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    whole = gru.log_likelihoods(np.concatenate(docs), at, model, shape, lanes=2, window=5)
    before = gru.log_likelihoods(np.array(prefix), np.array([0, len(prefix)]), model, shape)[0]
    assert np.exp(whole - before).sum() == pytest.approx(1, abs=1e-4)


def test_base_scores_and_better_scores(sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    total, want = unigram(rows)
    got = score_documents(sample, settings=Settings(first_passes=4)).collect()
    for r in got:
        n, known, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(score, rel=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_of_awkward_rows(docs, monkeypatch):
    import basketry.llm.lm as module

    monkeypatch.setattr(module, "NEAR_WORDS", 10)  # most words are joined
    got = score_documents(docs, settings=Settings(words=8, classes=2, first_tokens=100)).collect()
    total, want = unigram([(d, t) for d, t, *_ in awkward()][:-2] + [(None, awkward()[-1][1])])
    extra = len(words(awkward()[-2][1])) + 1  # the repeated row is trained on twice
    assert len(got) == len(awkward())
    by_id = {r.doc_id: r for r in got}
    assert {r.train_tokens for r in got} == {total + extra}
    assert all(by_id[d].n_tokens == want[d][0] for d in want)
    assert by_id[4].base_score == by_id[5].base_score == by_id[6].base_score
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    twice = [r for r in got if r.doc_id == 12]
    assert twice[0] == twice[1]
    assert score_documents(docs.limit(0)).count() == 0


# fingerprints


def test_an_edit_keeps_most_of_a_fingerprint():
    long = " ".join([ENGLISH, BASE] * 4)
    a, b, c, d = embed([long, long[:300] + "zz" + long[300:], long[::-1], long])
    assert a == d and likeness(a, d) == 1
    assert likeness(a, b) > 0.6 > 0.4 > likeness(a, c)
    assert embed([""]) == [""] and likeness("", "") == 1 and likeness("", a) == 0


def test_fingerprints_do_not_depend_on_the_batch():
    texts = [BASE, "x", "", ENGLISH * 30, "漢字"]
    assert [embed([t])[0] for t in texts] == embed(texts)


def test_edited_texts(spark, docs):
    rows = [(i, t) for i, (_, t, *_) in enumerate(awkward())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in with_edits(df).collect()}
    texts = {d: t or "" for d, t in rows}
    for d, text in texts.items():
        after, third = texts[(d - 1) % len(texts)], len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d].n_chars == len(text)
        assert (got[d].fingerprint, got[d].edited_fingerprint) == tuple(embed([text, edited]))
        assert got[d].near_next == likeness(got[d].fingerprint, embed([after])[0])
    assert with_edits(docs).count() == len(awkward())
    alone = with_edits(df.where("doc_id = 0")).first()
    assert alone.near_next == 1
    assert with_edits(docs.limit(0)).count() == 0


def test_groups_of_fingerprints(spark):
    long = " ".join([ENGLISH, BASE] * 4)
    rows = [(3, long), (1, long[:500] + "k" + long[500:]), (2, long), (5, long[::-1]), (6, None), (None, long)]
    prints = fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = {r.doc_id: r.group for r in near_groups(prints, least=0.6).collect()}
    assert got == {1: 1, 2: 1, 3: 1, None: 1, 5: 5, 6: 6}


def test_scores_take_few_steps_beside_one_long_document(monkeypatch):
    """Before, a long document next to short ones cost an output pass for each window of its own."""
    rng = np.random.default_rng(4)
    shape = gru.Shape(gru.class_bounds(np.arange(40, 0, -1), 5), hidden=4, width=3)
    model = gru.start(shape, np.arange(40, 0, -1.0))
    at = np.cumsum(np.concatenate(([0], [900], rng.integers(0, 6, 50))))
    tokens = rng.integers(0, 40, at[-1])
    plain, passes = gru._output, []
    monkeypatch.setattr(gru, "_output", lambda *args: passes.append(args[1].size) or plain(*args))
    got = gru.log_likelihoods(tokens, at, model, shape, lanes=8, window=12)
    assert len(passes) <= 12 and sum(passes) == len(tokens)
    alone = [gru.log_likelihoods(tokens[a:b], np.array([0, b - a]), model, shape)[0] for a, b in zip(at[:-1], at[1:])]
    assert np.allclose(got, alone, atol=1e-3)
    assert gru.log_likelihoods(tokens[:0], np.zeros(3, np.int64), model, shape).tolist() == [0, 0]
