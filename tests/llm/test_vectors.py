from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from basketry.llm.centroids import cluster_vectors, update_products
from basketry.llm.codes import code_text, decode_vectors, encode_vectors
from basketry.llm.gnat import Gnat

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(points, queries):
    away = ((queries[:, None, :] - points[None]) ** 2).sum(axis=2)
    index = away.argmin(axis=1)
    return away[np.arange(len(queries)), index], index


@pytest.mark.parametrize("spread, n, fan", [(3, 300, 16), (1000, 256, 16), (1 << 23, 100, 4), (2, 9, 2), (50, 1, 16)])
def test_tree_finds_the_nearest_of_the_lowest_index(spread, n, fan):
    rng = np.random.default_rng(spread)
    points = rng.integers(-spread, spread + 1, (n, 5))
    points[n // 2 :: 7] = points[0]  # equal entries
    queries = np.concatenate([rng.integers(-2 * spread, 2 * spread + 1, (400, 5)), points])
    found = Gnat(points, fan).nearest(queries)
    want = brute(points, queries)
    assert np.array_equal(found[0], want[0]) and np.array_equal(found[1], want[1])


def test_tree_leaves_out_subtrees():
    rng = np.random.default_rng(1)
    centres = rng.integers(-100000, 100000, (16, 8))
    points = (centres[:, None] + rng.integers(-50, 50, (16, 16, 8))).reshape(-1, 8)
    tree, seen = Gnat(points), []
    visit = tree._visit
    tree._visit = lambda node, queries, rows, *rest: (seen.append(len(rows)), visit(node, queries, rows, *rest))
    away, index = tree.nearest(points + 1)
    assert np.array_equal(away, brute(points, points + 1)[0]) and np.array_equal(index, brute(points, points + 1)[1])
    assert sum(seen) <= 3 * len(points)  # of 17 nodes each query enters the root and one or two more


def rows():
    rng = np.random.default_rng(5)
    out = [(i, [float(x) for x in rng.normal(0, 0.2, 8).astype(np.float32)], i % 3 if i % 7 else None) for i in range(60)]
    out += [out[3], out[3], (3, out[4][1], 1), (None, out[5][1], 2)]  # repeated rows, an id of two vectors, no id
    out += [(100 + i, [0.25 * (i % 2)] * 8, 9) for i in range(12)]  # ties
    return out, [
        (200, None, 1), (201, [], 1), (202, [1.0] * 7 + [None], 1), (203, [math.nan] + [0.0] * 7, 1),
        (204, [math.inf] + [0.0] * 7, 1), (205, [0.5] * 12, 1),
    ]


def whole(vector):
    return [math.floor(1024 * x) for x in vector]


def plain_codes(kept, entries, rounds, parts=4):
    vectors = np.array([whole(v) for _, v, _ in kept], np.int64)
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, whole(kept[i][1])))
    cut = np.split(vectors, parts, axis=1)
    books = [part[order[:entries]].copy() for part in cut]
    for _ in range(rounds):
        for part, book in zip(cut, books):
            _, index = brute(book, part)
            for e in set(index.tolist()):
                book[e] = part[index == e].sum(axis=0) // (index == e).sum()
    found = [brute(book, part) for part, book in zip(cut, books)]
    return np.stack([i for _, i in found], 1), sum(d for d, _ in found), books


def test_codes_equal_brute_force(spark):
    kept, left_out = rows()
    df = spark.createDataFrame(kept + left_out, SCHEMA).selectExpr("*", "1 AS key", "2 AS codes").repartition(3)
    for entries in (16, 256):
        coded, books = encode_vectors(df, entries=entries)
        codes, error, want = plain_codes(kept, entries, 4)
        text = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
        by_label = {}
        for (_, _, label), e in zip(kept, error.tolist()):
            by_label[label] = by_label.get(label, 0) + e
        expected = [(k, t, e, by_label[label]) for (k, _, label), t, e in zip(kept, text, error.tolist())]
        got = [tuple(r) for r in coded.select("key", code_text(), "error", "label_error").collect()]
        assert sorted(got, key=repr) == sorted(expected, key=repr)
        assert all(np.array_equal(a, b) for a, b in zip(books.values, want))
        flat = ",".join(str(x) for book in want for entry in book.tolist() for x in entry)
        assert books.digest() == hashlib.sha256(flat.encode()).hexdigest()
    back = decode_vectors(coded, books).collect()
    assert all(r.vector == [(x + 0.5) / 1024 for p, c in enumerate(r.codes) for x in want[p][c].tolist()] for r in back)


def test_codes_of_nothing(spark):
    df = spark.createDataFrame(rows()[1][:5], SCHEMA)
    coded, books = encode_vectors(df)
    assert books is None and coded.count() == 0
    assert coded.columns == ["key", "label", "codes", "error", "label_error"]
    assert encode_vectors(df.limit(0))[0].count() == 0


def test_too_large_components_stop_the_job(spark):
    df = spark.createDataFrame([(1, [1e30] * 8, 0)], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        encode_vectors(df)


def test_products_follow_changed_components_only():
    rng = np.random.default_rng(2)
    vectors, before, after = (rng.integers(-9, 9, (n, 6)) for n in (20, 3, 3))
    after[1] = before[1]
    after[2, 1:] = before[2, 1:]
    vectors = vectors.astype(np.int64)
    assert np.array_equal(update_products(vectors, vectors @ before.T, after - before), vectors @ after.T)
    wrong = vectors @ before.T + 1  # what did not change is not computed again
    assert np.array_equal(update_products(vectors, wrong, after - before)[:, 1], wrong[:, 1])


def plain_clusters(kept, k, rounds):
    vectors = np.array([whole(v) for _, v, _ in kept], np.int64)
    digest = lambda key: "~" if key is None else hashlib.sha256(f"3:{key}".encode()).hexdigest()
    order = sorted(range(len(kept)), key=lambda i: (digest(kept[i][0]), whole(kept[i][1])))
    centroids = vectors[order[:k]].copy()
    for _ in range(rounds):
        _, index = brute(centroids, vectors)
        for c in set(index.tolist()):
            centroids[c] = vectors[index == c].sum(axis=0) // (index == c).sum()
    return *brute(centroids, vectors), centroids


def test_clusters_equal_brute_force(spark):
    kept, left_out = rows()
    df = spark.createDataFrame(kept + left_out, SCHEMA).selectExpr("*", "1 AS cluster", "2 AS key").repartition(3)
    for k, rounds in ((8, 10), (100, 2), (1, 1)):
        away, index, centroids = plain_clusters(kept, k, rounds)
        expected = [
            (key, c, d, int(away[index == c].sum()), int(away.sum()),
             hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
            for (key, _, _), c, d in zip(kept, index.tolist(), away.tolist())
        ]
        got = [tuple(r) for r in cluster_vectors(df, width=8, k=k, rounds=rounds).drop("centroid").collect()]
        assert sorted(got, key=repr) == sorted(expected, key=repr)
    nothing = cluster_vectors(df, width=64)
    assert nothing.count() == 0 and nothing.columns == cluster_vectors(df, width=8, rounds=1).columns
    assert cluster_vectors(df.limit(0), width=8).count() == 0
