"""Hard negatives, centroid clustering and benchmark passages against plain versions."""

import math
import re
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placewise.llm import anchor_tree, centroids, wu_manber

VECTORS = "vec_id long, embedding array<float>, label int, id int, uid string, x int, cell int"
ODD = [None, [0.0] * 16, [1.0] * 15 + [float("nan")], [1.0] * 15 + [float("inf")], [1.0] * 15 + [None], [], [1.0, -2.0]]


def _integers(v):
    return [max(-(1 << 23), min(1 << 23, math.floor(256 * float(np.float32(x))))) for x in v]


def _whole(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def _vectors(seed, n, clusters, spread, dims=16):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((clusters, dims))
    return (middle[rng.integers(clusters, size=n)] + spread * rng.standard_normal((n, dims))).astype(np.float32).tolist()


def _table(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "u", 2, 3) for i, v, label in rows], VECTORS).repartition(4)


# Hard negatives


def _negatives(rows, modulus):
    kept = [(i, _integers(v), label) for i, v, label in rows if i is not None and label is not None and _whole(v)]
    out = []
    for k, (a, x, label) in enumerate(kept):
        if a % modulus:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), i, other) for j, (i, y, other) in enumerate(kept) if j != k]
        for score, positive, _ in sorted(s for s in scored if s[2] == label)[:5]:
            fit = sorted((s, i) for s, i, other in scored if other != label and 30 * -score <= 100 * -s <= 90 * -score)[:10]
            out += [(a, positive, rank, i, -score, -s) for rank, (s, i) in enumerate(fit, 1)]
    return sorted(out)


def _mined(spark, rows, modulus, **sizes):
    found = anchor_tree.mine(_table(spark, rows), F.col("vec_id") % modulus == 0, **sizes)
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found.collect())


@pytest.mark.parametrize("seed,spread,block", [(1, 0.05, 2048), (2, 0.4, 8), (3, 1.5, 5)])
def test_negatives_against_all_scores(spark, seed, spread, block):
    vectors = _vectors(seed, 400, 12, spread)
    rng = np.random.default_rng(seed)
    rows = [(i, v, int(rng.integers(4))) for i, v in enumerate(vectors)]
    rows += [(i, vectors[0], 1) for i in (3, 7, 400, 401, 402)] + [(1000 + k, v, 1) for k, v in enumerate(ODD)] + [(2000, vectors[1], None), (None, vectors[1], 1)]
    assert _mined(spark, rows, 10, anchor_block=block, part_rows=150, least_parts=2) == _negatives(rows, 10)


def test_negatives_of_one_hot_label_and_equal_rows(spark):
    rows = [(i, [1.0, 0.5] * 8, 0) for i in range(120)] + [(200 + i, [0.5, 0.5] * 8, 1) for i in range(40)] + [(300, [0.0] * 16, 5)]
    assert _mined(spark, rows, 20, anchor_block=3, least_parts=3) == _negatives(rows, 20)


def test_negatives_with_large_components_and_empty_tables(spark):
    rows = [(i, [float(2 ** (i % 30)), -3.0e38 if i == 5 else 1.0] * 8, i % 2) for i in range(30)]
    assert _mined(spark, rows, 10) == _negatives(rows, 10)
    assert _mined(spark, [], 10) == [] and _mined(spark, rows[1:9], 10) == [] and _mined(spark, rows[:1], 10) == []


def test_bounds_spare_scores_and_hold():
    x = np.array([_integers(v) for v in _vectors(4, 2000, 20, 0.05)])
    anchors = x[:200]
    block = anchor_tree.Block(anchors, x)
    ids = np.arange(len(x))
    for k, low, high in block.walk():
        true = x @ anchors[k]
        assert (low <= true).all() and (true <= high).all()
        got = block.first(k, ids, low, high, 0, int(true.max()) * 0.9, 10, ids)
        fit = np.flatnonzero((true >= 0) & (true <= int(true.max()) * 0.9))
        assert got.tolist() == fit[np.lexsort((fit, -true[fit]))[:10]].tolist()
    assert block.scored < 0.6 * len(x) * len(anchors)


def test_spanning_tree_is_minimal():
    points = np.random.default_rng(6).standard_normal((60, 3))
    parent = anchor_tree.spanning_tree(points)
    away = np.linalg.norm(points[:, None] - points[None], axis=2)
    edges, top, least = sorted((away[i, j], i, j) for i in range(60) for j in range(i)), list(range(60)), 0.0

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for d, i, j in edges:
        if find(i) != find(j):
            top[find(i)] = find(j)
            least += d
    assert math.isclose(sum(away[k, p] for k, p in enumerate(parent)), least)
    assert sorted(anchor_tree.visits(parent)) == list(range(60))


# Centroids


def _lloyd(rows, k, rounds, width):
    kept = [(i, _integers(v)) for i, v, _ in rows if _whole(v) and len(v) == width]
    start = sorted(kept, key=lambda r: (r[0] is None, sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    middle = [x for _, x in start]

    def assign():
        return [min((sum((p - q) ** 2 for p, q in zip(x, c)), j) for j, c in enumerate(middle)) for _, x in kept]

    for _ in range(rounds):
        near = assign()
        for j in range(len(middle)):
            own = [x for (_, x), (_, c) in zip(kept, near) if c == j]
            if own:
                middle[j] = [sum(column) // len(own) for column in zip(*own)]
    near = assign()
    total = sum(d for d, _ in near)
    return sorted(
        ((i is None, i or 0), c, d, sum(e for e, b in near if b == c), total, sha256(",".join(map(str, middle[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, near)
    )


def _clusters(spark, rows, k, rounds, width=16):
    found = centroids.report(*centroids.clustered(_table(spark, rows), k, rounds, width))
    return sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found.collect())


@pytest.mark.parametrize("seed,spread,k", [(1, 0.2, 8), (2, 1.0, 20), (3, 0.0, 6)])
def test_clusters_against_plain_rounds(spark, seed, spread, k):
    rows = [(i, v, 0) for i, v in enumerate(_vectors(seed, 300, 7, spread))]
    rows += [(5, rows[9][1], 0), (None, rows[4][1], 0), (400, [0.0] * 16, 0)] + [(1000 + j, v, 0) for j, v in enumerate(ODD)]
    assert _clusters(spark, rows, k, 4) == _lloyd(rows, k, 4, 16)


def test_clusters_of_few_equal_and_no_vectors(spark):
    rows = [(i, [0.25] * 16, 0) for i in range(5)] + [(9, [3.0e38] + [-1.0] * 15, None)]
    assert _clusters(spark, rows, 8, 3) == _lloyd(rows, 8, 3, 16)
    assert _clusters(spark, [(1, None, 0)], 8, 3) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 30), st.integers(1, 6), st.sampled_from([2, 300, 1 << 23]))
def test_search_is_exact_with_ties(seed, k, dims, size):
    rng = np.random.default_rng(seed)
    middle, x = rng.integers(-size, size, (k, dims)), rng.integers(-size, size, (50, dims))
    distance = np.square(x[:, None] - middle[None]).sum(axis=2)
    number, least = centroids.Search(middle).nearest(x)
    assert (least == distance.min(axis=1)).all() and (number == distance.argmin(axis=1)).all()


# Passages

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text):
    return _WORD.findall((text or "").translate(_LOWER))


def _contamination(docs, items, window=10):
    patterns = {}
    for item, text in items:
        words = _words(text)
        k = min(window, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            patterns.setdefault(tuple(words[i : i + k]), set()).add(item)
    out = []
    for doc, text in docs:
        words, hit, names = _words(text), set(), set()
        for k in {len(p) for p in patterns}:
            for i in range(len(words) - k + 1):
                own = patterns.get(tuple(words[i : i + k]))
                if own is not None:
                    hit |= set(range(i, i + k))
                    names |= {str(x) for x in own if x is not None}
        out.append((doc is None, doc or 0, len(words), len(hit), len(names), sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def _judged(spark, docs, items, **sizes):
    left = spark.createDataFrame([(d, t, 1, "k", "i") for d, t in docs], "doc_id long, text string, n_words int, item string, digest string").repartition(3)
    right = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, words int")
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in wu_manber.judged(left, right, **sizes).collect())


def _texts(seed):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(60)] + ["ÉTÉ", "straße", "日本", "a", "B", "x" * 300, "²"]
    say = lambda n: list(rng.choice(words, n))
    items = [(k, " ".join(say(rng.integers(1, 40)))) for k in range(40)]
    items += [(3, items[5][1]), (None, "only the nameless item has these ten words in a row"), (50, None), (51, ""), (52, "-- !"), (53, "a"), (54, "W1, w2; W3"), (55, items[7][1])]
    docs = []
    for k in range(80):
        parts = say(rng.integers(0, 60))
        for _ in range(rng.integers(0, 3)):
            at = rng.integers(len(parts) + 1)
            parts[at:at] = (items[rng.integers(46)][1] or "").upper().split(" ")
        docs.append((k % 70, rng.choice([" ", " \n", "--"]).join(parts)))
    docs += [(None, items[1][1]), (None, None), (90, ""), (91, "a"), (92, "--"), (93, " ".join(say(30_000) + items[2][1].split()))]
    docs += [(94, "The only nameless. Only THE nameless item has these ten words in a row!")] + [(200 + k, items[0][1]) for k in range(40)]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_against_plain_windows(spark, seed):
    docs, items = _texts(seed)
    want = _contamination(docs, items)
    assert _judged(spark, docs, items) == want
    assert _judged(spark, docs, items, part_bytes=20_000) == want


def test_passages_of_long_items_only(spark):
    docs, items = _texts(3)
    items = [(i, t) for i, t in items if len(_words(t)) >= 10]
    assert _judged(spark, docs, items) == _contamination(docs, items)


def test_passages_of_empty_tables(spark):
    docs, items = _texts(4)
    assert _judged(spark, docs, []) == _contamination(docs, []) and _judged(spark, [], items) == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab \n", max_size=60), min_size=1, max_size=6), st.lists(st.text("ab ", max_size=12), min_size=1, max_size=6), st.integers(1, 4))
def test_finder_on_small_alphabets(texts, items, window):
    rows = [(k, s, str(n)) for n, t in enumerate(items) for k, s in wu_manber.windows_of(wu_manber.words_of(t.encode()), window)]
    got = [(n, sum(y - x for x, y in spans), len(names)) for n, spans, names in wu_manber.Finder(rows).search([t.encode() for t in texts])]
    want = [r[2:5] for r in _contamination(list(enumerate(texts)), list(enumerate(items)), window)]
    assert got == want
