"""Pairs and places by likeness against all pairs in plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from placewise.functions import fuzzy
from placewise.operators import place_pairs

SCHEMA = "account_id long, latitude double, longitude double, normalized_address string, landmark string, locality string, pincode string, building string, street string, cross string"
WEIGHTS = {"spatial": 0.4, "landmark": 0.3, "text": 0.2, "building": 0.25, "street": 0.15, "locality": 0.1, "pincode": 0.05, "cross": 0.1}


def _ratio(a, b):
    rows = [0] * (len(b) + 1)
    for x in a:
        above = rows[:]
        for j, y in enumerate(b, 1):
            rows[j] = above[j - 1] + 1 if x == y else max(above[j], rows[j - 1])
    return 200 * rows[-1] / (len(a) + len(b)) if a or b else 100


def _token_set(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    if not both:
        return _ratio(left, right)
    lcs = _ratio(left, right) * (len(left) + len(right)) / 200
    joined = 100 - 100 * (len(left) + len(right) - 2 * lcs) / (len(one) + len(two))
    return max(joined, _ratio(both, one), _ratio(both, two))


def _likeness(p, q):
    _, la, lo, text, *_ = p
    _, la2, lo2, text2, *_ = q
    found = {}
    if la and la2:
        h = math.sin(math.radians(la2 - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(la2)) * math.sin(math.radians(lo2 - lo) / 2) ** 2
        found["spatial"] = math.exp(-2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h)) / 200)
    if text and text2:
        found["text"] = _token_set(text, text2) / 100
    for name, a, b in zip(("landmark", "locality", "pincode", "building", "street", "cross"), p[4:], q[4:]):
        if a and b:
            found[name] = float(_ratio(a.lower(), b.lower()) > 85) if name == "landmark" else float(a == b) if name in ("pincode", "cross") else _ratio(a.lower(), b.lower()) / 100
    weight = sum(WEIGHTS[n] for n in found)
    return round(sum(WEIGHTS[n] * v for n, v in found.items()) / weight, 9) if weight else 0.0


def _meets(p, q):
    lower = lambda x: x.lower() if x else None
    return bool(p[1] and q[1]) or any(lower(p[k]) and lower(p[k]) == lower(q[k]) for k in (4, 5, 6))


def _accounts(seed, n=110, hot=0.0):
    rng = random.Random(seed)
    maybe = lambda values, gap=0.3: None if rng.random() < gap else rng.choice(values)
    rows = []
    for i in range(n):
        if rng.random() < hot:
            # One block: one pincode, locality and landmark; only house numbers and the spot differ.
            at = (12.9 + rng.random() * 1e-4, 77.5) if rng.random() < 0.5 else (None, None)
            rows.append((i, *at, f"number {rng.randrange(400)} {rng.randrange(9)} cross kuvempu layout 560001", "ganesh temple", "Kuvempu Layout", "560001", None, None, None))
            continue
        spot = rng.choice([(None, None), (None, None), (0.0, 77.5), (12.9 + rng.random() * 0.02, 77.5 + rng.random() * 0.02), (-12.9, 179.9999 if rng.random() < 0.5 else -179.9999)])
        text = maybe([f"{rng.randrange(9)} main road near temple", f"house {rng.randrange(4)} gandhi nagar", "temple street", "bazaar", ""], 0.15)
        rows.append((
            i, *spot, text, maybe(["Ganesh Temple", "ganesh temple", "Ganesh Tempel", "masjid", ""]), maybe(["Gandhi Nagar", "Gandhi Nagara", "Nehru Layout", "x"]),
            maybe(["560001", "560002", "560003"]), maybe(["Rose Villa", "Rose Vila", "Sea View"], 0.6), maybe(["main road", "temple street"], 0.5), maybe(["1 cross", "2 cross"], 0.6),
        ))
    return rows + [(n + k, *rows[k][1:]) for k in range(4)] + [(n + 4 + k, *([None] * 9)) for k in range(2)]


def _brute(rows, threshold):
    pairs = {}
    for i, p in enumerate(rows):
        for q in rows[:i]:
            if _meets(p, q):
                value = _likeness(p, q)
                if value >= threshold:
                    pairs[q[0], p[0]] = value
    return pairs


@pytest.mark.parametrize("seed,hot", [(1, 0.0), (2, 0.0), (3, 0.9)])
def test_pairs_and_places_against_all_pairs(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(place_pairs, "SLICE_ROWS", 16)
    rows = _accounts(seed, hot=hot)
    want = _brute(rows, 0.75)
    nodes = place_pairs.nodes_of(spark.createDataFrame(rows, SCHEMA).repartition(3))
    node = {r.account_id: r.node for r in nodes.collect()}
    blank = lambda r: tuple(x or None for x in r[1:]) if r[1] else (None, None, *[x or None for x in r[3:]])
    first = {}
    for r in rows:
        first.setdefault(blank(r), r[0])
    assert node == {r[0]: first[blank(r)] for r in rows}
    got = {(r.account_id, r.other_id): r.similarity for r in place_pairs.alike_pairs(nodes).collect()}
    assert got == pytest.approx({k: v for k, v in want.items() if node[k[0]] == k[0] and node[k[1]] == k[1]}, abs=1e-8)
    assert len(got) > 50

    top = {r[0]: r[0] for r in rows}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in want:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    size = {}
    for i in top:
        size[find(i)] = size.get(find(i), 0) + 1
    places = {r.account_id: r.place for r in place_pairs.alike_places(nodes).collect()}
    # Equal accounts without any shared block are still one node.
    assert {i: p for i, p in places.items() if node[i] == i and p is None} == {i: None for i in top if node[i] == i and size[find(i)] == 1 and list(node.values()).count(i) == 1 or blank(rows[i]) == (None,) * 9 and node[i] == i}
    for i in top:
        if size[find(i)] > 1:
            assert places[i] == f"t{find(i)}"


@pytest.mark.parametrize("seed,hot", [(1, 0.0), (3, 0.9)])
def test_links_against_all_pairs(spark, seed, hot, monkeypatch):
    """Slices and word tables of a few entries; no pair leaves the comparison as a row."""
    monkeypatch.setattr(place_pairs, "SLICE_ROWS", 16)
    monkeypatch.setattr(fuzzy, "_WORDS_AT_ONCE", 3)
    rows = _accounts(seed, hot=hot)
    nodes = place_pairs.nodes_of(spark.createDataFrame(rows, SCHEMA).repartition(3))
    node = {r.account_id: r.node for r in nodes.collect()}
    want = dict.fromkeys(node.values(), 0)
    for pair in _brute(rows, 0.75):
        if all(node[i] == i for i in pair):
            for i in pair:
                want[i] += 1
    found = place_pairs.links(nodes)
    assert {r.account_id: (r.node, r.n_links) for r in found.collect()} == {i: (n, want[n]) for i, n in node.items()}
    assert sum(want.values()) > 100


@pytest.mark.parametrize("seed", [1, 3])
def test_pairs_that_share_no_block(spark, seed, monkeypatch):
    """Unlike pincodes, localities and landmarks: what else is alike may reach the threshold."""
    monkeypatch.setattr(place_pairs, "SLICE_ROWS", 16)
    rows = _accounts(seed)
    nodes = place_pairs.nodes_of(spark.createDataFrame(rows, SCHEMA).repartition(3))
    node = {r.account_id: r.node for r in nodes.collect()}
    every = {(q[0], p[0]): _likeness(p, q) for i, p in enumerate(rows) for q in rows[:i] if node[p[0]] == p[0] and node[q[0]] == q[0]}
    want = {k: v for k, v in every.items() if v >= 0.75}
    assert sum(not _meets(rows[a], rows[b]) for a, b in want) > 20
    got = {(r.account_id, r.other_id): r.similarity for r in place_pairs.alike_pairs(nodes, every=True).collect()}
    assert got == pytest.approx(want, abs=1e-8)
    counts = dict.fromkeys(node.values(), 0)
    for pair in want:
        for i in pair:
            counts[i] += 1
    assert {r.account_id: r.n_links for r in place_pairs.links(nodes, every=True).collect()} == {i: counts[n] for i, n in node.items()}
    top = {i: i for i in counts}
    while any(top[a] != top[b] for a, b in want):
        for a, b in want:
            top[a] = top[b] = min(top[a], top[b])
    told = [i for i in node if any(x is not None and x != "" for x in (rows[i][1] or None, *rows[i][3:]))]
    size = {}
    for i in told:
        size[top[node[i]]] = size.get(top[node[i]], 0) + 1
    places = {r.account_id: r.place for r in place_pairs.alike_places(nodes, every=True).collect()}
    assert places == {i: f"t{top[n]}" if i in told and size[top[n]] > 1 else None for i, n in node.items()}


def test_account_places_link_accounts_of_unlike_localities(monkeypatch):
    """``l5`` and ``l6`` ask for all pairs; ``l2`` lists them with their similarity."""
    from placewise.plans import place_queries, registry

    asked = []
    monkeypatch.setattr(place_queries.place_pairs, "nodes_of", lambda features: features)
    monkeypatch.setattr(place_queries.place_pairs, "alike_places", lambda nodes, threshold=0.75, every=False: asked.append(every))
    monkeypatch.setattr(place_queries.place_pairs, "merged_places", lambda spatial, text: None)
    monkeypatch.setattr(place_queries.places, "account_places", lambda clustered: None)
    monkeypatch.setattr(place_queries, "_clustered", lambda t: None)
    place_queries._account_places(None, None)
    assert asked == [True]
    assert "other_id" in registry.load()["l2_pair_similarity"].sql


def test_token_set_ratios_as_the_column_says(spark):
    rng = random.Random(9)
    words = ["a", "ab", "abc", "bca", "cab", "12", "123", "road"]
    texts = ["", "   "] + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(40)]
    pairs = [(i, j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)]
    ratio = spark.createDataFrame(pairs, "i int, j int, a string, b string").select("i", "j", fuzzy.token_set_ratio_col(F.col("a"), F.col("b")).alias("r")).collect()
    i, j, got = fuzzy.token_set_ratios(texts, texts, np.full((len(texts), len(texts)), 60.0))
    assert dict(zip(zip(i.tolist(), j.tolist()), got)) == pytest.approx({(r.i, r.j): r.r for r in ratio if r.r >= 60}, abs=1e-9)


def test_token_sets_reach_as_the_ratio_says(spark):
    rng = random.Random(8)
    words = ["a", "ab", "abc", "bca", "cab", "no.", "12", "123", "321", "\u0c95\u0ca8", "road"]
    texts = ["", "   "] + [rng.choice([" ", "  ", "\t"]).join(rng.choice(words) for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    pairs = [(i, j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)]
    ratio = spark.createDataFrame(pairs, "i int, j int, a string, b string").select("i", "j", fuzzy.token_set_ratio_col(F.col("a"), F.col("b")).alias("r")).collect()
    exact = np.zeros((len(texts), len(texts)))
    for r in ratio:
        exact[r.i, r.j] = r.r
    for shift in (-1e-6, 1e-6):
        assert (fuzzy.token_sets_reach(texts, texts, exact + shift) == (shift < 0)).all()
    assert (fuzzy.token_sets_reach(texts, texts, np.full(exact.shape, 60.000001)) == (exact >= 60.000001)).all()


def test_one_account_and_none(spark):
    one = _accounts(5)[:1]
    assert [r.place for r in place_pairs.alike_places(place_pairs.nodes_of(spark.createDataFrame(one, SCHEMA))).collect()] == ["t0"]
    assert place_pairs.alike_places(place_pairs.nodes_of(spark.createDataFrame([], SCHEMA))).count() == 0


def test_reach_follows_from_the_weights():
    assert 690 < place_pairs.reach_m(0.75) < 700


def test_texts_are_not_read_where_the_rest_decides(spark, monkeypatch):
    """Accounts of one class at one spot are alike whatever their addresses; those are only compared between what is still apart."""
    same = ("near temple", "rose nagar", "560001", None, "post office road", "3rd cross")
    rows = [(i, 12.97 + i * 1e-6, 77.59, f"house {i} of lane {i * 7}", *same) for i in range(60)] + [(60, 13.4, 77.1, "far away", "old mill", "hill colony", "560099", None, None, None)]
    monkeypatch.setattr(place_pairs.fuzzy, "token_set_ratio_col", lambda a, b: F.raise_error(F.concat(a, b)).cast("double"))
    got = {r.account_id: r.place for r in place_pairs.alike_places(place_pairs.nodes_of(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {**{i: "t0" for i in range(60)}, 60: None}
