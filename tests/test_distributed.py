"""Skew-safe building blocks against brute force, with the large-group paths forced on."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from placewise.functions import ranks
from placewise.functions.gazetteer import LANDMARK_TYPES
from placewise.operators import candidates, fusion, places, proximity, ranking, street_model


@pytest.mark.parametrize("hot_rows", [10, 10**9])
def test_rank_stats_match_numpy(spark, hot_rows):
    rng = random.Random(1)
    rows = [("big", float(rng.randint(0, 400))) for _ in range(3000)] + [("small", 5.0), ("small", 9.0), ("tie", 1.0)] + [("tie", 2.0)] * 50
    df = spark.createDataFrame(rows, "k string, v double")
    stats = {"q5": ranks.linear(0.5), "q9": ranks.linear(0.9), "i7": ranks.index(0.7)}
    got = {r.k: r for r in ranks.rank_stats(df, ["k"], "v", stats, count_as="n", hot_rows=hot_rows).collect()}
    for key in ("big", "small", "tie"):
        values = sorted(v for k, v in rows if k == key)
        assert got[key].n == len(values)
        assert got[key].q5 == pytest.approx(np.quantile(values, 0.5))
        assert got[key].q9 == pytest.approx(np.quantile(values, 0.9))
        assert got[key].i7 == values[min(len(values) - 1, int(len(values) * 0.7))]


@pytest.mark.parametrize("hot_rows", [10, 10**9])
def test_row_ranks(spark, hot_rows):
    rng = random.Random(2)
    rows = [(i, i % 2, float(rng.randint(0, 50))) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k int, v double")
    got = {r.id: r.row_rank for r in ranks.row_ranks(df, ["k"], "v", "id", hot_rows=hot_rows).collect()}
    for k in (0, 1):
        order = sorted((v, i) for i, kk, v in rows if kk == k)
        for expected, (_, i) in enumerate(order):
            assert got[i] == expected


def test_ordinary_groups_are_sorted_once(spark):
    """No task holds several sorted copies of its rows: without a large group, ranks take one window and no join by segment."""
    rows = [(i, i % 7 if i % 11 else None, float(i % 13) if i % 5 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k int, v double")
    for out, others in ((ranks.value_ranks(df, ["k"], "v"), ["v", "cnt", "first_rank", "n"]), (ranks.row_ranks(df, ["k"], "v", "id"), ["id", "v", "row_rank", "group_rows"])):
        got = sorted(tuple(r[c] for c in ("k", *others)) for r in out.collect())
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "isFinalPlan=true" in plan and "SortMergeJoin" not in plan and plan.count(" Sort [") == 1
        groups = {}
        for i, k, v in rows:
            if k is not None and v is not None:
                groups.setdefault(k, []).append((v, i))
        if "id" in others:
            want = [(k, i, v, n, len(own)) for k, own in groups.items() for n, (v, i) in enumerate(sorted(own))]
        else:
            count = lambda own, v: sum(x == v for x, _ in own)
            want = {(k, v, count(own, v), sum(x < v for x, _ in own), len(own)) for k, own in groups.items() for v, _ in own}
        assert got == sorted(want)


def test_nearest_within_keeps_pois_off_the_driver(spark, tmp_path):
    """Against brute force, by a plan that broadcasts neither side however small Spark takes the pois to be."""
    rng = random.Random(5)
    pois = [(k, rng.choice("ab"), rng.uniform(-2000, 2000), rng.uniform(-2000, 2000)) for k in range(400)]
    anchors = [(rng.choice("abc"), rng.uniform(-2500, 2500), rng.uniform(-2500, 2500)) for _ in range(60)]
    df = spark.createDataFrame(anchors * 3, "kind string, ax double, ay double")
    spark.createDataFrame(pois, "poi_id long, kind string, x double, y double").write.parquet(f"{tmp_path}/pois")
    near = proximity.nearest_within(df, spark.read.parquet(f"{tmp_path}/pois"), ["kind"], ("ax", "ay"), ("x", "y"), "poi_id", 300.0)
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    want = set()
    for kind, ax, ay in anchors:
        inside = [(math.hypot(x - ax, y - ay), k) for k, own, x, y in pois if own == kind and math.hypot(x - ax, y - ay) <= 300]
        want |= {(kind, ax, ay, min(inside)[1])} if inside else set()
    assert want and {(r.kind, r.ax, r.ay, r.poi_id) for r in near.collect()} == want


def test_box_neighbours(spark):
    rng = random.Random(3)
    # A dense spot, a sparse field and a point at the spot's rim.
    pts = [(i, rng.gauss(0, 0.4), rng.gauss(0, 0.4)) for i in range(150)] + [(i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(150, 260)]
    df = spark.createDataFrame(pts, "id long, a double, b double")
    got = {}
    for r in proximity.box_neighbours(df, "id", "a", "b", 1.0, 5).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour))
    for i, a, b in pts:
        near = sorted(j for j, c, d in pts if j != i and a - 1 <= c <= a + 1 and b - 1 <= d <= b + 1)[:5]
        assert [n for _, n in sorted(got.get(i, []))] == near


def test_leaders(spark):
    rng = random.Random(4)
    rows = [(g, i, rng.uniform(0, 300), rng.uniform(0, 300)) for g in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, i int, x double, y double")
    got = {(r.g, r.i): r.leader for r in candidates.assign_leaders(df, "g", [F.col("i")], "x", "y", 50.0, "projected_xy").collect()}
    for g in range(3):
        leaders = []
        for gg, i, x, y in rows:
            if gg != g:
                continue
            home = next((n for n, (lx, ly) in enumerate(leaders, 1) if math.hypot(x - lx, y - ly) <= 50), None)
            if home is None:
                leaders.append((x, y))
                home = len(leaders)
            assert got[(g, i)] == home


def _greedy(points, link):
    """points: (x, y, p) -> partition as a set of frozensets."""
    left, out = list(points), set()
    while left:
        def support(s):
            return round(sum(math.log(p / (1 - p)) for x, y, p in left if math.hypot(x - s[0], y - s[1]) <= link), 9)

        seed = max(left, key=support)
        members = [q for q in left if math.hypot(q[0] - seed[0], q[1] - seed[1]) <= link]
        left = [q for q in left if q not in members]
        out.add(frozenset(members))
    return out


@pytest.mark.parametrize("task_points", [1000, 5])
def test_visit_clusters(spark, task_points):
    rng = random.Random(5)
    rows, expected = [], {}
    for a in range(3):
        pts = []
        for i in range(70):
            spot = rng.choice([(0, 0), (400, 100), (520, 100), (2000, -500)])
            pts.append((round(spot[0] + rng.gauss(0, 60), 3), round(spot[1] + rng.gauss(0, 60), 3), rng.choice([0.6, 0.88, 0.94])))
        expected[a] = _greedy(pts, 150.0)
        rows += [(a, x, y, p, 1, a * 1000 + i) for i, (x, y, p) in enumerate(pts)]
    df = spark.createDataFrame(rows, "address_id long, x double, y double, p double, cnt long, first_visit long")
    got = {}
    for r in fusion.visit_clusters(df, 150.0, task_points).collect():
        got.setdefault(r.address_id, {}).setdefault(r.cluster, set()).add((r.x, r.y, r.p))
    for a in range(3):
        assert {frozenset(v) for v in got[a].values()} == expected[a]


def test_street_neighbours_leave_own_account_out(spark):
    rng = random.Random(6)
    known = [(f"L{i % 2}", float(i % 3), 1.0, i % 7, i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(60)]
    asked = [(loc, s1, s2, acc, aid) for loc, s1, s2, acc, aid, _, _ in known] + [("L0", 0.0, 1.0, 99, 500), ("L5", 0.0, 1.0, 99, 501)]
    points = spark.createDataFrame(known, "locality_id string, s1 double, s2 double, account_id long, address_id long, label_x double, label_y double")
    parsed = spark.createDataFrame(asked, "locality_id string, s1 double, s2 double, account_id long, address_id long")
    got = {r.address_id: r for r in fusion.street_neighbours(points, parsed).collect()}
    for loc, s1, s2, acc, aid in asked:
        others = [(x, y) for l, a, b, c, _, x, y in known if (l, a, b) == (loc, s1, s2) and c != acc]
        if not others:
            assert aid not in got
            continue
        assert got[aid].source == ("st_exact_2" if len(others) >= 2 else "st_exact_1")
        assert got[aid].x == pytest.approx(np.median([o[0] for o in others]))
        assert got[aid].y == pytest.approx(np.median([o[1] for o in others]))


@pytest.mark.parametrize("style,size,outliers,seed", [("karnataka", 80, 0, 1), ("karnataka", 80, 30, 2), ("metro", 300, 40, 3), ("hindi", 3600, 500, 4)])
def test_street_model_refits_each_held_out_account(spark, style, size, outliers, seed):
    rng = random.Random(seed)
    maybe = lambda v: None if rng.random() < 0.15 else float(v)
    known = []
    for i in range(size):
        s1, s2, kind = maybe(rng.randint(1, 9)), maybe(rng.randint(1, 7)), rng.choice([None, *LANDMARK_TYPES[:3]])
        # The outliers belong to one account.
        away, account = (2500.0, 999) if i < outliers else (0.0, rng.randint(0, size // 4))
        known.append(("L1", style, account, s1, s2, kind, (s1 or 4) * 40 + rng.gauss(0, 20) + away, (s2 or 4) * 50 + rng.gauss(0, 20)))
    asked = [(k, acc, "L1", *rng.choice(known)[3:6]) for k, acc in enumerate([999, 0, 1, 2, 5, 10**6])]
    pts = spark.createDataFrame(known, "locality_id string, style string, account_id long, s1 double, s2 double, landmark_type string, dx double, dy double")
    ask = spark.createDataFrame(asked, "address_id long, account_id long, locality_id string, s1 double, s2 double, landmark_type string")
    got = {r.address_id: r for r in street_model.street_predictions(pts, ask, accounts_per_task=2).collect()}
    # Leaving an account out is a fit on the rest: the rest alone, asked by a stranger, answers alike.
    for k, account, _, s1, s2, kind in asked:
        rest = [p for p in known if p[2] != account]
        if s1 is None and s2 is None and not any(kind is not None and p[5] == kind for p in rest):
            assert k not in got
            continue
        alone = street_model.street_predictions(spark.createDataFrame(rest, pts.schema), spark.createDataFrame([(k, 10**7, "L1", s1, s2, kind)], ask.schema)).first()
        assert (got[k].source, got[k].dx, got[k].dy) == (alone.source, pytest.approx(alone.dx, abs=1e-6), pytest.approx(alone.dy, abs=1e-6))
    # Points follow their street numbers; an account of far points does not move the others' fits by more than the noise.
    for k, account, _, s1, s2, kind in asked:
        if style != "metro" and s1 is not None and s2 is not None and size > 200:
            assert math.hypot(got[k].dx - s1 * 40, got[k].dy - s2 * 50) < 60


def _frame(style, rows):
    return pd.DataFrame([("L1", style, str(k % 7), *r) for k, r in enumerate(rows)], columns=["locality_id", "style", "account_id", "s1", "s2", "landmark_type", "dx", "dy"])


@pytest.mark.parametrize("style", ["karnataka", "metro"])
def test_street_fit_is_a_ridge_minimum_on_what_it_keeps(style):
    rng = np.random.default_rng(5)
    rows = [(float(rng.integers(1, 9)), float(rng.integers(1, 7)) if rng.random() < 0.8 else np.nan, None if rng.random() < 0.5 else LANDMARK_TYPES[int(rng.integers(3))], *rng.normal(0, 30, 2)) for _ in range(120)]
    far = [(float(rng.integers(1, 9)), 2.0, None, 4000.0 + k, -3000.0) for k in range(12)]
    for points in (rows, rows + far):
        place = street_model.Locality(_frame(style, points))
        weights, middles, kept = place.fit(np.ones(len(points), bool))
        # Near points all stay and far ones go, so the kept ones are the first rows.
        assert kept == len(rows)
        near = street_model.Locality(_frame(style, rows))
        basis, penalty = street_model.terms(style, near.s1, near.s2, near.kind, middles)
        misses = near.offsets - (basis @ weights)[near.shape]
        gradient = basis[near.shape].T @ misses - penalty[:, None] * weights
        assert np.abs(gradient).max() < 1e-6
        all_misses = np.hypot(*(place.offsets - (street_model.terms(style, place.s1, place.s2, place.kind, middles)[0] @ weights)[place.shape]).T)
        limit = max(street_model.NEAR_M, street_model.NEAR_MEDIANS * float(np.median(all_misses[: len(rows)])))
        assert ((all_misses <= limit) == (np.arange(len(points)) < len(rows))).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_cluster_growth_one_by_one_and_in_batches(spark, seed):
    rng = random.Random(seed)
    # A crowded strip, where founders hide each other, and a far field.
    visits = [(i, rng.randint(0, 30), rng.randint(0, 40), rng.uniform(0, 900), rng.uniform(0, 150)) for i in range(160)]
    visits += [(200 + i, rng.randint(0, 30), 50 + i, rng.uniform(5000, 9000), rng.uniform(5000, 9000)) for i in range(30)]
    standing = [("C1", 50.0, 50.0), ("C2", 60.0, 60.0)]
    members, centres = {("C1", 7)}, list(standing)
    for v, t, acc, x, y in sorted(visits, key=lambda r: (r[1], r[0])):
        near = [c for c, a, b in centres if x - 100 <= a <= x + 100 and y - 100 <= b <= y + 100]
        if not near:
            centres.append((f"N{v}", x, y))
        members.add((min(near) if near else f"N{v}", acc))
    clusters = spark.createDataFrame(standing, "cluster_id string, latitude double, longitude double")
    started = spark.createDataFrame([("C1", 7)], "cluster_id string, account_id long")
    frame = lambda rows: spark.createDataFrame(rows, "visit_id long, checkin_ts int, account_id long, x double, y double")
    whole, grown = places.assign_clusters(frame(visits), clusters, started, "x", "y", 100.0)
    assert {tuple(r) for r in whole.select("cluster_id", "account_id").collect()} == members
    assert {r.cluster_id for r in grown.collect()} == {c for c, _, _ in centres} - ({"C2"} - {c for c, _ in members})
    for low, high in ((0, 10), (10, 17), (17, 99)):
        started, clusters = places.assign_clusters(frame([r for r in visits if low <= r[1] < high]), clusters, started, "x", "y", 100.0)
        clusters = clusters.select("cluster_id", "latitude", "longitude").unionByName(spark.createDataFrame(standing, clusters.select("cluster_id", "latitude", "longitude").schema)).distinct()
    assert {tuple(r) for r in started.select("cluster_id", "account_id").collect()} == members


def test_spatial_clusters_against_union_find(spark):
    rng = random.Random(9)
    pts = [(i, rng.uniform(0, 2500), rng.uniform(0, 2500)) for i in range(220)] + [(300 + i, 5000.0, 5000.0) for i in range(2)] + [(400, 9000.0, 9000.0)]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    got = {r.id: r.place for r in places.spatial_clusters(df, "x", "y", 100.0).select("id", "place").collect()}
    parent = {i: i for i, _, _ in pts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x, y in pts:
        for j, c, d in pts:
            if i < j and math.hypot(x - c, y - d) <= 100:
                parent[find(i)] = find(j)
    groups = {}
    for i, _, _ in pts:
        groups.setdefault(find(i), set()).add(i)
    expected = {frozenset(g) for g in groups.values() if len(g) >= 2}
    found = {}
    for i, place in got.items():
        if place is not None:
            found.setdefault(place, set()).add(i)
    assert {frozenset(g) for g in found.values()} == expected
    assert got[400] is None


def test_training_rows_are_dealt_by_their_number(spark, monkeypatch):
    """One partition of many rows goes to tasks of bounded size."""
    from pyspark.ml.classification import GBTClassifier

    seen = []
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, df: seen.append(df))
    monkeypatch.setattr(ranking, "TRAINING_ROWS", 100)
    columns = {name: F.lit(default).cast(kind) for name, (kind, default) in candidates.SCHEMA.items()} | {"label": (F.col("id") % 2).cast("double")}
    ranking.train(spark.range(0, 2000, 1, 1).withColumns(columns))
    sizes = [r["count"] for r in seen[0].groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2000 and len(sizes) == 20 and max(sizes) <= 200
