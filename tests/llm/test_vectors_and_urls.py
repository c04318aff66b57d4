"""Vector and URL operators against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from placewise.llm import cover_tree, permutation_index, url_trust
from placewise.llm.queries import ALLOW, BLOCK

VECTORS = "vec_id long, embedding array<float>, label int, id int, v string, n string"


def _unit(rows):
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _vectors(seed, singles, groups, spread, dims=16):
    rng = np.random.default_rng(seed)
    rows = [rng.standard_normal((singles, dims))]
    for size in groups:
        rows.append(rng.standard_normal(dims) + spread * rng.standard_normal((size, dims)))
    rows = np.concatenate(rows).astype(np.float32)
    return rows[rng.permutation(len(rows))]


ODD = [
    (10_000, None), (10_001, [0.0] * 16), (10_002, [1.0] * 15 + [float("nan")]), (10_003, [1.0] * 15 + [float("inf")]), (10_004, [1.0] * 15 + [None]),
    (10_005, []), (10_006, [1.0, 2.0]), (None, [1.0] * 16),
]


def _table(spark, rows):
    data = [(int(i), None if v is None else [None if x is None else float(x) for x in v], 0, 1, "x", "y") if i is not None else (None, v, 0, 1, "x", "y") for i, v in rows]
    return spark.createDataFrame(data, VECTORS).repartition(4)


@pytest.mark.parametrize("seed,spread", [(1, 0.01), (2, 0.15), (3, 0.3)])
def test_links_and_components_against_all_pairs(spark, seed, spread):
    rows = _vectors(seed, 150, [120, 40, 7, 2, 2], spread)
    rows = np.concatenate([rows, rows[:9], rows[:3]])
    ids = np.arange(len(rows)) * 3
    got = {r.vec_id: r for r in cover_tree.classes(_table(spark, [*zip(ids, rows), *ODD])).collect()}
    near = _unit(rows.astype(float)) @ _unit(rows.astype(float)).T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(rows))
    while True:
        new = np.array([min(label[k], label[near[k]].min(initial=len(rows))) for k in range(len(rows))])
        if (new == label).all():
            break
        label = new
    for k, i in enumerate(ids.tolist()):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[k].sum(), ids[label[k]], label[k] == k)
    for i, _ in ODD:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, i is not None)


def test_blocks_of_one_hot_cell(spark):
    """Nearly all vectors in one cell: blocks stay small and no link is lost."""
    rows = _vectors(4, 30, [900], 0.02)
    members = spark.createDataFrame([(k, 1, [float(x) for x in v]) for k, v in enumerate(rows)], "id long, n long, v array<double>")
    found = cover_tree.links(members, 16, 0.95, block_rows=256, blocks=10).groupBy("id").agg(F.sum("n_links").alias("n")).collect()
    near = _unit(rows.astype(float)) @ _unit(rows.astype(float)).T >= 0.95
    want = {k: int(near[k].sum()) - 1 for k in range(len(rows)) if near[k].sum() > 1}
    assert {r.id: r.n for r in found} == want
    assert len(cover_tree.links(members, 16, 0.95, block_rows=256, blocks=10).collect()) < 10 * len(rows)


def test_levels_are_nested_nets():
    points = _unit(_vectors(5, 60, [80], 0.1).astype(float))
    path = cover_tree.levels(points)
    for level, radius in enumerate(cover_tree.RADII):
        centres = np.unique(path[:, level])
        assert (path[centres, level] == centres).all()
        assert (np.linalg.norm(points - points[path[:, level]], axis=1) <= radius + 1e-9).all()
        if level:
            assert set(np.unique(path[:, level - 1])) <= set(centres)


@pytest.mark.parametrize("scaled", [False, True])
def test_recall_of_the_permutation_index(spark, scaled):
    rows = _vectors(6, 1500, [100, 30], 0.2)
    if scaled:
        rows = rows * np.random.default_rng(1).uniform(0.3, 3.0, (len(rows), 1)).astype(np.float32)
    ids = np.arange(len(rows))
    found = permutation_index.nearest(_table(spark, [*zip(ids, rows), *ODD]), F.col("vec_id") % 20 == 0, k=10).collect()
    exact = rows.astype(float) @ rows.astype(float).T
    np.fill_diagonal(exact, -np.inf)
    by_query = {}
    for r in found:
        by_query.setdefault(r.query_id, []).append(r)
    assert sorted(by_query) == [i for i in ids.tolist() if i % 20 == 0]
    hits = 0
    for q, own in by_query.items():
        own.sort(key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11))
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        assert all(r.score == pytest.approx(exact[q, r.vec_id], abs=1e-9) for r in own)
        hits += len({r.vec_id for r in own} & set(np.argsort(-exact[q])[:10].tolist()))
    assert hits >= 0.95 * 10 * len(by_query)


def test_permutation_index_of_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0])]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in permutation_index.nearest(_table(spark, rows), F.col("vec_id") % 20 == 0).collect())
    assert got == sorted([(0, 1, 3, 1.0), (0, 2, 20, 0.0), (0, 3, 20, 0.0), *2 * [(20, 1, 3, 1.0), (20, 2, 20, 1.0), (20, 3, 0, 0.0)]])
    assert permutation_index.nearest(_table(spark, ODD[:6]), F.lit(True)).count() == 0
    assert cover_tree.classes(_table(spark, ODD[:1]).filter("false")).count() == 0


PAGES = "page_id long, url string, html string, host int, src string, rank double"


def _pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], PAGES)


def _rule(url):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None
    rest = url[at + 3 :]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fit = []
    for rule in (*ALLOW, *BLOCK):
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail):
            fit.append(rule)
    return host, path, max(fit, key=len, default=None)


def test_rules_against_plain_python(spark):
    urls = [
        "http://a.com/", "http://A.COM", "http://a.com?x=/", "https://www.example.com/en/1", "https://m.example.com/en/?q", "https://example.com/en", "http://x.net/es/5#top",
        "http://net/fr/", "http://xnet/fr/", "http://a.org/net/es/", "no scheme", "://b.com/x", None, "", "http://", "http://h.com:80/p?a://b", "x\ny://q.NET/es/\nz", "http://İ.com/é/", "a://b://c.net/es/",
    ]
    rows = [(k, u, None) for k, u in enumerate(urls)] + [(0, urls[0], ""), (None, urls[0], "x")]
    got = url_trust.judge(_pages(spark, rows), ALLOW, BLOCK).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None:
            host, path, rule = _rule(urls[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, rule)
            if rule:
                assert r.verdict == ("allow" if rule in ALLOW else "block")


def _rank(nodes, links, restart, damping=0.85, rounds=200):
    at = {n: k for k, n in enumerate(nodes)}
    move = np.zeros((len(nodes), len(nodes)))
    for (a, b), n in links.items():
        move[at[b], at[a]] += n
    total = move.sum(axis=0)
    move = move / np.where(total > 0, total, 1)
    start = np.array([restart.get(n, 0.0) for n in nodes])
    rank = start.copy()
    for _ in range(rounds):
        got = move @ rank
        rank = damping * got + (1 - damping * got.sum()) * start
    return dict(zip(nodes, rank))


def test_pagerank_against_numpy(spark):
    rng = random.Random(8)
    nodes = [f"h{k}" for k in range(12)]
    links = {}
    for _ in range(40):
        pair = (rng.choice(nodes[:9]), rng.choice(nodes))
        links[pair] = links.get(pair, 0) + 1
    restart = {"h0": 0.5, "h3": 0.25, "h11": 0.25}
    total = {}
    for (a, _), n in links.items():
        total[a] = total.get(a, 0) + n
    table = spark.createDataFrame([(a, b, n / total[a]) for (a, b), n in links.items()], "src string, dst string, share double")
    frame = spark.createDataFrame([(n, restart.get(n, 0.0)) for n in nodes], "host string, restart double")
    got = {r.host: r["rank"] for r in url_trust.pagerank(frame, table, rounds=80, tolerance=1e-9).collect()}
    want = _rank(nodes, links, restart)
    assert all(got[n] == pytest.approx(want[n], abs=1e-6) for n in nodes)


def test_distrust_flows_against_links(spark):
    to = lambda *hosts: "".join(f'<a HREF = "{h}">x</a>' for h in hosts)
    rows = [(k, f"http://bad.net/es/{k}", to("/local")) for k in range(20)]
    rows += [(100 + k, f"http://farm{k}.org/p", to("http://bad.net/es/1", "//bad.net/q", "mailto:a@b.c", "#here")) for k in range(3)]
    rows += [(200 + k, "http://good.com/p", to("https://friend.org/a")) for k in range(20)] + [(300, "http://friend.org/a", to("http://good.com/"))]
    rows += [(400, "http://lonely.org/a", None)]
    got = {r.page_id: r for r in url_trust.judge(_pages(spark, rows), ALLOW, BLOCK).collect()}
    assert [got[100 + k].verdict for k in range(3)] == ["block"] * 3
    assert got[300].verdict == got[400].verdict == "allow"
    assert got[300].trust > got[300].distrust and got[100].distrust > got[100].trust
    edges = {(r.src, r.dst): r.n for r in url_trust.link_counts(_pages(spark, rows)).collect()}
    assert edges[("farm0.org", "bad.net")] == 2 and edges[("bad.net", "bad.net")] == 20 and ("farm0.org", "") not in edges
    assert math.isclose(got[400].trust, 0.0)


def test_no_python_in_url_plans(spark):
    plan = url_trust.link_counts(_pages(spark, [(1, "http://a.b/", "")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_pages(spark):
    assert url_trust.judge(_pages(spark, []), ALLOW, BLOCK).count() == 0


def test_permutation_index_of_repeated_ids(spark):
    """Every row but the query's own is a candidate, whatever its id; the order of rows does not matter."""
    vectors = [(20, [1.0, 0.0]), (1, [0.9, 0.1]), (1, [5.0, 0.0]), (2, [0.5, 0.5]), (3, [0.0, 1.0]), (20, [2.0, 0.0])]
    want = sorted([(20, 5.0, 1), (20, 2.0, 20), (20, 0.9, 1), (20, 0.5, 2), (20, 0.0, 3), (20, 10.0, 1), (20, 2.0, 20), (20, 1.8, 1), (20, 1.0, 2), (20, 0.0, 3)])
    for rows in (vectors, vectors[::-1]):
        found = permutation_index.nearest(_table(spark, rows), F.col("vec_id") % 20 == 0).collect()
        assert sorted((r.query_id, round(r.score, 6), r.vec_id) for r in found) == want
