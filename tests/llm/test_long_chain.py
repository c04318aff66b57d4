"""Ranks along a chain of hosts that is longer than a dozen links."""

from placewise.llm import url_trust


def test_rank_reaches_the_end_of_a_long_chain(spark):
    n = 18
    nodes = spark.createDataFrame([(f"h{i}", float(i == 0)) for i in range(n)], "host string, restart double").coalesce(1)
    links = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1.0) for i in range(n - 1)], "src string, dst string, share double").coalesce(1)
    got = {r.host: r.rank for r in url_trust.pagerank(nodes, links).collect()}
    total = sum(0.85**i for i in range(n))
    assert all(abs(got[f"h{i}"] - 0.85**i / total) < 1e-3 for i in range(n))
    assert got[f"h{n - 1}"] > 0
