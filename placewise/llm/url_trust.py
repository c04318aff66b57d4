"""URL verdicts by rules and, where no rule fits, by trust and distrust over the links of hosts.

Rules are (host, path prefix): they fit the host, its subdomains, and paths that start
with the prefix; the longest one decides. Pages that allow rules fit are the trusted
seeds, pages that block rules fit the blocked seeds; a host's share in the restart is
its number of such pages. Trust is personalised PageRank along the links, distrust the
same against them. Both are taken relative to the host's share of all pages. A host is
blocked when its distrust reaches ``threshold`` and exceeds its trust.

Links are counted per pair of hosts before any shuffle of them, so a hot host is one row
for each neighbour. Scores live in tables of hosts; ranks are cut off by checkpoints.
A null url, or one without ``://``, has an empty host and path and no rule. Null html
has no links. Equal pages count once each. Hosts without links or seeds are allowed.
Other columns are ignored. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.llm.shared import settled

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"""(?i)\bhref\s*=\s*["']([^"'#][^"']*)["']"""


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark or number sign, A-Z lowered; empty without it."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark or number sign."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_parts(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def fits(rule: str, host: Column, path: Column) -> Column:
    rule_host, prefix = rule_parts(rule)
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)


def longest_rule(rules: Sequence[str], host: Column, path: Column) -> Column:
    """The longest of ``rules`` that fits; of equally long ones the first in order. Null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r), r))
    return F.coalesce(*[F.when(fits(r, host, path), F.lit(r)) for r in ordered], F.lit(None).cast("string"))


def link_counts(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between hosts. A link without a host stays on its page's host."""
    rows = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_HREF), F.lit(1))).alias("link"))
    target = (
        F.when(F.col("link").contains("://"), host_of(F.col("link")))
        .when(F.col("link").startswith("//"), host_of(F.concat(F.lit("x:"), F.col("link"))))
        .when(F.col("link").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(""))
        .otherwise(F.col("src"))
    )
    return rows.select("src", target.alias("dst")).filter("src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def pagerank(nodes: DataFrame, links: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-4) -> DataFrame:
    """host, rank from ``nodes`` (host, restart; restarts sum to one) and ``links`` (src, dst, share of src).

    What reaches hosts without links returns to the restart. Stops when the ranks
    move less than ``tolerance`` in sum (or after ``rounds``, if given); each round shrinks the move by ``damping`` at
    least, so about 60 rounds are the most at the defaults.
    """
    ranks = settled(nodes.select("host", "restart", F.col("restart").alias("rank")))
    for _ in count() if rounds is None else range(rounds):
        sent = links.join(ranks.select(F.col("host").alias("src"), "rank"), "src")
        got = sent.groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        moved = settled(ranks.join(got, "host", "left").withColumn("got", F.coalesce("got", F.lit(0.0))))
        kept = moved.agg(F.sum("got")).first()[0] or 0.0
        rank = F.lit(damping) * F.col("got") + F.lit(1 - damping * kept) * F.col("restart")
        moved = moved.withColumn("next", rank)
        change = moved.agg(F.sum(F.abs(F.col("next") - F.col("rank")))).first()[0] or 0.0
        ranks = moved.select("host", "restart", F.col("next").alias("rank"))
        if change < tolerance:
            break
    return ranks.select("host", "rank")


def _shares(links: DataFrame, src: str, dst: str) -> DataFrame:
    total = links.groupBy(src).agg(F.sum("n").alias("_total"))
    return settled(links.join(total, src).select(F.col(src).alias("src"), F.col(dst).alias("dst"), (F.col("n") / F.col("_total")).alias("share")))


def judge(pages: DataFrame, allow: Sequence[str], block: Sequence[str], threshold: float = 2.0) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of each row of ``pages`` (page_id, url, html)."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", longest_rule([*allow, *block], F.col("host"), F.col("path")))
    allowed = reduce(lambda a, b: a | b, [F.col("rule") == r for r in allow], F.lit(False))
    blocked = reduce(lambda a, b: a | b, [F.col("rule") == r for r in block], F.lit(False))
    links = settled(link_counts(pages))
    seeds = parsed.filter("host <> ''").groupBy("host").agg(
        F.count_if(allowed).alias("good"), F.count_if(blocked).alias("bad"), F.count(F.lit(1)).alias("pages")
    )
    ends = links.select(F.col("src").alias("host")).union(links.select("dst")).distinct()
    hosts = settled(seeds.join(ends, "host", "full").select("host", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "bad", "pages")]))
    sums = hosts.agg(*[F.sum(c).alias(c) for c in ("good", "bad", "pages")]).first()
    restart = lambda c: (F.col(c) / F.lit(float(max(sums[c] or 0, 1)))).alias("restart")
    trust = pagerank(hosts.select("host", restart("good")), _shares(links, "src", "dst"))
    distrust = pagerank(hosts.select("host", restart("bad")), _shares(links, "dst", "src"))
    scale = F.lit(float(max(sums.pages or 0, 1))) / F.greatest("pages", F.lit(1))
    scored = settled(
        trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host").join(hosts.select("host", "pages"), "host")
        .select("host", (F.col("trust") * scale).alias("trust"), (F.col("distrust") * scale).alias("distrust"))
    )
    by_host = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    verdict = F.when(allowed, "allow").when(blocked, "block").when(F.coalesce(by_host, F.lit(False)), "block").otherwise("allow")
    return parsed.join(scored, "host", "left").select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )
