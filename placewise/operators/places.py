"""Accounts that share a physical place, and how confirmed locations are written back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placewise.functions import geo
from placewise.operators import proximity
from placewise.session import settled


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) with root the smallest node of the component.

    ``nodes``: node; ``edges``: a, b. Alternating star contractions reach stars in
    a number of rounds that grows with the logarithm of the node count; each round
    is checkpointed.
    """
    current = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        nxt = small.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        current = settled(nxt.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        mark = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == (mark.n, mark.s):
            break
        before = (mark.n, mark.s)
    root = current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("_r"))
    return nodes.join(root, "node", "left").select("node", F.coalesce("_r", "node").alias("root"))


def spatial_clusters(points: DataFrame, x: str, y: str, eps: float = 100.0) -> DataFrame:
    """Rows with ``place``: density clusters with two points as the minimum; a lone point has none.

    With that minimum the clusters are the connected components of "within eps".
    Points of one cell of side eps/sqrt(2) are connected, so cells are the nodes.
    Two cells are compared by the boxes of their sub-cells; points are compared
    only for sub-cells whose boxes leave it open.
    """
    side = eps / 2**0.5
    fine = side / 6
    rows = points.withColumns({"_cx": geo.cell(x, side), "_cy": geo.cell(y, side)})
    rows = rows.withColumn("node", F.concat_ws(":", "_cx", "_cy"))
    distinct = settled(rows.select("node", "_cx", "_cy", F.col(x).alias("x"), F.col(y).alias("y")).distinct())
    sub = distinct.withColumns({"_fx": geo.cell("x", fine), "_fy": geo.cell("y", fine)}).groupBy("node", "_cx", "_cy", "_fx", "_fy").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )
    right = sub.select(*[F.col(c).alias(f"o{c}") for c in ("node", "_cx", "_cy", "_fx", "_fy", "x0", "x1", "y0", "y1")])
    pairs = (
        sub.withColumn("_o", F.explode(geo.offsets(2, inner=0)))
        .withColumns({"o_cx": F.col("_cx") + F.col("_o.dx"), "o_cy": F.col("_cy") + F.col("_o.dy")})
        .drop("_o")
        .join(right, ["o_cx", "o_cy"])
        .filter(F.col("node") < F.col("onode"))
    )
    gap = F.hypot(
        F.greatest(F.lit(0.0), F.col("ox0") - F.col("x1"), F.col("x0") - F.col("ox1")),
        F.greatest(F.lit(0.0), F.col("oy0") - F.col("y1"), F.col("y0") - F.col("oy1")),
    )
    far = F.hypot(
        F.greatest(F.col("ox1") - F.col("x0"), F.col("x1") - F.col("ox0")),
        F.greatest(F.col("oy1") - F.col("y0"), F.col("y1") - F.col("oy0")),
    )
    judged = pairs.withColumns({"_gap": gap, "_far": far}).filter(F.col("_gap") <= eps)
    sure = judged.filter(F.col("_far") <= eps).select(F.col("node").alias("a"), F.col("onode").alias("b")).distinct()
    open_pairs = judged.filter(F.col("_far") > eps).select("node", "_fx", "_fy", "onode", "o_fx", "o_fy").join(
        sure.select(F.col("a").alias("node"), F.col("b").alias("onode")), ["node", "onode"], "left_anti"
    )
    located = distinct.select("node", geo.cell("x", fine).alias("_fx"), geo.cell("y", fine).alias("_fy"), "x", "y")
    other = located.select(F.col("node").alias("onode"), F.col("_fx").alias("o_fx"), F.col("_fy").alias("o_fy"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    close = (
        open_pairs.join(located, ["node", "_fx", "_fy"]).join(other, ["onode", "o_fx", "o_fy"])
        .filter(geo.euclidean_m("x", "y", "ox", "oy") <= eps)
        .select(F.col("node").alias("a"), F.col("onode").alias("b")).distinct()
    )
    roots = connected_components(distinct.select("node").distinct(), sure.unionByName(close))
    labelled = rows.join(roots, "node")
    sizes = labelled.groupBy("root").agg(F.count(F.lit(1)).alias("_n"))
    return labelled.join(sizes, "root").withColumn("place", F.when(F.col("_n") >= 2, F.concat(F.lit("s"), F.col("root")))).drop(
        "node", "root", "_n", "_cx", "_cy"
    )


def account_places(clustered: DataFrame) -> DataFrame:
    """The largest place (by all its points) among those an account visits; the smaller label wins a tie."""
    sizes = clustered.filter(F.col("place").isNotNull()).groupBy("place").agg(F.count(F.lit(1)).alias("_n"))
    return (
        clustered.filter(F.col("place").isNotNull()).select("account_id", "place").distinct().join(sizes, "place")
        .groupBy("account_id").agg(F.min_by("place", F.struct((-F.col("_n")).alias("n"), F.col("place"))).alias("place"))
    )


def place_summary(members: DataFrame) -> DataFrame:
    """Per place: mean point, members, distinct landmarks and addresses, visits, confidence.

    ``members``: account_id, place, x, y, landmark, address, visits. The member
    list itself stays a long table: a place may hold very many accounts.
    """
    n, v = F.count(F.lit(1)), F.sum("visits")
    return members.groupBy("place").agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), n.alias("accounts"), F.count_distinct("landmark").alias("landmarks"),
        F.count_distinct("address").alias("address_variants"), v.alias("visits"),
        F.least(F.lit(1.0), n * 0.2 + v * 0.05).alias("confidence"),
    )


def _within(visits: DataFrame, centres: DataFrame, half: float) -> DataFrame:
    """Pairs of ``visits`` (v, at, on, ...) and ``centres`` (c, c_at, c_on, ...) in one box; only the centres are copied to neighbour cells."""
    spread = centres.withColumn("_o", F.explode(geo.offsets(1))).select(
        *centres.columns, (geo.cell("c_at", half) + F.col("_o.dx")).alias("_ca"), (geo.cell("c_on", half) + F.col("_o.dy")).alias("_cb")
    )
    placed = visits.withColumns({"_ca": geo.cell("at", half), "_cb": geo.cell("on", half)})
    near = F.col("c_at").between(F.col("at") - half, F.col("at") + half) & F.col("c_on").between(F.col("on") - half, F.col("on") + half)
    return placed.join(spread, ["_ca", "_cb"]).filter(near).drop("_ca", "_cb")


def founders(visits: DataFrame, half: float) -> DataFrame:
    """Visits (v, t, at, on) that have no earlier founder, in (t, v) order, in their box.

    Two visits of one cell of side ``half`` are in one box, so a cell has one founder at
    most. Each round the first open visit of a cell is its candidate; it founds if no
    earlier open visit stands in its box, and its founder then covers others.
    An open visit meets at most nine candidates.
    """
    spot = F.struct("at", "on")
    open_ = settled(visits.select("v", "t", "at", "on"))
    done = None
    while not open_.isEmpty():
        by_cell = open_.groupBy(geo.cell("at", half).alias("_ca"), geo.cell("on", half).alias("_cb"))
        first = settled(by_cell.agg(F.min_by(F.struct("v", "t", spot.alias("p")), F.struct("t", "v")).alias("_f")).select(
            F.col("_f.v").alias("c"), F.col("_f.t").alias("c_t"), F.col("_f.p.at").alias("c_at"), F.col("_f.p.on").alias("c_on")
        ))
        earlier = _within(open_, first, half).filter(F.struct("t", "v") < F.struct("c_t", "c")).select("c").distinct()
        new = settled(first.join(earlier, "c", "left_anti"))
        covered = _within(open_, new, half).select("v").distinct()
        open_ = settled(open_.join(covered, "v", "left_anti"))
        done = new if done is None else done.unionByName(new)
    none = visits.filter("false").select(F.col("v").alias("c"), F.col("t").alias("c_t"), F.col("at").alias("c_at"), F.col("on").alias("c_on"))
    return none if done is None else done


def assign_clusters(
    visits: DataFrame, clusters: DataFrame, members: DataFrame, lat: str, lon: str, half: float = geo.box_degrees(100)
) -> tuple[DataFrame, DataFrame]:
    """Successful visits join the first cluster (by id) that stands in their 100 m box at their time, else found one: (membership, clusters).

    Visits count in (checkin_ts, visit_id) order, so the result does not depend on how
    they are cut into batches. ``members``: cluster_id, account_id. Returned clusters
    carry visit_count (members) and confidence.
    """
    rows = settled(visits.select(
        F.col("visit_id").alias("v"), F.col("checkin_ts").alias("t"), F.col(lat).cast("double").alias("at"), F.col(lon).cast("double").alias("on"), "account_id"
    ))
    standing = clusters.select(F.col("cluster_id"), F.col("latitude").alias("c_at"), F.col("longitude").alias("c_on"))
    matched = settled(_within(rows, standing, half).groupBy("v").agg(F.min("cluster_id").alias("_old")))
    fresh = settled(founders(rows.join(matched, "v", "left_anti"), half).withColumn("cluster_id", F.concat(F.lit("N"), F.col("c").cast("string"))))
    at_their_time = F.struct("c_t", "c") <= F.struct("t", "v")
    joined = _within(rows, fresh, half).filter(at_their_time).groupBy("v").agg(F.min("cluster_id").alias("_new"))
    placed = rows.join(matched, "v", "left").join(joined, "v", "left").withColumn("cluster_id", F.least("_old", "_new"))
    fresh = fresh.select("cluster_id", F.col("c_at").alias("latitude"), F.col("c_on").alias("longitude"))
    membership = members.select("cluster_id", "account_id").unionByName(placed.select("cluster_id", "account_id")).distinct()
    size = membership.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("visit_count"))
    everywhere = clusters.select("cluster_id", "latitude", "longitude").unionByName(fresh.select("cluster_id", "latitude", "longitude"))
    out = everywhere.join(size, "cluster_id").withColumn("confidence", F.least(F.lit(1.0), 0.5 + F.col("visit_count") * 0.1))
    return membership, out


def merge_locations(events: DataFrame, gate: float = 0.5) -> DataFrame:
    """Canonical, confirmed and predicted location of each account.

    ``events``: account_id, event_id, ts, x, y, confidence, radius_m, source. A confirmed
    visit always wins; predictions count only from a confidence of ``gate`` on and
    only while nothing is confirmed. One bounded aggregate per account.
    """
    usable = events.filter((F.col("source") != "prediction") | (F.col("confidence") >= gate))
    value, when = F.struct("x", "y", "confidence", "radius_m", "source"), F.struct("ts", "event_id")
    confirmed = F.col("source") == "visit_confirmed"
    merged = usable.groupBy("account_id").agg(
        F.max_by(F.when(confirmed, value), F.when(confirmed, when)).alias("confirmed"),
        F.max_by(F.when(~confirmed, value), F.when(~confirmed, when)).alias("predicted"),
    )
    best = F.coalesce("confirmed", "predicted")
    return merged.withColumn("_b", best).select(
        "account_id", F.col("_b.x").alias("x"), F.col("_b.y").alias("y"), F.col("_b.confidence").alias("confidence"),
        F.col("_b.radius_m").alias("radius_m"), F.col("_b.source").alias("location_source"), "confirmed", "predicted",
    )


def propagate_confirmations(confirmations: DataFrame, members: DataFrame, current: DataFrame) -> DataFrame:
    """Location events for the other members of a confirmed visit's cluster.

    ``confirmations``: cluster_id, account_id, visit_id, ts, x, y, reliability, radius_m;
    ``members``: cluster_id, account_id; ``current``: account_id, location_source,
    confidence. Confirmations are taken in (ts, visit_id) order: a member that is itself
    confirmed yields once a confirmation by another account is more reliable than it,
    and from then on takes each later one. So it ends at the latest confirmation by
    another account if any of those exceeds its own reliability. For each cluster the
    latest ones and the highest reliabilities of two accounts answer that for every
    member.
    """
    row = F.struct("account_id", "visit_id", "ts", "x", "y", "reliability", "radius_m")
    by_account = confirmations.groupBy("cluster_id", "account_id").agg(
        F.max_by(row, F.struct("ts", "visit_id")).alias("_last"), F.max("reliability").alias("_top")
    )
    order, top = F.struct("_last.ts", "_last.visit_id"), F.struct("_top", "account_id")
    firsts = by_account.groupBy("cluster_id").agg(F.max_by("_last", order).alias("_l1"), F.max(top).alias("_t1"))
    rest = by_account.join(firsts.select("cluster_id", F.col("_l1.account_id").alias("_al"), F.col("_t1.account_id").alias("_at")), "cluster_id")
    seconds = rest.groupBy("cluster_id").agg(
        F.max_by(F.when(F.col("account_id") != F.col("_al"), F.col("_last")), F.when(F.col("account_id") != F.col("_al"), order)).alias("_l2"),
        F.max(F.when(F.col("account_id") != F.col("_at"), F.col("_top"))).alias("_t2"),
    )
    rows = firsts.join(seconds, "cluster_id").join(members, "cluster_id").join(
        current.select("account_id", "location_source", F.col("confidence").alias("_have")), "account_id", "left"
    )
    rows = rows.withColumn("_c", F.when(F.col("_l1.account_id") != F.col("account_id"), F.col("_l1")).otherwise(F.col("_l2"))).withColumn(
        "_best", F.when(F.col("_t1.account_id") != F.col("account_id"), F.col("_t1._top")).otherwise(F.col("_t2"))
    )
    stays = (F.col("location_source") == "visit_confirmed") & (F.coalesce(F.col("_have"), F.lit(0.0)) >= F.col("_best"))
    return rows.filter(F.col("_c").isNotNull() & ~F.coalesce(stays, F.lit(False))).select(
        "account_id", "cluster_id", F.col("_c.visit_id").alias("event_id"), F.col("_c.ts").alias("ts"), F.col("_c.x").alias("x"), F.col("_c.y").alias("y"),
        F.col("_c.reliability").alias("confidence"), F.col("_c.radius_m").alias("radius_m"), F.lit("cluster_confirmed").alias("source"),
    )


