"""Spatial and temporal joins written as equi-joins on cells and buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placewise.functions import geo


def box_neighbours(
    points: DataFrame, id_col: str, a: str, b: str, half: float, k: int, others: DataFrame | None = None,
    other_id: str | None = None,
) -> DataFrame:
    """For each point the ``k`` smallest-id others inside its axis-aligned box of half-side ``half``.

    Returns (id_col, neighbour, rank). With ``others`` None the neighbours come
    from ``points`` itself and the point is never its own neighbour.

    Cells have side half/4, so for every point of a cell the 7x7 block around it
    lies inside the box and the ring at distance 4 is the only part to test.
    A cell is represented by its k+1 smallest ids. When the inner block already
    holds k+1 ids, ring points with a larger id cannot be among the answers and
    are not joined, so dense places cost a few rows per cell, not all pairs.
    """
    side = half / 4.0
    self_join = others is None
    targets = points.select(F.col(id_col), F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")).filter(
        F.col("_a").isNotNull() & F.col("_b").isNotNull()
    ).withColumns({"_ca": geo.cell("_a", side), "_cb": geo.cell("_b", side)})
    source = points if self_join else others
    sid = id_col if self_join else other_id
    pool = source.select(F.col(sid).alias("_nid"), F.col(a).cast("double").alias("_na"), F.col(b).cast("double").alias("_nb")).filter(
        F.col("_na").isNotNull() & F.col("_nb").isNotNull()
    ).withColumns({"_pa": geo.cell("_na", side), "_pb": geo.cell("_nb", side)})
    keep = k + 1

    occupied = targets.select("_ca", "_cb").distinct()
    head = pool.withColumn(
        "_r", F.row_number().over(W.partitionBy("_pa", "_pb").orderBy("_nid"))
    ).filter(F.col("_r") <= keep)
    inner_rows = (
        head.withColumn("_o", F.explode(geo.offsets(3)))
        .select((F.col("_pa") + F.col("_o.dx")).alias("_ca"), (F.col("_pb") + F.col("_o.dy")).alias("_cb"), "_nid")
        .join(occupied, ["_ca", "_cb"], "left_semi")
        .withColumn("_r", F.row_number().over(W.partitionBy("_ca", "_cb").orderBy("_nid")))
        .filter(F.col("_r") <= keep)
    )
    inner = inner_rows.groupBy("_ca", "_cb").agg(
        F.array_sort(F.collect_list("_nid")).alias("_ids"),
        F.when(F.count(F.lit(1)) >= keep, F.max("_nid")).alias("_limit"),
    )
    cells = occupied.join(inner, ["_ca", "_cb"], "left")

    from_inner = targets.join(inner, ["_ca", "_cb"]).select(id_col, F.explode("_ids").alias("_nid"))
    ring = (
        cells.select("_ca", "_cb", "_limit", F.explode(geo.offsets(4, inner=3)).alias("_o"))
        .select(
            "_ca", "_cb", "_limit", (F.col("_ca") + F.col("_o.dx")).alias("_pa"), (F.col("_cb") + F.col("_o.dy")).alias("_pb")
        )
        .join(pool, ["_pa", "_pb"])
        .filter(F.col("_limit").isNull() | (F.col("_nid") <= F.col("_limit")))
    )
    from_ring = (
        targets.join(ring.select("_ca", "_cb", "_nid", "_na", "_nb"), ["_ca", "_cb"])
        .filter(geo.in_box("_na", "_nb", "_a", "_b", half))
        .select(id_col, "_nid")
    )
    pairs = from_inner.unionByName(from_ring)
    if self_join:
        pairs = pairs.filter(F.col("_nid") != F.col(id_col))
    order = W.partitionBy(id_col).orderBy("_nid")
    return (
        pairs.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(id_col, F.col("_nid").alias("neighbour"), "rank")
    )


def box_join(
    left: DataFrame, right: DataFrame, left_at: tuple[str, str], right_at: tuple[str, str], half: float
) -> DataFrame:
    """All (left, right) rows whose right point is in the left point's box: cell equi-join, then the exact test."""
    la, lb = left_at
    ra, rb = right_at
    lhs = left.withColumns({"_ca": geo.cell(la, half), "_cb": geo.cell(lb, half)})
    rhs = (
        right.withColumn("_o", F.explode(geo.offsets(1)))
        .withColumns({"_ca": geo.cell(ra, half) + F.col("_o.dx"), "_cb": geo.cell(rb, half) + F.col("_o.dy")})
        .drop("_o")
    )
    return lhs.join(rhs, ["_ca", "_cb"]).filter(geo.in_box(ra, rb, la, lb, half)).drop("_ca", "_cb")


def asof_forward(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_ts: str,
    right_ts: str,
    right_id: str,
    carry: Sequence[str],
) -> DataFrame:
    """Each left row with the first right row of its key at or after its time (inner).

    Rows are grouped by (key, day), so a key with very many rows is spread over
    its days. A left row with no match left in its day takes the head of the
    key's next day that has one. Nothing is paired: one sort per (key, day).
    """
    day = "_day"
    payload = F.struct(F.col(right_ts).alias("_ts"), F.col(right_id).alias("_id"), *[F.col(c) for c in carry])
    r = right.select(F.col(key), F.to_date(right_ts).alias(day), payload.alias("_hit"))
    l = left.withColumn(day, F.to_date(left_ts))
    heads = r.groupBy(key, day).agg(F.min_by("_hit", F.struct("_hit._ts", "_hit._id")).alias("_head"))
    days = l.select(key, day).distinct().join(heads, [key, day], "full_outer")
    later = W.partitionBy(key).orderBy(F.col(day).desc()).rowsBetween(W.unboundedPreceding, -1)
    next_head = days.select(key, day, F.last("_head", ignorenulls=True).over(later).alias("_next"))

    left_cols = [F.col(c) for c in left.columns]
    tagged = l.select(
        key, day, F.col(left_ts).alias("_t"), F.lit(1).alias("_kind"), F.struct(*left_cols).alias("_left"),
        F.lit(None).cast(r.schema["_hit"].dataType).alias("_hit"),
    ).unionByName(
        r.select(
            key, day, F.col("_hit._ts").alias("_t"), F.lit(0).alias("_kind"),
            F.lit(None).cast(l.select(F.struct(*left_cols).alias("s")).schema["s"].dataType).alias("_left"), "_hit",
        )
    )
    backwards = (
        W.partitionBy(key, day)
        .orderBy(F.col("_t").desc(), F.col("_kind").asc(), F.col("_hit._id").desc())
        .rowsBetween(W.unboundedPreceding, 0)
    )
    same_day = tagged.withColumn("_same", F.last("_hit", ignorenulls=True).over(backwards)).filter(F.col("_kind") == 1)
    joined = same_day.select(key, day, "_left", "_same").join(next_head, [key, day], "left")
    hit = F.coalesce("_same", "_next")
    return (
        joined.withColumn("_h", hit)
        .filter(F.col("_h").isNotNull())
        .select("_left.*", F.col("_h._ts").alias(right_ts), F.col("_h._id").alias(right_id), *[F.col(f"_h.{c}").alias(c) for c in carry])
    )


def nearest_within(
    anchors: DataFrame, pois: DataFrame, on: Sequence[str], anchor: tuple[str, str], poi: tuple[str, str], poi_id: str,
    radius: float,
) -> DataFrame:
    """Nearest poi per distinct (on, anchor) not farther than ``radius`` (projected metres).

    Anchors are collapsed first: thousands of addresses share a locality centre. The distinct
    anchors, not the pois, take the cells around them, and the merge join keeps both tables off
    the driver: Spark's guess at a table's size knows nothing of cells.
    """
    ax, ay = anchor
    px, py = poi
    a = (
        anchors.select(*on, ax, ay)
        .distinct()
        .withColumn("_o", F.explode(geo.offsets(1)))
        .withColumns({"_ca": geo.cell(ax, radius) + F.col("_o.dx"), "_cb": geo.cell(ay, radius) + F.col("_o.dy")})
        .drop("_o")
    )
    p = pois.select(*on, px, py, poi_id).withColumns({"_ca": geo.cell(px, radius), "_cb": geo.cell(py, radius)}).hint("merge")
    dist = geo.euclidean_m(ax, ay, px, py)
    return (
        a.join(p, [*on, "_ca", "_cb"])
        .withColumn("_d", dist)
        .filter(F.col("_d") <= radius)
        .groupBy(*on, ax, ay)
        .agg(F.min(F.struct(F.col("_d").alias("d"), F.col(poi_id).alias("id"), F.col(px).alias("x"), F.col(py).alias("y"))).alias("_best"))
        .select(*on, ax, ay, F.col("_best.id").alias(poi_id), F.col("_best.x").alias("poi_x"), F.col("_best.y").alias("poi_y"),
                F.col("_best.d").alias("poi_distance_m"))
    )


def close_history_count(
    visits: DataFrame, history: DataFrame, key: str, x: str, y: str, id_col: str, radius: float
) -> DataFrame:
    """For each visit, how many other visits of the key's bounded history lie within ``radius``.

    ``history`` holds at most the history limit of rows per key, so it travels as
    one array per key and no pair rows are produced.
    """
    arrays = history.groupBy(key).agg(F.collect_list(F.struct(F.col(id_col).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"))).alias("_h"))
    near = F.filter(
        "_h", lambda h: (h["id"] != F.col(id_col)) & (geo.euclidean_m(F.col(x), F.col(y), h["x"], h["y"]) <= radius)
    )
    return visits.join(arrays, key).withColumn("n_close", F.size(near).cast("long")).drop("_h")
