"""Per-visit figures from GPS points, one row per point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placewise.functions import geo

_CHUNK = 4096


def collect_trajectories(points: DataFrame, columns: tuple[str, ...] = ("x", "y", "offset_s")) -> DataFrame:
    """One row per visit with its points as an array in ``seq`` order."""
    item = F.struct("seq", *columns)
    return points.groupBy("visit_id").agg(F.array_sort(F.collect_list(item)).alias("trajectory"))


def steps(points: DataFrame, crs: str, a: str = "x", b: str = "y", t: str = "offset_s") -> DataFrame:
    """Consecutive point pairs: dist_m, dt_s.

    A visit is cut into chunks of its sequence numbers, so a runaway recording
    is not sorted by one task; each chunk starts from the last point before it.
    """
    here = F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(t).alias("t"))
    rows = points.select("visit_id", "seq", here.alias("p")).withColumn("_chunk", F.floor(F.col("seq") / _CHUNK))
    tails = rows.groupBy("visit_id", "_chunk").agg(F.max_by("p", "seq").alias("_tail"))
    before = tails.select(
        "visit_id", "_chunk", F.lag("_tail").over(W.partitionBy("visit_id").orderBy("_chunk")).alias("_before")
    )
    prev = F.lag("p").over(W.partitionBy("visit_id", "_chunk").orderBy("seq"))
    linked = rows.withColumn("_prev", prev).join(before, ["visit_id", "_chunk"]).withColumn("_q", F.coalesce("_prev", "_before"))
    return linked.filter(F.col("_q").isNotNull()).select(
        "visit_id",
        "seq",
        geo.distance_m(crs, "_q.a", "_q.b", "p.a", "p.b").alias("dist_m"),
        (F.col("p.t") - F.col("_q.t")).cast("double").alias("dt_s"),
    )


def summarise(
    points: DataFrame, crs: str, a: str = "x", b: str = "y", t: str = "offset_s", jump_m: float = 500.0, jump_s: float = 60.0
) -> DataFrame:
    """Length, straight line, efficiency, speeds, stationary time and GPS jumps of every visit with two or more points."""
    moving = F.col("dt_s") > 0
    speed = F.when(moving, F.col("dist_m") / F.col("dt_s"))
    per_step = steps(points, crs, a, b, t).withColumn("_v", speed).groupBy("visit_id").agg(
        F.sum("dist_m").alias("length_m"),
        F.coalesce(F.avg("_v"), F.lit(0.0)).alias("mean_speed_ms"),
        F.coalesce(F.max("_v"), F.lit(0.0)).alias("max_speed_ms"),
        F.coalesce(F.stddev_samp("_v"), F.lit(0.0)).alias("stdev_speed_ms"),
        F.coalesce(F.sum(F.when(F.col("_v") < 0.5, F.col("dt_s"))), F.lit(0.0)).alias("stationary_s"),
        F.count_if(moving & (F.col("dist_m") > jump_m) & (F.col("dt_s") < jump_s)).alias("gps_jumps"),
    )
    p = F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(t).alias("t"))
    ends = points.groupBy("visit_id").agg(
        F.count(F.lit(1)).alias("n_points"), F.min_by(p, "seq").alias("_first"), F.max_by(p, "seq").alias("_last")
    )
    straight = geo.distance_m(crs, "_first.a", "_first.b", "_last.a", "_last.b")
    return ends.filter(F.col("n_points") >= 2).join(per_step, "visit_id").select(
        "visit_id", "n_points", "length_m",
        straight.alias("straight_m"),
        F.when(straight > 0, straight / F.col("length_m")).alias("efficiency"),
        "mean_speed_ms", "max_speed_ms", "stdev_speed_ms", "stationary_s", "gps_jumps",
        (F.col("_last.t") - F.col("_first.t")).cast("double").alias("span_s"),
        F.col("_first.a").alias("start_a"), F.col("_first.b").alias("start_b"),
        F.col("_last.a").alias("end_a"), F.col("_last.b").alias("end_b"),
    )
