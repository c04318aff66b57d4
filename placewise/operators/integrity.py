"""Signs that a visit was not made where or how it claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.config import INTEGRITY_PENALTY
from placewise.functions import geo
from placewise.session import settled

SAME_COORDINATES = 3
SPEED_KMH = 80.0
MIN_DURATION_S = 10
SIMILAR, IDENTICAL = 0.95, 0.99
_ENDS = ("start_a", "start_b", "end_a", "end_b")
# Start plus end distance in metres, and the similarity that no pair farther apart exceeds: 1 - reach / 400.
_REACHES_M = {12.0: 0.97, 20.0: SIMILAR}


def coordinate_frequency(visits: DataFrame, a: str, b: str) -> DataFrame:
    """Visits and accounts per six-decimal coordinate, with the count relative to the busiest one."""
    counts = visits.groupBy(geo.coordinate_key(a, b).alias("coordinate")).agg(
        F.count(F.lit(1)).alias("coordinate_visits"), F.count_distinct("account_id").alias("coordinate_accounts")
    )
    busiest = counts.agg(F.max("coordinate_visits").alias("m")).scalar()
    return counts.withColumn("coordinate_rank", F.col("coordinate_visits") / busiest)


def meeting_points(visits: DataFrame, a: str, b: str, ts: str = "checkin_ts", at_least: int = 3) -> DataFrame:
    """Each agent's most used coordinate when used at least three times; the earliest used wins a tie."""
    per_point = visits.groupBy("agent_id", geo.coordinate_key(a, b).alias("coordinate")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(ts, "visit_id")).alias("_first")
    )
    best = per_point.groupBy("agent_id").agg(
        F.min_by(F.struct("coordinate", "n"), F.struct((-F.col("n")).alias("neg"), F.col("_first"))).alias("_m")
    )
    xy = F.split("_m.coordinate", ",")
    return best.filter(F.col("_m.n") >= at_least).select(
        "agent_id", xy[0].cast("double").alias("meet_a"), xy[1].cast("double").alias("meet_b"), F.col("_m.n").alias("meet_visits")
    )


def similar_trajectories(visits: DataFrame, trajectories: DataFrame, crs: str = "projected_xy") -> DataFrame:
    """Per visit: how many of the agent's other visits have the same track, and the best near match.

    Two tracks above a similarity differ by a bounded start plus end distance, so tracks meet in
    cells of twice that reach. Identical ones and matches within the shortest reach come first;
    only tracks without a near match there search the next reach, so a dense place ends its
    search early and never pairs everything with everything. Equal tracks are collapsed to one
    row with a count before the joins.
    """
    if crs != "projected_xy":
        raise ValueError("trajectory blocks need projected metres")
    tracks = settled(visits.select("visit_id", "agent_id").join(trajectories.select("visit_id", *_ENDS, "n_points"), "visit_id"))
    shape = ["agent_id", *_ENDS, "n_points"]
    distinct = settled(tracks.groupBy(*shape).agg(F.count(F.lit(1)).alias("copies")))
    others = distinct.select("agent_id", *[F.col(c).alias(f"o_{c}") for c in (*_ENDS, "n_points", "copies")])
    gap = geo.euclidean_m("start_a", "start_b", "o_start_a", "o_start_b") + geo.euclidean_m("end_a", "end_b", "o_end_a", "o_end_b")
    length_gap = F.abs(F.col("n_points") - F.col("o_n_points")) / F.greatest("n_points", "o_n_points")
    similarity = (2.0 - F.least(F.lit(1.0), gap / 200) - length_gap) / 2
    same = F.lit(True)
    for c in (*_ENDS, "n_points"):
        same = same & (F.col(c) == F.col(f"o_{c}"))
    found, open_ = [], distinct
    for reach, least in _REACHES_M.items():
        found.append(settled(
            _same_agent_pairs(open_, others, reach)
            .withColumn("_sim", similarity)
            .filter(F.col("_sim") > least)
            .groupBy(*shape)
            .agg(
                F.sum(F.when(F.col("_sim") > IDENTICAL, F.col("o_copies") - F.when(same, 1).otherwise(0))).alias("identical"),
                F.max(F.when(F.col("_sim") <= IDENTICAL, F.col("_sim"))).alias("best_similarity"),
            )
        ))
        open_ = open_.join(found[-1].filter("best_similarity IS NOT NULL"), shape, "left_anti")
    # A later reach sees the identical ones again and knows no other number of them.
    best = reduce(DataFrame.unionByName, found).groupBy(*shape).agg(
        F.max("identical").alias("identical"), F.max("best_similarity").alias("best_similarity")
    )
    return tracks.join(best, shape, "left").select(
        "visit_id", F.coalesce("identical", F.lit(0)).alias("identical_trajectories"),
        F.coalesce("best_similarity", F.lit(0.0)).alias("trajectory_similarity"),
    )


def _same_agent_pairs(left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
    """Pairs of an agent's tracks no coordinate of which differs by more than ``reach``, among others; each pair once.

    Each side is copied to the neighbour cells of two of the four coordinates.
    """
    side, margin = 2 * reach + 1, reach + 0.001
    for i, c in enumerate(_ENDS):
        far = lambda x: F.explode(F.array_distinct(F.array(geo.cell(F.col(x) - margin, side), geo.cell(F.col(x) + margin, side))))
        own = lambda x: geo.cell(x, side)
        left = left.withColumn(f"_k{i}", (far if i % 2 else own)(c))
        right = right.withColumn(f"_k{i}", (own if i % 2 else far)(f"o_{c}"))
    cell = ["agent_id", *[f"_k{i}" for i in range(len(_ENDS))]]
    # One number leads the sort of the join: rows of different cells rarely tie on it.
    left, right = (df.withColumn("_cell", F.xxhash64(*cell)) for df in (left, right))
    return left.join(right, ["_cell", *cell])


def detect(
    visits: DataFrame,
    trajectories: DataFrame,
    crs: str = "projected_xy",
    a: str = "checkin_x",
    b: str = "checkin_y",
    agent_homes: DataFrame | None = None,
    ts: str = "checkin_ts",
) -> DataFrame:
    """Integrity score, level and ordered risk factors of every visit.

    ``agent_homes``: agent_id, home_a, home_b.
    """
    rows = visits.withColumn("coordinate", geo.coordinate_key(a, b))
    rows = rows.join(coordinate_frequency(visits, a, b), "coordinate", "left")
    rows = rows.join(meeting_points(visits, a, b, ts), "agent_id", "left")
    if agent_homes is None:
        rows = rows.withColumns({"home_a": F.lit(None).cast("double"), "home_b": F.lit(None).cast("double")})
    else:
        rows = rows.join(agent_homes.select("agent_id", "home_a", "home_b"), "agent_id", "left")
    short = visits.groupBy("agent_id").agg(
        F.count_if((F.col("dwell_s") != 0) & (F.col("dwell_s") < MIN_DURATION_S)).alias("agent_short_visits")
    )
    rows = rows.join(short, "agent_id", "left")
    rows = rows.join(trajectories.select("visit_id", "span_s", "max_speed_ms", "gps_jumps"), "visit_id", "left")
    rows = rows.join(similar_trajectories(visits, trajectories, crs), "visit_id", "left")

    rows = rows.withColumns(
        {
            "home_distance_m": geo.distance_m(crs, a, b, "home_a", "home_b"),
            "meeting_distance_m": geo.distance_m(crs, a, b, "meet_a", "meet_b"),
            "duration_s": F.coalesce(F.when(F.col("dwell_s") != 0, F.col("dwell_s").cast("double")), F.col("span_s")),
            "max_speed_kmh": F.coalesce(F.col("max_speed_ms") * 3.6, F.lit(0.0)),
            "gps_jumps": F.coalesce("gps_jumps", F.lit(0)),
            "identical_trajectories": F.coalesce("identical_trajectories", F.lit(0)),
            "trajectory_similarity": F.coalesce("trajectory_similarity", F.lit(0.0)),
        }
    )
    n, v, acc = F.col("coordinate_visits"), F.col("max_speed_kmh"), F.col("gps_accuracy_m")
    hour = F.hour(ts)
    rounded_speed = F.bround(v, 0).cast("long").cast("string")
    findings = [
        ("repeated_coordinates", n >= SAME_COORDINATES, F.concat(F.lit("repeated_coordinates_"), n, F.lit("_accounts"))),
        ("shared_coordinates", (n > 1) & (n < SAME_COORDINATES), F.concat(F.lit("shared_coordinates_"), n, F.lit("_accounts"))),
        ("near_agent_home", F.col("home_distance_m") < 100, F.lit("near_agent_home")),
        ("common_meeting_point", F.col("meeting_distance_m") < 50, F.lit("common_meeting_point")),
        ("extremely_short_visit", F.col("duration_s") < MIN_DURATION_S, F.lit("extremely_short_visit")),
        ("impossible_speed", v > SPEED_KMH, F.concat(F.lit("impossible_speed_"), rounded_speed, F.lit("kmh"))),
        ("gps_jumps", F.col("gps_jumps") > 0, F.concat(F.lit("gps_jumps_"), F.col("gps_jumps"))),
        ("identical_trajectories", F.col("identical_trajectories") > 0,
         F.concat(F.lit("identical_trajectories_"), F.col("identical_trajectories"))),
        ("highly_similar_trajectory", (F.col("identical_trajectories") <= 0) & (F.col("trajectory_similarity") > SIMILAR),
         # 0.955, 0.965, 0.975 and 0.985 are stored just below the tie, so they print downwards.
         F.format_string("highly_similar_trajectory_%.2f", F.col("trajectory_similarity") - 1e-12)),
        ("poor_gps_accuracy", acc > 500, F.lit("poor_gps_accuracy")),
        ("pattern_short_visits", F.col("agent_short_visits") >= 3, F.lit("pattern_short_visits")),
        ("unusual_timing", (hour < 6) | (hour > 22), F.lit("unusual_timing")),
    ]
    score = F.lit(1.0)
    labels = []
    for name, condition, label in findings:
        score = score - F.when(condition, INTEGRITY_PENALTY[name]).otherwise(0.0)
        labels.append(F.when(condition, label))
    rank = F.coalesce(F.col("coordinate_rank"), F.lit(0.0))
    score = score - F.when(rank > 0.5, rank * 0.1).otherwise(0.0)
    score = score - F.when(v > SPEED_KMH, F.least(F.lit(0.3), (v - SPEED_KMH) / 200)).otherwise(0.0)
    score = score - F.when(acc > 100, F.least(F.lit(0.2), (acc - 100) / 1000)).otherwise(0.0)
    out = rows.withColumn("risk_factors", F.array_compact(F.array(*labels)))
    out = out.withColumn("integrity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    # Rounded so that a sum of decimal penalties meets its decimal threshold.
    s = F.round("integrity", 9)
    level = F.when(s >= 0.7, "LOW").when(s >= 0.4, "MEDIUM").when(s >= 0.2, "HIGH").otherwise("CRITICAL")
    return out.withColumn("risk_level", level)
