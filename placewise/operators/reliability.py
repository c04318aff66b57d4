"""How far a visit can be trusted as evidence of the account's location."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise import config
from placewise.functions import geo


def _null_if_zero(c: Column) -> Column:
    return F.when(c != 0, c)


def accuracy_score(accuracy: Column) -> Column:
    a = _null_if_zero(accuracy)
    return F.when(a.isNull(), 0.4).when(a <= 10, 1.0).when(a <= 30, 0.8).when(a <= 100, 0.5).when(a <= 500, 0.2).otherwise(0.1)


def dwell_score(dwell: Column) -> Column:
    d = _null_if_zero(dwell)
    return F.when(d.isNull(), 0.4).when(d >= 300, 1.0).when(d >= 120, 0.8).when(d >= 30, 0.5).otherwise(0.1)


def outcome_score(outcome: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for kv in config.RELIABILITY_OUTCOME_WEIGHT.items() for x in kv])
    return F.coalesce(F.try_element_at(weights, outcome), F.lit(0.3))


def trajectory_score(efficiency: Column) -> Column:
    e = efficiency
    return F.when(e.isNull(), 0.4).when(e >= 0.9, 1.0).when(e >= 0.7, 0.8).when(e >= 0.5, 0.5).otherwise(0.2)


def known_location_score(d: Column) -> Column:
    return F.when(d <= 50, 1.0).when(d <= 100, 0.8).when(d <= 250, 0.5).when(d <= 500, 0.3).when(d.isNotNull(), 0.1)


def consistency_score(
    visits: DataFrame, history: DataFrame, crs: str, a: str, b: str, key: str = "account_id"
) -> DataFrame:
    """Adds ``consistency``: how close a visit is to the upper median of its account's successes.

    ``history`` holds at most the history limit of rows per account (canonical
    outcomes), so it travels as one bounded array and no visit pairs are formed.
    """
    hit = F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    past = history.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.collect_list(F.when(F.col("outcome").isin(*config.CANONICAL_SUCCESS), hit)).alias("_hits"),
    )
    # Unknown distances sort last. ``sort_array`` compares natively, ``array_sort`` by a lambda for each pair.
    far = F.lit(float("inf"))
    distances = F.sort_array(F.transform("_hits", lambda h: F.coalesce(geo.distance_m(crs, F.col(a), F.col(b), h["a"], h["b"]), far)))
    med = F.get("_d", F.floor(F.size("_d") / 2).cast("int"))
    score = (
        F.when(F.coalesce(F.col("_n"), F.lit(0)) <= 1, 0.5)
        .when(F.size("_d") == 0, 0.3)
        .when(med <= 50, 1.0)
        .when(med <= 100, 0.8)
        .when(med <= 250, 0.5)
        .when(med <= 500, 0.2)
        .otherwise(0.1)
    )
    return visits.join(past, key, "left").withColumn("_d", distances).withColumn("consistency", score).drop("_n", "_hits", "_d")


def score(
    visits: DataFrame,
    trajectories: DataFrame,
    history: DataFrame,
    crs: str,
    a: str = "checkin_x",
    b: str = "checkin_y",
    known: tuple[str, str] | None = None,
    agent_reliability: str | None = None,
) -> DataFrame:
    """Reliability with its parts and flags for every visit.

    ``visits.outcome`` is canonical; ``known`` names two columns with the known
    account location (null where unknown).
    """
    rows = visits.join(trajectories.select("visit_id", "efficiency"), "visit_id", "left")
    rows = consistency_score(rows, history, crs, a, b)
    distance = (
        F.when(F.col(known[0]).isNotNull(), known_location_score(geo.distance_m(crs, a, b, known[0], known[1])))
        if known
        else F.lit(None).cast("double")
    )
    agent = F.col(agent_reliability) if agent_reliability else F.lit(None).cast("double")
    parts = {
        "gps_accuracy": accuracy_score(F.col("gps_accuracy_m")),
        "dwell_time": dwell_score(F.col("dwell_s")),
        "outcome": outcome_score(F.col("outcome")),
        "trajectory": trajectory_score(F.col("efficiency")),
        "agent_reliability": F.coalesce(_null_if_zero(agent), F.lit(0.5)),
        "consistency": F.col("consistency"),
        "distance_consistency": distance,
    }
    rows = rows.withColumns({f"part_{k}": v.cast("double") for k, v in parts.items()})
    weighted, total = F.lit(0.0), F.lit(0.0)
    for name, weight in config.RELIABILITY_WEIGHTS.items():
        part = F.col(f"part_{name}")
        weighted = weighted + F.coalesce(part, F.lit(0.0)) * weight
        total = total + F.when(part.isNotNull(), weight).otherwise(0.0)
    flags = {
        "poor_gps_accuracy": "gps_accuracy",
        "short_dwell_time": "dwell_time",
        "unfavorable_outcome": "outcome",
        "poor_trajectory": "trajectory",
        "far_from_known_location": "distance_consistency",
    }
    flag_list = F.array_compact(F.array(*[F.when(F.col(f"part_{p}") < 0.3, F.lit(name)) for name, p in flags.items()]))
    return rows.withColumn("reliability", F.greatest(F.lit(0.0), F.least(F.lit(1.0), weighted / total))).withColumn(
        "flags", flag_list
    )
