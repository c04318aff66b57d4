"""Fuse address text and visits into one point with radius and confidence (projected metres)."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placewise import config
from placewise.functions import geo, ranks
from placewise.operators import calibration, proximity, street_model
from placewise.session import ensure_checkpoint_dir

RULES = config.FusionRules()
COARSE = ("locality", "base_locality", "base_pincode")
# An address with more distinct check-in points than this is clustered by distributed rounds.
TASK_POINTS = 1000


@dataclass
class FusionParams:
    """Measured error of every source and the calibration of the result."""

    n_confirmed_addresses: int = 0
    sigma: dict[str, float] = field(default_factory=dict)
    radius_scale: float = 2.0
    text_tail: float = 0.1
    calibration_sigma: list[float] = field(default_factory=lambda: [50.0, 400.0])
    calibration_p: list[float] = field(default_factory=lambda: [0.9, 0.2])
    visit_reliability: dict[str, float] = field(default_factory=dict)
    visit_sigma: float = 30.0


# ------------------------------------------------------------------ confirmed points
def confirmed_labels(visits: DataFrame) -> DataFrame:
    """address_id, label_x, label_y: median check-in of successes, else of visits told the borrower moved next door."""
    tier = F.when(F.col("outcome").isin(*config.RAW_SUCCESS), 0).when(F.col("outcome") == "neighbour_says_shifted", 1)
    rows = visits.withColumn("_tier", tier).filter(F.col("_tier").isNotNull())
    best = rows.groupBy("address_id").agg(F.min("_tier").alias("_tier"))
    return ranks.multi_rank_stats(
        rows.join(best, ["address_id", "_tier"]), ["address_id"],
        {"checkin_x": {"label_x": ranks.linear(0.5)}, "checkin_y": {"label_y": ranks.linear(0.5)}},
    )


def usable_points(labels: DataFrame, parsed: DataFrame, localities: DataFrame, towns: DataFrame) -> DataFrame:
    """Labels of parsed addresses at most 1500 m from their parsed locality's centre."""
    places = localities.select("locality_id", "centroid_x", "centroid_y")
    near = geo.euclidean_m("label_x", "label_y", "centroid_x", "centroid_y") <= RULES.label_cut_m
    return (
        parsed.join(labels, "address_id")
        .join(towns.select("town_id", F.col("address_style").alias("style")), "town_id")
        .join(places, "locality_id")
        .filter(near)
        .withColumns({"dx": F.col("label_x") - F.col("centroid_x"), "dy": F.col("label_y") - F.col("centroid_y")})
    )


# ------------------------------------------------------------------ text evidence
def street_neighbours(points: DataFrame, parsed: DataFrame) -> DataFrame:
    """address_id, source, x, y: median label of other accounts' confirmed addresses on the same street.

    The medians leave the own account out by rank arithmetic: the k-th of the
    others sits at rank k plus the account's own points before it, so one lookup
    per account replaces pairing all addresses of a street.
    """
    street = ["locality_id", "s1", "s2"]
    known = points.filter(F.col("s1").isNotNull() & F.col("s2").isNotNull()).select(*street, "account_id", "address_id", "label_x", "label_y")
    asked = parsed.filter(F.col("locality_id").isNotNull() & F.col("s1").isNotNull() & F.col("s2").isNotNull()).select(
        *street, "account_id", "address_id"
    )
    sizes = known.groupBy(*street).agg(F.count(F.lit(1)).alias("_n"))
    owned = known.groupBy(*street, "account_id").agg(F.count(F.lit(1)).alias("_c"))
    owners = asked.join(sizes, street).join(owned, [*street, "account_id"], "left").withColumn("_c", F.coalesce("_c", F.lit(0)))
    owners = owners.withColumn("_m", F.col("_n") - F.col("_c")).filter(F.col("_m") >= 1)
    # Without own points on the street the question is the same for every asker.
    owners = owners.withColumn("_who", F.when(F.col("_c") > 0, F.col("account_id")))
    questions = owners.select(*street, "_who", "_m").distinct()
    picks = questions.withColumn(
        "_k", F.explode(F.array_distinct(F.array(F.floor((F.col("_m") - 1) / 2), F.floor(F.col("_m") / 2))))
    )
    result = None
    for axis in ("label_x", "label_y"):
        ranked = ranks.row_ranks(known, street, axis, "address_id")
        own = ranked.select(*street, F.col("account_id").alias("_who"), "row_rank").withColumn(
            "_before", F.col("row_rank") - (F.row_number().over(W.partitionBy(*street, "_who").orderBy("row_rank")) - 1)
        )
        shift = (
            picks.filter(F.col("_who").isNotNull())
            .join(own.select(*street, "_who", "_before"), [*street, "_who"])
            .groupBy(*street, "_who", "_k")
            .agg(F.count_if(F.col("_before") <= F.col("_k")).alias("_shift"))
        )
        joined = picks.join(
            shift.select(*[F.col(c).alias(f"_s_{c}") for c in (*street, "_who", "_k")], "_shift"),
            reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in (*street, "_who", "_k")]),
            "left",
        ).select(*street, "_who", (F.col("_k") + F.coalesce("_shift", F.lit(0))).alias("row_rank"))
        values = joined.join(ranked.select(*street, "row_rank", axis), [*street, "row_rank"])
        med = values.groupBy(*street, "_who").agg(F.avg(axis).alias(axis))
        result = med if result is None else _null_safe_join(result, med, [*street, "_who"])
    answer = _null_safe_join(owners, result, [*street, "_who"])
    return answer.select(
        "address_id", F.when(F.col("_m") >= 2, "st_exact_2").otherwise("st_exact_1").alias("source"),
        F.col("label_x").alias("x"), F.col("label_y").alias("y"),
    )


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, on).drop(*[f"_r_{k}" for k in keys])


def base_components(parsed: DataFrame, baseline: DataFrame, localities: DataFrame, pois: DataFrame) -> DataFrame:
    """Geocode, locality-centre and named-landmark components: address_id, source, x, y."""
    places = localities.select("locality_id", "centroid_x", "centroid_y")
    rows = parsed.join(places, "locality_id", "left").join(baseline, "address_id", "left")
    out = rows.filter(F.col("geocoder_x").isNotNull()).select(
        "address_id", F.concat(F.lit("base_"), F.col("precision")).alias("source"), F.col("geocoder_x").alias("x"), F.col("geocoder_y").alias("y")
    )
    out = out.unionByName(
        rows.filter(F.col("centroid_x").isNotNull()).select("address_id", F.lit("locality").alias("source"), F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"))
    )
    # Anchor: locality centre, else a geocode good enough to tell landmarks apart.
    fallback = F.col("precision").isin("street", "rooftop", "locality")
    anchored = rows.filter(F.col("landmark_type").isNotNull()).withColumns(
        {
            "anchor_x": F.coalesce("centroid_x", F.when(fallback, F.col("geocoder_x"))),
            "anchor_y": F.coalesce("centroid_y", F.when(fallback, F.col("geocoder_y"))),
        }
    ).filter(F.col("anchor_x").isNotNull())
    on = ["town_id", "landmark_type"]
    nearest = proximity.nearest_within(anchored, pois, on, ("anchor_x", "anchor_y"), ("x", "y"), "poi_id", RULES.poi_radius_m)
    named = anchored.join(nearest, [*on, "anchor_x", "anchor_y"]).select(
        "address_id", F.concat(F.lit("poi_"), F.col("relation")).alias("source"), F.col("poi_x").alias("x"), F.col("poi_y").alias("y")
    )
    return out.unionByName(named)


def text_components(
    parsed: DataFrame, points: DataFrame, baseline: DataFrame, localities: DataFrame, pois: DataFrame
) -> DataFrame:
    """All text components of every address; the own account's confirmed points are never used."""
    places = localities.select("locality_id", "centroid_x", "centroid_y")
    modelled = (
        street_model.street_predictions(
            points.select("locality_id", "style", "account_id", "s1", "s2", "landmark_type", "dx", "dy"),
            parsed.select("address_id", "account_id", "locality_id", "s1", "s2", "landmark_type"),
        )
        .join(parsed.select("address_id", "locality_id"), "address_id")
        .join(places, "locality_id")
        .select("address_id", "source", (F.col("centroid_x") + F.col("dx")).alias("x"), (F.col("centroid_y") + F.col("dy")).alias("y"))
    )
    return base_components(parsed, baseline, localities, pois).unionByName(modelled).unionByName(street_neighbours(points, parsed))


def _source_order() -> Column:
    s = F.col("source")
    return F.when(s.startswith("base_"), 0).when(s == "locality", 1).when(s.startswith("poi_"), 2).when(s.startswith("reg_"), 3).otherwise(4)


def fuse(components: DataFrame, sigma: DataFrame) -> DataFrame:
    """address_id, text_x, text_y, text_sigma, sources: inverse-variance mean of the best of each family.

    ``sigma``: source, sigma. Sources built from the same information count once.
    """
    s = F.col("source")
    family = F.when(s.isin(*COARSE), "coarse").when(s.startswith("st_") | s.startswith("reg_"), "street").otherwise(s)
    usable = components.join(sigma, "source").withColumn("_family", family)
    best = usable.groupBy("address_id", "_family").agg(
        F.min_by(F.struct("x", "y", "sigma", "source"), F.struct("sigma", _source_order())).alias("_b")
    )
    w = 1 / (F.col("_b.sigma") * F.col("_b.sigma"))
    return best.groupBy("address_id").agg(
        (F.sum(w * F.col("_b.x")) / F.sum(w)).alias("text_x"),
        (F.sum(w * F.col("_b.y")) / F.sum(w)).alias("text_y"),
        (1 / F.sqrt(F.sum(w))).alias("text_sigma"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("_b.sigma", "_b.source"))), lambda b: b["source"]
        ).alias("sources"),
    )


# ------------------------------------------------------------------ fitting
def source_sigma(components: DataFrame, labels: DataFrame) -> DataFrame:
    """source, sigma, n: median held-out error over 1.1774 for sources with eight or more observations."""
    errors = components.join(labels, "address_id").withColumn("_e", geo.euclidean_m("x", "y", "label_x", "label_y"))
    stats = ranks.rank_stats(errors, ["source"], "_e", {"_m": ranks.linear(0.5)}, count_as="n")
    return stats.filter(F.col("n") >= RULES.min_sigma_observations).select(
        "source", (F.col("_m") / RULES.rayleigh_median).alias("sigma"), "n"
    )


def held_out_visit_distances(visits: DataFrame) -> DataFrame:
    """visit_id, outcome, distance_m: from each visit to the median of the address's other successes.

    Leaving one value out moves a median by at most one place, so three order
    statistics per address answer every visit.
    """
    hits = visits.filter(F.col("outcome").isin(*config.RAW_SUCCESS))

    def place(offset: int):
        # 0-based rank of the lower middle after one value is gone, plus an offset.
        return lambda n: F.least(n - 1, F.greatest(F.lit(0), F.floor((n - 2) / 2) + offset)).cast("double")

    stats = {}
    for axis, column in (("x", "checkin_x"), ("y", "checkin_y")):
        stats[column] = {f"_{axis}m": ranks.linear(0.5), **{f"_{axis}{i}": place(i) for i in range(3)}}
    middle = ranks.multi_rank_stats(hits, ["address_id"], stats)
    sizes = hits.groupBy("address_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = visits.join(middle, "address_id").join(sizes, "address_id")
    success = F.col("outcome").isin(*config.RAW_SUCCESS)

    def without(axis: str, column: str) -> Column:
        v = F.col(column)

        def nth(i: int) -> Column:
            return F.when(v > F.col(f"_{axis}{i}"), F.col(f"_{axis}{i}")).otherwise(F.col(f"_{axis}{i + 1}"))

        return F.when((F.col("_n") - 1) % 2 == 1, nth(0)).otherwise((nth(0) + nth(1)) / 2)

    cx = F.when(success, without("x", "checkin_x")).otherwise(F.col("_xm"))
    cy = F.when(success, without("y", "checkin_y")).otherwise(F.col("_ym"))
    return rows.filter(~success | (F.col("_n") >= 2)).select(
        "visit_id", "address_id", "outcome", geo.euclidean_m("checkin_x", "checkin_y", cx, cy).alias("distance_m")
    )


def outcome_reliability(distances: DataFrame) -> DataFrame:
    """outcome, n, reliability: share of check-ins within 300 m, or the prior below 20 observations."""
    prior = F.create_map(*[F.lit(v) for kv in RULES.prior_reliability.items() for v in kv])
    seen = distances.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("distance_m") <= 300).cast("double")).alias("_share"))
    rate = F.when(F.col("n") >= 20, F.round(F.least(F.lit(0.97), F.col("_share")), 3)).otherwise(F.try_element_at(prior, F.col("outcome")))
    return seen.withColumn("reliability", rate).drop("_share")


def visit_sigma(distances: DataFrame) -> DataFrame:
    inliers = distances.filter(F.col("outcome").isin(*config.RAW_SUCCESS) & (F.col("distance_m") <= 300))
    return ranks.rank_stats(inliers, [], "distance_m", {"_m": ranks.linear(0.5)}).select(
        (F.col("_m") / (RULES.rayleigh_median * math.sqrt(2))).alias("visit_sigma")
    )


def fit(labels: DataFrame, components: DataFrame, visits: DataFrame) -> FusionParams:
    """Measure every source by leave-one-account-out errors and calibrate radius and confidence.

    Only the small parameter tables reach the driver.
    """
    params = FusionParams(n_confirmed_addresses=labels.count())
    sigma = source_sigma(components, labels)
    small = sigma.select("source", "sigma").collect()
    spark = labels.sparkSession
    table = spark.createDataFrame([(r.source, r.sigma) for r in small], "source string, sigma double")
    fused = fuse(components.join(labels.select("address_id"), "address_id", "left_semi"), table).join(labels, "address_id")
    fused = fused.withColumn("error_m", geo.euclidean_m("text_x", "text_y", "label_x", "label_y")).select("text_sigma", "error_m").persist()
    scaled = fused.withColumn("_r", F.col("error_m") / F.col("text_sigma"))
    tail = fused.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("error_m") > 4 * F.col("text_sigma")).cast("double")).alias("t")).first()
    if tail.n:
        params.radius_scale = round(ranks.rank_stats(scaled, [], "_r", {"q": ranks.linear(RULES.coverage)}).first().q, 3)
        params.text_tail = round(tail.t, 3)
    if tail.n >= 30:
        model = calibration.fit_isotonic(fused, "text_sigma", F.col("error_m") <= RULES.accuracy_m, increasing=False)
        xs, ys = calibration.knots(model)
        params.calibration_sigma, params.calibration_p = xs, [min(0.98, max(0.02, y)) for y in ys]
    fused.unpersist()
    params.sigma = {r.source: round(r.sigma, 1) for r in small}
    distances = held_out_visit_distances(visits)
    reliability = dict(RULES.prior_reliability)
    reliability.update({r.outcome: r.reliability for r in outcome_reliability(distances).collect() if r.reliability is not None})
    params.visit_reliability = {k: v for k, v in reliability.items() if v >= 0.5}
    spread = visit_sigma(distances).first()
    params.visit_sigma = round(spread.visit_sigma, 1) if spread else 30.0
    return params


def save_params(spark: SparkSession, params: FusionParams, path: str) -> None:
    row = asdict(params)
    schema = (
        "n_confirmed_addresses long, sigma map<string,double>, radius_scale double, text_tail double, calibration_sigma array<double>, "
        "calibration_p array<double>, visit_reliability map<string,double>, visit_sigma double"
    )
    spark.createDataFrame([tuple(row.values())], schema).write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str, n_confirmed: int) -> FusionParams | None:
    """Saved parameters, or None when they describe another set of confirmed addresses."""
    row = spark.read.parquet(path).first()
    if row is None or row.n_confirmed_addresses != n_confirmed:
        return None
    return FusionParams(**{k: (dict(v) if isinstance(v, dict) else list(v) if isinstance(v, list) else v) for k, v in row.asDict().items()})


# ------------------------------------------------------------------ visit clusters
def reliable_points(visits: DataFrame, reliability: dict[str, float]) -> DataFrame:
    """Distinct check-in points per address with their reliability ``p``, count and first visit."""
    known = F.create_map(*[F.lit(v) for kv in reliability.items() for v in kv])
    p = F.try_element_at(known, F.col("outcome"))
    return (
        visits.withColumn("p", p)
        .filter(F.col("p").isNotNull())
        .groupBy("address_id", F.col("checkin_x").alias("x"), F.col("checkin_y").alias("y"), "p")
        .agg(F.count(F.lit(1)).alias("cnt"), F.min("visit_id").alias("first_visit"))
    )


def greedy_clusters(x: np.ndarray, y: np.ndarray, weight: np.ndarray, link: float) -> np.ndarray:
    """Cluster number per point: repeatedly the best supported point takes everything within ``link``."""
    near = np.hypot(x[:, None] - x[None, :], y[:, None] - y[None, :]) <= link
    number = np.full(len(x), -1)
    step = 0
    while (number < 0).any():
        alive = number < 0
        support = np.round((near & alive[None, :]) @ (weight * alive), 9)
        seed = int(np.argmax(np.where(alive, support, -1.0)))
        number[near[seed] & alive] = step
        step += 1
    return number


def _cluster_arrays(link: float):
    @F.pandas_udf("array<int>")
    def clusters(x: pd.Series, y: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([greedy_clusters(np.asarray(a, float), np.asarray(b, float), np.asarray(c, float), link) for a, b, c in zip(x, y, w)])

    return clusters


def _log_odds() -> Column:
    return F.log(F.col("p") / (1 - F.col("p"))) * F.col("cnt")


def visit_clusters(points: DataFrame, link: float = RULES.cluster_link_m, task_points: int = TASK_POINTS) -> DataFrame:
    """Points with ``cluster``. Addresses with few distinct points are clustered in one task each, others by rounds."""
    sizes = points.groupBy("address_id").agg(F.count(F.lit(1)).alias("_n"))
    sized = points.join(sizes, "address_id")
    listed = (
        sized.filter(F.col("_n") <= task_points)
        .groupBy("address_id")
        .agg(F.array_sort(F.collect_list(F.struct("first_visit", "x", "y", "p", "cnt", _log_odds().alias("w")))).alias("v"))
    )
    numbered = listed.withColumn("c", _cluster_arrays(link)(F.col("v.x"), F.col("v.y"), F.col("v.w")))
    small = numbered.select("address_id", F.explode(F.arrays_zip("v", "c")).alias("z")).select(
        "address_id", "z.v.x", "z.v.y", "z.v.p", "z.v.cnt", "z.v.first_visit", F.col("z.c").cast("long").alias("cluster")
    )
    crowded = sizes.filter(F.col("_n") > task_points)
    if crowded.isEmpty():
        return small
    large = points.join(crowded.select("address_id"), "address_id", "left_semi")
    return small.unionByName(clusters_by_rounds(large, link))


def clusters_by_rounds(points: DataFrame, link: float) -> DataFrame:
    """The same greedy clusters for addresses with very many points.

    Points sit in cells of link/6. A cell wholly inside the link distance of
    another counts by its sum; only cells at the rim are compared point by point.
    A point that beats every point within twice the link distance is a seed no
    matter in which order seeds are taken, so each round picks all such points
    at once. Rounds end when no point is left; each is checkpointed.
    """
    ensure_checkpoint_dir(points.sparkSession)
    side = link / 6.0
    cell = ["address_id", "cx", "cy"]
    alive = points.withColumns({"cx": geo.cell("x", side), "cy": geo.cell("y", side), "w": _log_odds()}).checkpoint()
    done = None
    base = 0
    while not alive.isEmpty():
        boxes = alive.groupBy(*cell).agg(
            F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.sum("w").alias("cw")
        )
        other = boxes.select("address_id", *[F.col(c).alias(f"o_{c}") for c in ("cx", "cy", "x0", "x1", "y0", "y1", "cw")])

        def spread(reach: int) -> DataFrame:
            return boxes.withColumn("_o", F.explode(geo.offsets(reach))).withColumns(
                {"o_cx": F.col("cx") + F.col("_o.dx"), "o_cy": F.col("cy") + F.col("_o.dy")}
            ).drop("_o").join(other, ["address_id", "o_cx", "o_cy"])

        gap_x = F.greatest(F.lit(0.0), F.col("o_x0") - F.col("x1"), F.col("x0") - F.col("o_x1"))
        gap_y = F.greatest(F.lit(0.0), F.col("o_y0") - F.col("y1"), F.col("y0") - F.col("o_y1"))
        far_x = F.greatest(F.col("o_x1") - F.col("x0"), F.col("x1") - F.col("o_x0"))
        far_y = F.greatest(F.col("o_y1") - F.col("y0"), F.col("y1") - F.col("o_y0"))
        near_pairs = spread(8).withColumns({"gap": F.hypot(gap_x, gap_y), "far": F.hypot(far_x, far_y)}).filter(F.col("gap") <= link)
        inside = near_pairs.filter(F.col("far") <= link).groupBy(*cell).agg(F.sum("o_cw").alias("sure"))
        rim = near_pairs.filter(F.col("far") > link).select(*cell, "o_cx", "o_cy")
        q = alive.select("address_id", F.col("cx").alias("o_cx"), F.col("cy").alias("o_cy"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("w").alias("qw"))
        partial = (
            alive.join(rim, cell).join(q, ["address_id", "o_cx", "o_cy"])
            .filter(geo.euclidean_m("x", "y", "qx", "qy") <= link)
            .groupBy("address_id", "x", "y", "p").agg(F.sum("qw").alias("rim_w"))
        )
        scored = alive.join(inside, cell, "left").join(partial, ["address_id", "x", "y", "p"], "left").withColumn(
            "support", F.round(F.coalesce("sure", F.lit(0.0)) + F.coalesce("rim_w", F.lit(0.0)), 9)
        ).drop("sure", "rim_w")
        order = F.struct(F.col("support").alias("s"), (-F.col("first_visit")).alias("v"), (-F.col("x")).alias("nx"), (-F.col("y")).alias("ny"))
        best = scored.groupBy(*cell).agg(F.max(order).alias("best"), F.max_by(F.struct("x", "y"), order).alias("at"))
        # Conservative: compare with the best of every cell that may reach within twice the link.
        rival = best.select("address_id", F.col("cx").alias("o_cx"), F.col("cy").alias("o_cy"), F.col("best").alias("o_best"))
        reach = spread(14).withColumn("gap", F.hypot(gap_x, gap_y)).filter(F.col("gap") <= 2 * link).select(*cell, "o_cx", "o_cy")
        beaten = (
            reach.filter((F.col("cx") != F.col("o_cx")) | (F.col("cy") != F.col("o_cy")))
            .join(best.select(*cell, "best"), cell).join(rival, ["address_id", "o_cx", "o_cy"])
            .filter(F.col("o_best") > F.col("best")).select(*cell).distinct()
        )
        seeds = best.join(beaten, cell, "left_anti").select(
            "address_id", F.col("at.x").alias("sx"), F.col("at.y").alias("sy"), "cx", "cy", F.col("best.s").alias("s"), F.col("best.v").alias("v")
        )
        # Seeds of one round are numbered by support; the number only has to be unique per address.
        seeds = seeds.withColumn("cluster", F.lit(base) + F.row_number().over(W.partitionBy("address_id").orderBy(F.col("s").desc(), F.col("v").desc(), "sx", "sy")))
        catch = seeds.withColumn("_o", F.explode(geo.offsets(7))).select(
            "address_id", (F.col("cx") + F.col("_o.dx")).alias("cx"), (F.col("cy") + F.col("_o.dy")).alias("cy"), "sx", "sy", "cluster"
        )
        marked = alive.join(catch, cell, "left").withColumn(
            "_hit", F.when(geo.euclidean_m("x", "y", "sx", "sy") <= link, F.col("cluster"))
        ).groupBy("address_id", "x", "y", "p").agg(
            F.first("cnt").alias("cnt"), F.first("first_visit").alias("first_visit"), F.first("cx").alias("cx"), F.first("cy").alias("cy"),
            F.first("w").alias("w"), F.max("_hit").alias("cluster"),
        ).checkpoint()
        taken = marked.filter(F.col("cluster").isNotNull()).select("address_id", "x", "y", "p", "cnt", "first_visit", F.col("cluster").cast("long").alias("cluster"))
        done = taken if done is None else done.unionByName(taken)
        base += 1_000_000
        alive = marked.filter(F.col("cluster").isNull()).drop("cluster")
    return done


# ------------------------------------------------------------------ prediction
def hypotheses(clustered: DataFrame, text: DataFrame, addresses: DataFrame, towns: DataFrame, params: FusionParams) -> DataFrame:
    """One row per address and explanation (each visit cluster, and the text): centre, own radius, posterior."""
    keys = ["address_id", "cluster"]
    spread = params.visit_sigma * math.sqrt(2)
    tail = min(0.5, max(0.02, params.text_tail))
    gaussian = math.sqrt(-2 * math.log(1 - RULES.coverage))
    n, p = F.col("cnt"), F.col("p")
    town = addresses.select("address_id", "town_id").join(towns.select("town_id", "approx_radius_m"), "town_id", "left")
    radius = F.coalesce(F.col("approx_radius_m"), F.lit(4000.0))
    facts = town.join(text, "address_id", "left").select(
        "address_id", "text_x", "text_y", "text_sigma", (-F.log(F.lit(math.pi) * radius * radius)).alias("lu")
    )
    # A visit counts as often as it was repeated at its point.
    repeated = clustered.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("cnt").cast("int"))))
    centre = ranks.multi_rank_stats(repeated, keys, {"x": {"mx": ranks.linear(0.5)}, "y": {"my": ranks.linear(0.5)}})
    means = clustered.groupBy(*keys).agg(
        F.sum(n).alias("members"), (F.sum(n * p * F.col("x")) / F.sum(n * p)).alias("wx"), (F.sum(n * p * F.col("y")) / F.sum(n * p)).alias("wy"),
        F.min("first_visit").alias("first_visit"),
    )
    centres = means.join(centre, keys).withColumns(
        {"hx": F.when(F.col("members") >= 3, F.col("mx")).otherwise(F.col("wx")), "hy": F.when(F.col("members") >= 3, F.col("my")).otherwise(F.col("wy"))}
    )
    r = geo.euclidean_m("x", "y", "hx", "hy")
    gain = n * (F.log(p / (1 - p)) - math.log(2 * math.pi * spread * spread) - r * r / (2 * spread * spread))
    evidence = clustered.join(centres.select(*keys, "hx", "hy"), keys).groupBy(*keys).agg(
        F.sum(gain).alias("gain"), F.max(r).alias("reach")
    )
    outliers = clustered.groupBy("address_id").agg(F.sum(n).alias("points"), F.sum(n * F.log(1 - p)).alias("log_out"))
    rows = centres.join(evidence, keys).join(outliers, "address_id").join(facts, "address_id")
    s = F.col("text_sigma")

    def text_term(distance: Column) -> Column:
        density = (1 - tail) * F.exp(-distance * distance / (2 * s * s)) / (2 * math.pi * s * s)
        return F.when(s.isNull(), 0.0).otherwise(F.log(density + tail * F.exp(F.col("lu"))))

    everything_out = F.col("log_out") + F.col("points") * F.col("lu")
    by_cluster = rows.select(
        "address_id", "hx", "hy", "members", "points", "reach", "text_x", "text_y", "text_sigma",
        F.greatest(F.lit(15.0), params.visit_sigma / F.sqrt(F.col("members").cast("double"))).alias("sigma_m"),
        (everything_out + F.col("gain") - F.col("members") * F.col("lu") + text_term(geo.euclidean_m("hx", "hy", "text_x", "text_y"))).alias("score"),
        F.lit("field_visits").alias("method"), F.col("cluster").alias("ord"),
    ).withColumn("own_radius", F.col("sigma_m") * gaussian)
    by_text = facts.filter(s.isNotNull()).join(outliers, "address_id", "left").fillna(0.0, ["log_out"]).fillna(0, ["points"]).select(
        "address_id", F.col("text_x").alias("hx"), F.col("text_y").alias("hy"), F.lit(0).cast("long").alias("members"), "points",
        F.lit(None).cast("double").alias("reach"), "text_x", "text_y", "text_sigma", s.alias("sigma_m"),
        (everything_out + text_term(F.lit(0.0))).alias("score"), F.lit("address_text").alias("method"),
        F.lit(9_000_000_000_000).alias("ord"), (s * params.radius_scale).alias("own_radius"),
    )
    all_rows = by_cluster.unionByName(by_text)
    per = W.partitionBy("address_id")
    weight = F.exp(F.col("score") - F.max("score").over(per))
    return all_rows.withColumn("_w", weight).withColumn("posterior", F.col("_w") / F.sum("_w").over(per)).drop("_w")


def decide(rows: DataFrame, params: FusionParams, coverage: float = RULES.coverage) -> DataFrame:
    """The most probable explanation per address with an 80 % radius over the alternatives."""
    order = W.partitionBy("address_id").orderBy(F.col("score").desc(), "ord")
    ranked = rows.withColumn("_rn", F.row_number().over(order))
    before = F.sum("posterior").over(order.rowsBetween(W.unboundedPreceding, -1))
    first = F.first(F.struct("hx", "hy")).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    ranked = ranked.withColumns({"_before": F.coalesce(before, F.lit(0.0)), "_top": first})
    needed = F.when(F.col("_before") < coverage, geo.euclidean_m("hx", "hy", "_top.hx", "_top.hy") + F.col("own_radius"))
    radius = ranked.groupBy("address_id").agg(F.max(needed).alias("radius_m"))
    best = ranked.filter(F.col("_rn") == 1).join(radius, "address_id")
    limit = RULES.accuracy_m
    within = F.when(
        F.col("method") == "field_visits", 1 - F.exp(-(limit * limit) / (2 * F.col("sigma_m") * F.col("sigma_m")))
    ).otherwise(calibration.interpolate(F.col("sigma_m"), params.calibration_sigma, params.calibration_p))
    return best.select(
        "address_id", F.col("hx").alias("x"), F.col("hy").alias("y"), "sigma_m",
        F.least(F.lit(0.98), F.col("posterior") * within).alias("confidence"), "radius_m", "method",
        F.col("members").alias("visits_used"), (F.col("points") - F.col("members")).alias("visits_rejected"),
        "reach", "text_x", "text_y", "text_sigma",
    )


def predict(
    parsed: DataFrame, components: DataFrame, visits: DataFrame | None, towns: DataFrame, params: FusionParams
) -> DataFrame:
    """Point, radius, confidence and method of every address that has any evidence.

    ``visits`` None withholds all check-ins (the cold-start case).
    """
    spark = parsed.sparkSession
    sigma = spark.createDataFrame([(k, float(v)) for k, v in params.sigma.items()], "source string, sigma double")
    text = fuse(components, sigma)
    if visits is None:
        points = spark.createDataFrame([], "address_id long, x double, y double, p double, cnt long, first_visit long, cluster long")
        points = points.withColumn("address_id", F.col("address_id").cast(parsed.schema["address_id"].dataType))
    else:
        known = visits.join(parsed.select("address_id"), "address_id", "left_semi")
        points = visit_clusters(reliable_points(known, params.visit_reliability))
    out = decide(hypotheses(points, text.drop("sources"), parsed, towns, params), params)
    return out.join(text.select("address_id", "sources"), "address_id", "left").join(
        parsed.select("address_id", "locality_id", "landmark_type"), "address_id"
    )


# Sentences of the required output.
_DESCRIPTIONS = {
    "base_rooftop": "Commercial geocoder (rooftop precision)",
    "base_street": "Commercial geocoder (street precision)",
    "base_locality": "Commercial geocoder (locality precision)",
    "base_pincode": "Commercial geocoder (pincode precision only)",
    "locality": "Locality centre",
    "poi_near": "Landmark named in the address",
    "poi_behind": "Landmark named in the address (behind)",
    "poi_opposite": "Landmark named in the address (opposite)",
    "st_exact_1": "A confirmed address on the same street",
    "st_exact_2": "Confirmed addresses on the same street",
}


def with_evidence(predicted: DataFrame, points: DataFrame, localities: DataFrame) -> DataFrame:
    """Adds ``evidence``: the reasons in plain words."""
    counts = points.groupBy("locality_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = predicted.join(localities.select("locality_id", "locality_name"), "locality_id", "left").join(counts, "locality_id", "left")
    text_of = F.create_map(*[F.lit(v) for kv in _DESCRIPTIONS.items() for v in kv])

    def plural(c: Column) -> Column:
        return F.when(c > 1, "s").otherwise("")

    def whole(c: Column) -> Column:
        return F.bround(c, 0).cast("long").cast("string")

    def describe(key: Column) -> Column:
        what = F.when(key.startswith("reg_lm"), "landmark pattern").otherwise("street layout")
        learned = F.concat_ws(
            " ", F.coalesce(F.col("locality_name"), F.lit("the locality")), what, F.lit("learned from"),
            F.coalesce(F.col("_n"), F.lit(0)).cast("string"), F.lit("confirmed addresses"),
        )
        return F.when(key.startswith("reg_"), learned).otherwise(F.coalesce(F.try_element_at(text_of, key), key))

    used, rejected = F.col("visits_used"), F.col("visits_rejected")
    gap = geo.euclidean_m("x", "y", "text_x", "text_y")
    by_visits = F.array_compact(
        F.array(
            F.when(used > 1, F.concat(used.cast("string"), F.lit(" on-premises visits within "), whole(F.col("reach")), F.lit(" m of their centre"))).otherwise("1 on-premises visit"),
            F.when(F.col("text_sigma").isNotNull(), F.when(gap > 3 * F.col("text_sigma"), F.concat(F.lit("Address text points "), whole(gap), F.lit(" m away"))).otherwise("Consistent with the address text")),
            F.when(rejected > 0, F.concat(rejected.cast("string"), F.lit(" other check-in"), plural(rejected), F.lit(" elsewhere ignored"))),
        )
    )
    ignored = F.when(rejected > 0, F.array(F.concat(rejected.cast("string"), F.lit(" check-in"), plural(rejected), F.lit(" far from the address ignored")))).otherwise(
        F.array().cast("array<string>")
    )
    by_text = F.concat(F.transform("sources", describe), ignored)
    return rows.withColumn("evidence", F.when(F.col("method") == "field_visits", by_visits).otherwise(by_text)).drop("_n", "locality_name")
