"""Baseline predictors, leakage-safe splits and ablation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions import ranks
from placewise.operators import matching, metrics
from placewise.operators.lookup import is_success
from placewise.session import settled

CUTOFF_QUANTILE = 0.70


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def geocoder_baseline(frame: DataFrame, radius_m: float = 500.0) -> DataFrame:
    """The external geocoder's point as a prediction."""
    return frame.select(
        "address_id", F.col("geocoder_x").alias("pred_x"), F.col("geocoder_y").alias("pred_y"), F.lit(radius_m).alias("radius_m")
    )


def latest_success_baseline(visits: DataFrame, radius_m: float = 200.0) -> DataFrame:
    """The newest successful check-in of each address: one bounded aggregate per key."""
    hit = F.struct(F.col("checkin_x").alias("x"), F.col("checkin_y").alias("y"))
    return (
        visits.filter(is_success())
        .groupBy("address_id")
        .agg(F.max_by(hit, F.struct("checkin_ts", "visit_id")).alias("_p"))
        .select("address_id", F.col("_p.x").alias("pred_x"), F.col("_p.y").alias("pred_y"), F.lit(radius_m).alias("radius_m"))
    )


def _centroid(rows: DataFrame, weight: Column) -> DataFrame:
    w, x, y = F.col("_w"), F.col("checkin_x"), F.col("checkin_y")
    sums = rows.withColumn("_w", weight).groupBy("address_id").agg(
        F.sum(w).alias("_sw"), F.sum(w * x).alias("_sx"), F.sum(w * y).alias("_sy"), F.sum(w * (x * x + y * y)).alias("_sq")
    )
    px, py = F.col("_sx") / F.col("_sw"), F.col("_sy") / F.col("_sw")
    return sums.filter(F.col("_sw") > 0).select(
        "address_id", px.alias("pred_x"), py.alias("pred_y"), (F.col("_sq") / F.col("_sw") - px * px - py * py).alias("_var")
    )


def weighted_centroid_baseline(visits: DataFrame, max_agent_share: float | None = None) -> DataFrame:
    """Centroid of successful check-ins weighted by dwell and accuracy; radius is their weighted spread.

    ``max_agent_share`` caps how much of an address's weight one agent may carry.
    """
    accuracy = F.greatest(F.coalesce(F.col("gps_accuracy_m"), F.lit(100.0)), F.lit(1.0))
    dwell = F.greatest(F.least(F.coalesce(F.col("dwell_s"), F.lit(0)), F.lit(600)), F.lit(1))
    weight = (1 / accuracy) * dwell / 300
    rows = visits.filter(is_success())
    if max_agent_share is not None:
        rows = rows.withColumn("_w0", weight)
        by_agent = rows.groupBy("address_id", "agent_id").agg(F.sum("_w0").alias("_aw"))
        totals = by_agent.groupBy("address_id").agg(F.sum("_aw").alias("_tw"))
        factor = F.least(F.lit(1.0), F.lit(max_agent_share) * F.col("_tw") / F.col("_aw"))
        scale = by_agent.join(totals, "address_id").select("address_id", "agent_id", factor.alias("_f"))
        rows = rows.join(scale, ["address_id", "agent_id"])
        weight = F.col("_w0") * F.col("_f")
    out = _centroid(rows, weight)
    radius = F.greatest(F.lit(50.0), F.sqrt(F.greatest(F.col("_var"), F.lit(0.0))))
    return out.select("address_id", "pred_x", "pred_y", radius.alias("radius_m"))


def operational_centroid_baseline(visits: DataFrame, radius_m: float = 250.0) -> DataFrame:
    """The service's variant: a missing or zero accuracy or dwell leaves that factor out."""
    accuracy = F.when(F.coalesce(F.col("gps_accuracy_m"), F.lit(0.0)) == 0, 1.0).otherwise(
        1 / F.greatest(F.lit(1.0), F.col("gps_accuracy_m"))
    )
    dwell = F.when(F.coalesce(F.col("dwell_s"), F.lit(0)) == 0, 1.0).otherwise(F.least(F.lit(2.0), F.col("dwell_s") / 300))
    out = _centroid(visits.filter(is_success()), accuracy * dwell)
    return out.select("address_id", "pred_x", "pred_y", F.lit(radius_m).alias("radius_m"))


def hybrid_predictor(frame: DataFrame, visits: DataFrame) -> DataFrame:
    """Weighted centroid where any visit succeeded, else the geocoder's point."""
    centroid = weighted_centroid_baseline(visits).select(
        "address_id", F.col("pred_x").alias("_cx"), F.col("pred_y").alias("_cy"), F.col("radius_m").alias("_cr")
    )
    joined = geocoder_baseline(frame).join(centroid, "address_id", "left")
    has_visits = F.col("_cx").isNotNull()
    return joined.select(
        "address_id",
        F.coalesce("_cx", "pred_x").alias("pred_x"),
        F.coalesce("_cy", "pred_y").alias("pred_y"),
        F.coalesce("_cr", "radius_m").alias("radius_m"),
        F.when(has_visits, "weighted_centroid").otherwise("geocoder").alias("method"),
    ).filter(F.col("pred_x").isNotNull())


def summarise(frame: DataFrame, predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Error summary of predictions against the frame, with the share of the frame they cover."""
    scored = matching.score_predictions(frame, predictions.filter(F.col("pred_x").isNotNull()))
    # A few numbers for each surveyed address: written once, read by every figure.
    scored = settled(scored.select(*keys, "error_m", "radius_m"))
    total = frame.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = metrics.error_summary(scored, keys, radius="radius_m")
    return out.withColumn("coverage_rate", F.col("n") / total)


def ablation_table(frame: DataFrame, visits: DataFrame) -> DataFrame:
    """One row per evidence level; the level without independent evidence is marked, not estimated."""
    levels = {
        "address_only": geocoder_baseline(frame),
        "address_plus_visits": latest_success_baseline(visits),
        "address_plus_visits_plus_integrity": weighted_centroid_baseline(visits),
    }
    stacked = None
    for name, predictions in levels.items():
        part = predictions.withColumn("ablation", F.lit(name))
        stacked = part if stacked is None else stacked.unionByName(part)
    rows = summarise(frame, stacked, ["ablation"]).withColumn("status", F.lit("evaluated"))
    missing = frame.sparkSession.createDataFrame([("address_plus_nearby", "not_estimable")], "ablation string, status string")
    return rows.unionByName(missing, allowMissingColumns=True)


def temporal_split(visits: DataFrame, quantile: float = CUTOFF_QUANTILE) -> DataFrame:
    """Visits with ``is_future``: later than the overall time quantile."""
    rows = visits.withColumn("_us", micros("checkin_ts"))
    cutoff = settled(ranks.rank_stats(rows, [], "_us", {"c": ranks.linear(quantile)})).scalar()
    return rows.withColumn("cutoff_us", cutoff).withColumn("is_future", F.col("_us") > F.col("cutoff_us")).drop("_us")


def account_temporal_split(visits: DataFrame, quantile: float = CUTOFF_QUANTILE) -> DataFrame:
    """Visits with ``is_future`` relative to their own account's time quantile."""
    rows = visits.withColumn("_us", micros("checkin_ts"))
    cutoffs = settled(ranks.rank_stats(rows, ["account_id"], "_us", {"cutoff_us": ranks.linear(quantile)}))
    return rows.join(cutoffs, "account_id").withColumn("is_future", F.col("_us") > F.col("cutoff_us")).drop("_us")


def evaluate_split(frame: DataFrame, split_visits: DataFrame) -> DataFrame:
    """Centroids from past visits, scored only on addresses that are visited again later."""
    past = split_visits.filter(~F.col("is_future"))
    future = split_visits.filter("is_future").select("address_id").distinct()
    return summarise(frame.join(future, "address_id", "left_semi"), weighted_centroid_baseline(past))


def split_counts(split_visits: DataFrame, unit: str) -> DataFrame:
    """Rows on each side and units (addresses, accounts) on either or both sides of a split."""
    per_unit = split_visits.groupBy(unit).agg(
        F.count_if(~F.col("is_future")).alias("_past"), F.count_if("is_future").alias("_future")
    )
    return per_unit.agg(
        F.sum("_past").alias("train_visits"),
        F.sum("_future").alias("future_visits"),
        F.count_if(F.col("_past") > 0).alias("train_units"),
        F.count_if(F.col("_future") > 0).alias("future_units"),
        F.count_if((F.col("_past") > 0) & (F.col("_future") > 0)).alias("overlap_units"),
    )


def geography_holdout(frame: DataFrame) -> DataFrame:
    """Address-only summary of the last town in sort order."""
    last_town = frame.agg(F.max("town_id").alias("t")).scalar()
    held_out = frame.filter(F.col("town_id") == last_town)
    return summarise(held_out, geocoder_baseline(held_out).filter(F.col("pred_x").isNotNull()))


def region_split(df: DataFrame, x: str, y: str, order: str, regions: int = 4, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """K-means regions; the last ``fraction`` of each region's rows is the test part."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=[x, y], outputCol="_xy").transform(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()))
    model = KMeans(k=regions, seed=seed, featuresCol="_xy", predictionCol="region").fit(vectors)
    rows = model.transform(vectors).drop("_xy")
    ranked = ranks.row_ranks(rows, ["region"], order, order)
    n_test = F.greatest(F.lit(1), F.floor(F.col("group_rows") * fraction))
    return ranked.withColumn("is_test", F.col("row_rank") >= F.col("group_rows") - n_test)


def recency_split(visits: DataFrame, fraction: float = 0.25) -> DataFrame:
    """The newest max(1, floor(n * fraction)) visits of each account are the test part."""
    rows = visits.withColumn("_us", micros("checkin_ts"))
    ranked = ranks.row_ranks(rows, ["account_id"], "_us", "visit_id")
    n_test = F.greatest(F.lit(1), F.floor(F.col("group_rows") * fraction))
    return ranked.withColumn("is_test", F.col("row_rank") >= F.col("group_rows") - n_test).drop("_us")


def hash_split(df: DataFrame, key: str = "account_id", folds: int = 5) -> DataFrame:
    """``is_train`` from the account id's SHA-256: stable across runs and machines."""
    bucket = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("long") % folds
    return df.withColumn("is_train", bucket != 0)
