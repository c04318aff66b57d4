"""The whole candidate path as one job over the account table (WGS84)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placewise import config
from placewise.functions import entities, geo, narrative
from placewise.session import settled
from placewise.operators import calibration, candidates, lookup, matching, proximity, ranking


@dataclass
class GeocodeInputs:
    """accounts: account_id, address, town_id, latitude, longitude, confidence, place_cluster_id.
    visits: visit_id, account_id, checkin_ts, latitude, longitude, canonical outcome, gps_accuracy_m, dwell_s,
    integrity_score, reliability, trajectory_ratio. geocodes: account_id, latitude, longitude, provider_rank, accuracy_m.
    landmarks / localities: gazetteer with latitude, longitude. clusters: cluster_id, latitude, longitude, n_members."""

    accounts: DataFrame
    visits: DataFrame
    clusters: DataFrame
    geocodes: DataFrame
    landmarks: DataFrame
    localities: DataFrame


def described_accounts(accounts: DataFrame) -> DataFrame:
    parts = entities.extract_entities(accounts.select("account_id", "town_id", "address", "latitude"), "address")
    return settled(parts.select("account_id", "town_id", "latitude", "entities", "landmark", "locality", "pincode"))


def _neighbours(inputs: GeocodeInputs, described: DataFrame, only: DataFrame | None) -> DataFrame:
    """Neighbour lists of all accounts, or of ``only`` some among all."""
    key = "account_id"
    related = matching.related_accounts(inputs.accounts, described.select(key, "landmark", "locality", "pincode"))
    if only is None:
        return candidates.neighbour_lists(inputs.accounts, key, "latitude", "longitude", related)
    others = inputs.accounts.select(F.col(key).alias("other"), "latitude", "longitude")
    near = proximity.box_neighbours(inputs.accounts.join(only, key, "left_semi"), key, "latitude", "longitude", geo.box_degrees(1000), 21, others, "other")
    near = near.filter(F.col(key) != F.col("neighbour")).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("neighbour"))).filter("rank <= 20")
    return near.unionByName(related.join(only, key, "left_semi").select(key, F.col("related_id").alias("neighbour"), "rank"))


def generate(inputs: GeocodeInputs, described: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Merged and capped candidates of every account (or of those in ``only``), with rank and probability."""
    key = "account_id"
    mine = lambda df: df if only is None else df.join(only, key, "left_semi")
    neighbours = _neighbours(inputs, described, only)
    described = mine(described)
    near_clusters = proximity.box_neighbours(
        mine(inputs.accounts), key, "latitude", "longitude", geo.box_degrees(1000), candidates.RULES.per_source, inputs.clusters, "cluster_id"
    )
    pins = inputs.localities.groupBy("pincode").agg(
        F.min_by(F.struct("locality_id", F.col("latitude").alias("centroid_x"), F.col("longitude").alias("centroid_y")), "locality_id").alias("_l")
    ).select("pincode", "_l.*")
    point = ("latitude", "longitude")
    by_landmark = candidates.fuzzy_gazetteer_match(described, "landmark", inputs.landmarks, "poi_id", "name", point)
    by_locality = candidates.fuzzy_gazetteer_match(described, "locality", inputs.localities, "locality_id", "locality_name", point)
    listed = candidates.union_sources(
        candidates.historical_candidates(mine(inputs.visits), key, *point, "wgs84"),
        candidates.nearby_candidates(neighbours, inputs.accounts, key, *point),
        candidates.cluster_candidates(near_clusters, inputs.clusters, key, *point),
        candidates.geocoder_candidates(mine(inputs.geocodes), key, *point, "provider_rank", F.col("accuracy_m")),
        candidates.landmark_candidates(by_landmark, key),
        candidates.locality_candidates(by_locality, key),
        candidates.pincode_candidates(described, pins, key),
    )
    merged = candidates.merge_duplicates(listed, key, "wgs84")
    return ranking.rank(candidates.strongest(merged, key), key)


def geocode_accounts(inputs: GeocodeInputs, only: DataFrame | None = None, described: DataFrame | None = None) -> DataFrame:
    """One prediction per account: point, confidence, radius, action, evidence and directions.

    With ``only`` (account_id, distinct) the other accounts serve as neighbours and get none.
    ``described`` saves reading the addresses again where they are known.
    """
    described = described_accounts(inputs.accounts) if described is None else described
    ranked = settled(generate(inputs, described, only))
    visits = inputs.visits
    if only is not None:
        described, visits = (df.join(only, "account_id", "left_semi") for df in (described, visits))
    agreement = calibration.candidate_agreement(ranked, "account_id")
    history = lookup.newest_visits(visits, "account_id", candidates.RULES.history_limit)
    sums = calibration.evidence_sums(history.filter(F.col("outcome").isin(*config.CANONICAL_SUCCESS)), "account_id")
    best = ranked.filter(F.col("rank") == 1).join(sums, "account_id", "left").join(agreement, "account_id", "left")
    best = best.withColumn("evidence_confidence", calibration.evidence_confidence())
    best = best.withColumn("confidence", calibration.combined_confidence())
    best = best.withColumn("confidence_radius_m", calibration.heuristic_radius("confidence"))
    best = best.withColumn("evidence", narrative.candidate_evidence())
    out = described.select("account_id", "entities", "landmark", "locality").join(
        best.select(
            "account_id", F.col("x").alias("pred_lat"), F.col("y").alias("pred_lon"), "source", "probability", "confidence",
            "confidence_radius_m", "evidence",
        ),
        "account_id",
        "left",
    )
    found = F.col("pred_lat").isNotNull()
    steps = narrative.direction_steps("entities", "landmark", "locality", found)
    return out.withColumns(
        {
            "prediction_method": F.when(found, "candidate_ranking").otherwise("no_candidates"),
            "recommended_action": F.when(found, calibration.recommended_action("confidence", "confidence_radius_m")).otherwise("VERIFY_FIRST"),
            "directions": F.when(found, narrative.directions_text(steps)).otherwise(
                "Address could not be geocoded. Manual verification required."
            ),
            "confidence": F.coalesce("confidence", F.lit(0.0)),
            "evidence": F.when(found, F.col("evidence")).otherwise(F.array(F.lit("No candidate locations found"))),
        }
    ).drop("entities")
