from pyspark.sql import functions as F

from placewise.functions import geo
from placewise.operators import candidates, evaluation, integrity, lookup, matching, proximity, ranking, reliability, trajectories
from placewise.plans import geocode
from placewise.plans.metric_queries import canonical_visits, rounded
from placewise.plans.registry import query
from placewise.session import settled

_OK = "outcome IN ('met_borrower', 'met_family', 'cash_collected')"


def to_degrees(df, x, y):
    return df.withColumns({"latitude": 12.97 + F.col(y) / 111000, "longitude": 77.59 + F.col(x) / 108168})


def scored_visits(t):
    """Canonical visits in degrees with integrity, reliability and trajectory ratio."""
    return scored(t.visits, settled(trajectories.summarise(t.gps_points, "projected_xy")))


def scored(visits, tracks):
    """``scored_visits`` of some ``visits`` with the ``tracks`` of all."""
    canon = visits.withColumn("outcome", lookup.canonical_outcome("outcome"))
    history = lookup.newest_visits(canon, "account_id")
    trust = reliability.score(canon, tracks, history, "projected_xy").select(
        "visit_id", "reliability", F.col("efficiency").alias("trajectory_ratio")
    )
    honest = integrity.detect(visits, tracks).select("visit_id", F.col("integrity").alias("integrity_score"))
    return settled(to_degrees(canon, "checkin_x", "checkin_y").join(trust, "visit_id").join(honest, "visit_id"))


def geocode_inputs(t, visits=scored_visits):
    """Inputs of the batch geocode; ``visits`` makes the scored visits (None: they come later)."""
    results = t.baseline.join(t.addresses.select("address_id", "account_id"), "address_id")
    return geocode.GeocodeInputs(
        accounts=t.accounts,
        visits=visits(t) if visits else None,
        clusters=t.clusters,
        geocodes=to_degrees(results, "geocoder_x", "geocoder_y").withColumns({"provider_rank": F.lit(1), "accuracy_m": F.lit(100.0)}),
        landmarks=to_degrees(t.landmarks, "x", "y"),
        localities=to_degrees(t.localities, "centroid_x", "centroid_y"),
    )


def _plain_visits(t):
    """Canonical visits without integrity or trajectory evidence."""
    return canonical_visits(t).withColumns(
        {"integrity_score": F.lit(None).cast("double"), "trajectory_ratio": F.lit(None).cast("double")}
    )


@query("h1_visit_groups")
def h1(t):
    groups = candidates.visit_groups(_plain_visits(t), "account_id", "checkin_x", "checkin_y", "projected_xy")
    return groups.select("account_id", "visit_id", F.col("leader").cast("int").alias("visit_group"))


@query(
    "h2_weighted_centroid",
    f"""SELECT account_id, round(sum(w * checkin_x) / sum(w), 4) AS x, round(sum(w * checkin_y) / sum(w), 4) AS y, round(sum(w), 4) AS weight, count(*) AS visits,
 round(CAST(min(gps_accuracy_m) AS DOUBLE), 4) AS accuracy, round(avg(dwell_s), 4) AS dwell FROM (SELECT *, CAST(CASE outcome WHEN 'met_family' THEN 0.7 ELSE 1.0 END * 0.5 AS DOUBLE) AS w FROM v_visits WHERE {_OK}) GROUP BY 1""",
)
def h2(t):
    hits = _plain_visits(t).filter(F.col("outcome").isin("SUCCESSFUL_CONTACT", "PARTIAL_CONTACT")).withColumn("position", F.col("visit_id"))
    out = candidates.weighted_centroid(hits, ["account_id"], "checkin_x", "checkin_y")
    return rounded(out.select("account_id", "x", "y", "weight", "visits", "accuracy", "dwell"))


@query("h4_historical_candidates")
def h4(t):
    out = candidates.historical_candidates(_plain_visits(t), "account_id", "checkin_x", "checkin_y", "projected_xy")
    return rounded(out.select("account_id", "source_order", "x", "y", "supporting_visit_count", "weighted_successful_visit_count"))


_HALF = geo.box_degrees(1000)


@query(
    "h5_nearby_candidates",
    f"""SELECT n.account_id, CAST(n.rank AS INT) AS source_order, b.latitude AS x, b.longitude AS y, CAST(1 AS BIGINT) AS nearby_account_support, CAST(1 AS BIGINT) AS place_cluster_support FROM (
 SELECT a.account_id, b.account_id AS neighbour, row_number() OVER (PARTITION BY a.account_id ORDER BY b.account_id) AS rank FROM v_accounts a JOIN v_accounts b ON b.account_id <> a.account_id
  AND b.latitude BETWEEN a.latitude - {_HALF!r} AND a.latitude + {_HALF!r} AND b.longitude BETWEEN a.longitude - {_HALF!r} AND a.longitude + {_HALF!r}) n
 JOIN v_accounts b ON b.account_id = n.neighbour WHERE n.rank <= 10 AND b.confidence >= 0.5""",
)
def h5(t):
    lists = candidates.neighbour_lists(t.accounts, "account_id", "latitude", "longitude")
    out = candidates.nearby_candidates(lists, t.accounts, "account_id", "latitude", "longitude")
    return out.select("account_id", "source_order", "x", "y", "nearby_account_support", "place_cluster_support")


@query(
    "h6_cluster_candidates",
    f"""SELECT account_id, cluster_id AS source_reference, source_order, place_cluster_support FROM (SELECT a.account_id, c.cluster_id, c.n_members AS place_cluster_support,
 CAST(row_number() OVER (PARTITION BY a.account_id ORDER BY c.cluster_id) AS INT) AS source_order FROM v_accounts a JOIN v_clusters c
 ON c.latitude BETWEEN a.latitude - {_HALF!r} AND a.latitude + {_HALF!r} AND c.longitude BETWEEN a.longitude - {_HALF!r} AND a.longitude + {_HALF!r}) WHERE source_order <= 10""",
)
def h6(t):
    near = proximity.box_neighbours(t.accounts, "account_id", "latitude", "longitude", _HALF, 10, t.clusters, "cluster_id")
    out = candidates.cluster_candidates(near, t.clusters, "account_id", "latitude", "longitude")
    return out.select("account_id", "source_reference", "source_order", "place_cluster_support")


@query("h7_geocoder_candidates", "SELECT address_id, geocoder_x AS x, geocoder_y AS y, 0.0::DOUBLE AS commercial_geocoder_distance FROM v_baseline")
def h7(t):
    out = candidates.geocoder_candidates(t.baseline, "address_id", "geocoder_x", "geocoder_y", "precision", F.lit(100.0))
    return out.select("address_id", "x", "y", "commercial_geocoder_distance")


@query("c7_h8_landmark_candidates")
def h8(t):
    described = geocode.described_accounts(t.accounts)
    out = candidates.fuzzy_gazetteer_match(described, "landmark", t.landmarks, "poi_id", "name", ("x", "y"))
    return rounded(candidates.landmark_candidates(out, "account_id").select("account_id", "source_reference", "x", "y", "landmark_similarity"))


@query("c8_h9_locality_candidates")
def h9(t):
    described = geocode.described_accounts(t.accounts)
    out = candidates.fuzzy_gazetteer_match(described, "locality", t.localities, "locality_id", "locality_name", ("centroid_x", "centroid_y"))
    return rounded(candidates.locality_candidates(out, "account_id").select("account_id", "source_reference", "x", "y", "locality_similarity"))


@query(
    "h10_pincode_candidates",
    """SELECT a.account_id, l.locality_id AS source_reference, l.centroid_x AS x, l.centroid_y AS y, 1000.0::DOUBLE AS gps_accuracy FROM v_accounts a
 JOIN (SELECT *, row_number() OVER (PARTITION BY pincode ORDER BY locality_id) AS rn FROM v_localities) l ON l.pincode = a.pincode AND l.rn = 1""",
)
def h10(t):
    out = candidates.pincode_candidates(t.accounts, matching.pincode_locality(t.localities), "account_id")
    return out.select("account_id", "source_reference", "x", "y", "gps_accuracy")


@query("h11_h13_ranked_candidates")
def h13(t):
    inputs = geocode_inputs(t)
    out = geocode.generate(inputs, geocode.described_accounts(inputs.accounts))
    return rounded(out.select("account_id", "rank", "source", "x", "y", "evidence_score", "probability", "merged_from"), 6)


@query("h14_batch_geocode")
def h14(t):
    out = geocode.geocode_accounts(geocode_inputs(t))
    return rounded(out.withColumn("evidence", F.array_join("evidence", "; ")), 6)


_EXAMPLES = f"""
WITH s AS (SELECT s.address_id, t.account_id, t.town_id, t.pincode, s.surveyed_x, s.surveyed_y FROM v_surveyed s JOIN v_truth t ON t.address_id = s.address_id),
hv AS (SELECT *, count(*) OVER (PARTITION BY address_id) AS n FROM v_visits WHERE {_OK}),
ex AS (
 SELECT s.address_id, s.account_id, s.surveyed_x, s.surveyed_y, v.checkin_x AS x, v.checkin_y AS y, 'HISTORICAL_VISIT' AS source, CAST(v.visit_id AS VARCHAR) AS source_reference,
  0.6 * 0.3 + 0.4 * 0.3 + 0.5 * 0.1 - 0.3 + least(1.0, v.n / 5) * 0.2 + least(1.0, v.n / 3) * 0.2 + 0.8 * 0.15 + greatest(0, 1 - v.gps_accuracy_m / 500) * 0.1 + least(1.0, v.dwell_s / 300) * 0.1 + 0.07 + 0.05 + 0.2 AS p FROM s JOIN hv v ON v.address_id = s.address_id
 UNION ALL SELECT s.address_id, s.account_id, s.surveyed_x, s.surveyed_y, b.geocoder_x, b.geocoder_y, 'GEOCODER', 'baseline', 0.5 * 0.3 + 0.3 * 0.3 + 0.4 * 0.1 - 0.3 + 0.15 + 0.8 * 0.1 + 0.05 + 0.1 + 0.1 FROM s JOIN v_baseline b ON b.address_id = s.address_id
 UNION ALL SELECT s.address_id, s.account_id, s.surveyed_x, s.surveyed_y, l.centroid_x, l.centroid_y, 'LOCALITY', l.locality_id, 0.2 * 0.3 + 0.8 * 0.1 - 0.3 + 0.15 + 0.0 + 0.03 + 0.1 FROM s JOIN v_localities l ON l.town_id = s.town_id
 UNION ALL SELECT s.address_id, s.account_id, s.surveyed_x, s.surveyed_y, l.centroid_x, l.centroid_y, 'PINCODE', l.locality_id, 0.1 * 0.3 + 0.3 * 0.1 - 0.3 + 0.15 + 0.0 + 0.02 + 0.1 FROM s JOIN v_localities l ON l.pincode = s.pincode),
sc AS (SELECT *, CAST(round(greatest(0, least(1, p)), 6) AS DOUBLE) AS probability, sqrt((x - surveyed_x) * (x - surveyed_x) + (y - surveyed_y) * (y - surveyed_y)) AS d FROM ex)
"""


def learning(t):
    """Examples with the heuristic probability (rounded, so that ties are ties in every engine)."""
    facts = t.truth.select("address_id", "account_id", "town_id", "pincode")
    frame = ranking.learning_frame(t.surveyed.join(facts, "address_id"), t.visits, t.baseline, t.localities, lookup.is_success())
    scored = ranking.features(frame).withColumn("probability", F.round(ranking.heuristic_score(), 6))
    return scored


@query(
    "i6_learning_frame",
    _EXAMPLES + "SELECT address_id, source, source_reference, x, y, round(d, 4) AS distance_to_truth_m, CASE WHEN d <= 250 THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM sc",
)
def i6(t):
    return learning(t).select("address_id", "source", "source_reference", "x", "y", F.round("distance_to_truth_m", 4).alias("distance_to_truth_m"), "label")


@query("i1_i2_heuristic_scores", _EXAMPLES + "SELECT address_id, source, source_reference, round(probability, 4) AS probability FROM sc")
def i2(t):
    return learning(t).select("address_id", "source", "source_reference", F.round("probability", 4).alias("probability"))


@query(
    "i3_ranked_examples",
    _EXAMPLES + "SELECT address_id, source, source_reference, CAST(row_number() OVER (PARTITION BY address_id ORDER BY probability DESC, source, source_reference) AS INT) AS rank FROM sc",
)
def i3(t):
    rows = learning(t).withColumn("_tie", F.concat_ws("|", "source", "source_reference"))
    return ranking.rank(rows, "address_id", "_tie").select("address_id", "source", "source_reference", "rank")


def _hash_split_training(t):
    return evaluation.hash_split(learning(t).drop("probability", "f"))


def with_validation(train):
    """Every fifth training address, by hash, judges when boosting stops."""
    return train.withColumn("is_validation", F.pmod(F.xxhash64("address_id"), F.lit(5)) == 0)


@query("i4_i5_learned_ranker")
def i4(t):
    """Train on the hash split's training accounts, score the held-out ones, report AUC and confusion counts."""
    frame = _hash_split_training(t)
    model = ranking.train(with_validation(frame.filter("is_train")), "is_validation")
    scored = ranking.score_with_model(frame.filter("NOT is_train"), model)
    return ranking.classifier_metrics(scored).withColumn("auc", ranking.roc_auc(scored).scalar())


@query("i11_feature_importance")
def i11(t):
    model = ranking.train(with_validation(_hash_split_training(t).filter("is_train")), "is_validation")
    return ranking.feature_importance(t.spark, model)


@query(
    "i8_classifier_metrics",
    _EXAMPLES + """, c AS (SELECT count(*) FILTER (probability > 0.5 AND d <= 250) AS tp, count(*) FILTER (probability > 0.5 AND d > 250) AS fp, count(*) FILTER (probability <= 0.5 AND d <= 250) AS fn, count(*) FILTER (probability <= 0.5 AND d > 250) AS tn FROM sc)
SELECT *, round(tp / (tp + fp), 4) AS "precision", round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM c""",
)
def i8(t):
    return rounded(ranking.classifier_metrics(learning(t)))


@query(
    "i9_roc_auc",
    _EXAMPLES + """, r AS (SELECT d <= 250 AS pos, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1) / 2.0 AS rk FROM sc)
SELECT round((sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos) * CAST(count(*) FILTER (NOT pos) AS DOUBLE)), 6) AS auc FROM r""",
)
def i9(t):
    return rounded(ranking.roc_auc(learning(t)), 6)


@query(
    "i10_probability_buckets",
    _EXAMPLES + "SELECT CAST(least(floor(probability * 10), 9) AS BIGINT) AS bucket, count(*) AS count, round(avg(CAST((probability > 0.5) = (d <= 250) AS INT)), 4) AS accuracy FROM sc GROUP BY 1",
)
def i10(t):
    return rounded(ranking.probability_buckets(learning(t)))


@query(
    "i12_best_candidate",
    _EXAMPLES + "SELECT address_id, source, source_reference, x, y FROM (SELECT *, row_number() OVER (PARTITION BY address_id ORDER BY probability DESC, source, source_reference) AS rn FROM sc) WHERE rn = 1",
)
def i12(t):
    rows = learning(t).withColumn("_tie", F.struct("source", "source_reference"))
    return ranking.best_candidate(rows, "address_id", ["source", "source_reference", "x", "y"], "_tie").drop("probability")
