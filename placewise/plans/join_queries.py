from pyspark.sql import functions as F

from placewise.functions import geo
from placewise.operators import lookup, matching, proximity
from placewise.plans.registry import query

FRAME_SQL = """
SELECT s.address_id, s.surveyed_x, s.surveyed_y, a.account_id, a.town_id, b.geocoder_x, b.geocoder_y,
  sqrt((b.geocoder_x - s.surveyed_x) * (b.geocoder_x - s.surveyed_x) + (b.geocoder_y - s.surveyed_y) * (b.geocoder_y - s.surveyed_y)) AS baseline_error_m
FROM v_surveyed s JOIN v_addresses a ON a.address_id = s.address_id LEFT JOIN v_baseline b ON b.address_id = s.address_id"""

ASOF_SQL = """
SELECT p.prediction_id, p.account_id, p.ts, p.pred_x, p.pred_y, p.confidence, p.confidence_radius_m,
       h.checkin_ts, h.visit_id, h.checkin_x, h.checkin_y,
       sqrt((h.checkin_x - p.pred_x) * (h.checkin_x - p.pred_x) + (h.checkin_y - p.pred_y) * (h.checkin_y - p.pred_y)) AS error_m
FROM v_predictions p JOIN (
  SELECT p.prediction_id, v.*, row_number() OVER (PARTITION BY p.prediction_id ORDER BY v.checkin_ts, v.visit_id) AS rn
  FROM v_predictions p JOIN v_visits v ON v.account_id = p.account_id AND v.checkin_ts >= p.ts
  WHERE v.outcome IN ('met_borrower', 'met_family', 'cash_collected')) h ON h.prediction_id = p.prediction_id AND h.rn = 1"""


def frame(t):
    return matching.evaluation_frame(t.surveyed, t.addresses, t.baseline)


def predictions_with_outcome(t):
    """Each prediction with the first successful visit at or after it, and the distance between them."""
    hits = t.visits.filter(lookup.is_success())
    joined = proximity.asof_forward(
        t.predictions, hits, "account_id", "ts", "checkin_ts", "visit_id", ["checkin_x", "checkin_y"]
    )
    return joined.withColumn("error_m", geo.euclidean_m("checkin_x", "checkin_y", "pred_x", "pred_y"))


@query("c1_evaluation_frame", f"SELECT address_id, town_id, geocoder_x, surveyed_x, round(baseline_error_m, 4) AS baseline_error_m FROM ({FRAME_SQL})")
def c1(t):
    return frame(t).select("address_id", "town_id", "geocoder_x", "surveyed_x", F.round("baseline_error_m", 4).alias("baseline_error_m"))


@query(
    "c2_prediction_truth_join",
    f"""SELECT count(*) AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM ({FRAME_SQL})), 6) AS coverage_rate
FROM ({FRAME_SQL}) WHERE address_id IN (SELECT address_id FROM v_visits WHERE outcome IN ('met_borrower', 'met_family', 'cash_collected'))""",
)
def c2(t):
    reached = t.visits.filter(lookup.is_success()).select("address_id", F.lit(True).alias("hit")).distinct()
    rows = frame(t).select("address_id").join(reached, "address_id", "left")
    n = F.count("hit")
    return rows.agg(n.alias("n"), F.round(n / F.count(F.lit(1)), 6).alias("coverage_rate"))


@query("c3_forward_asof_visit", f"SELECT prediction_id, account_id, visit_id, checkin_ts, round(error_m, 4) AS error_m FROM ({ASOF_SQL})")
def c3(t):
    return predictions_with_outcome(t).select(
        "prediction_id", "account_id", "visit_id", "checkin_ts", F.round("error_m", 4).alias("error_m")
    )


_HALF = geo.box_degrees(1000)


@query(
    "c4_nearby_accounts",
    f"""SELECT account_id, neighbour, rank FROM (
SELECT a.account_id, b.account_id AS neighbour, CAST(row_number() OVER (PARTITION BY a.account_id ORDER BY b.account_id) AS INT) AS rank
FROM v_accounts a JOIN v_accounts b ON b.account_id <> a.account_id
 AND b.latitude BETWEEN a.latitude - {_HALF!r} AND a.latitude + {_HALF!r}
 AND b.longitude BETWEEN a.longitude - {_HALF!r} AND a.longitude + {_HALF!r}) WHERE rank <= 20""",
)
def c4(t):
    return proximity.box_neighbours(t.accounts, "account_id", "latitude", "longitude", _HALF, 20)


@query(
    "c5_nearby_clusters",
    f"""SELECT a.account_id, c.cluster_id, c.n_members FROM v_accounts a JOIN v_clusters c
 ON c.latitude BETWEEN a.latitude - {_HALF!r} AND a.latitude + {_HALF!r} AND c.longitude BETWEEN a.longitude - {_HALF!r} AND a.longitude + {_HALF!r}""",
)
def c5(t):
    accounts = t.accounts.filter(F.col("latitude").isNotNull()).select("account_id", "latitude", "longitude")
    clusters = t.clusters.select("cluster_id", "n_members", F.col("latitude").alias("c_lat"), F.col("longitude").alias("c_lon"))
    joined = proximity.box_join(accounts, clusters, ("latitude", "longitude"), ("c_lat", "c_lon"), _HALF)
    return joined.select("account_id", "cluster_id", "n_members")


@query(
    "c6_related_accounts",
    """
WITH long AS (
  SELECT account_id, 1 AS source_rank, locality AS term FROM v_accounts UNION ALL SELECT account_id, 2, pincode FROM v_accounts
  UNION ALL SELECT account_id, 0, nullif(regexp_extract(lower(address), '(ganesh mandir|govt school|masjid|ration shop|post office)', 1), '') FROM v_accounts),
heads AS (SELECT * FROM (SELECT source_rank, term, account_id AS related_id, row_number() OVER (PARTITION BY source_rank, term ORDER BY account_id) AS r FROM long WHERE term IS NOT NULL) WHERE r <= 10),
found AS (SELECT l.account_id, h.related_id, min(h.source_rank * 100 + h.r) AS f FROM long l JOIN heads h ON h.source_rank = l.source_rank AND h.term = l.term
  WHERE h.related_id <> l.account_id AND l.account_id IN (SELECT account_id FROM v_accounts WHERE latitude IS NULL) GROUP BY 1, 2)
SELECT account_id, related_id, CAST(f // 100 AS INT) AS source_rank, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY account_id ORDER BY f, related_id) AS INT) AS rank FROM found) WHERE rank <= 20""",
)
def c6(t):
    landmark = F.nullif(
        F.regexp_extract(F.lower("address"), "(ganesh mandir|govt school|masjid|ration shop|post office)", 1), F.lit("")
    )
    terms = t.accounts.select("account_id", landmark.alias("landmark"), "locality", "pincode")
    return matching.related_accounts(t.accounts, terms)


@query(
    "c9_pincode_match",
    """
SELECT a.account_id, l.locality_id, l.centroid_x, l.centroid_y FROM v_accounts a JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pincode ORDER BY locality_id) AS rn FROM v_localities) WHERE rn = 1) l ON l.pincode = a.pincode""",
)
def c9(t):
    return t.accounts.select("account_id", "pincode").join(matching.pincode_locality(t.localities), "pincode").drop("pincode")


@query(
    "c10_nearest_poi",
    """
SELECT * FROM (
SELECT a.address_id, p.poi_id, round(sqrt((p.x - l.centroid_x) * (p.x - l.centroid_x) + (p.y - l.centroid_y) * (p.y - l.centroid_y)), 4) AS poi_distance_m,
  row_number() OVER (PARTITION BY a.address_id ORDER BY sqrt((p.x - l.centroid_x) * (p.x - l.centroid_x) + (p.y - l.centroid_y) * (p.y - l.centroid_y)), p.poi_id) AS rn
FROM v_truth a JOIN v_localities l ON l.locality_id = a.locality_id
JOIN v_landmarks p ON p.town_id = a.town_id AND p.landmark_type = CASE a.address_id % 6 WHEN 0 THEN 'ganesha_temple' WHEN 1 THEN 'govt_school' WHEN 2 THEN 'masjid' WHEN 3 THEN 'ration_shop' WHEN 4 THEN 'post_office' END)
WHERE rn = 1 AND poi_distance_m <= 600""",
)
def c10(t):
    kinds = F.array(*[F.lit(k) for k in ("ganesha_temple", "govt_school", "masjid", "ration_shop", "post_office")])
    named = t.truth.select("address_id", "town_id", "locality_id", F.get(kinds, (F.col("address_id") % 6).cast("int")).alias("landmark_type"))
    anchored = named.filter(F.col("landmark_type").isNotNull()).join(
        t.localities.select("locality_id", "centroid_x", "centroid_y"), "locality_id"
    )
    best = proximity.nearest_within(
        anchored, t.landmarks, ["town_id", "landmark_type"], ("centroid_x", "centroid_y"), ("x", "y"), "poi_id", 600.0
    )
    return anchored.join(best, ["town_id", "landmark_type", "centroid_x", "centroid_y"]).select(
        "address_id", "poi_id", F.round("poi_distance_m", 4).alias("poi_distance_m"), F.lit(1).cast("long").alias("rn")
    )


@query("c11_orphan_addresses", "SELECT count(*) AS orphans FROM v_addresses WHERE address_id NOT IN (SELECT address_id FROM v_visits)")
def c11(t):
    return matching.orphan_count(t.addresses, t.visits, "address_id", "orphans")


@query(
    "c12_cluster_members",
    "SELECT c.cluster_id, a.account_id FROM v_clusters c JOIN v_accounts a ON a.place_cluster_id = c.cluster_id",
)
def c12(t):
    accounts = t.accounts.select("account_id", F.col("place_cluster_id").alias("cluster_id"))
    return t.clusters.select("cluster_id").join(accounts, "cluster_id")


@query(
    "c13_town_coverage",
    """
SELECT w.town_id, w.town_name, coalesce(a.n, 0) AS n_addresses, coalesce(p.n, 0) AS n_landmarks FROM v_towns w
LEFT JOIN (SELECT town_id, count(*) AS n FROM v_addresses GROUP BY 1) a ON a.town_id = w.town_id
LEFT JOIN (SELECT town_id, count(*) AS n FROM v_landmarks GROUP BY 1) p ON p.town_id = w.town_id""",
)
def c13(t):
    return matching.town_coverage(t.towns, t.addresses, t.landmarks).select("town_id", "town_name", "n_addresses", "n_landmarks")


@query(
    "c14_same_place_visits",
    """
WITH h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY checkin_ts DESC, visit_id DESC) AS rn FROM v_visits) WHERE rn <= 100)
SELECT v.visit_id, v.account_id, count(o.visit_id) AS n_close FROM v_visits v LEFT JOIN h o ON o.account_id = v.account_id AND o.visit_id <> v.visit_id
 AND sqrt((o.checkin_x - v.checkin_x) * (o.checkin_x - v.checkin_x) + (o.checkin_y - v.checkin_y) * (o.checkin_y - v.checkin_y)) <= 50
GROUP BY 1, 2""",
)
def c14(t):
    history = lookup.newest_visits(t.visits, "account_id")
    return proximity.close_history_count(
        t.visits, history, "account_id", "checkin_x", "checkin_y", "visit_id", 50.0
    ).select("visit_id", "account_id", "n_close")
