from pyspark.sql import functions as F

from placewise.functions import geo
from placewise.operators import fusion
from placewise.plans.metric_queries import rounded
from placewise.plans.registry import query
from placewise.session import settled
from placewise.plans.text_queries import parsed
from placewise.operators import evaluation, metrics

_OK = "outcome IN ('met_borrower', 'met_family', 'cash_collected')"
_LABELS = f"SELECT address_id, quantile_cont(checkin_x, 0.5) AS label_x, quantile_cont(checkin_y, 0.5) AS label_y FROM v_visits WHERE {_OK} GROUP BY 1"
_PARSED = """SELECT t.address_id, t.account_id, t.town_id, t.locality_id, t.address_id % 9 + 1 AS s1, t.address_id % 7 + 1 AS s2,
 CASE t.address_id % 6 WHEN 0 THEN 'ganesha_temple' WHEN 1 THEN 'govt_school' WHEN 2 THEN 'masjid' WHEN 3 THEN 'ration_shop' WHEN 4 THEN 'post_office' END AS landmark_type,
 CASE t.address_id % 6 WHEN 0 THEN 'opposite' WHEN 1 THEN 'behind' ELSE 'near' END AS relation FROM v_truth t"""
_POINTS = f"""SELECT p.*, l.label_x, l.label_y, c.centroid_x, c.centroid_y FROM ({_PARSED}) p JOIN ({_LABELS}) l ON l.address_id = p.address_id JOIN v_localities c ON c.locality_id = p.locality_id
 WHERE sqrt((l.label_x - c.centroid_x) * (l.label_x - c.centroid_x) + (l.label_y - c.centroid_y) * (l.label_y - c.centroid_y)) <= 1500"""


class Evidence:
    """Shared inputs of the fusion queries of one run."""

    def __init__(self, t):
        self.t = t
        self.parsed = settled(parsed(t).drop("address_text"))
        self.labels = settled(fusion.confirmed_labels(t.visits))
        self.points = settled(fusion.usable_points(self.labels, self.parsed, t.localities, t.towns))
        self._components = None

    @property
    def components(self):
        if self._components is None:
            t = self.t
            self._components = settled(fusion.text_components(self.parsed, self.points, t.baseline, t.localities, t.landmarks))
        return self._components

    def fit(self):
        return fusion.fit(self.labels, self.components, self.t.visits)


@query("k1_confirmed_labels", f"SELECT address_id, round(label_x, 4) AS label_x, round(label_y, 4) AS label_y FROM ({_LABELS})")
def k1(t):
    return rounded(fusion.confirmed_labels(t.visits))


@query("k2_usable_points", f"SELECT address_id, locality_id, round(label_x - centroid_x, 4) AS dx, round(label_y - centroid_y, 4) AS dy FROM ({_POINTS})")
def k2(t):
    points = fusion.usable_points(fusion.confirmed_labels(t.visits), parsed(t), t.localities, t.towns)
    return rounded(points.select("address_id", "locality_id", "dx", "dy"))


@query("k3_street_model")
def k3(t):
    e = Evidence(t)
    return rounded(e.components.filter(F.col("source").startswith("reg_")).select("address_id", "source", "x", "y"))


@query(
    "k4_base_components",
    f"""SELECT address_id, concat('base_', "precision") AS source, geocoder_x AS x, geocoder_y AS y FROM v_baseline
UNION ALL SELECT p.address_id, 'locality', c.centroid_x, c.centroid_y FROM ({_PARSED}) p JOIN v_localities c ON c.locality_id = p.locality_id
UNION ALL SELECT address_id, concat('poi_', relation), x, y FROM (SELECT p.address_id, p.relation, k.x, k.y, sqrt((k.x - c.centroid_x) * (k.x - c.centroid_x) + (k.y - c.centroid_y) * (k.y - c.centroid_y)) AS d,
  row_number() OVER (PARTITION BY p.address_id ORDER BY sqrt((k.x - c.centroid_x) * (k.x - c.centroid_x) + (k.y - c.centroid_y) * (k.y - c.centroid_y)), k.poi_id) AS rn
  FROM ({_PARSED}) p JOIN v_localities c ON c.locality_id = p.locality_id JOIN v_landmarks k ON k.town_id = p.town_id AND k.landmark_type = p.landmark_type) WHERE rn = 1 AND d <= 600""",
)
def k4(t):
    return fusion.base_components(parsed(t), t.baseline, t.localities, t.landmarks).select("address_id", "source", "x", "y")


@query(
    "k5_street_neighbours",
    f"""SELECT a.address_id, CASE WHEN count(*) >= 2 THEN 'st_exact_2' ELSE 'st_exact_1' END AS source, round(quantile_cont(b.label_x, 0.5), 4) AS x, round(quantile_cont(b.label_y, 0.5), 4) AS y
 FROM ({_PARSED}) a JOIN ({_POINTS}) b ON b.locality_id = a.locality_id AND b.s1 = a.s1 AND b.s2 = a.s2 AND b.account_id <> a.account_id GROUP BY 1""",
)
def k5(t):
    e = Evidence(t)
    return rounded(fusion.street_neighbours(e.points, e.parsed).select("address_id", "source", "x", "y"))


@query("k6_k7_source_sigma")
def k7(t):
    e = Evidence(t)
    return rounded(fusion.source_sigma(e.components, e.labels))


@query("k8_fused_text")
def k8(t):
    e = Evidence(t)
    sigma = fusion.source_sigma(e.components, e.labels).select("source", "sigma")
    return rounded(fusion.fuse(e.components, sigma).withColumn("sources", F.array_join("sources", ",")))


@query("k9_k10_fitted_parameters")
def k9(t):
    p = Evidence(t).fit()
    return t.spark.createDataFrame(
        [(p.n_confirmed_addresses, p.radius_scale, p.text_tail, p.visit_sigma, p.calibration_sigma, p.calibration_p)],
        "n_confirmed_addresses long, radius_scale double, text_tail double, visit_sigma double, sigma array<double>, p array<double>",
    )


_DISTANCES = f"""SELECT v.visit_id, v.outcome, sqrt((v.checkin_x - m.mx) * (v.checkin_x - m.mx) + (v.checkin_y - m.my) * (v.checkin_y - m.my)) AS distance_m FROM v_visits v JOIN (
 SELECT v.visit_id, quantile_cont(s.checkin_x, 0.5) AS mx, quantile_cont(s.checkin_y, 0.5) AS my FROM v_visits v JOIN v_visits s ON s.address_id = v.address_id AND s.visit_id <> v.visit_id AND s.{_OK} GROUP BY 1) m ON m.visit_id = v.visit_id"""


@query(
    "k11_outcome_reliability",
    f"""SELECT outcome, count(*) AS n, CASE WHEN count(*) >= 20 THEN round(least(0.97, avg(CAST(distance_m <= 300 AS INT))), 3) ELSE CASE outcome WHEN 'met_family' THEN 0.94 WHEN 'met_borrower' THEN 0.88 WHEN 'cash_collected' THEN 0.92 WHEN 'locked_premises' THEN 0.88 END END AS reliability FROM ({_DISTANCES}) GROUP BY 1""",
)
def k11(t):
    return fusion.outcome_reliability(fusion.held_out_visit_distances(t.visits))


@query("k11_held_out_distances", f"SELECT visit_id, round(distance_m, 4) AS distance_m FROM ({_DISTANCES})")
def k11_distances(t):
    return rounded(fusion.held_out_visit_distances(t.visits).select("visit_id", "distance_m"))


@query("k12_visit_sigma", f"SELECT round(quantile_cont(distance_m, 0.5) / (1.1774 * sqrt(2)), 4) AS visit_sigma FROM ({_DISTANCES}) WHERE {_OK} AND distance_m <= 300")
def k12(t):
    return rounded(fusion.visit_sigma(fusion.held_out_visit_distances(t.visits)))


@query("k13_visit_clusters")
def k13(t):
    points = fusion.reliable_points(t.visits, {"met_borrower": 0.88, "met_family": 0.94, "cash_collected": 0.92, "locked_premises": 0.88})
    return fusion.visit_clusters(points).select("address_id", "x", "y", "p", "cnt", "cluster")


@query("k14_k17_evidence_predictions")
def k17(t):
    e = Evidence(t)
    out = fusion.predict(e.parsed, e.components, t.visits, t.towns, e.fit())
    out = fusion.with_evidence(out, e.points, t.localities)
    return rounded(
        out.select("address_id", "x", "y", "sigma_m", "confidence", "radius_m", "method", "visits_used", "visits_rejected",
                   F.array_join("evidence", "; ").alias("evidence"))
    )


@query("k17_evidence_summary")
def k17_summary(t):
    """Error, coverage and confidence of the fused predictions on surveyed addresses."""
    e = Evidence(t)
    out = settled(fusion.predict(e.parsed, e.components, t.visits, t.towns, e.fit()))
    frame = t.surveyed.join(t.addresses, "address_id")
    return rounded(evaluation.summarise(frame, out.select("address_id", F.col("x").alias("pred_x"), F.col("y").alias("pred_y"), "radius_m")))


@query("k18_cold_start")
def k18(t):
    """Own visits hidden: text-only error against the median successful visit."""
    e = Evidence(t)
    out = settled(fusion.predict(e.parsed, e.components, None, t.towns, e.fit())).join(e.labels, "address_id")
    scored = out.withColumn("error_m", geo.euclidean_m("x", "y", "label_x", "label_y"))
    return rounded(metrics.error_summary(scored, radius="radius_m"))
