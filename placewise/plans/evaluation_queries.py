from pyspark.sql import functions as F

from placewise.operators import evaluation
from placewise.plans.join_queries import FRAME_SQL, frame
from placewise.plans.metric_queries import rounded, summary_sql
from placewise.plans.registry import query

_OK = "outcome IN ('met_borrower', 'met_family', 'cash_collected')"
_GEO = f"SELECT address_id, geocoder_x AS pred_x, geocoder_y AS pred_y, 500.0::DOUBLE AS radius_m FROM ({FRAME_SQL}) WHERE geocoder_x IS NOT NULL"
_LATEST = f"""SELECT address_id, checkin_x AS pred_x, checkin_y AS pred_y, 200.0::DOUBLE AS radius_m FROM (SELECT *, row_number() OVER (PARTITION BY address_id ORDER BY checkin_ts DESC, visit_id DESC) AS rn FROM v_visits WHERE {_OK}) WHERE rn = 1"""


def _centroid_sql(weight: str, radius: str, visits: str = "v_visits") -> str:
    return f"""SELECT address_id, px AS pred_x, py AS pred_y, {radius} AS radius_m FROM (SELECT address_id, sum(w * checkin_x) / sum(w) AS px, sum(w * checkin_y) / sum(w) AS py,
  sum(w * (checkin_x * checkin_x + checkin_y * checkin_y)) / sum(w) - power(sum(w * checkin_x) / sum(w), 2) - power(sum(w * checkin_y) / sum(w), 2) AS var, sum(w) AS sw
  FROM (SELECT *, {weight} AS w FROM {visits} WHERE {_OK}) GROUP BY address_id) WHERE sw > 0"""


_W = "(1 / greatest(gps_accuracy_m, 1)) * greatest(least(dwell_s, 600), 1) / 300"
_RADIUS = "greatest(50, sqrt(greatest(var, 0)))"
_CENTROID = _centroid_sql(_W, _RADIUS)
_OPERATIONAL = _centroid_sql(
    "(1 / greatest(1, gps_accuracy_m)) * CASE WHEN dwell_s = 0 THEN 1.0 ELSE least(2.0, dwell_s / 300) END", "250.0::DOUBLE"
)


def _scored(predictions: str, frame_sql: str = FRAME_SQL) -> str:
    return f"""SELECT p.*, f.town_id, sqrt((p.pred_x - f.surveyed_x) * (p.pred_x - f.surveyed_x) + (p.pred_y - f.surveyed_y) * (p.pred_y - f.surveyed_y)) AS error_m
 FROM ({frame_sql}) f JOIN ({predictions}) p ON p.address_id = f.address_id"""


def _summary(predictions: str, frame_sql: str = FRAME_SQL) -> str:
    rate = f", round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM ({frame_sql})), 4) AS coverage_rate"
    return summary_sql(_scored(predictions, frame_sql), extra=rate)


@query("n1_geocoder_summary", _summary(_GEO))
def n1(t):
    f = frame(t)
    return rounded(evaluation.summarise(f, evaluation.geocoder_baseline(f)))


@query("n2_latest_success_summary", _summary(_LATEST))
def n2(t):
    return rounded(evaluation.summarise(frame(t), evaluation.latest_success_baseline(t.visits)))


@query("n3_weighted_centroid_predictions", f"SELECT address_id, round(pred_x, 4) AS pred_x, round(pred_y, 4) AS pred_y, round(radius_m, 3) AS radius_m FROM ({_CENTROID})")
def n3_points(t):
    p = evaluation.weighted_centroid_baseline(t.visits)
    return p.select("address_id", F.round("pred_x", 4).alias("pred_x"), F.round("pred_y", 4).alias("pred_y"), F.round("radius_m", 3).alias("radius_m"))


@query("n3_weighted_centroid_summary", _summary(_CENTROID))
def n3(t):
    return rounded(evaluation.summarise(frame(t), evaluation.weighted_centroid_baseline(t.visits)))


@query(
    "n3_agent_capped_centroid",
    f"""WITH w AS (SELECT *, {_W} AS w0 FROM v_visits WHERE {_OK}), a AS (SELECT address_id, agent_id, sum(w0) AS aw FROM w GROUP BY 1, 2),
 s AS (SELECT address_id, agent_id, least(1.0, 0.4 * sum(aw) OVER (PARTITION BY address_id) / aw) AS f FROM a)
 SELECT address_id, round(sum(w0 * f * checkin_x) / sum(w0 * f), 4) AS pred_x, round(sum(w0 * f * checkin_y) / sum(w0 * f), 4) AS pred_y FROM w JOIN s USING (address_id, agent_id) GROUP BY 1""",
)
def n3_capped(t):
    return rounded(evaluation.weighted_centroid_baseline(t.visits, 0.4).drop("radius_m"))


@query("n4_operational_centroid_summary", _summary(_OPERATIONAL))
def n4(t):
    return rounded(evaluation.summarise(frame(t), evaluation.operational_centroid_baseline(t.visits)))


@query(
    "n5_hybrid_predictor",
    f"""SELECT g.address_id, round(coalesce(c.pred_x, g.geocoder_x), 4) AS pred_x, round(coalesce(c.pred_y, g.geocoder_y), 4) AS pred_y,
 round(coalesce(c.radius_m, 500), 3) AS radius_m, CASE WHEN c.pred_x IS NOT NULL THEN 'weighted_centroid' ELSE 'geocoder' END AS method
 FROM ({FRAME_SQL}) g LEFT JOIN ({_CENTROID}) c ON c.address_id = g.address_id WHERE coalesce(c.pred_x, g.geocoder_x) IS NOT NULL""",
)
def n5(t):
    return rounded(evaluation.hybrid_predictor(frame(t), t.visits).withColumn("radius_m", F.round("radius_m", 3)))


_CORE = ["ablation", "status", "n", "median_error_m", "p90_error_m", "coverage", "coverage_rate"]


@query(
    "n6_ablation_table",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS ablation, 'evaluated' AS status, n, median_error_m, p90_error_m, coverage, coverage_rate FROM ({_summary(p)})"
        for name, p in (("address_only", _GEO), ("address_plus_visits", _LATEST), ("address_plus_visits_plus_integrity", _CENTROID))
    )
    + " UNION ALL SELECT 'address_plus_nearby', 'not_estimable', NULL, NULL, NULL, NULL, NULL)",
)
def n6(t):
    return rounded(evaluation.ablation_table(frame(t), t.visits).select(*_CORE))


_T_SPLIT = "SELECT *, epoch_us(checkin_ts) > (SELECT quantile_cont(CAST(epoch_us(checkin_ts) AS DOUBLE), 0.7) FROM v_visits) AS is_future FROM v_visits"
_A_SPLIT = "SELECT v.*, epoch_us(checkin_ts) > c.q AS is_future FROM v_visits v JOIN (SELECT account_id, quantile_cont(CAST(epoch_us(checkin_ts) AS DOUBLE), 0.7) AS q FROM v_visits GROUP BY 1) c ON c.account_id = v.account_id"


def _split_eval(split: str) -> str:
    f = f"SELECT * FROM ({FRAME_SQL}) WHERE address_id IN (SELECT address_id FROM ({split}) WHERE is_future)"
    return _summary(_centroid_sql(_W, _RADIUS, f"(SELECT * FROM ({split}) WHERE NOT is_future)"), f)


def _split_count(split: str, unit: str) -> str:
    return f"""SELECT CAST(sum(p) AS BIGINT) AS train_visits, CAST(sum(f) AS BIGINT) AS future_visits, count(*) FILTER (p > 0) AS train_units, count(*) FILTER (f > 0) AS future_units,
 count(*) FILTER (p > 0 AND f > 0) AS overlap_units FROM (SELECT {unit}, count(*) FILTER (NOT is_future) AS p, count(*) FILTER (is_future) AS f FROM ({split}) GROUP BY 1)"""


@query("n7_temporal_split_summary", _split_eval(_T_SPLIT))
def n7(t):
    return rounded(evaluation.evaluate_split(frame(t), evaluation.temporal_split(t.visits)))


@query("n7_temporal_split_counts", _split_count(_T_SPLIT, "address_id"))
def n7_counts(t):
    return evaluation.split_counts(evaluation.temporal_split(t.visits), "address_id")


@query("n8_geography_holdout", _summary(_GEO, f"SELECT * FROM ({FRAME_SQL}) WHERE town_id = (SELECT max(town_id) FROM ({FRAME_SQL}))"))
def n8(t):
    return rounded(evaluation.geography_holdout(frame(t)))


@query("n9_account_split_summary", _split_eval(_A_SPLIT))
def n9(t):
    return rounded(evaluation.evaluate_split(frame(t), evaluation.account_temporal_split(t.visits)))


@query("n9_account_split_counts", _split_count(_A_SPLIT, "account_id"))
def n9_counts(t):
    return evaluation.split_counts(evaluation.account_temporal_split(t.visits), "account_id")


@query("n10_region_split")
def n10(t):
    split = evaluation.region_split(t.surveyed, "surveyed_x", "surveyed_y", "address_id")
    return split.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("n_test"))


@query(
    "n11_recency_split",
    "SELECT visit_id, account_id, rn <= greatest(1, floor(n * 0.25)) AS is_test FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY checkin_ts DESC, visit_id DESC) AS rn, count(*) OVER (PARTITION BY account_id) AS n FROM v_visits)",
)
def n11(t):
    return evaluation.recency_split(t.visits).select("visit_id", "account_id", "is_test")


_HASH = "CAST(concat('0x', substr(sha256(CAST(account_id AS VARCHAR)), 1, 8)) AS BIGINT) % 5 <> 0"


@query("i7_account_hash_split", f"SELECT account_id, {_HASH} AS is_train FROM v_accounts")
def i7(t):
    return evaluation.hash_split(t.accounts.select("account_id"))
