from pyspark.sql import functions as F

from placewise.functions import geo
from placewise.operators import lookup, metrics
from placewise.plans.join_queries import ASOF_SQL, FRAME_SQL, frame, predictions_with_outcome
from placewise.plans.registry import query


def rounded(df, digits=4):
    """Round every double so that values compare across engines."""
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


_SUM = """count(*) AS n, round(avg(error_m), 4) AS mean_error_m,
  round(avg(CAST(error_m <= 50 AS INT)), 4) AS within_50m, round(avg(CAST(error_m <= 100 AS INT)), 4) AS within_100m,
  round(avg(CAST(error_m <= 250 AS INT)), 4) AS within_250m, round(avg(CAST(error_m <= 500 AS INT)), 4) AS within_500m"""
_QUANT = """round(quantile_cont(error_m, 0.5), 4) AS median_error_m, round(quantile_cont(error_m, 0.75), 4) AS p75_error_m,
  round(quantile_cont(error_m, 0.9), 4) AS p90_error_m, round(quantile_cont(error_m, 0.95), 4) AS p95_error_m"""
_COVER = """round(avg(CAST(error_m <= radius_m AS INT)), 4) AS coverage, round(avg(radius_m), 4) AS mean_radius_m,
  round(avg(abs(CAST(error_m <= radius_m AS INT) - {stated})), 4) AS calibration_error,
  round(quantile_cont(radius_m, 0.5), 4) AS median_radius_m, round(quantile_cont(radius_m, 0.9), 4) AS p90_radius_m"""


def summary_sql(source: str, stated: str = "greatest(0, least(1, 1 - radius_m / 1000))", keys: str = "", extra: str = "") -> str:
    head, tail = (f"{keys}, ", f" GROUP BY {keys}") if keys else ("", "")
    return f"SELECT {head}{_SUM}, {_QUANT}, {_COVER.format(stated=stated)}{extra} FROM ({source}) WHERE error_m IS NOT NULL{tail}"


_BASE_PRED = f"SELECT *, baseline_error_m AS error_m, 500.0::DOUBLE AS radius_m FROM ({FRAME_SQL})"


@query("m1_error_summary", summary_sql(_BASE_PRED))
def m1(t):
    rows = frame(t).withColumn("radius_m", F.lit(500.0))
    return rounded(metrics.error_summary(rows, error="baseline_error_m", radius="radius_m"))


@query("m1_error_summary_by_town", summary_sql(_BASE_PRED, keys="town_id"))
def m1_town(t):
    rows = frame(t).withColumn("radius_m", F.lit(500.0))
    return rounded(metrics.error_summary(rows, ["town_id"], "baseline_error_m", "radius_m"))


_INDEX = "list_sort(list(error_m))[CAST(least(count(*) - 1, floor(count(*) * {q})) AS BIGINT) + 1]"
_INDEX_SUM = (
    "count(*) AS total_evaluated, round(avg(error_m), 4) AS mean_error_m, round(max(error_m), 4) AS max_error_m, round(min(error_m), 4) AS min_error_m, "
    + ", ".join(f"round(avg(CAST(error_m <= {w} AS INT)), 4) AS within_{w}m" for w in (50, 100, 250, 500, 1000))
    + ", "
    + ", ".join(
        f"round({_INDEX.format(q=q)}, 4) AS {n}"
        for n, q in (("median_error_m", 0.5), ("p75_error_m", 0.75), ("p90_error_m", 0.9), ("p95_error_m", 0.95))
    )
)


@query("m2_index_error_summary", f"SELECT {_INDEX_SUM} FROM (SELECT baseline_error_m AS error_m FROM ({FRAME_SQL})) WHERE error_m IS NOT NULL")
def m2(t):
    return rounded(metrics.index_error_summary(frame(t), error="baseline_error_m"))


_ASOF = f"SELECT *, confidence_radius_m AS radius_m, CASE WHEN confidence >= 0.85 AND confidence_radius_m <= 100 THEN 'VISIT_DIRECTLY' WHEN confidence >= 0.6 AND confidence_radius_m <= 500 THEN 'VERIFY_FIRST' ELSE 'LOW_CONFIDENCE' END AS action FROM ({ASOF_SQL})"


@query(
    "m3_m4_coverage_and_low_confidence",
    summary_sql(_ASOF, stated="confidence", extra=", round(avg(CAST(action = 'LOW_CONFIDENCE' AS INT)), 4) AS low_confidence_rate"),
)
def m3(t):
    from placewise.operators.calibration import recommended_action

    rows = predictions_with_outcome(t).withColumn("action", recommended_action("confidence", "confidence_radius_m"))
    return rounded(metrics.error_summary(rows, radius="confidence_radius_m", confidence="confidence", action="action"))


def canonical_visits(t):
    return t.visits.withColumn("outcome", lookup.canonical_outcome("outcome"))


@query(
    "m5_system_metrics",
    """
SELECT (SELECT count(*) FROM v_accounts) AS total_accounts, (SELECT count(*) FROM v_visits) AS total_visits,
 (SELECT count(*) FROM v_predictions) AS predictions_made, (SELECT round(avg(CAST(confidence >= 0.85 AS INT)), 4) FROM v_predictions) AS high_confidence_rate,
 (SELECT round(avg(CAST(outcome = 'address_not_traceable' AS INT)), 4) FROM v_visits) AS address_not_traceable_rate,
 (SELECT count(*) FROM v_visits WHERE outcome IN ('met_borrower', 'met_family', 'cash_collected')) AS productive_visits""",
)
def m5(t):
    return rounded(metrics.system_metrics(t.accounts, canonical_visits(t), t.predictions))


_LEVELS = """SELECT account_id, 'city' AS level, city AS territory FROM v_accounts UNION ALL SELECT account_id, 'district', city FROM v_accounts
 UNION ALL SELECT account_id, 'pincode', pincode FROM v_accounts UNION ALL SELECT account_id, 'locality', locality FROM v_accounts"""


@query(
    "m6_territory_metrics",
    f"""
SELECT a.*, round(v.nt, 4) AS not_traceable_rate FROM (
 SELECT level, territory, count(DISTINCT account_id) AS accounts, count(*) AS evaluated_predictions,
   round(avg(CAST(error_m <= confidence_radius_m AS INT)), 4) AS confidence_coverage,
   round({_INDEX.format(q=0.5)}, 4) AS median_error_m, round({_INDEX.format(q=0.9)}, 4) AS p90_error_m
 FROM ({ASOF_SQL}) x JOIN ({_LEVELS}) l USING (account_id) GROUP BY level, territory) a
LEFT JOIN (SELECT level, territory, avg(CAST(outcome = 'address_not_traceable' AS INT)) AS nt FROM v_visits JOIN ({_LEVELS}) l USING (account_id) GROUP BY 1, 2) v
 ON v.level = a.level AND v.territory = a.territory""",
)
def m6(t):
    return rounded(metrics.territory_metrics(predictions_with_outcome(t), t.accounts, canonical_visits(t)))


@query(
    "m7_town_metrics",
    f"""
SELECT w.town_id, w.town_name, x.surveyed_addresses, x.mean_error_m, x.within_50m, x.within_100m, x.within_250m, x.within_500m, x.median_error_m, x.p90_error_m, coalesce(c.n, 0) AS accounts
FROM (SELECT town_id, count(*) AS surveyed_addresses, round(avg(error_m), 4) AS mean_error_m,
  {", ".join(f"round(avg(CAST(error_m <= {w} AS INT)), 4) AS within_{w}m" for w in (50, 100, 250, 500))},
  round({_INDEX.format(q=0.5)}, 4) AS median_error_m, round({_INDEX.format(q=0.9)}, 4) AS p90_error_m
  FROM (SELECT town_id, baseline_error_m AS error_m FROM ({FRAME_SQL})) WHERE error_m IS NOT NULL GROUP BY town_id) x
JOIN v_towns w ON w.town_id = x.town_id LEFT JOIN (SELECT town_id, count(*) AS n FROM v_accounts GROUP BY 1) c ON c.town_id = x.town_id""",
)
def m7(t):
    scored = frame(t).select("town_id", F.col("baseline_error_m").alias("error_m"))
    return rounded(metrics.town_metrics(scored, t.accounts, t.towns))


_PROD = """SELECT agent_id, CAST(checkin_ts AS DATE) AS day, count(*) AS visits,
 count(*) FILTER (outcome IN ('met_borrower', 'met_family', 'cash_collected')) AS productive,
 count(*) FILTER (outcome = 'address_not_traceable') AS not_traceable FROM v_visits GROUP BY 1, 2"""


@query("m8_productivity_agent_day", _PROD)
def m8(t):
    return metrics.productivity(canonical_visits(t))


@query(
    "m8_productivity_totals",
    f"""SELECT count(*) AS agent_days, CAST(sum(productive) AS BIGINT) AS productive_visits, CAST(sum(visits) AS BIGINT) AS visits,
 round(CAST(sum(productive) AS DOUBLE) / count(*), 4) AS productive_visits_per_agent_day, round(CAST(sum(not_traceable) AS DOUBLE) / sum(visits), 4) AS not_traceable_rate
 FROM ({_PROD})""",
)
def m8_totals(t):
    return rounded(metrics.productivity_totals(metrics.productivity(canonical_visits(t))))


@query(
    "m9_error_histogram",
    f"""SELECT CASE WHEN e <= 50 THEN '0-50m' WHEN e <= 100 THEN '50-100m' WHEN e <= 250 THEN '100-250m' WHEN e <= 500 THEN '250-500m' WHEN e <= 1000 THEN '500-1000m' ELSE '>1000m' END AS range, count(*) AS count
 FROM (SELECT baseline_error_m AS e FROM ({FRAME_SQL})) WHERE e IS NOT NULL GROUP BY 1""",
)
def m9(t):
    return metrics.error_histogram(frame(t), "baseline_error_m")


@query(
    "m10_account_evidence",
    """
SELECT t.*, v.visit_ids FROM (SELECT account_id, count(*) AS total_visits, count(*) FILTER (outcome IN ('met_borrower', 'met_family', 'cash_collected')) AS successful_visits,
 count(*) FILTER (outcome NOT IN ('met_borrower', 'met_family', 'cash_collected')) AS failed_visits FROM v_visits GROUP BY 1) t
JOIN (SELECT account_id, string_agg(CAST(visit_id AS VARCHAR), ',' ORDER BY rn) AS visit_ids FROM (SELECT account_id, visit_id, row_number() OVER (PARTITION BY account_id ORDER BY checkin_ts DESC, visit_id DESC) AS rn FROM v_visits) WHERE rn <= 100 GROUP BY 1) v
 ON v.account_id = t.account_id""",
)
def m10(t):
    ids = F.array_join(F.transform("visits", lambda v: v["visit_id"].cast("string")), ",")
    return metrics.account_evidence(canonical_visits(t)).withColumn("visit_ids", ids).drop("visits")


@query(
    "m11_location_features",
    """
SELECT a.account_id, a.confidence, a.confidence_radius_m, coalesce(v.s, 0) AS successful_visits, coalesce(v.f, 0) AS failed_searches, a.latitude IS NOT NULL AS confirmed_location
FROM v_accounts a LEFT JOIN (SELECT account_id, count(*) FILTER (outcome IN ('met_borrower', 'met_family', 'cash_collected')) AS s,
 count(*) FILTER (outcome IN ('locked_premises', 'address_not_traceable')) AS f FROM v_visits GROUP BY 1) v ON v.account_id = a.account_id""",
)
def m11(t):
    out = metrics.location_features(t.accounts, canonical_visits(t))
    return out.select(
        "account_id", "confidence", "confidence_radius_m", "successful_visits", "failed_searches",
        F.col("latitude").isNotNull().alias("confirmed_location"),
    )


@query(
    "m12_latest_prediction",
    """SELECT account_id, prediction_id, ts, confidence FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY ts DESC, prediction_id DESC) AS rn FROM v_predictions) WHERE rn = 1""",
)
def m12(t):
    return metrics.latest_prediction(t.predictions)


@query(
    "m12_prediction_history",
    """SELECT account_id, prediction_id, ts, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY account_id ORDER BY ts DESC, prediction_id DESC) AS INT) AS rank FROM v_predictions) WHERE rank <= 20""",
)
def m12_history(t):
    return metrics.latest_predictions(t.predictions).select("account_id", "prediction_id", "ts", "rank")


@query(
    "m13_visit_planner",
    """
WITH d AS (SELECT *, sqrt(power((latitude - 12.96) * 111.32, 2) + power((longitude - 77.6) * 111.32 * cos(radians(12.96)), 2)) AS km FROM v_accounts WHERE latitude IS NOT NULL)
SELECT account_id, round(km, 6) AS distance_km, confidence, CASE WHEN coalesce(confidence, 0) < 0.5 THEN 'verify_first' ELSE 'visit_directly' END AS recommended_action FROM d WHERE km <= 3
ORDER BY CASE WHEN coalesce(confidence, 0) < 0.5 THEN 0 ELSE 1 END, km NULLS LAST, coalesce(confidence, 0) DESC, account_id LIMIT 100""",
)
def m13(t):
    plan = metrics.plan_visits(t.accounts, (12.96, 77.6), 3.0, 100)
    return plan.select("account_id", F.round("distance_km", 6).alias("distance_km"), "confidence", "recommended_action")


@query(
    "m14_data_quality",
    """
SELECT 'visits' AS table_name, count(*) AS n_rows, CAST(10 AS BIGINT) AS n_columns, CAST(0 AS BIGINT) AS null_cells, count(visit_id) - count(DISTINCT visit_id) AS duplicate_ids FROM v_visits
UNION ALL SELECT 'accounts', count(*), 11, CAST(count(*) FILTER (latitude IS NULL) * 5 AS BIGINT), count(account_id) - count(DISTINCT account_id) FROM v_accounts
UNION ALL SELECT 'visits_by_account', count(*), 10, 0, count(account_id) - count(DISTINCT account_id) FROM v_visits""",
)
def m14(t):
    visits = metrics.data_quality(t.visits, "visits", "visit_id")
    accounts = metrics.data_quality(t.accounts, "accounts", "account_id")
    by_account = metrics.data_quality(t.visits, "visits_by_account", "account_id")
    return visits.unionByName(accounts).unionByName(by_account)


@query(
    "m15_outcome_profile",
    """
SELECT v.outcome, count(*) AS visits, round(avg(CASE WHEN g.visit_id IS NULL THEN 0.0 ELSE 1.0 END), 4) AS gps_share,
 round(quantile_cont(gps_accuracy_m, 0.5), 4) AS median_accuracy_m, round(quantile_cont(dwell_s, 0.5), 4) AS median_dwell_s
FROM v_visits v LEFT JOIN (SELECT DISTINCT visit_id FROM v_gps_points WHERE offset_s > 60) g ON g.visit_id = v.visit_id GROUP BY 1""",
)
def m15(t):
    return rounded(metrics.outcome_profile(t.visits, t.gps_points.filter("offset_s > 60")))


@query("m16_outcome_counts", "SELECT outcome, count(*) AS count FROM v_visits GROUP BY 1")
def m16(t):
    return metrics.value_counts(t.visits, "outcome")


@query("m16_address_types", "SELECT address_type, count(*) AS count FROM v_address_book GROUP BY 1")
def m16_types(t):
    return metrics.value_counts(t.address_book, "address_type")


@query("m16_address_sources", "SELECT source, count(*) AS count FROM v_address_book GROUP BY 1")
def m16_sources(t):
    return metrics.value_counts(t.address_book, "source")


@query("m16_top_agents", "SELECT agent_id, count(*) AS count FROM v_visits GROUP BY 1 ORDER BY count(*) DESC, agent_id LIMIT 10")
def m16_top(t):
    return metrics.value_counts(t.visits, "agent_id").orderBy(F.col("count").desc(), "agent_id").limit(10)


@query(
    "m17_coordinate_ranges",
    """
SELECT 'visits' AS table_name, min(checkin_x) AS min_x, max(checkin_x) AS max_x, min(checkin_y) AS min_y, max(checkin_y) AS max_y FROM v_visits
UNION ALL SELECT 'surveyed', min(surveyed_x), max(surveyed_x), min(surveyed_y), max(surveyed_y) FROM v_surveyed
UNION ALL SELECT 'baseline', min(geocoder_x), max(geocoder_x), min(geocoder_y), max(geocoder_y) FROM v_baseline""",
)
def m17(t):
    return metrics.coordinate_ranges(
        {
            "visits": (t.visits, "checkin_x", "checkin_y"),
            "surveyed": (t.surveyed, "surveyed_x", "surveyed_y"),
            "baseline": (t.baseline, "geocoder_x", "geocoder_y"),
        }
    )


@query(
    "m18_numeric_describe",
    """SELECT 'dwell_s' AS column_name, count(dwell_s) AS count, round(avg(dwell_s), 4) AS mean, round(stddev_samp(dwell_s), 4) AS std, CAST(min(dwell_s) AS DOUBLE) AS min, CAST(max(dwell_s) AS DOUBLE) AS max,
 round(quantile_cont(CAST(dwell_s AS DOUBLE), 0.5), 4) AS p50, round(quantile_cont(CAST(dwell_s AS DOUBLE), 0.9), 4) AS p90 FROM v_visits""",
)
def m18(t):
    return rounded(metrics.describe_numeric(t.visits, "dwell_s"))


@query(
    "m19_robustness",
    f"""SELECT round(1 - least(1.0, (SELECT stddev_samp(m) FROM (SELECT quantile_cont(baseline_error_m, 0.5) AS m FROM ({FRAME_SQL}) GROUP BY town_id))
 / greatest(1.0, (SELECT quantile_cont(baseline_error_m, 0.5) FROM ({FRAME_SQL})))), 4) AS robustness""",
)
def m19(t):
    return rounded(metrics.robustness(frame(t), "town_id", "baseline_error_m"))


@query(
    "m20_dataset_summary",
    f"""SELECT (SELECT count(*) FROM v_addresses) AS addresses, (SELECT count(*) FROM v_visits) AS visits, (SELECT count(*) FROM v_surveyed) AS surveyed_addresses,
 (SELECT count(geocoder_x) FROM ({FRAME_SQL})) AS baseline_matches""",
)
def m20(t):
    def n(df):
        return df.agg(F.count(F.lit(1)).alias("n")).scalar()

    return frame(t).agg(F.count("geocoder_x").alias("baseline_matches")).select(
        n(t.addresses).alias("addresses"), n(t.visits).alias("visits"), n(t.surveyed).alias("surveyed_addresses"), "baseline_matches"
    )


@query(
    "m21_audit_search",
    "SELECT id, ts, actor_id, resource_id FROM v_audit WHERE action = 'VIEW' AND outcome = 'DENIED' AND ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-25' ORDER BY ts DESC, id DESC LIMIT 100",
)
def m21(t):
    rows = metrics.search_audit(t.audit, since="2024-01-10", until="2024-01-25", action="VIEW", outcome="DENIED")
    return rows.select("id", "ts", "actor_id", "resource_id")


@query(
    "m22_audit_violations",
    "SELECT action, count(*) AS violations FROM v_audit WHERE outcome IN ('DENIED', 'FAILURE') AND ts >= TIMESTAMP '2024-01-05' GROUP BY 1",
)
def m22(t):
    return metrics.audit_violations(t.audit, since="2024-01-05")


@query(
    "m23_task_statistics",
    "SELECT status, count(*) AS tasks, (SELECT round(avg(execution_time_ms), 2) FROM v_tasks) AS average_execution_time_ms FROM v_tasks GROUP BY 1",
)
def m23(t):
    return metrics.task_statistics(t.tasks)


@query(
    "d_distance_functions",
    """
SELECT account_id, round(2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)), 4) AS haversine_m, round(sqrt(dy * dy + dx * dx), 4) AS planner_km,
 round((latitude - 12.97) * 111000, 4) AS north_m, round((longitude - 77.59) * 111000 * cos(radians(12.97)), 4) AS east_m,
 printf('%.6f,%.6f', latitude, longitude) AS coordinate_key
FROM (SELECT *, sin(radians(latitude - 12.97) / 2) * sin(radians(latitude - 12.97) / 2) + cos(radians(12.97)) * cos(radians(latitude)) * sin(radians(longitude - 77.59) / 2) * sin(radians(longitude - 77.59) / 2) AS h,
 (latitude - 12.97) * 111.32 AS dy, (longitude - 77.59) * 111.32 * cos(radians(12.97)) AS dx FROM v_accounts WHERE latitude IS NOT NULL)""",
)
def distances(t):
    lat0, lon0 = F.lit(12.97), F.lit(77.59)
    north, east = geo.local_metres("latitude", "longitude", lat0, lon0)
    out = t.accounts.filter(F.col("latitude").isNotNull()).select(
        "account_id",
        geo.distance_m("wgs84", lat0, lon0, "latitude", "longitude").alias("haversine_m"),
        geo.planner_distance_km(lat0, lon0, "latitude", "longitude").alias("planner_km"),
        north.alias("north_m"),
        east.alias("east_m"),
        geo.coordinate_key("latitude", "longitude").alias("coordinate_key"),
    )
    return rounded(out)
