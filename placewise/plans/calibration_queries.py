from pyspark.sql import functions as F

from placewise.operators import calibration
from placewise.plans.candidate_queries import _EXAMPLES, learning
from placewise.plans.join_queries import ASOF_SQL, FRAME_SQL, frame, predictions_with_outcome
from placewise.plans.metric_queries import rounded
from placewise.plans.registry import query

_HIT = "error_m <= confidence_radius_m"


@query(
    "j1_evidence_confidence",
    """SELECT a.account_id, round(CASE WHEN v.n IS NULL THEN 0.3 WHEN v.s IS NULL THEN 0.2 ELSE least(1.0, v.q / v.s + least(0.3, v.n * 0.05)) END, 4) AS evidence_confidence
FROM v_accounts a LEFT JOIN (SELECT account_id, count(*) AS n, sum(r) AS s, sum(r * r) AS q FROM (SELECT account_id, nullif(greatest(0, (dwell_s - 60) / 3000), 0) AS r FROM v_visits) GROUP BY 1) v ON v.account_id = a.account_id""",
)
def j1(t):
    trust = F.greatest(F.lit(0.0), (F.col("dwell_s") - 60) / 3000)
    sums = calibration.evidence_sums(t.visits.select("account_id", trust.alias("reliability")), "account_id")
    rows = t.accounts.select("account_id").join(sums, "account_id", "left").withColumn("n", F.col("n_reliabilities"))
    return rounded(rows.select("account_id", calibration.evidence_confidence("n").alias("evidence_confidence")))


@query(
    "j2_candidate_agreement",
    _EXAMPLES + """, r AS (SELECT address_id, probability AS p FROM (SELECT *, row_number() OVER (PARTITION BY address_id ORDER BY probability DESC, source, source_reference) AS rn FROM sc) WHERE rn <= 5),
 t AS (SELECT address_id, count(*) AS k, sum(p) AS s FROM r GROUP BY 1)
SELECT t.address_id, round(CASE WHEN any_value(k) < 2 THEN 0.5 WHEN any_value(s) = 0 THEN 0.3 ELSE greatest(0, least(1, 1 - sum(CASE WHEN p > 0 THEN -(p / s) * ln(p / s + 1e-10) ELSE 0 END) / ln(any_value(k)))) END, 4) AS agreement FROM r JOIN t ON t.address_id = r.address_id GROUP BY 1""",
)
def j2(t):
    from placewise.operators.ranking import rank

    rows = learning(t).withColumn("_tie", F.concat_ws("|", "source", "source_reference"))
    return rounded(calibration.candidate_agreement(rank(rows, "address_id", "_tie"), "address_id"))


@query(
    "j3_j7_confidence_radius_action",
    """SELECT prediction_id, round(c, 6) AS combined, round(greatest(10, least(5000, 500 * (1 - c) + 10)), 4) AS radius_m, CASE WHEN c >= 0.85 AND 500 * (1 - c) + 10 <= 100 THEN 'VISIT_DIRECTLY' WHEN c >= 0.6 AND 500 * (1 - c) + 10 <= 500 THEN 'VERIFY_FIRST' ELSE 'LOW_CONFIDENCE' END AS action
FROM (SELECT *, greatest(0, least(1, CASE WHEN confidence = 0 THEN 0.5 ELSE confidence END * 0.5 + (prediction_id % 50) / 50.0 * 0.3 + (prediction_id % 20) / 20.0 * 0.2)) AS c FROM v_predictions)""",
)
def j3(t):
    rows = t.predictions.withColumns(
        {"evidence_confidence": F.col("prediction_id") % 50 / 50.0, "agreement": F.col("prediction_id") % 20 / 20.0}
    )
    rows = rows.withColumn("combined", calibration.combined_confidence("confidence"))
    rows = rows.withColumn("radius_m", calibration.heuristic_radius("combined"))
    rows = rows.withColumn("action", calibration.recommended_action("combined", "radius_m"))
    return rows.select("prediction_id", F.round("combined", 6).alias("combined"), F.round("radius_m", 4).alias("radius_m"), "action")


@query("j4_isotonic_calibration")
def j4(t):
    """Monotone calibration of the stated confidence against hits within the stated radius."""
    rows = predictions_with_outcome(t)
    model = calibration.fit_isotonic(rows, "confidence", F.col("error_m") <= F.col("confidence_radius_m"))
    out = calibration.apply_isotonic(rows, "confidence", model)
    return rounded(out.select("prediction_id", "confidence", "calibrated"), 6)


@query("j5_platt_calibration")
def j5(t):
    rows = predictions_with_outcome(t)
    model = calibration.fit_platt(rows, "confidence", F.col("error_m") <= F.col("confidence_radius_m"))
    return rounded(calibration.apply_platt(rows, "confidence", model).select("prediction_id", "confidence", "calibrated"))


@query(
    "j6_radius_from_errors",
    f"""WITH e AS (SELECT list_sort(list(baseline_error_m)) AS v, count(baseline_error_m) AS n FROM ({FRAME_SQL}) WHERE baseline_error_m IS NOT NULL)
SELECT prediction_id, round(least(5000, greatest(10, v[CAST(floor(pos) AS BIGINT) + 1] + (v[CAST(ceil(pos) AS BIGINT) + 1] - v[CAST(floor(pos) AS BIGINT) + 1]) * (pos - floor(pos)))), 4) AS radius_m
FROM (SELECT p.prediction_id, e.v, p.confidence * (e.n - 1) AS pos FROM v_predictions p, e)""",
)
def j6(t):
    out = calibration.radius_from_errors(t.predictions, "confidence", frame(t), "baseline_error_m")
    return rounded(out.select("prediction_id", "radius_m"))


_BIN = "CAST(" + " + ".join(f"CAST(confidence >= {k} * CAST(0.1 AS DOUBLE) AS INT)" for k in range(1, 10)) + " AS INT)"
_BINS = f"SELECT {_BIN} AS bin, avg(confidence) AS predicted, avg(CAST({_HIT} AS INT)) AS actual, count(*) AS count FROM ({ASOF_SQL}) GROUP BY 1"
_PART = f"SELECT *, count / (SELECT sum(count) FROM ({_BINS})) * abs(predicted - actual) AS ece_part FROM ({_BINS})"


@query("j10_operational_calibration", f"SELECT bin, round(predicted, 6) AS predicted, round(actual, 4) AS actual, count, round(ece_part, 6) AS ece_part FROM ({_PART})")
def j10(t):
    out = calibration.reliability_table(predictions_with_outcome(t), "confidence", F.col("error_m") <= F.col("confidence_radius_m"))
    return out.select("bin", F.round("predicted", 6).alias("predicted"), F.round("actual", 4).alias("actual"), "count", F.round("ece_part", 6).alias("ece_part"))


@query(
    "j8_calibration_report",
    f"""SELECT round(avg(CAST({_HIT} AS INT)), 4) AS coverage, round(avg(confidence_radius_m), 4) AS mean_radius, round(avg(abs(confidence - CAST({_HIT} AS INT))), 4) AS calibration_error,
 round(quantile_cont(confidence_radius_m, 0.5), 4) AS median_radius, round(quantile_cont(confidence_radius_m, 0.9), 4) AS p90_radius, (SELECT round(sum(ece_part), 4) FROM ({_PART})) AS ece FROM ({ASOF_SQL})""",
)
def j8(t):
    return rounded(calibration.calibration_report(predictions_with_outcome(t), "confidence", "error_m", "confidence_radius_m"))


@query(
    "j9_dataset_calibration",
    f"""SELECT b.bin, round(coalesce(x.p, b.bin / 10 + 0.05), 6) AS predicted, round(coalesce(x.a, 0), 4) AS actual, coalesce(x.n, 0) AS count,
 round(coalesce(x.n / (SELECT count(*) FROM ({ASOF_SQL})) * abs(x.p - x.a), 0), 6) AS ece_part
FROM (SELECT CAST(unnest(range(10)) AS INT) AS bin) b LEFT JOIN (SELECT {_BIN} AS bin, avg(confidence) AS p, avg(CAST(error_m <= 250 AS INT)) AS a, count(*) AS n FROM ({ASOF_SQL}) WHERE confidence >= 0 AND confidence < 1 GROUP BY 1) x ON x.bin = b.bin""",
)
def j9(t):
    out = calibration.dataset_calibration(predictions_with_outcome(t), "confidence", "error_m")
    return out.select("bin", F.round("predicted", 6).alias("predicted"), F.round("actual", 4).alias("actual"), "count", F.round("ece_part", 6).alias("ece_part"))
