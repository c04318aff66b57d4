from pyspark.sql import functions as F

from placewise.operators import integrity, lookup, reliability, trajectories
from placewise.plans.metric_queries import canonical_visits, rounded
from placewise.plans.registry import query

_CANON = """CASE outcome WHEN 'met_borrower' THEN 'SUCCESSFUL_CONTACT' WHEN 'cash_collected' THEN 'SUCCESSFUL_CONTACT' WHEN 'met_family' THEN 'PARTIAL_CONTACT'
 WHEN 'locked_premises' THEN 'FAILED_SEARCH' ELSE 'ADDRESS_NOT_TRACEABLE' END"""

_TRAJ = """SELECT visit_id, count(*) + 1 AS n_points, sum(d) AS length_m, coalesce(avg(v), 0) AS mean_speed_ms, coalesce(max(v), 0) AS max_speed_ms, coalesce(stddev_samp(v), 0) AS stdev_speed_ms,
  coalesce(sum(dt) FILTER (v < 0.5), 0.0) AS stationary_s, count(*) FILTER (dt > 0 AND d > 500 AND dt < 60) AS gps_jumps, any_value(straight) AS straight_m, CASE WHEN any_value(straight) > 0 THEN any_value(straight) / sum(d) END AS efficiency,
  any_value(sx) AS sx, any_value(sy) AS sy, any_value(ex) AS ex, any_value(ey) AS ey, any_value(span) AS span_s
 FROM (SELECT *, CASE WHEN dt > 0 THEN d / dt END AS v, sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)) AS straight FROM (
  SELECT visit_id, seq, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS d, CAST(offset_s - lag(offset_s) OVER w AS DOUBLE) AS dt,
   first(x) OVER f AS sx, first(y) OVER f AS sy, last(x) OVER f AS ex, last(y) OVER f AS ey, CAST(last(offset_s) OVER f - first(offset_s) OVER f AS DOUBLE) AS span
  FROM v_gps_points WINDOW w AS (PARTITION BY visit_id ORDER BY seq), f AS (PARTITION BY visit_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE d IS NOT NULL) GROUP BY visit_id"""


@query(
    "a2_trajectories",
    "SELECT visit_id, string_agg(concat(seq, ':', CAST(CAST(x AS BIGINT) AS VARCHAR)), ' ' ORDER BY seq) AS trajectory FROM v_gps_points GROUP BY 1",
)
def a2(t):
    text = F.array_join(
        F.transform("trajectory", lambda p: F.concat(p["seq"].cast("string"), F.lit(":"), p["x"].cast("long").cast("string"))), " "
    )
    return trajectories.collect_trajectories(t.gps_points).select("visit_id", text.alias("trajectory"))


@query(
    "f4_f6_trajectory_statistics",
    f"""SELECT visit_id, n_points, round(length_m, 4) AS length_m, round(straight_m, 4) AS straight_m, round(efficiency, 4) AS efficiency, round(mean_speed_ms, 4) AS mean_speed_ms,
 round(max_speed_ms, 4) AS max_speed_ms, round(stationary_s, 4) AS stationary_s, gps_jumps, span_s FROM ({_TRAJ})""",
)
def f4(t):
    out = trajectories.summarise(t.gps_points, "projected_xy")
    keep = ["visit_id", "n_points", "length_m", "straight_m", "efficiency", "mean_speed_ms", "max_speed_ms", "stationary_s", "gps_jumps", "span_s"]
    return rounded(out.select(*keep))


_HIST = f"""h AS (SELECT * FROM (SELECT *, {_CANON} AS canon, row_number() OVER (PARTITION BY account_id ORDER BY checkin_ts DESC, visit_id DESC) AS rn FROM v_visits) WHERE rn <= 100),
hn AS (SELECT account_id, count(*) AS n FROM h GROUP BY 1),
med AS (SELECT visit_id, list_sort(list(d))[CAST(count(*) // 2 AS BIGINT) + 1] AS m FROM (SELECT v.visit_id, sqrt((h.checkin_x - v.checkin_x) * (h.checkin_x - v.checkin_x) + (h.checkin_y - v.checkin_y) * (h.checkin_y - v.checkin_y)) AS d
  FROM v_visits v JOIN h ON h.account_id = v.account_id WHERE h.canon IN ('SUCCESSFUL_CONTACT', 'PARTIAL_CONTACT')) GROUP BY 1)"""

_RELIABILITY = f"""
WITH {_HIST}, tr AS ({_TRAJ}),
p AS (SELECT v.visit_id, v.account_id,
 CASE WHEN gps_accuracy_m = 0 THEN 0.4 WHEN gps_accuracy_m <= 10 THEN 1.0 WHEN gps_accuracy_m <= 30 THEN 0.8 WHEN gps_accuracy_m <= 100 THEN 0.5 WHEN gps_accuracy_m <= 500 THEN 0.2 ELSE 0.1 END AS g,
 CASE WHEN dwell_s = 0 THEN 0.4 WHEN dwell_s >= 300 THEN 1.0 WHEN dwell_s >= 120 THEN 0.8 WHEN dwell_s >= 30 THEN 0.5 ELSE 0.1 END AS d,
 CASE outcome WHEN 'met_borrower' THEN 1.0 WHEN 'cash_collected' THEN 1.0 WHEN 'met_family' THEN 0.7 WHEN 'locked_premises' THEN 0.2 ELSE 0.1 END AS o,
 CASE WHEN tr.efficiency IS NULL THEN 0.4 WHEN tr.efficiency >= 0.9 THEN 1.0 WHEN tr.efficiency >= 0.7 THEN 0.8 WHEN tr.efficiency >= 0.5 THEN 0.5 ELSE 0.2 END AS t,
 CASE WHEN hn.n <= 1 THEN 0.5 WHEN med.m IS NULL THEN 0.3 WHEN med.m <= 50 THEN 1.0 WHEN med.m <= 100 THEN 0.8 WHEN med.m <= 250 THEN 0.5 WHEN med.m <= 500 THEN 0.2 ELSE 0.1 END AS c,
 CASE WHEN k <= 50 THEN 1.0 WHEN k <= 100 THEN 0.8 WHEN k <= 250 THEN 0.5 WHEN k <= 500 THEN 0.3 WHEN k IS NOT NULL THEN 0.1 END AS l
 FROM (SELECT v.*, sqrt((s.surveyed_x - v.checkin_x) * (s.surveyed_x - v.checkin_x) + (s.surveyed_y - v.checkin_y) * (s.surveyed_y - v.checkin_y)) AS k FROM v_visits v LEFT JOIN v_surveyed s ON s.address_id = v.address_id) v
 LEFT JOIN tr ON tr.visit_id = v.visit_id LEFT JOIN hn ON hn.account_id = v.account_id LEFT JOIN med ON med.visit_id = v.visit_id)
SELECT visit_id, CAST(c AS DOUBLE) AS consistency, round((g * 0.2 + d * 0.15 + o * 0.25 + t * 0.15 + 0.5 * 0.1 + c * 0.1 + coalesce(l, 0) * 0.05) / (0.95 + CASE WHEN l IS NULL THEN 0 ELSE 0.05 END), 4) AS reliability,
 concat_ws(',', CASE WHEN g < 0.3 THEN 'poor_gps_accuracy' END, CASE WHEN d < 0.3 THEN 'short_dwell_time' END, CASE WHEN o < 0.3 THEN 'unfavorable_outcome' END, CASE WHEN t < 0.3 THEN 'poor_trajectory' END, CASE WHEN l < 0.3 THEN 'far_from_known_location' END) AS flags
FROM p"""


@query("f1_f10_visit_reliability", _RELIABILITY)
def f10(t):
    visits = canonical_visits(t).join(t.surveyed, "address_id", "left")
    history = lookup.newest_visits(canonical_visits(t), "account_id")
    scored = reliability.score(
        visits, trajectories.summarise(t.gps_points, "projected_xy"), history, "projected_xy", known=("surveyed_x", "surveyed_y")
    )
    return scored.select(
        "visit_id", "consistency", F.round("reliability", 4).alias("reliability"), F.array_join("flags", ",").alias("flags")
    )


_FREQ = "SELECT printf('%.6f,%.6f', checkin_x, checkin_y) AS coordinate, count(*) AS coordinate_visits, count(DISTINCT account_id) AS coordinate_accounts FROM v_visits GROUP BY 1"


@query(
    "g1_coordinate_frequency",
    f"SELECT *, round(CAST(coordinate_visits AS DOUBLE) / (SELECT max(coordinate_visits) FROM ({_FREQ})), 4) AS coordinate_rank FROM ({_FREQ})",
)
def g1(t):
    return rounded(integrity.coordinate_frequency(t.visits, "checkin_x", "checkin_y"))


_MEET = """SELECT agent_id, checkin_x AS meet_a, checkin_y AS meet_b, n AS meet_visits FROM (SELECT agent_id, checkin_x, checkin_y, count(*) AS n, row_number() OVER (PARTITION BY agent_id ORDER BY count(*) DESC, min(checkin_ts)) AS rn
 FROM v_visits GROUP BY 1, 2, 3) WHERE rn = 1 AND n >= 3"""


@query("g2_agent_meeting_points", _MEET)
def g2(t):
    return integrity.meeting_points(t.visits, "checkin_x", "checkin_y")


_SIM = f"""SELECT a.visit_id, count(*) FILTER (s > 0.99) AS identical_trajectories, coalesce(max(s) FILTER (s <= 0.99 AND s > 0.95), 0.0) AS trajectory_similarity FROM (
 SELECT t1.visit_id, CASE WHEN t2.visit_id IS NULL THEN NULL ELSE (2.0 - least(1.0, (sqrt((t1.sx - t2.sx) * (t1.sx - t2.sx) + (t1.sy - t2.sy) * (t1.sy - t2.sy)) + sqrt((t1.ex - t2.ex) * (t1.ex - t2.ex) + (t1.ey - t2.ey) * (t1.ey - t2.ey))) / 200)
   - abs(t1.n_points - t2.n_points) / greatest(t1.n_points, t2.n_points)) / 2 END AS s
 FROM (SELECT tr.*, v.agent_id FROM ({_TRAJ}) tr JOIN v_visits v ON v.visit_id = tr.visit_id) t1 LEFT JOIN (SELECT tr.*, v.agent_id FROM ({_TRAJ}) tr JOIN v_visits v ON v.visit_id = tr.visit_id) t2
  ON t2.agent_id = t1.agent_id AND t2.visit_id <> t1.visit_id) a GROUP BY 1"""


@query("g8_similar_trajectories", f"SELECT visit_id, identical_trajectories, round(trajectory_similarity, 4) AS trajectory_similarity FROM ({_SIM})")
def g8(t):
    return rounded(integrity.similar_trajectories(t.visits, trajectories.summarise(t.gps_points, "projected_xy")))


_INTEGRITY = f"""
WITH fr AS ({_FREQ}), mp AS ({_MEET}), sm AS ({_SIM}), tr AS ({_TRAJ}),
sh AS (SELECT agent_id, count(*) FILTER (dwell_s <> 0 AND dwell_s < 10) AS n FROM v_visits GROUP BY 1),
x AS (SELECT v.visit_id, fr.coordinate_visits AS n, CAST(fr.coordinate_visits AS DOUBLE) / (SELECT max(coordinate_visits) FROM fr) AS rank,
  sqrt((v.checkin_x - h.home_a) * (v.checkin_x - h.home_a) + (v.checkin_y - h.home_b) * (v.checkin_y - h.home_b)) AS home,
  sqrt((v.checkin_x - mp.meet_a) * (v.checkin_x - mp.meet_a) + (v.checkin_y - mp.meet_b) * (v.checkin_y - mp.meet_b)) AS meet,
  CASE WHEN dwell_s <> 0 THEN dwell_s ELSE tr.span_s END AS dur, tr.max_speed_ms * 3.6 AS v, tr.gps_jumps AS j, sm.identical_trajectories AS idt, sm.trajectory_similarity AS sim, gps_accuracy_m AS acc, sh.n AS short_n, hour(checkin_ts) AS hr
 FROM v_visits v JOIN fr ON fr.coordinate = printf('%.6f,%.6f', v.checkin_x, v.checkin_y) LEFT JOIN mp ON mp.agent_id = v.agent_id LEFT JOIN sm ON sm.visit_id = v.visit_id LEFT JOIN tr ON tr.visit_id = v.visit_id LEFT JOIN sh ON sh.agent_id = v.agent_id
 LEFT JOIN (SELECT concat('A', s_suppkey % 20) AS agent_id, CAST(max(s_suppkey) * 10 AS DOUBLE) AS home_a, CAST(max(s_suppkey) * 5 AS DOUBLE) AS home_b FROM supplier GROUP BY 1) h ON h.agent_id = v.agent_id),
s AS (SELECT visit_id, greatest(0, least(1, 1.0 - CASE WHEN n >= 3 THEN 0.3 WHEN n > 1 THEN 0.15 ELSE 0 END - CASE WHEN home < 100 THEN 0.25 ELSE 0 END - CASE WHEN meet < 50 THEN 0.3 ELSE 0 END - CASE WHEN dur < 10 THEN 0.2 ELSE 0 END - CASE WHEN v > 80 THEN 0.4 ELSE 0 END
  - CASE WHEN j > 0 THEN 0.15 ELSE 0 END - CASE WHEN idt > 0 THEN 0.35 WHEN sim > 0.95 THEN 0.2 ELSE 0 END - CASE WHEN acc > 500 THEN 0.15 ELSE 0 END - CASE WHEN short_n >= 3 THEN 0.2 ELSE 0 END - CASE WHEN hr < 6 OR hr > 22 THEN 0.1 ELSE 0 END
  - CASE WHEN rank > 0.5 THEN 0.1 * rank ELSE 0 END - CASE WHEN v > 80 THEN least(0.3, (v - 80) / 200) ELSE 0 END - CASE WHEN acc > 100 THEN least(0.2, (acc - 100) / 1000) ELSE 0 END)) AS score,
 concat_ws(',', CASE WHEN n >= 3 THEN concat('repeated_coordinates_', n, '_accounts') WHEN n > 1 THEN concat('shared_coordinates_', n, '_accounts') END, CASE WHEN home < 100 THEN 'near_agent_home' END, CASE WHEN meet < 50 THEN 'common_meeting_point' END,
  CASE WHEN dur < 10 THEN 'extremely_short_visit' END, CASE WHEN v > 80 THEN printf('impossible_speed_%.0fkmh', v) END, CASE WHEN j > 0 THEN concat('gps_jumps_', j) END, CASE WHEN idt > 0 THEN concat('identical_trajectories_', idt) WHEN sim > 0.95 THEN printf('highly_similar_trajectory_%.2f', sim) END,
  CASE WHEN acc > 500 THEN 'poor_gps_accuracy' END, CASE WHEN short_n >= 3 THEN 'pattern_short_visits' END, CASE WHEN hr < 6 OR hr > 22 THEN 'unusual_timing' END) AS risk_factors FROM x)
SELECT visit_id, round(score, 4) AS integrity, risk_factors, CASE WHEN round(score, 9) >= 0.7 THEN 'LOW' WHEN round(score, 9) >= 0.4 THEN 'MEDIUM' WHEN round(score, 9) >= 0.2 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level FROM s"""


@query("g1_g12_visit_integrity", _INTEGRITY)
def g12(t):
    homes = t.supplier.groupBy(F.concat(F.lit("A"), F.col("s_suppkey") % 20).alias("agent_id")).agg(
        (F.max("s_suppkey") * 10).cast("double").alias("home_a"), (F.max("s_suppkey") * 5).cast("double").alias("home_b")
    )
    found = integrity.detect(t.visits, trajectories.summarise(t.gps_points, "projected_xy"), agent_homes=homes)
    return found.select(
        "visit_id", F.round("integrity", 4).alias("integrity"), F.array_join("risk_factors", ",").alias("risk_factors"), "risk_level"
    )
