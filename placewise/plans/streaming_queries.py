import uuid

from pyspark.sql import functions as F

from placewise.operators import lookup, trajectories
from placewise.plans.candidate_queries import geocode_inputs, scored
from placewise.plans.compliance_queries import _COUNTS, _VERDICT, flagged_log, holidays
from placewise.plans.metric_queries import _PROD, rounded
from placewise.plans.place_queries import growth_sql
from placewise.plans.registry import query
from placewise.session import ensure_checkpoint_dir, settled
from placewise.sources.views import Tables
from placewise.streaming import contacts, delivery, refresh
from placewise.streaming import visits as arrivals


class StreamTables(Tables):
    """The same views with ``events`` read as a stream."""

    def base(self, name):
        if name == "events" and name not in self._cache:
            schema = self.spark.read.parquet(f"{self.sf_dir}/events.parquet").schema
            self._cache[name] = self.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(self.sf_dir)
        return super().base(name)


def _folder(t):
    return f"{ensure_checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"


def _canonical(visits):
    return visits.withColumn("outcome", lookup.canonical_outcome("outcome"))


@query(
    "p1_p2_visit_ingest",
    """SELECT visit_id, account_id, CASE WHEN account_id NOT IN (SELECT account_id FROM v_accounts WHERE town_id <> 'T0') THEN 'unknown_account' END AS rejected FROM v_visits""",
)
def p1(t):
    s, folder = StreamTables(t.spark, t.sf_dir), _folder(t)
    accepted = arrivals.check_visits(arrivals.drop_repeats(s.visits), t.accounts.filter("town_id <> 'T0'"))
    arrivals.run_available(accepted.select("visit_id", "account_id", "rejected"), f"{folder}/out", f"{folder}/state")
    return t.spark.read.parquet(f"{folder}/out")


@query(
    "p2_redelivered_visits",
    "SELECT visit_id, account_id, agent_id FROM v_visits",
)
def p2(t):
    """Every third visit is submitted twice; one of both passes."""
    s, folder = StreamTables(t.spark, t.sf_dir), _folder(t)
    again = StreamTables(t.spark, t.sf_dir).visits.filter("visit_id % 3 = 0")
    once = arrivals.drop_repeats(s.visits.unionByName(again))
    arrivals.run_available(once.select("visit_id", "account_id", "agent_id"), f"{folder}/out", f"{folder}/state")
    return t.spark.read.parquet(f"{folder}/out")


@query(
    "p1_quarantined_visits",
    """SELECT visit_id, 'accepted' AS sink, NULL::VARCHAR AS rejected FROM v_visits WHERE account_id IN (SELECT account_id FROM v_accounts WHERE town_id <> 'T0')
 UNION ALL SELECT visit_id, 'quarantine', 'unknown_account' FROM v_visits WHERE account_id NOT IN (SELECT account_id FROM v_accounts WHERE town_id <> 'T0')""",
)
def p1_sinks(t):
    s, folder = StreamTables(t.spark, t.sf_dir), _folder(t)
    arrivals.run_batches(s.visits, delivery.VisitSinks(f"{folder}/sinks", t.accounts.filter("town_id <> 'T0'")), f"{folder}/state")
    accepted = t.spark.read.parquet(f"{folder}/sinks/accepted").select("visit_id", F.lit("accepted").alias("sink"), F.lit(None).cast("string").alias("rejected"))
    return accepted.unionByName(t.spark.read.parquet(f"{folder}/sinks/quarantine").select("visit_id", F.lit("quarantine").alias("sink"), "rejected"))


_TRIES = """SELECT event_id, event_id % 6 AS before, ts AS attempted_at, CASE event_id % 4 WHEN 0 THEN 201 WHEN 1 THEN 503 WHEN 2 THEN 400 END AS http_status,
 CASE WHEN event_id % 8 = 3 THEN 'timeout' END AS error FROM events"""


@query(
    "p3_dead_letter_sinks",
    f"""SELECT event_id, sink, retries, CASE WHEN sink = 'dead_letter' THEN coalesce('HTTP ' || http_status, error, 'Network error') END AS last_error, CASE WHEN sink = 'dead_letter' THEN attempted_at END AS failed_at
 FROM (SELECT *, before + CASE WHEN http_status = 201 THEN 0 ELSE 1 END AS retries, CASE WHEN http_status = 201 THEN 'synced' WHEN before + 1 >= 5 THEN 'dead_letter' ELSE 'pending' END AS sink FROM ({_TRIES}))""",
)
def p3(t):
    """Attempts at queued items, split into three sinks."""
    s, folder = StreamTables(t.spark, t.sf_dir), _folder(t)
    status = F.when(F.col("event_id") % 4 == 0, 201).when(F.col("event_id") % 4 == 1, 503).when(F.col("event_id") % 4 == 2, 400)
    queue = s.base("events").select("event_id", (F.col("event_id") % 6).alias("retries"), F.col("ts").alias("attempted_at"), status.alias("http_status"), F.when(F.col("event_id") % 8 == 3, "timeout").alias("error"))
    arrivals.run_batches(queue, delivery.QueueSinks(f"{folder}/sinks"), f"{folder}/state")
    read = lambda sink: t.spark.read.parquet(f"{folder}/sinks/{sink}").withColumn("sink", F.lit(sink)).drop("batch")
    rows = read("synced").unionByName(read("pending")).unionByName(read("dead_letter"), allowMissingColumns=True)
    return rows.select("event_id", "sink", "retries", "last_error", "failed_at")


@query(
    "p3_p4_queue_statistics",
    "SELECT CASE WHEN event_id % 3 = 0 THEN 'synced' WHEN event_id % 8 >= 5 THEN 'dead_letter' ELSE 'pending' END AS route, count(*) AS items FROM events GROUP BY 1",
)
def p4(t):
    queue = t.events.select(
        "event_id", F.when(F.col("event_id") % 3 == 0, "synced").otherwise("pending").alias("status"), (F.col("event_id") % 8).alias("retries")
    )
    return arrivals.queue_statistics(arrivals.route_failures(queue))


@query(
    "p5_p6_arrival_refresh",
    """SELECT account_id, checkin_x AS x, checkin_y AS y, 0.9::DOUBLE AS confidence, 'visit_confirmed' AS location_source
FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY checkin_ts DESC, visit_id DESC) AS rn FROM v_visits WHERE outcome IN ('met_borrower', 'met_family', 'cash_collected')) WHERE rn = 1""",
)
def p5(t):
    """Score each arriving visit and keep the merged location of the touched accounts."""
    s, folder = StreamTables(t.spark, t.sf_dir), _folder(t)
    handler = arrivals.ArrivalRefresh(t.spark, folder, t.gps_points)
    arrivals.run_batches(_canonical(s.visits), handler, f"{folder}/state")
    return handler.latest_locations().select("account_id", "x", "y", "confidence", "location_source")


@query("p6_refreshed_predictions")
def p6(t):
    """Predictions of the accounts that arriving visits touch."""
    s, folder = StreamTables(t.spark, t.sf_dir), _folder(t)
    tracks = settled(trajectories.summarise(t.gps_points, "projected_xy"))
    refresher = refresh.PredictionRefresh(t.spark, folder, geocode_inputs(t, visits=None), lambda visits: scored(visits, tracks.join(visits.select("visit_id"), "visit_id", "left_semi")))
    arrivals.run_batches(s.visits, refresher, f"{folder}/state")
    out = refresher.latest("predictions")
    return rounded(out.withColumn("evidence", F.array_join("evidence", "; ")), 6)


_P7 = growth_sql(
    "SELECT visit_id, account_id, checkin_ts, checkin_x AS lat, checkin_y AS lon FROM v_visits WHERE outcome IN ('met_borrower', 'met_family', 'cash_collected')",
    "SELECT NULL::VARCHAR AS cluster_id, 0.0::DOUBLE AS latitude, 0.0::DOUBLE AS longitude WHERE false",
    "SELECT NULL::VARCHAR AS cluster_id, 0::BIGINT AS account_id WHERE false", "100",
)


@query("p7_incremental_clusters", _P7)
def p7(t):
    """Place clusters grown from the arriving successful visits."""
    s, folder = StreamTables(t.spark, t.sf_dir), _folder(t)
    handler = arrivals.ArrivalRefresh(t.spark, folder)
    arrivals.run_batches(_canonical(s.visits), handler, f"{folder}/state")
    return handler.clusters().withColumn("confidence", F.round("confidence", 4))


@query("p8_streaming_productivity", f"SELECT * FROM ({_PROD}) WHERE CAST(day AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(checkin_ts) - INTERVAL 1 DAY FROM v_visits)")
def p8(t):
    s, folder = StreamTables(t.spark, t.sf_dir), _folder(t)
    arrivals.run_available(arrivals.daily_productivity(_canonical(s.visits)), f"{folder}/out", f"{folder}/state")
    return t.spark.read.parquet(f"{folder}/out")


def _guarded(t, log, days=None):
    folder = _folder(t)
    contacts.run_guard(contacts.guarded(log, holidays=days), f"{folder}/checked", f"{folder}/state")
    return t.spark.read.parquet(f"{folder}/checked")


@query("p9_streaming_contact_guard", f"SELECT id, attempts_today, attempts_7d, attempts_14d, last_complaint FROM ({_COUNTS})")
def p9(t):
    s = StreamTables(t.spark, t.sf_dir)
    return _guarded(t, s.contact_log).select("id", "attempts_today", "attempts_7d", "attempts_14d", "last_complaint")


@query("p9_streaming_contact_verdict", f"SELECT id, allowed, reason, next_allowed_at FROM ({_VERDICT})")
def p9_verdict(t):
    s = StreamTables(t.spark, t.sf_dir)
    return _guarded(t, flagged_log(s), holidays(t)).select("id", "allowed", "reason", "next_allowed_at")
