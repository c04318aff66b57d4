from pyspark.sql import functions as F

from placewise.operators import compliance
from placewise.plans.registry import query

_LOCAL = "attempted_at + INTERVAL 330 MINUTE"
_HOLIDAYS_SQL = "SELECT DISTINCT CAST(o_orderdate AS DATE) + 9496 AS day FROM orders WHERE o_orderkey % 50 = 0"


def flagged_log(t):
    """The contact log with account flags: do-not-contact, consent outside the window, legal notice."""
    return t.contact_log.withColumns(
        {
            "do_not_contact": F.col("account_id") % 50 == 7,
            "consented": F.col("account_id") % 7 == 0,
            "legal_notice": (F.col("channel") == "EMAIL") & (F.col("id") % 5 == 0),
        }
    )


def holidays(t):
    """Holidays derived from order dates, moved into the log's month."""
    return t.orders.filter("o_orderkey % 50 = 0").select(F.date_add(F.to_date("o_orderdate"), 9496).alias("day")).distinct()


_FACTS = f"""SELECT c.*, {_LOCAL} AS local_ts, hour({_LOCAL}) >= 7 AND hour({_LOCAL}) < 20 AS in_window, hour({_LOCAL}) >= 21 OR hour({_LOCAL}) < 6 AS quiet,
 isodow({_LOCAL}) = 7 AS sunday, h.day IS NOT NULL AS holiday, account_id % 50 = 7 AS dnc, account_id % 7 = 0 AS consent, channel = 'EMAIL' AND id % 5 = 0 AS legal
FROM v_contact_log c LEFT JOIN ({_HOLIDAYS_SQL}) h ON h.day = CAST({_LOCAL} AS DATE)"""


@query("o7_o8_contact_times", f"SELECT id, in_window, quiet, sunday, holiday FROM ({_FACTS})")
def o7(t):
    return compliance.contact_times(t.contact_log, holidays=holidays(t)).select("id", "in_window", "quiet", "sunday", "holiday")


_COUNTS = f"""SELECT f.*, count(*) OVER (PARTITION BY account_id, CAST(local_ts AS DATE) ORDER BY epoch_us(attempted_at) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS attempts_today,
 count(*) OVER (PARTITION BY account_id ORDER BY epoch_us(attempted_at) RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING) AS attempts_7d,
 count(*) OVER (PARTITION BY account_id ORDER BY epoch_us(attempted_at) RANGE BETWEEN 1209600000000 PRECEDING AND 1 PRECEDING) AS attempts_14d,
 max(CASE WHEN outcome = 'COMPLAINT' THEN attempted_at END) OVER (PARTITION BY account_id ORDER BY epoch_us(attempted_at) RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING) AS last_complaint FROM ({_FACTS}) f"""


@query("o9_o10_attempt_counts", f"SELECT id, attempts_today, attempts_7d, attempts_14d, last_complaint FROM ({_COUNTS})")
def o9(t):
    return compliance.attempt_counts(t.contact_log).select("id", "attempts_today", "attempts_7d", "attempts_14d", "last_complaint")


_VERDICT = f"""SELECT id, account_id, channel, attempted_at, reasons = '' AS allowed, nullif(reasons, '') AS reason, first_type, CASE WHEN reasons <> '' THEN CASE WHEN NOT in_window THEN
   CAST(CAST(local_ts AS DATE) AS TIMESTAMP) + INTERVAL 7 HOUR + CASE WHEN hour(local_ts) >= 7 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END - INTERVAL 330 MINUTE
  WHEN attempts_today >= 3 THEN CAST(CAST(local_ts AS DATE) AS TIMESTAMP) + INTERVAL 31 HOUR - INTERVAL 330 MINUTE END END AS next_allowed_at FROM (
 SELECT *, concat_ws('; ', CASE WHEN dnc AND NOT legal THEN 'Account flagged Do Not Contact; only legally required notices permitted' END,
  CASE WHEN NOT in_window AND NOT (consent OR legal) THEN concat('Contact attempted at ', strftime(local_ts, '%H:%M'), ' IST; permitted window is 07:00-20:00 IST') END,
  CASE WHEN quiet AND NOT legal THEN concat('Contact attempted during quiet hours (', strftime(local_ts, '%H:%M'), ' IST)') END,
  CASE WHEN sunday AND NOT (legal OR consent) THEN 'Contact attempted on Sunday' END,
  CASE WHEN holiday AND NOT (legal OR consent) THEN concat('Contact attempted on public holiday ', CAST(CAST(local_ts AS DATE) AS VARCHAR)) END,
  CASE WHEN attempts_today >= 3 THEN 'Daily limit of 3 attempts reached' END, CASE WHEN attempts_7d >= 7 THEN 'Weekly limit of 7 attempts reached' END,
  CASE WHEN attempts_14d >= 10 THEN 'Fortnightly limit of 10 attempts reached' END,
  CASE WHEN attempted_at < last_complaint + INTERVAL 7 DAY AND NOT legal THEN concat('Borrower registered a complaint; cool-down until ', strftime(last_complaint + INTERVAL 7 DAY, '%Y-%m-%dT%H:%M:%S.%f')) END) AS reasons,
  CASE WHEN dnc AND NOT legal THEN 'DO_NOT_CONTACT' WHEN NOT in_window AND NOT (consent OR legal) THEN 'OUTSIDE_CONTACT_HOURS' WHEN quiet AND NOT legal THEN 'QUIET_HOURS'
   WHEN (sunday OR holiday) AND NOT (legal OR consent) THEN 'HOLIDAY_CONTACT' WHEN attempts_today >= 3 THEN 'DAILY_LIMIT_EXCEEDED' WHEN attempts_7d >= 7 THEN 'WEEKLY_LIMIT_EXCEEDED'
   WHEN attempts_14d >= 10 THEN 'FORTNIGHT_LIMIT_EXCEEDED' WHEN attempted_at < last_complaint + INTERVAL 7 DAY AND NOT legal THEN 'REPEATED_AFTER_COMPLAINT' END AS first_type FROM ({_COUNTS}))"""


@query("o11_contact_verdict", f"SELECT id, allowed, reason, next_allowed_at FROM ({_VERDICT})")
def o11(t):
    return compliance.verdicts(flagged_log(t), holidays=holidays(t)).select("id", "allowed", "reason", "next_allowed_at")


@query(
    "o12_remaining_quota",
    """SELECT a.account_id, greatest(0, 3 - coalesce(d, 0)) AS today_remaining, greatest(0, 7 - coalesce(w, 0)) AS week_remaining, greatest(0, 10 - coalesce(f, 0)) AS fortnight_remaining
FROM v_accounts a LEFT JOIN (SELECT account_id, count(*) FILTER (attempted_at >= TIMESTAMP '2024-01-19 18:30:00') AS d, count(*) FILTER (attempted_at >= TIMESTAMP '2024-01-13 12:00:00') AS w,
 count(*) FILTER (attempted_at >= TIMESTAMP '2024-01-06 12:00:00') AS f FROM v_contact_log WHERE attempted_at <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1) q ON q.account_id = a.account_id""",
)
def o12(t):
    return compliance.remaining_quota(t.contact_log, t.accounts, "2024-01-20 12:00:00")


@query(
    "o13_violation_report",
    f"SELECT id, account_id, channel, attempted_at, first_type AS violation_type, reason AS detail FROM ({_VERDICT}) WHERE NOT allowed AND attempted_at >= TIMESTAMP '2024-01-10'",
)
def o13(t):
    checked = compliance.verdicts(flagged_log(t), holidays=holidays(t))
    return compliance.violation_report(checked, since="2024-01-10")


_RECORDS_SQL = """SELECT event_id AS id, user_id, ts AS created_at,
 CASE event_id % 7 WHEN 0 THEN 'IDENTITY' WHEN 1 THEN 'CONTACT' WHEN 2 THEN 'FINANCIAL' WHEN 3 THEN 'LOCATION' WHEN 4 THEN 'BIOMETRIC' WHEN 5 THEN 'BEHAVIORAL' ELSE 'OTHER' END AS category,
 CASE event_id % 5 WHEN 0 THEN 'DEBT_COLLECTION' WHEN 1 THEN 'FRAUD_PREVENTION' WHEN 2 THEN 'MARKETING' WHEN 3 THEN 'RESEARCH' ELSE 'OTHER' END AS purpose FROM events"""


def records(t):
    return t.spark.sql(_RECORDS_SQL.replace("FROM events", "FROM {events}"), events=t.events)


@query(
    "o14_retention_expiry",
    f"""SELECT id, days AS retention_days, created_at + to_days(days) AS expires_at FROM (SELECT *, CAST(greatest(
 CASE WHEN category IN ('IDENTITY', 'CONTACT', 'FINANCIAL') THEN 2555 ELSE 1095 END, CASE purpose WHEN 'DEBT_COLLECTION' THEN 2555 WHEN 'MARKETING' THEN 730 ELSE 1095 END) AS INT) AS days FROM ({_RECORDS_SQL}))""",
)
def o14(t):
    return compliance.with_expiry(records(t)).select("id", "retention_days", "expires_at")


@query(
    "o15_expired_split",
    "SELECT visit_id, checkin_ts < TIMESTAMP '2027-01-15' - INTERVAL 1095 DAY AS expired FROM v_visits",
)
def o15(t):
    return compliance.split_expired(t.visits, "2027-01-15", "checkin_ts", 1095).select("visit_id", "expired")


@query(
    "o16_consent_gate",
    """SELECT visit_id, account_id FROM v_visits WHERE account_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey % 2 = 0 AND (c_custkey % 4 = 0 OR c_custkey % 4 = 1))""",
)
def o16(t):
    far, near = F.lit("2030-01-01").cast("timestamp_ntz"), F.lit("2024-01-01").cast("timestamp_ntz")
    consents = t.customer.select(
        F.col("c_custkey").alias("user_id"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "GRANTED").otherwise("WITHDRAWN").alias("status"),
        F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("LOCATION"), F.lit("CONTACT"))).otherwise(F.array(F.lit("CONTACT"))).alias("data_categories"),
        F.array(F.lit("DEBT_COLLECTION"), F.lit("RESEARCH")).alias("purposes"),
        F.when(F.col("c_custkey") % 4 == 0, F.lit(None).cast("timestamp_ntz")).when(F.col("c_custkey") % 4 == 1, far).otherwise(near).alias("expires_at"),
    )
    return compliance.with_consent(
        t.visits.select("visit_id", "account_id"), consents, "account_id", "LOCATION", "RESEARCH", "2025-06-01"
    )
