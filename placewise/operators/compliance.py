"""Contact rules, retention and consent over logs of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placewise import config

_DAY_US = 86_400_000_000


def _micros(ts: str | Column) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def local_time(ts: str, rules: config.ContactRules = config.ContactRules()) -> Column:
    """Zone-free UTC timestamp -> zone-free local (IST) timestamp."""
    return F.col(ts) + F.make_dt_interval(mins=F.lit(rules.utc_offset_minutes))


def contact_times(log: DataFrame, rules: config.ContactRules = config.ContactRules(), holidays: DataFrame | None = None) -> DataFrame:
    """Adds local time, window, quiet-hour, Sunday and holiday facts. ``holidays``: one column ``day``."""
    out = log.withColumn("local_ts", local_time("attempted_at", rules))
    hour = F.hour("local_ts")
    out = out.withColumns(
        {
            "in_window": (hour >= rules.window_start_h) & (hour < rules.window_end_h),
            "quiet": (hour >= rules.quiet_start_h) | (hour < rules.quiet_end_h),
            "sunday": F.weekday("local_ts") == 6,
            "local_day": F.to_date("local_ts"),
        }
    )
    if holidays is None:
        return out.withColumn("holiday", F.lit(False))
    days = holidays.select(F.col("day").alias("local_day"), F.lit(True).alias("holiday")).distinct()
    return out.join(days, "local_day", "left").fillna(False, ["holiday"])


def attempt_counts(log: DataFrame, rules: config.ContactRules = config.ContactRules()) -> DataFrame:
    """Earlier attempts of the same account on the local day, in 7 and in 14 days, and the last complaint in 7 days.

    Blocked attempts count too, so nothing is recursive. The look-back is at most
    14 days: rows are windowed per account and 14-day block, and each block also
    sees its predecessor, so one account's long history is spread over blocks.
    """
    rows = log.withColumns({"_us": _micros("attempted_at"), "_local_day": F.to_date(local_time("attempted_at", rules))})
    block = F.floor(F.col("_us") / (14 * _DAY_US))
    spread = rows.withColumn("_live", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn(
        "_block", block + F.when(F.col("_live"), 0).otherwise(1)
    )
    in_block = W.partitionBy("account_id", "_block").orderBy("_us")
    week = in_block.rangeBetween(-7 * _DAY_US, -1)
    fortnight = in_block.rangeBetween(-14 * _DAY_US, -1)
    complaint = F.when(F.col("outcome") == "COMPLAINT", F.col("attempted_at"))
    counted = (
        spread.withColumn("attempts_7d", F.count(F.lit(1)).over(week))
        .withColumn("attempts_14d", F.count(F.lit(1)).over(fortnight))
        .withColumn("last_complaint", F.max(complaint).over(week))
        .filter("_live")
    )
    today = W.partitionBy("account_id", "_local_day").orderBy("_us").rangeBetween(W.unboundedPreceding, -1)
    return counted.withColumn("attempts_today", F.count(F.lit(1)).over(today)).drop("_us", "_local_day", "_live", "_block")


def verdicts(
    log: DataFrame,
    rules: config.ContactRules = config.ContactRules(),
    holidays: DataFrame | None = None,
) -> DataFrame:
    """Each attempt with its violations, reasons and the next allowed time.

    Optional boolean columns of ``log``: do_not_contact, consented, legal_notice.
    """
    return judged(attempt_counts(log, rules), rules, holidays)


def judged(counted: DataFrame, rules: config.ContactRules = config.ContactRules(), holidays: DataFrame | None = None) -> DataFrame:
    """``verdicts`` of attempts whose earlier ones are counted already (batch or stream)."""
    for flag in ("do_not_contact", "consented", "legal_notice"):
        if flag not in counted.columns:
            counted = counted.withColumn(flag, F.lit(False))
    rows = contact_times(counted, rules, holidays)
    legal, consent = F.col("legal_notice"), F.col("consented")
    hhmm = F.date_format("local_ts", "HH:mm")
    cooldown = F.col("last_complaint") + F.make_dt_interval(days=F.lit(rules.cooldown_days))
    window = f"{rules.window_start_h:02d}:00-{rules.window_end_h:02d}:00 IST"
    found = [
        ("DO_NOT_CONTACT", "CRITICAL", F.col("do_not_contact") & ~legal,
         F.lit("Account flagged Do Not Contact; only legally required notices permitted")),
        ("OUTSIDE_CONTACT_HOURS", "HIGH", ~F.col("in_window") & ~(consent | legal),
         F.concat(F.lit("Contact attempted at "), hhmm, F.lit(f" IST; permitted window is {window}"))),
        ("QUIET_HOURS", "HIGH", F.col("quiet") & ~legal,
         F.concat(F.lit("Contact attempted during quiet hours ("), hhmm, F.lit(" IST)"))),
        ("HOLIDAY_CONTACT", "MEDIUM", F.col("sunday") & ~(legal | consent), F.lit("Contact attempted on Sunday")),
        ("HOLIDAY_CONTACT", "MEDIUM", F.col("holiday") & ~(legal | consent),
         F.concat(F.lit("Contact attempted on public holiday "), F.col("local_day").cast("string"))),
        ("DAILY_LIMIT_EXCEEDED", "HIGH", F.col("attempts_today") >= rules.max_day,
         F.lit(f"Daily limit of {rules.max_day} attempts reached")),
        ("WEEKLY_LIMIT_EXCEEDED", "HIGH", F.col("attempts_7d") >= rules.max_week,
         F.lit(f"Weekly limit of {rules.max_week} attempts reached")),
        ("FORTNIGHT_LIMIT_EXCEEDED", "HIGH", F.col("attempts_14d") >= rules.max_fortnight,
         F.lit(f"Fortnightly limit of {rules.max_fortnight} attempts reached")),
        ("REPEATED_AFTER_COMPLAINT", "CRITICAL", (F.col("attempted_at") < cooldown) & ~legal,
         F.concat(F.lit("Borrower registered a complaint; cool-down until "),
                  F.date_format(cooldown, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))),
    ]
    entries = F.array_compact(
        F.array(
            *[
                F.when(cond, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), detail.alias("detail")))
                for kind, severity, cond, detail in found
            ]
        )
    )
    out = rows.withColumn("violations", entries)
    out = out.withColumn("allowed", F.size("violations") == 0)
    opening = F.col("local_day").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(rules.window_start_h))
    one_day = F.make_dt_interval(days=F.lit(1))
    back = F.make_dt_interval(mins=F.lit(rules.utc_offset_minutes))
    next_allowed = F.when(
        ~F.col("allowed"),
        F.when(~F.col("in_window"), F.when(opening <= F.col("local_ts"), opening + one_day).otherwise(opening) - back).when(
            F.col("attempts_today") >= rules.max_day, opening + one_day - back
        ),
    )
    return out.withColumn(
        "reason", F.when(~F.col("allowed"), F.array_join(F.transform("violations", lambda v: v["detail"]), "; "))
    ).withColumn("next_allowed_at", next_allowed)


def remaining_quota(log: DataFrame, accounts: DataFrame, as_of: str, rules: config.ContactRules = config.ContactRules()) -> DataFrame:
    """What each account may still receive today, this week and this fortnight as of a UTC time."""
    now = F.lit(as_of).cast("timestamp_ntz")
    local_now = now + F.make_dt_interval(mins=F.lit(rules.utc_offset_minutes))
    day_start = F.to_date(local_now).cast("timestamp_ntz") - F.make_dt_interval(mins=F.lit(rules.utc_offset_minutes))
    at = F.col("attempted_at")

    def since(start: Column) -> Column:
        return F.count_if((at >= start) & (at <= now))

    used = log.groupBy("account_id").agg(
        since(day_start).alias("_d"),
        since(now - F.make_dt_interval(days=F.lit(7))).alias("_w"),
        since(now - F.make_dt_interval(days=F.lit(14))).alias("_f"),
    )

    def left(limit: int, column: str) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.lit(limit) - F.coalesce(F.col(column), F.lit(0)))

    return accounts.select("account_id").join(used, "account_id", "left").select(
        "account_id",
        left(rules.max_day, "_d").alias("today_remaining"),
        left(rules.max_week, "_w").alias("week_remaining"),
        left(rules.max_fortnight, "_f").alias("fortnight_remaining"),
    )


def violation_report(checked: DataFrame, account_id=None, since: str | None = None) -> DataFrame:
    """Denied attempts, newest first."""
    rows = checked.filter(~F.col("allowed"))
    if account_id is not None:
        rows = rows.filter(F.col("account_id") == account_id)
    if since:
        rows = rows.filter(F.col("attempted_at") >= F.lit(since).cast("timestamp_ntz"))
    return rows.select(
        "id", "account_id", "channel", "attempted_at", F.col("violations")[0]["type"].alias("violation_type"),
        F.col("reason").alias("detail"),
    ).orderBy(F.col("attempted_at").desc(), F.col("id").desc())


def retention_days(category: str, purpose: str) -> Column:
    def lookup(values: dict, column: str) -> Column:
        pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
        return F.coalesce(F.try_element_at(pairs, F.col(column)), F.lit(config.DEFAULT_RETENTION_DAYS))

    return F.greatest(
        lookup(config.CATEGORY_RETENTION_DAYS, category), lookup(config.PURPOSE_RETENTION_DAYS, purpose)
    )


def with_expiry(records: DataFrame, created: str = "created_at", category: str = "category", purpose: str = "purpose") -> DataFrame:
    days = retention_days(category, purpose)
    return records.withColumn("retention_days", days).withColumn(
        "expires_at", F.col(created) + F.make_dt_interval(days=F.col("retention_days"))
    )


def split_expired(records: DataFrame, as_of: str, created: str, days: int) -> DataFrame:
    """``expired`` marks rows created more than ``days`` before ``as_of``; the rest is kept."""
    edge = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))
    return records.withColumn("expired", F.col(created) < edge)


def with_consent(records: DataFrame, consents: DataFrame, principal: str, category: str, purpose: str, as_of: str) -> DataFrame:
    """Records whose principal granted an unexpired consent for this category and purpose."""
    now = F.lit(as_of).cast("timestamp_ntz")
    valid = consents.filter(
        (F.col("status") == "GRANTED")
        & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
        & F.array_contains("data_categories", category)
        & F.array_contains("purposes", purpose)
    ).select(F.col("user_id").alias(principal))
    return records.join(valid, principal, "left_semi")
