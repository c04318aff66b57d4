"""Error summaries, operational metrics and data profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise import config
from placewise.functions import geo, ranks
from placewise.session import settled

WITHIN = (50, 100, 250, 500)


def share(condition: Column) -> Column:
    """Share of rows where the condition is true; null counts as false."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def error_summary(
    df: DataFrame, keys: Sequence[str] = (), error: str = "error_m", radius: str | None = None,
    confidence: str | None = None, action: str | None = None,
) -> DataFrame:
    """n, linear quantiles, mean, shares within 50/100/250/500 m per group.

    With ``radius``: coverage, mean/median/p90 radius and calibration error, where
    the stated confidence is ``confidence`` or, without one, clip(1 - radius/1000).
    """
    rows = df.filter(F.col(error).isNotNull())
    keyed = list(keys)
    if not keyed:
        rows = rows.withColumn("_all", F.lit(1))
        keyed = ["_all"]
    e = F.col(error)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(e).alias("mean_error_m")]
    aggs += [share(e <= w).alias(f"within_{w}m") for w in WITHIN]
    if radius:
        r = F.col(radius)
        covered = (e <= r).cast("double")
        stated = F.col(confidence) if confidence else F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - r / 1000))
        aggs += [
            F.avg(covered).alias("coverage"),
            F.avg(F.abs(covered - stated)).alias("calibration_error"),
            F.avg(r).alias("mean_radius_m"),
        ]
    if action:
        aggs.append(share(F.col(action) == "LOW_CONFIDENCE").alias("low_confidence_rate"))
    out = rows.groupBy(*keyed).agg(*aggs)
    quantiles = {"median_error_m": 0.5, "p75_error_m": 0.75, "p90_error_m": 0.9, "p95_error_m": 0.95}
    wanted = {error: {k: ranks.linear(p) for k, p in quantiles.items()}}
    if radius:
        wanted[radius] = {"median_radius_m": ranks.linear(0.5), "p90_radius_m": ranks.linear(0.9)}
    return out.join(ranks.multi_rank_stats(rows, keyed, wanted), keyed).drop("_all")


def index_error_summary(df: DataFrame, keys: Sequence[str] = (), error: str = "error_m") -> DataFrame:
    """Quantiles as the element at floor(n * q) of the sorted errors, plus min, max and shares."""
    keyed = list(keys)
    rows = df.filter(F.col(error).isNotNull())
    if not keyed:
        rows = rows.withColumn("_all", F.lit(1))
        keyed = ["_all"]
    e = F.col(error)
    shares = [share(e <= w).alias(f"within_{w}m") for w in (*WITHIN, 1000)]
    base = rows.groupBy(*keyed).agg(
        F.count(F.lit(1)).alias("total_evaluated"), F.avg(e).alias("mean_error_m"), F.max(e).alias("max_error_m"),
        F.min(e).alias("min_error_m"), *shares,
    )
    quantiles = {"median_error_m": 0.5, "p75_error_m": 0.75, "p90_error_m": 0.9, "p95_error_m": 0.95}
    stats = ranks.rank_stats(rows, keyed, error, {k: ranks.index(p) for k, p in quantiles.items()})
    return base.join(stats, keyed).drop("_all")


def system_metrics(accounts: DataFrame, visits: DataFrame, predictions: DataFrame) -> DataFrame:
    """Totals and rates of the service in one row. ``visits.outcome`` is canonical."""
    spark = accounts.sparkSession
    not_traceable = (F.col("outcome") == "ADDRESS_NOT_TRACEABLE").cast("double")
    productive = F.col("outcome").isin(*config.CANONICAL_SUCCESS)
    v = visits.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.avg(not_traceable), F.lit(0.0)).alias("nt"),
            F.count_if(productive).alias("p"),
        ).alias("v")
    ).scalar()
    p = predictions.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.avg((F.col("confidence") >= 0.85).cast("double")), F.lit(0.0)).alias("hc"),
        ).alias("p")
    ).scalar()
    a = accounts.agg(F.count(F.lit(1)).alias("n")).scalar()
    one = spark.range(1).select(a.alias("total_accounts"), v.alias("v"), p.alias("p"))
    return one.select(
        "total_accounts",
        F.col("v.n").alias("total_visits"),
        F.col("p.n").alias("predictions_made"),
        F.col("p.hc").alias("high_confidence_rate"),
        F.col("v.nt").alias("address_not_traceable_rate"),
        F.col("v.p").alias("productive_visits"),
    )


TERRITORY_LEVELS = ("city", "district", "pincode", "locality")


def territory_levels(accounts: DataFrame) -> DataFrame:
    """account_id, level, territory: one row per territory level; a missing value falls back to city, then unknown."""
    def level(name: str) -> Column:
        value = F.col(name) if name in accounts.columns else F.lit(None).cast("string")
        return F.struct(F.lit(name).alias("level"), F.coalesce(value, F.col("city"), F.lit("unknown")).alias("territory"))

    return accounts.select("account_id", F.explode(F.array(*[level(n) for n in TERRITORY_LEVELS])).alias("_l")).select(
        "account_id", "_l.*"
    )


def territory_metrics(scored: DataFrame, accounts: DataFrame, visits: DataFrame) -> DataFrame:
    """Accuracy per territory at every level. ``scored``: account_id, error_m, confidence_radius_m."""
    levels = territory_levels(accounts)
    keys = ["level", "territory"]
    rows = settled(scored.select("account_id", "error_m", "confidence_radius_m").join(levels, "account_id").select(*keys, "account_id", "error_m", "confidence_radius_m"))
    per = rows.groupBy(*keys).agg(
        F.count_distinct("account_id").alias("accounts"),
        F.count(F.lit(1)).alias("evaluated_predictions"),
        share(F.col("error_m") <= F.col("confidence_radius_m")).alias("confidence_coverage"),
    )
    stats = ranks.rank_stats(rows, keys, "error_m", {"median_error_m": ranks.index(0.5), "p90_error_m": ranks.index(0.9)})
    # Visits are counted per account before they meet the levels.
    by_account = visits.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("_v"), F.count_if(F.col("outcome") == "ADDRESS_NOT_TRACEABLE").alias("_nt")
    )
    trace = by_account.join(levels, "account_id").groupBy(*keys).agg(
        (F.sum("_nt") / F.sum("_v")).alias("not_traceable_rate")
    )
    return per.join(stats, keys).join(trace, keys, "left")


def town_metrics(scored: DataFrame, accounts: DataFrame, towns: DataFrame) -> DataFrame:
    """Error figures per town that has surveyed addresses. ``scored``: town_id, error_m."""
    e = F.col("error_m")
    rows = scored.filter(e.isNotNull())
    base = rows.groupBy("town_id").agg(
        F.count(F.lit(1)).alias("surveyed_addresses"), F.avg(e).alias("mean_error_m"),
        *[share(e <= w).alias(f"within_{w}m") for w in WITHIN],
    )
    stats = ranks.rank_stats(rows, ["town_id"], "error_m", {"median_error_m": ranks.index(0.5), "p90_error_m": ranks.index(0.9)})
    counts = accounts.groupBy("town_id").agg(F.count(F.lit(1)).alias("accounts"))
    return base.join(stats, "town_id").join(towns.select("town_id", "town_name"), "town_id").join(counts, "town_id", "left").fillna(0, ["accounts"])


def productivity(visits: DataFrame, ts: str = "checkin_ts") -> DataFrame:
    """Visits, productive and untraceable visits per agent and day. ``outcome`` is canonical."""
    return visits.groupBy("agent_id", F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("visits"),
        F.count_if(F.col("outcome").isin(*config.CANONICAL_SUCCESS)).alias("productive"),
        F.count_if(F.col("outcome") == "ADDRESS_NOT_TRACEABLE").alias("not_traceable"),
    )


def productivity_totals(per_day: DataFrame) -> DataFrame:
    return per_day.agg(
        F.count(F.lit(1)).alias("agent_days"),
        F.sum("productive").alias("productive_visits"),
        F.sum("visits").alias("visits"),
        (F.sum("productive") / F.count(F.lit(1))).alias("productive_visits_per_agent_day"),
        (F.sum("not_traceable") / F.sum("visits")).alias("not_traceable_rate"),
    )


_EDGES = ((50, "0-50m"), (100, "50-100m"), (250, "100-250m"), (500, "250-500m"), (1000, "500-1000m"))


def error_histogram(df: DataFrame, error: str = "error_m") -> DataFrame:
    label = F.when(F.col(error) <= _EDGES[0][0], _EDGES[0][1])
    for edge, name in _EDGES[1:]:
        label = label.when(F.col(error) <= edge, name)
    return (
        df.filter(F.col(error).isNotNull())
        .groupBy(label.otherwise(">1000m").alias("range"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def account_evidence(visits: DataFrame, limit: int = 100) -> DataFrame:
    """Totals per account and its newest visits (canonical outcomes) as a bounded array."""
    from placewise.operators.lookup import newest_visits

    totals = visits.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("total_visits"),
        F.count_if(F.col("outcome").isin(*config.CANONICAL_SUCCESS)).alias("successful_visits"),
        F.count_if(~F.col("outcome").isin(*config.CANONICAL_SUCCESS)).alias("failed_visits"),
    )
    recent = newest_visits(visits, "account_id", limit).groupBy("account_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "visit_id", "checkin_ts", "outcome"))).alias("visits")
    )
    return totals.join(recent, "account_id")


def location_features(accounts: DataFrame, visits: DataFrame) -> DataFrame:
    """Per account: confidence and address-health counts; accounts without visits get zeros."""
    counts = visits.groupBy("account_id").agg(
        F.count_if(F.col("outcome").isin(*config.CANONICAL_SUCCESS)).alias("successful_visits"),
        F.count_if(F.col("outcome").isin("FAILED_SEARCH", "ADDRESS_NOT_TRACEABLE")).alias("failed_searches"),
    )
    return accounts.join(counts, "account_id", "left").fillna(0, ["successful_visits", "failed_searches"])


def latest_predictions(predictions: DataFrame, history: int = 20) -> DataFrame:
    from pyspark.sql import Window as W

    newest = W.partitionBy("account_id").orderBy(F.col("ts").desc(), F.col("prediction_id").desc())
    return predictions.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= history)


def latest_prediction(predictions: DataFrame) -> DataFrame:
    """Newest prediction of each account, as one bounded aggregate per key."""
    row = F.struct("prediction_id", "ts", "confidence")
    return predictions.groupBy("account_id").agg(F.max_by(row, F.struct("ts", "prediction_id")).alias("_p")).select(
        "account_id", "_p.*"
    )


def plan_visits(
    accounts: DataFrame, origin: tuple[float, float] | None = None, max_distance_km: float | None = None, limit: int = 100
) -> DataFrame:
    """Located accounts in visiting order: doubtful locations first, then by distance, then by confidence."""
    located = accounts.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    if origin is None:
        located = located.withColumn("distance_km", F.lit(None).cast("double"))
    else:
        located = located.withColumn(
            "distance_km", geo.planner_distance_km(F.lit(origin[0]), F.lit(origin[1]), "latitude", "longitude")
        )
        if max_distance_km is not None:
            located = located.filter(F.col("distance_km") <= max_distance_km)
    doubtful = F.coalesce(F.col("confidence"), F.lit(0.0)) < 0.5
    return (
        located.withColumn("recommended_action", F.when(doubtful, "verify_first").otherwise("visit_directly"))
        .withColumn("reason", F.when(doubtful, "low_location_confidence").otherwise("confirmed_or_high_confidence"))
        .orderBy(
            F.when(doubtful, 0).otherwise(1), F.col("distance_km").asc_nulls_last(),
            F.coalesce(F.col("confidence"), F.lit(0.0)).desc(), "account_id",
        )
        .limit(limit)
    )


def data_quality(df: DataFrame, table: str, id_col: str) -> DataFrame:
    """Rows, columns, null cells and duplicate ids of a table in one pass."""
    nulls = F.lit(0).cast("long")
    for name in df.columns:
        nulls = nulls + F.count_if(F.col(name).isNull())
    return df.agg(
        F.lit(table).alias("table_name"),
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        nulls.alias("null_cells"),
        (F.count(id_col) - F.count_distinct(id_col)).alias("duplicate_ids"),
    )


def outcome_profile(visits: DataFrame, gps_points: DataFrame) -> DataFrame:
    trails = gps_points.select("visit_id", F.lit(1.0).alias("_trail")).distinct()
    rows = visits.join(trails, "visit_id", "left").fillna(0.0, ["_trail"])
    base = rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("visits"), F.avg("_trail").alias("gps_share"))
    medians = {
        "gps_accuracy_m": {"median_accuracy_m": ranks.linear(0.5)},
        "dwell_s": {"median_dwell_s": ranks.linear(0.5)},
    }
    return base.join(ranks.multi_rank_stats(rows, ["outcome"], medians), "outcome")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def coordinate_ranges(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    parts = [
        df.agg(
            F.lit(name).alias("table_name"), F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"),
            F.max(y).alias("max_y"),
        )
        for name, (df, x, y) in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def describe_numeric(df: DataFrame, column: str) -> DataFrame:
    rows = df.select(F.lit(column).alias("column_name"), F.col(column).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    base = rows.groupBy("column_name").agg(
        F.count("_x").alias("count"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"), F.min("_x").alias("min"),
        F.max("_x").alias("max"),
    )
    stats = ranks.rank_stats(rows, ["column_name"], "_x", {"p50": ranks.linear(0.5), "p90": ranks.linear(0.9)})
    return base.join(stats, "column_name")


def robustness(df: DataFrame, group: str, error: str) -> DataFrame:
    """1 - min(1, spread of group medians / overall median)."""
    per_group = ranks.median(df, [group], error, "_m").agg(F.stddev_samp("_m").alias("_s")).scalar()
    overall = ranks.median(df, [], error, "_o")
    return overall.select((1 - F.least(F.lit(1.0), per_group / F.greatest(F.lit(1.0), F.col("_o")))).alias("robustness"))


def search_audit(
    audit: DataFrame, limit: int = 100, since: str | None = None, until: str | None = None, **equals: str
) -> DataFrame:
    """Newest audit rows matching every given filter (actor_id, action, resource_type, resource_id, outcome)."""
    rows = audit
    for column, value in equals.items():
        rows = rows.filter(F.col(column) == value)
    if since:
        rows = rows.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    if until:
        rows = rows.filter(F.col("ts") <= F.lit(until).cast("timestamp_ntz"))
    return rows.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(limit)


def audit_violations(audit: DataFrame, since: str | None = None) -> DataFrame:
    rows = audit.filter(F.col("outcome").isin("FAILURE", "DENIED"))
    if since:
        rows = rows.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    return rows.groupBy("action").agg(F.count(F.lit(1)).alias("violations"))


def task_statistics(tasks: DataFrame) -> DataFrame:
    """Count per status with the mean execution time over all timed tasks."""
    mean_ms = tasks.agg(F.coalesce(F.round(F.avg("execution_time_ms"), 2), F.lit(0.0)).alias("m")).scalar()
    return tasks.groupBy("status").agg(F.count(F.lit(1)).alias("tasks")).withColumn("average_execution_time_ms", mean_ms)
