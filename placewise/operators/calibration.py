"""Confidence, its calibration, the stated radius and the action it leads to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise import config
from placewise.functions import ranks
from placewise.session import settled

MIN_RADIUS_M, MAX_RADIUS_M = 10.0, 5000.0


def recommended_action(confidence: str, radius: str, rules: config.ActionRules = config.ActionRules()) -> Column:
    c, r = F.col(confidence), F.col(radius)
    return (
        F.when((c >= rules.direct_confidence) & (r <= rules.direct_radius_m), "VISIT_DIRECTLY")
        .when((c >= rules.verify_confidence) & (r <= rules.verify_radius_m), "VERIFY_FIRST")
        .otherwise("LOW_CONFIDENCE")
    )


def evidence_sums(reliabilities: DataFrame, key: str, value: str = "reliability") -> DataFrame:
    """Per key the sums behind the self-weighted mean of its visit reliabilities."""
    r = F.when(F.col(value) > 0, F.col(value))
    return reliabilities.groupBy(key).agg(
        F.count(value).alias("n_reliabilities"), F.sum(r).alias("sum_r"), F.sum(r * r).alias("sum_rr")
    )


def evidence_confidence(support: str = "supporting_visit_count") -> Column:
    mean = F.col("sum_rr") / F.col("sum_r")
    boost = F.least(F.lit(0.3), F.col(support) * 0.05)
    return (
        F.when(F.coalesce(F.col("n_reliabilities"), F.lit(0)) == 0, 0.3)
        .when(F.col("sum_r").isNull(), 0.2)
        .otherwise(F.least(F.lit(1.0), mean + boost))
    )


def candidate_agreement(ranked: DataFrame, key: str, top: int = 5) -> DataFrame:
    """1 - normalised entropy of the five most probable candidates. ``ranked`` has probability and rank."""
    p = F.coalesce(F.col("probability"), F.lit(0.0))
    few = ranked.filter(F.col("rank") <= top).groupBy(key).agg(F.array_sort(F.collect_list(p)).alias("_p"))
    total = F.aggregate("_p", F.lit(0.0), lambda a, v: a + v)
    entropy = F.aggregate(
        F.filter("_p", lambda v: v > 0),
        F.lit(0.0),
        lambda a, v: a - v / F.col("_t") * F.log(v / F.col("_t") + F.lit(1e-10)),
    )
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - entropy / F.log(F.size("_p").cast("double"))))
    return (
        few.withColumn("_t", total)
        .withColumn("agreement", F.when(F.size("_p") < 2, 0.5).when(F.col("_t") == 0, 0.3).otherwise(value))
        .select(key, "agreement")
    )


def combined_confidence(probability: str = "probability") -> Column:
    base = F.coalesce(F.when(F.col(probability) != 0, F.col(probability)), F.lit(0.5))
    mix = base * 0.5 + F.col("evidence_confidence") * 0.3 + F.col("agreement") * 0.2
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), mix))


def heuristic_radius(confidence: str) -> Column:
    radius = 500.0 * (1.0 - F.col(confidence)) + 10.0
    return F.greatest(F.lit(MIN_RADIUS_M), F.least(F.lit(MAX_RADIUS_M), radius))


def radius_from_errors(df: DataFrame, confidence: str, errors: DataFrame, error: str, block: int = 1024) -> DataFrame:
    """Adds ``radius_m``: the exact error quantile at each row's confidence (needs more than ten errors).

    Ranks are looked up by an equi-join on rank blocks, so neither side is held in one place.
    """
    table = settled(ranks.value_ranks(errors, [], error))
    n = table.agg(F.max("n").alias("n")).scalar()
    rows = df.withColumn("_n", n).withColumn("_pos", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(confidence))) * (F.col("_n") - 1))
    rows = rows.withColumns({"_lo": F.floor("_pos").cast("long"), "_hi": F.ceil("_pos").cast("long")})
    last = F.col("first_rank") + F.col("cnt") - 1
    spans = table.select(
        F.col(error).alias("_value"), F.col("first_rank"), last.alias("_last"),
        F.explode(F.sequence(F.floor(F.col("first_rank") / block), F.floor(last / block))).alias("_b"),
    )
    wanted = rows.select(F.explode(F.array("_lo", "_hi")).alias("_r")).distinct().withColumn("_b", F.floor(F.col("_r") / block))
    values = wanted.join(spans, "_b").filter((F.col("_r") >= F.col("first_rank")) & (F.col("_r") <= F.col("_last"))).select("_r", "_value")
    low = values.select(F.col("_r").alias("_lo"), F.col("_value").alias("_vlo"))
    high = values.select(F.col("_r").alias("_hi"), F.col("_value").alias("_vhi"))
    out = rows.join(low, "_lo", "left").join(high, "_hi", "left")
    quantile = F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * (F.col("_pos") - F.col("_lo"))
    radius = F.when(F.coalesce(F.col("_n"), F.lit(0)) > 10, F.greatest(F.lit(MIN_RADIUS_M), quantile)).otherwise(heuristic_radius(confidence))
    return out.withColumn("radius_m", F.least(F.lit(MAX_RADIUS_M), radius)).drop("_n", "_pos", "_lo", "_hi", "_vlo", "_vhi")


def _bin(confidence: str) -> Column:
    """Ten right-open bins with edges k * 0.1 in double arithmetic (0.3 lies below the third edge); 1.0 joins the last one."""
    return sum((F.col(confidence) >= k * 0.1).cast("int") for k in range(1, 10))


def reliability_table(df: DataFrame, confidence: str, hit: Column) -> DataFrame:
    """Non-empty confidence bins with mean confidence, accuracy, count and share of the calibration error."""
    rows = df.select(F.col(confidence).alias("_c"), hit.cast("double").alias("_h"))
    bins = settled(rows.groupBy(_bin("_c").alias("bin")).agg(
        F.avg("_c").alias("predicted"), F.avg("_h").alias("actual"), F.count(F.lit(1)).alias("count")
    ))
    total = bins.agg(F.sum("count").alias("n")).scalar()
    return bins.withColumn("ece_part", F.col("count") / total * F.abs(F.col("predicted") - F.col("actual")))


def calibration_report(df: DataFrame, confidence: str, error: str, radius: str) -> DataFrame:
    """Coverage, radius statistics, expected calibration error and mean |confidence - hit| in one row."""
    df = settled(df.select(confidence, error, radius))
    hit = F.col(error) <= F.col(radius)
    ece = reliability_table(df, confidence, hit).agg(F.sum("ece_part").alias("e")).scalar()
    base = df.agg(
        F.avg(hit.cast("double")).alias("coverage"), F.avg(radius).alias("mean_radius"),
        F.avg(F.abs(F.col(confidence) - hit.cast("double"))).alias("calibration_error"),
    ).withColumn("_all", F.lit(0))
    spread = ranks.rank_stats(
        df.withColumn("_all", F.lit(0)), ["_all"], radius, {"median_radius": ranks.linear(0.5), "p90_radius": ranks.linear(0.9)}
    )
    return base.join(spread, "_all").drop("_all").withColumn("ece", ece)


def dataset_calibration(df: DataFrame, confidence: str, error: str, hit_m: float = 250.0) -> DataFrame:
    """All ten right-open bins; an empty bin predicts its centre and a confidence of 1.0 falls in none."""
    spark = df.sparkSession
    rows = df.select(F.col(confidence).alias("_c"), (F.col(error) <= hit_m).cast("double").alias("_h"))
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    filled = rows.filter((F.col("_c") >= 0) & (F.col("_c") < 1.0)).groupBy(_bin("_c").alias("bin")).agg(
        F.avg("_c").alias("_p"), F.avg("_h").alias("_a"), F.count(F.lit(1)).alias("_n")
    )
    bins = spark.range(10).select(F.col("id").cast("int").alias("bin"))
    return bins.join(filled, "bin", "left").select(
        "bin",
        F.coalesce("_p", F.col("bin") / 10 + 0.05).alias("predicted"),
        F.coalesce("_a", F.lit(0.0)).alias("actual"),
        F.coalesce("_n", F.lit(0)).alias("count"),
        F.coalesce(F.col("_n") / total * F.abs(F.col("_p") - F.col("_a")), F.lit(0.0)).alias("ece_part"),
    )


def _weighted_points(df: DataFrame, feature: str, label: Column) -> DataFrame:
    """One row per distinct feature value: what a monotone fit needs, whatever the row count."""
    return df.groupBy(F.col(feature).cast("double").alias("feature")).agg(
        F.avg(label.cast("double")).alias("label"), F.count(F.lit(1)).cast("double").alias("weight")
    )


def fit_isotonic(df: DataFrame, feature: str, label: Column, increasing: bool = True):
    from pyspark.ml.regression import IsotonicRegression

    points = _weighted_points(df.filter(F.col(feature).isNotNull()), feature, label)
    return IsotonicRegression(isotonic=increasing, featuresCol="feature", labelCol="label", weightCol="weight").fit(points)


def knots(model) -> tuple[list[float], list[float]]:
    """Breakpoints of an isotonic model: a short monotone table."""
    return [float(v) for v in model.boundaries.toArray()], [float(v) for v in model.predictions.toArray()]


def interpolate(value: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise-linear lookup in a short sorted table, flat beyond its ends."""
    table = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in zip(xs, ys)])
    left = F.filter(table, lambda k: k["x"] <= value)
    right = F.filter(table, lambda k: k["x"] > value)
    a, b = F.get(left, F.size(left) - 1), F.get(right, F.lit(0))
    between = a["y"] + (b["y"] - a["y"]) * (value - a["x"]) / (b["x"] - a["x"])
    return F.when(value.isNull(), F.lit(None)).when(F.size(left) == 0, b["y"]).when(F.size(right) == 0, a["y"]).otherwise(between)


def apply_isotonic(df: DataFrame, feature: str, model, out: str = "calibrated") -> DataFrame:
    xs, ys = knots(model)
    return df.withColumn(out, interpolate(F.col(feature), xs, ys))


def fit_platt(df: DataFrame, feature: str, label: Column):
    """Sigmoid calibration: logistic regression on the single confidence feature."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = df.select(F.col(feature).cast("double").alias("_c"), label.cast("double").alias("label")).groupBy("_c", "label").agg(
        F.count(F.lit(1)).cast("double").alias("weight")
    )
    vectors = VectorAssembler(inputCols=["_c"], outputCol="features").transform(rows)
    return LogisticRegression(maxIter=100, weightCol="weight").fit(vectors)


def apply_platt(df: DataFrame, feature: str, model, out: str = "calibrated") -> DataFrame:
    slope, intercept = float(model.coefficients[0]), float(model.intercept)
    return df.withColumn(out, 1 / (1 + F.exp(-(F.col(feature) * slope + intercept))))
