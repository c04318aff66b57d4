"""Policy values from logged decisions: weighting, doubly robust estimates and a bootstrap interval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_PROPENSITY = 0.05


def estimable(df: DataFrame, treatment: str, outcome: str, covariates: Sequence[str]) -> DataFrame:
    """One row: status and reason. Two arms, a usable outcome and a covariate are needed."""
    spark = df.sparkSession
    schema = "status string, reason string"
    if treatment not in df.columns or outcome not in df.columns:
        return spark.createDataFrame([("not_estimable", "treatment and outcome columns are required")], schema)
    if not covariates:
        return spark.createDataFrame([("not_estimable", "at least one numeric covariate is required")], schema)
    facts = df.agg(F.count_distinct(treatment).alias("arms"), F.count(F.col(outcome).try_cast("double")).alias("outcomes"))
    ok = (F.col("arms") >= 2) & (F.col("outcomes") > 0)
    return facts.select(
        F.when(ok, "estimable").otherwise("not_estimable").alias("status"),
        F.when(ok, F.lit(None).cast("string")).otherwise("two arms and a numeric outcome are required").alias("reason"),
    )


def with_propensity(df: DataFrame, treatment: str, covariates: Sequence[str]) -> DataFrame:
    """Adds ``propensity`` of the arm each row received, clipped to [0.05, 1]; null covariates take the median."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    filled = [f"_c{i}" for i in range(len(covariates))]
    rows = df.withColumns({name: F.col(c).cast("double") for name, c in zip(filled, covariates)})
    rows = Imputer(inputCols=filled, outputCols=filled, strategy="median").fit(rows).transform(rows)
    rows = StringIndexer(inputCol=treatment, outputCol="_arm", stringOrderType="alphabetAsc").fit(rows).transform(rows)
    rows = VectorAssembler(inputCols=filled, outputCol="_x").transform(rows)
    model = LogisticRegression(featuresCol="_x", labelCol="_arm", maxIter=100, regParam=1e-6, family="multinomial").fit(rows)
    scored = model.transform(rows).withColumn("_p", F.get(vector_to_array("probability"), F.col("_arm").cast("int")))
    return scored.withColumn("propensity", F.greatest(F.lit(MIN_PROPENSITY), F.least(F.lit(1.0), F.col("_p")))).drop(
        "_p", "rawPrediction", "probability", "prediction"
    )


def ipw_values(scored: DataFrame, treatment: str, outcome: str) -> DataFrame:
    w = 1 / F.col("propensity")
    return scored.groupBy(F.col(treatment).alias("arm")).agg((F.sum(F.col(outcome) * w) / F.sum(w)).alias("ipw_value"), F.count(F.lit(1)).alias("n"))


def doubly_robust_values(scored: DataFrame, treatment: str, outcome: str) -> DataFrame:
    """Mean of the arm's outcome model plus the weighted residual of rows that received the arm."""
    from pyspark.ml.regression import LinearRegression

    spark = scored.sparkSession
    arms = [r[0] for r in scored.select(treatment).distinct().orderBy(treatment).collect()]
    values = []
    for arm in arms:
        mine = scored.filter(F.col(treatment) == arm)
        n = mine.count()
        model = LinearRegression(
            featuresCol="_x", labelCol=outcome, predictionCol="_m", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, solver="normal"
        ).fit(mine)
        got = F.when(F.col(treatment) == arm, (F.col(outcome) - F.col("_m")) / F.col("propensity")).otherwise(0.0)
        values.append((arm, float(model.transform(scored).agg(F.avg(F.col("_m") + got)).first()[0])))
    return spark.createDataFrame(values, "arm string, doubly_robust_value double")


def weight_diagnostics(scored: DataFrame) -> DataFrame:
    w = 1 / F.col("propensity")
    n = F.count(F.lit(1))
    return scored.agg(
        F.min("propensity").alias("min_propensity"), F.max(w).alias("max_weight"),
        (n * n / F.sum(w * w)).alias("effective_sample_size"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("kish_sample_size"),
    )


def _poisson(uniform: Column) -> Column:
    """Poisson(1) count from a uniform number by its distribution function, as far as doubles tell its steps apart."""
    out, total, term, k = F.lit(0), 0.0, 0.36787944117144233, 0
    while total + term > total:
        total += term
        out = out + F.when(uniform > total, 1).otherwise(0)
        k += 1
        term /= k
    return out


def ate_bootstrap(scored: DataFrame, treated: Column, outcome: str, row_id: str, resamples: int = 100, seed: int = 42) -> DataFrame:
    """Weighted difference treated - control with a 95 % interval over seeded Poisson resamples.

    Replicate 0 is the data itself. Sums per replicate are combined map-side, so
    only a few rows per task are shuffled.
    """
    w, y = 1 / F.col("propensity"), F.col(outcome)
    rows = scored.select(F.col(row_id).alias("_id"), w.alias("_w"), y.alias("_y"), treated.alias("_t"))
    copies = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(resamples))))
    uniform = F.pmod(F.xxhash64("_id", "_b", F.lit(seed)), F.lit(2**40)) / float(2**40)
    copies = copies.withColumn("_k", F.when(F.col("_b") == 0, 1).otherwise(_poisson(uniform)))
    kw = F.col("_k") * F.col("_w")

    def mean(arm: Column) -> Column:
        return F.sum(F.when(arm, kw * F.col("_y"))) / F.sum(F.when(arm, kw))

    effects = copies.groupBy("_b").agg((mean(F.col("_t")) - mean(~F.col("_t"))).alias("effect"))
    replicate = F.when(F.col("_b") > 0, F.col("effect"))
    return effects.agg(
        F.max(F.when(F.col("_b") == 0, F.col("effect"))).alias("ate"),
        F.percentile(replicate, F.lit(0.025)).alias("ci_low"), F.percentile(replicate, F.lit(0.975)).alias("ci_high"),
    )
