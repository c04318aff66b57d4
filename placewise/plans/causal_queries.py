from pyspark.sql import functions as F

from placewise.operators import causal
from placewise.plans.metric_queries import rounded
from placewise.plans.registry import query

_COVARIATES = ["balance", "segment", "month"]


def decisions(t):
    """Orders as logged decisions: priority is the arm, the amount the outcome."""
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("arm_name"), (F.col("o_totalprice") / 1000).alias("outcome"),
        F.col("c_acctbal").alias("balance"), F.length("c_mktsegment").alias("segment"), F.month("o_orderdate").alias("month"),
    )


@query(
    "o1_estimability",
    "SELECT 'estimable' AS status, CAST(NULL AS VARCHAR) AS reason FROM orders HAVING count(DISTINCT o_orderpriority) >= 2",
)
def o1(t):
    return causal.estimable(decisions(t), "arm_name", "outcome", _COVARIATES)


@query("o2_o3_ipw_values")
def o3(t):
    return rounded(causal.ipw_values(causal.with_propensity(decisions(t), "arm_name", _COVARIATES), "arm_name", "outcome"))


@query("o4_doubly_robust_values")
def o4(t):
    return rounded(causal.doubly_robust_values(causal.with_propensity(decisions(t), "arm_name", _COVARIATES).persist(), "arm_name", "outcome"))


@query("o5_weight_diagnostics")
def o5(t):
    return rounded(causal.weight_diagnostics(causal.with_propensity(decisions(t), "arm_name", _COVARIATES)))


@query("o6_ate_bootstrap")
def o6(t):
    rows = decisions(t).withColumn("urgent", F.when(F.col("arm_name").startswith("1"), "yes").otherwise("no"))
    scored = causal.with_propensity(rows, "urgent", _COVARIATES)
    return rounded(causal.ate_bootstrap(scored, F.col("urgent") == "yes", "outcome", "id"))
