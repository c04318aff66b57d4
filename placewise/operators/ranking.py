"""Candidate features, the heuristic score, a learned ranker and its figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placewise.functions import geo
from placewise.operators.candidates import SCHEMA
from placewise.session import settled

# The names of the features, in order, and the source behind each one-hot feature.
FEATURES = [
    "address_similarity", "landmark_similarity", "locality_similarity", "distance_to_successful_visits",
    "distance_to_failed_visits", "number_of_supporting_visits", "weighted_successful_visit_count", "visit_integrity",
    "gps_accuracy", "dwell_time", "trajectory_quality", "nearby_account_support", "commercial_geocoder_distance",
    "place_cluster_support", "agent_independence", "source_historical", "source_nearby", "source_geocoder",
    "source_landmark", "source_locality", "source_pincode",
]
_ONE_HOT = {
    "source_historical": "HISTORICAL_VISIT", "source_nearby": "NEARBY_ACCOUNT", "source_geocoder": "GEOCODER",
    "source_landmark": "LANDMARK", "source_locality": "LOCALITY", "source_pincode": "PINCODE",
}
FAR = 999_999.0
# Rows of one task in a training pass.
TRAINING_ROWS = 100_000


def features(candidates: DataFrame, zero_is_null: bool = True) -> DataFrame:
    """Adds struct ``f`` with the 21 features; with ``zero_is_null`` a zero distance or accuracy counts as missing."""

    def known(name: str, missing: float) -> Column:
        value = F.col(name)
        if zero_is_null:
            value = F.when(value != 0, value)
        return F.coalesce(value, F.lit(missing))

    values = {
        "distance_to_successful_visits": known("distance_to_successful_visits", FAR),
        "distance_to_failed_visits": known("distance_to_failed_visits", FAR),
        "number_of_supporting_visits": F.col("supporting_visit_count"),
        "gps_accuracy": known("gps_accuracy", 999.0),
        "dwell_time": F.coalesce(F.col("dwell_time"), F.lit(0.0)),
        "commercial_geocoder_distance": known("commercial_geocoder_distance", FAR),
        **{name: (F.col("source") == source).cast("int") for name, source in _ONE_HOT.items()},
    }
    return candidates.withColumn("f", F.struct(*[(values[n] if n in values else F.col(n)).cast("double").alias(n) for n in FEATURES]))


def heuristic_score() -> Column:
    """Weighted evidence in [0, 1] over the struct ``f``."""
    def f(name: str) -> Column:
        return F.col(f"f.{name}")

    def up_to(name: str, full: float) -> Column:
        return F.least(F.lit(1.0), f(name) / full)

    def fading(name: str, zero_at: float) -> Column:
        return F.greatest(F.lit(0.0), 1.0 - f(name) / zero_at)

    score = f("address_similarity") * 0.3 + f("landmark_similarity") * 0.3 + f("locality_similarity") * 0.1
    score += F.when(f("distance_to_successful_visits") > 0, fading("distance_to_successful_visits", 500) * 0.4).otherwise(0.0)
    score -= F.when(f("distance_to_failed_visits") > 0, F.least(F.lit(0.3), f("distance_to_failed_visits") / 1000)).otherwise(0.0)
    score += up_to("number_of_supporting_visits", 5) * 0.2 + up_to("weighted_successful_visit_count", 3) * 0.2
    score += f("visit_integrity") * 0.15 + fading("gps_accuracy", 500) * 0.1
    score += up_to("dwell_time", 300) * 0.1 + f("trajectory_quality") * 0.1
    score += up_to("nearby_account_support", 3) * 0.2
    score += F.when(f("commercial_geocoder_distance") > 0, fading("commercial_geocoder_distance", 1000) * 0.15).otherwise(0.0)
    score += up_to("place_cluster_support", 3) * 0.15 + f("agent_independence") * 0.1
    prior = F.when(f("source_historical") == 1, 0.2).when(f("source_nearby") == 1, 0.15).when(f("source_geocoder") == 1, 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score + prior))


def rank(candidates: DataFrame, key: str, tiebreak: str = "candidate_rank") -> DataFrame:
    """Adds probability (heuristic unless present) and its rank within the key."""
    scored = candidates
    if "probability" not in candidates.columns:
        scored = features(candidates).withColumn("probability", heuristic_score()).drop("f")
    order = W.partitionBy(key).orderBy(F.col("probability").desc(), tiebreak)
    return scored.withColumn("rank", F.row_number().over(order))


def best_candidate(scored: DataFrame, key: str, payload: list[str], tiebreak: str) -> DataFrame:
    """The most probable candidate of each key, as one bounded aggregate."""
    best = F.min_by(F.struct("probability", *payload), F.struct((-F.col("probability")).alias("p"), F.col(tiebreak)))
    return scored.groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


# Fixed feature values of the learning frame per source.
_LEARNING = {
    "HISTORICAL_VISIT": dict(visit_integrity=0.8, trajectory_quality=0.7, agent_independence=0.5, address_similarity=0.6,
                             landmark_similarity=0.4, locality_similarity=0.5, distance_to_successful_visits=0.0),
    "GEOCODER": dict(visit_integrity=1.0, gps_accuracy=100.0, dwell_time=0.0, trajectory_quality=0.5, agent_independence=1.0,
                     address_similarity=0.5, landmark_similarity=0.3, locality_similarity=0.4, commercial_geocoder_distance=0.0,
                     distance_to_successful_visits=FAR),
    "LOCALITY": dict(visit_integrity=1.0, gps_accuracy=500.0, dwell_time=0.0, trajectory_quality=0.3, agent_independence=1.0,
                     address_similarity=0.2, landmark_similarity=0.0, locality_similarity=0.8, distance_to_successful_visits=FAR),
    "PINCODE": dict(visit_integrity=1.0, gps_accuracy=1000.0, dwell_time=0.0, trajectory_quality=0.2, agent_independence=1.0,
                    address_similarity=0.1, landmark_similarity=0.0, locality_similarity=0.3, distance_to_successful_visits=FAR),
}


def _examples(df: DataFrame, source: str, x: str, y: str, reference: Column, **extra: Column) -> DataFrame:
    fixed = {**_LEARNING[source], "distance_to_failed_visits": FAR, "source": source}
    out = ["address_id", "account_id", "surveyed_x", "surveyed_y"]
    cols = []
    for name, (kind, default) in SCHEMA.items():
        if name == "x":
            value = F.col(x)
        elif name == "y":
            value = F.col(y)
        elif name == "source_reference":
            value = reference
        elif name in extra:
            value = extra[name]
        else:
            value = F.lit(fixed.get(name, default))
        cols.append(value.cast(kind).alias(name))
    return df.select(*out, *cols)


def learning_frame(
    surveyed: DataFrame, visits: DataFrame, baseline: DataFrame, localities: DataFrame, success: Column, label_m: float = 250.0
) -> DataFrame:
    """Candidates of surveyed addresses with ``label`` 1 when within 250 m of the truth.

    ``surveyed``: address_id, account_id, town_id, pincode, surveyed_x, surveyed_y.
    Sources: every successful visit, the geocode, all localities of the town, the
    localities of the pincode.
    """
    hits = visits.filter(success)
    counts = hits.groupBy("address_id").agg(F.count(F.lit(1)).alias("_n"))
    by_visit = surveyed.join(hits.drop("account_id"), "address_id").join(counts, "address_id")
    history = _examples(
        by_visit, "HISTORICAL_VISIT", "checkin_x", "checkin_y", F.col("visit_id"), supporting_visit_count=F.col("_n"),
        weighted_successful_visit_count=F.col("_n"), gps_accuracy=F.col("gps_accuracy_m"), dwell_time=F.col("dwell_s"),
    )
    geocoded = _examples(surveyed.join(baseline, "address_id"), "GEOCODER", "geocoder_x", "geocoder_y", F.lit("baseline"))
    places = localities.select("town_id", "locality_id", "centroid_x", "centroid_y", F.col("pincode").alias("_pin"))
    by_town = _examples(surveyed.join(places, "town_id"), "LOCALITY", "centroid_x", "centroid_y", F.col("locality_id"))
    by_pin = _examples(
        surveyed.join(places.drop("town_id"), F.col("pincode") == F.col("_pin")), "PINCODE", "centroid_x", "centroid_y", F.col("locality_id")
    )
    frame = history.unionByName(geocoded).unionByName(by_town).unionByName(by_pin)
    error = geo.euclidean_m("x", "y", "surveyed_x", "surveyed_y")
    return frame.withColumn("distance_to_truth_m", error).withColumn("label", (error <= label_m).cast("double"))


def train(frame: DataFrame, validation: str | None = None, trees: int = 200, seed: int = 42, gain: float = 0.001):
    """Gradient-boosted trees on the 21 features.

    With a ``validation`` column boosting stops when the error on its rows falls by
    less than ``gain``. Every pass reads all rows from the cache: they are dealt to tasks of
    about ``TRAINING_ROWS`` rows, since few bytes of a table hold many of them.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = settled(features(frame).select("label", F.col("f.*"), *([validation] if validation else [])))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TRAINING_ROWS))
    rows = rows.repartition(tasks)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    gbt = GBTClassifier(maxIter=trees, maxDepth=5, stepSize=0.05, seed=seed, minInstancesPerNode=3, featureSubsetStrategy="all")
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation).setParams(validationTol=gain)
    return gbt.fit(vectors)


def score_with_model(candidates: DataFrame, model) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    flat = features(candidates).withColumns({f"_f_{n}": F.col(f"f.{n}") for n in FEATURES}).drop("f")
    vectors = VectorAssembler(inputCols=[f"_f_{n}" for n in FEATURES], outputCol="features").transform(flat)
    scored = model.transform(vectors).withColumn("probability", vector_to_array("probability")[1])
    return scored.drop("features", "rawPrediction", "prediction", *[f"_f_{n}" for n in FEATURES])


def feature_importance(spark, model) -> DataFrame:
    return spark.createDataFrame([(n, float(v)) for n, v in zip(FEATURES, model.featureImportances.toArray())], "feature string, importance double")


def classifier_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Confusion counts, precision, recall and F1 of probability > threshold."""
    hit, real = F.col("probability") > threshold, F.col("label") == 1
    counts = scored.agg(
        F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"),
        F.count_if(~hit & real).alias("fn"), F.count_if(~hit & ~real).alias("tn"),
    )
    p = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return counts.withColumns({"precision": p, "recall": r}).withColumn(
        "f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    )


def roc_auc(scored: DataFrame, buckets: int = 1024) -> DataFrame:
    """P(positive scores higher) + half the ties, from counts per distinct score.

    Scores fall into fixed buckets of [0, 1]; counts per bucket give each bucket
    its starting rank, so no task sees all scores.
    """
    per_score = scored.groupBy("probability").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("n"))
    per_score = per_score.withColumn("_b", F.floor(F.col("probability") * buckets))
    per_bucket = per_score.groupBy("_b").agg(F.sum("n").alias("_bn"))
    # At most buckets + 1 rows meet in this window.
    base = per_bucket.select("_b", (F.sum("_bn").over(W.orderBy("_b")) - F.col("_bn")).alias("_base"))
    below = F.sum("n").over(W.partitionBy("_b").orderBy("probability")) - F.col("n") + F.col("_base")
    wins = per_score.join(base, "_b").withColumn("_wins", F.col("p") * (below + 0.5 * F.col("n")))
    return wins.agg(F.try_divide(F.sum("_wins"), F.sum("p") * F.sum("n")).alias("auc"))


def probability_buckets(scored: DataFrame) -> DataFrame:
    bucket = F.least(F.floor(F.col("probability") * 10), F.lit(9)).alias("bucket")
    correct = (F.col("probability") > 0.5) == (F.col("label") == 1)
    return scored.groupBy(bucket).agg(F.count(F.lit(1)).alias("count"), F.avg(correct.cast("double")).alias("accuracy"))
