"""Keyed joins between accounts, gazetteer and cluster tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placewise.functions import geo


def evaluation_frame(surveyed: DataFrame, addresses: DataFrame, baseline: DataFrame) -> DataFrame:
    """Surveyed addresses with their address row, geocode (if any) and the geocode's error."""
    return (
        surveyed.join(addresses, "address_id")
        .join(baseline, "address_id", "left")
        .withColumn("baseline_error_m", geo.euclidean_m("geocoder_x", "geocoder_y", "surveyed_x", "surveyed_y"))
    )


def score_predictions(frame: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions joined to truth with ``error_m``. ``predictions``: address_id, pred_x, pred_y, radius_m."""
    return frame.join(predictions, "address_id").withColumn(
        "error_m", geo.euclidean_m("pred_x", "pred_y", "surveyed_x", "surveyed_y")
    )


def related_accounts(accounts: DataFrame, terms: DataFrame, per_term: int = 10, keep: int = 20) -> DataFrame:
    """Accounts that share a landmark, locality or pincode with an unlocated account.

    ``terms``: account_id, landmark, locality, pincode as read from the address.
    For each value only its ``per_term`` first accounts are candidates, so one
    popular value never fans out. Order: landmark hits, locality hits, pincode
    hits, each by account id; a repeated account keeps its first place.
    """
    sources = ["landmark", "locality", "pincode"]
    long = terms.select(
        "account_id",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("source_rank"), F.col(s).alias("term")) for i, s in enumerate(sources)])
        ).alias("_t"),
    ).select("account_id", "_t.*").filter(F.col("term").isNotNull() & (F.col("term") != ""))
    by_term = W.partitionBy("source_rank", "term").orderBy("account_id")
    heads = (
        long.withColumn("_r", F.row_number().over(by_term))
        .filter(F.col("_r") <= per_term)
        .select("source_rank", "term", F.col("account_id").alias("related_id"), F.col("_r").alias("term_rank"))
    )
    seekers = long.join(accounts.filter(F.col("latitude").isNull()).select("account_id"), "account_id", "left_semi")
    found = (
        seekers.join(heads, ["source_rank", "term"])
        .filter(F.col("related_id") != F.col("account_id"))
        .groupBy("account_id", "related_id")
        .agg(F.min(F.struct("source_rank", "term_rank")).alias("_first"))
    )
    order = W.partitionBy("account_id").orderBy("_first", "related_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= keep)
        .select("account_id", "related_id", F.col("_first.source_rank").alias("source_rank"), "rank")
    )


def pincode_locality(localities: DataFrame) -> DataFrame:
    """The first locality (by id) of each pincode."""
    return localities.groupBy("pincode").agg(
        F.min_by(F.struct("locality_id", "centroid_x", "centroid_y"), "locality_id").alias("_l")
    ).select("pincode", "_l.*")


def orphan_count(left: DataFrame, right: DataFrame, key: str, alias: str) -> DataFrame:
    return left.join(right, key, "left_anti").agg(F.count(F.lit(1)).alias(alias))


def town_coverage(towns: DataFrame, addresses: DataFrame, landmarks: DataFrame) -> DataFrame:
    n_addresses = addresses.groupBy("town_id").agg(F.count(F.lit(1)).alias("n_addresses"))
    n_landmarks = landmarks.groupBy("town_id").agg(F.count(F.lit(1)).alias("n_landmarks"))
    return (
        towns.join(n_addresses, "town_id", "left")
        .join(n_landmarks, "town_id", "left")
        .fillna(0, ["n_addresses", "n_landmarks"])
    )


def first_non_null(*cols: str) -> Column:
    return F.coalesce(*[F.col(c) for c in cols])
