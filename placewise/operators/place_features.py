"""What is known about an account's place, and how alike two accounts are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions import entities, fuzzy, geo
from placewise.operators import lookup

# Weight of each signal, decay of the spatial one, and the ratio from which landmarks are the same.
WEIGHTS = {"spatial": 0.4, "landmark": 0.3, "text": 0.2, "building": 0.25, "street": 0.15, "locality": 0.1, "pincode": 0.05, "cross": 0.1}
DECAY_M, SAME_LANDMARK = 200.0, 85.0

FEATURES = ("latitude", "longitude", "normalized_address", "landmark", "locality", "pincode", "building", "street", "cross")


def account_features(accounts: DataFrame, visits: DataFrame, lat: str, lon: str) -> DataFrame:
    """account_id, the features, and visits.

    ``accounts``: account_id, address, locality, pincode, latitude, longitude;
    ``visits``: account_id, visit_id, checkin_ts, outcome and the two coordinates.
    An account without a location takes its first successful visit's. What the address
    says about locality and pincode comes before the stored values.
    """
    stored = accounts.select(
        "account_id", "address", "latitude", "longitude", F.col("locality").alias("_locality"), F.col("pincode").alias("_pincode")
    )
    parsed = entities.extract_entities(stored, "address")
    first = lambda kind: F.get(F.filter("entities", lambda e: e["entity_type"] == kind), F.lit(0))["value"]
    order = F.struct("checkin_ts", "visit_id")
    seen = visits.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("visits"),
        F.min_by(F.when(lookup.is_success(), F.struct(F.col(lat).alias("a"), F.col(lon).alias("b"))), F.when(lookup.is_success(), order)).alias("_first"),
    )
    lacking = F.col("latitude").isNull()
    return parsed.join(seen, "account_id", "left").select(
        "account_id",
        F.when(lacking, F.col("_first.a")).otherwise(F.col("latitude")).alias("latitude"),
        F.when(lacking, F.col("_first.b")).otherwise(F.col("longitude")).alias("longitude"),
        "normalized_address", F.nullif("landmark", F.lit("")).alias("landmark"),
        F.coalesce("locality", "_locality").alias("locality"), F.coalesce("pincode", "_pincode").alias("pincode"),
        first("BUILDING").alias("building"), first("STREET").alias("street"), first("CROSS").alias("cross"),
        F.coalesce("visits", F.lit(0)).alias("visits"),
    )


def signals(l: dict[str, Column], r: dict[str, Column]) -> dict[str, tuple[Column, Column]]:  # noqa: E741
    """For each signal that needs neither distance nor address: (both sides have it, how alike they are), from the features of two sides."""
    told = lambda c: (F.coalesce(l[c], F.lit("")) != "") & (F.coalesce(r[c], F.lit("")) != "")
    alike = lambda c: fuzzy.ratio_col(F.lower(l[c]), F.lower(r[c]))
    equal = lambda c: (l[c] == r[c]).cast("double")
    return {
        "landmark": (told("landmark"), (alike("landmark") > SAME_LANDMARK).cast("double")),
        "building": (told("building"), alike("building") / 100),
        "street": (told("street"), alike("street") / 100),
        "locality": (told("locality"), alike("locality") / 100),
        "pincode": (told("pincode"), equal("pincode")),
        "cross": (told("cross"), equal("cross")),
    }


def pair_similarity(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """``pairs`` (account_id, other_id) with similarity: the weighted mean of the signals that both accounts have; 0 without any."""
    side = lambda key, mark: features.select(F.col("account_id").alias(key), *[F.col(c).alias(f"{mark}{c}") for c in FEATURES])
    rows = pairs.join(side("account_id", "l_"), "account_id").join(side("other_id", "r_"), "other_id")
    l, r = ({c: F.col(f"{mark}{c}") for c in FEATURES} for mark in ("l_", "r_"))  # noqa: E741
    located = (F.coalesce(l["latitude"], F.lit(0.0)) != 0) & (F.coalesce(r["latitude"], F.lit(0.0)) != 0)
    away = geo.haversine_m("l_latitude", "l_longitude", "r_latitude", "r_longitude")
    text = (F.coalesce(l["normalized_address"], F.lit("")) != "") & (F.coalesce(r["normalized_address"], F.lit("")) != "")
    every = {
        "spatial": (located, F.exp(-away / DECAY_M)),
        "text": (text, fuzzy.token_set_ratio_col(l["normalized_address"], r["normalized_address"]) / 100),
        **signals(l, r),
    }
    weight = sum(F.when(has, F.lit(WEIGHTS[name])).otherwise(0.0) for name, (has, _) in every.items())
    total = sum(F.when(has, value * WEIGHTS[name]).otherwise(0.0) for name, (has, value) in every.items())
    return rows.select("account_id", "other_id", F.when(weight > 0, total / weight).otherwise(0.0).alias("similarity"))
