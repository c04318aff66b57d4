"""Search, filter and pagination over account, visit and gazetteer tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placewise import config


def search_accounts(accounts: DataFrame, pattern: str, limit: int = 50, order: str = "account_id") -> DataFrame:
    """Case-insensitive match of ``%pattern%`` in address, locality, pincode or city.

    ``%`` and ``_`` in the pattern stay wildcards, as in the service's search box.
    """
    like = f"%{pattern}%"
    hit = (
        F.col("address").ilike(like)
        | F.col("locality").ilike(like)
        | F.col("pincode").ilike(like)
        | F.col("city").ilike(like)
    )
    return accounts.filter(hit).orderBy(order).limit(limit)


def search_dataset_accounts(
    accounts: DataFrame,
    addresses: DataFrame,
    text: str,
    columns: Sequence[str] = ("account_id", "town_id"),
    offset: int = 0,
    limit: int = 100,
) -> DataFrame:
    """Literal, case-insensitive substring over account columns or any of the account's addresses."""
    needle = F.lit(text.lower())

    def contains(name: str) -> Column:
        return F.coalesce(F.lower(F.col(name).cast("string")).contains(needle), F.lit(False))

    by_address = addresses.filter(contains("address_text")).select("account_id", F.lit(True).alias("_hit")).distinct()
    own = F.lit(False)
    for name in columns:
        own = own | contains(name)
    return (
        accounts.join(by_address, "account_id", "left")
        .filter(own | F.coalesce(F.col("_hit"), F.lit(False)))
        .drop("_hit")
        .orderBy("account_id")
        .offset(offset)
        .limit(limit)
    )


def canonical_outcome(raw: str | Column) -> Column:
    """Raw field outcome -> canonical outcome; anything unknown is OTHER."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    mapping = F.create_map(*[F.lit(x) for kv in config.OUTCOME_MAP.items() for x in kv])
    return F.coalesce(F.try_element_at(mapping, raw), F.lit("OTHER"))


def is_success(raw: str = "outcome") -> Column:
    return F.col(raw).isin(*config.RAW_SUCCESS)


def newest_visits(
    visits: DataFrame, key: str, limit: int = 100, ts: str = "checkin_ts", before: Column | None = None
) -> DataFrame:
    """The ``limit`` newest visits per ``key``, strictly before ``before`` when given.

    The row-number filter is pruned before the shuffle (window group limit), so a
    hot key sends at most ``limit`` rows per input partition.
    """
    rows = visits if before is None else visits.filter(F.col(ts) < before)
    newest_first = W.partitionBy(key).orderBy(F.col(ts).desc(), F.col("visit_id").desc())
    return rows.withColumn("rank", F.row_number().over(newest_first)).filter(F.col("rank") <= limit)


def gazetteer_of_town(towns: DataFrame, localities: DataFrame, landmarks: DataFrame, name: str) -> DataFrame:
    """Localities and landmarks of the towns with this name, in one list."""
    town = towns.filter(F.col("town_name") == name.lower()).select("town_id")
    places = localities.select(
        "town_id", F.lit("locality").alias("kind"), F.col("locality_id").alias("id"), F.col("locality_name").alias("name")
    )
    pois = landmarks.select(
        "town_id", F.lit("landmark").alias("kind"), F.col("poi_id").cast("string").alias("id"), "name"
    )
    return places.unionByName(pois).join(town, "town_id", "left_semi")


def account_detail(
    accounts: DataFrame, addresses: DataFrame, visits: DataFrame, baseline: DataFrame, surveyed: DataFrame,
    visit_limit: int = 100,
) -> DataFrame:
    """One nested row per account: its addresses (with geocode and truth) and newest visits."""
    address = (
        addresses.join(baseline, "address_id", "left")
        .join(surveyed, "address_id", "left")
        .select(
            "account_id",
            F.struct("address_id", "address_text", "geocoder_x", "geocoder_y", "surveyed_x", "surveyed_y").alias("a"),
        )
        .groupBy("account_id")
        .agg(F.array_sort(F.collect_list("a")).alias("addresses"))
    )
    recent = (
        newest_visits(visits, "account_id", visit_limit)
        .groupBy("account_id")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "visit_id", "checkin_ts", "outcome"))),
                lambda v: F.struct(v["visit_id"].alias("visit_id"), v["checkin_ts"].alias("checkin_ts"), v["outcome"].alias("outcome")),
            ).alias("visits")
        )
    )
    return accounts.join(address, "account_id", "left").join(recent, "account_id", "left")


def page(df: DataFrame, order: Sequence[str | Column], offset: int = 0, limit: int = 100) -> DataFrame:
    """A page under an explicit order; the page size is at most 1000."""
    return df.orderBy(*order).offset(offset).limit(min(limit, 1000))
