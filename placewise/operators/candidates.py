"""Candidate points per account from seven sources, merged and cut to the strongest."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placewise import config
from placewise.functions import fuzzy, geo
from placewise.operators import proximity
from placewise.operators.lookup import newest_visits

RULES = config.CandidateRules()

# Source -> merge priority (fixed values); earlier sources absorb later ones.
SOURCE_PRIORITY = {
    "HISTORICAL_VISIT": 0,
    "NEARBY_ACCOUNT": 1,
    "LANDMARK": 2,
    "GEOCODER": 3,
    "LOCALITY": 4,
    "PINCODE": 5,
    "INTERPOLATION": 6,
}
# Every candidate column with its type and default.
SCHEMA = {
    "x": ("double", None),
    "y": ("double", None),
    "source": ("string", None),
    "source_reference": ("string", None),
    "source_order": ("int", 0),
    "address_similarity": ("double", 0.0),
    "landmark_similarity": ("double", 0.0),
    "locality_similarity": ("double", 0.0),
    "distance_to_successful_visits": ("double", None),
    "distance_to_failed_visits": ("double", None),
    "supporting_visit_count": ("long", 0),
    "weighted_successful_visit_count": ("double", 0.0),
    "visit_integrity": ("double", 1.0),
    "gps_accuracy": ("double", None),
    "dwell_time": ("double", None),
    "trajectory_quality": ("double", 0.0),
    "nearby_account_support": ("long", 0),
    "commercial_geocoder_distance": ("double", None),
    "place_cluster_support": ("long", 0),
    "agent_independence": ("double", 1.0),
}
# Order in which the sources are listed before merging.
_LISTING = ("history", "nearby", "cluster", "geocoder", "landmark", "locality", "pincode")


def complete(df: DataFrame, key: str, listing: str, **columns) -> DataFrame:
    """Project to the candidate schema; columns not given take their default."""
    out = [F.col(key), F.lit(_LISTING.index(listing)).alias("listing")]
    for name, (kind, default) in SCHEMA.items():
        value = columns.get(name, default)
        value = value if isinstance(value, Column) else F.lit(value)
        out.append(value.cast(kind).alias(name))
    return df.select(*out)


def assign_leaders(
    df: DataFrame, key: str, order: Sequence[Column], x: str, y: str, radius: float, crs: str
) -> DataFrame:
    """Adds ``leader``: 1-based number of the first leader within ``radius``, in the given order.

    A row is a leader when no earlier leader is within the radius. The rows of a
    key must be few (a visit history or a candidate list); each key is one array.
    """
    rows = df.withColumn("_row", F.struct(*df.columns))
    listed = rows.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("_row").alias("row")))).alias("_rows")
    )
    point = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def within(s: Column, v: Column) -> Column:
        return geo.distance_m(crs, s["x"], s["y"], v["row"][x], v["row"][y]) <= radius

    def step(acc: Column, v: Column) -> Column:
        new = F.struct(v["row"][x].cast("double").alias("x"), v["row"][y].cast("double").alias("y"))
        return F.when(F.exists(acc, lambda s: within(s, v)), acc).otherwise(F.concat(acc, F.array(new)))

    start = F.filter(F.array(point), lambda _: F.lit(False))
    listed = listed.withColumn("_leaders", F.aggregate("_rows", start, step))
    numbered = F.transform(
        "_rows",
        lambda v, i: F.struct(
            v["row"].alias("row"), i.alias("pos"),
            F.array_position(F.transform("_leaders", lambda s: within(s, v)), F.lit(True)).alias("leader"),
        ),
    )
    return listed.select(F.explode(numbered).alias("_r")).select("_r.row.*", F.col("_r.pos").alias("position"), F.col("_r.leader").alias("leader"))


def visit_groups(visits: DataFrame, key: str, x: str, y: str, crs: str, rules: config.CandidateRules = RULES) -> DataFrame:
    """Successful visits of the newest history, grouped around seed visits 50 m wide."""
    history = newest_visits(visits, key, rules.history_limit)
    hits = history.filter(F.col("outcome").isin(*config.CANONICAL_SUCCESS))
    return assign_leaders(hits, key, [F.col("rank")], x, y, rules.group_radius_m, crs)


def weighted_centroid(groups: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Centroid, weight and quality of each visit group; ``integrity_score`` and ``trajectory_ratio`` may be null.

    A missing or zero integrity counts 0.5 in weights and 1.0 in the minimum.
    """
    integrity = F.when(F.col("integrity_score") != 0, F.col("integrity_score"))
    weights = F.create_map(*[F.lit(v) for kv in config.CENTROID_OUTCOME_WEIGHT.items() for v in kv])
    rows = groups.withColumn("_w", F.coalesce(integrity, F.lit(0.5)) * F.coalesce(F.try_element_at(weights, F.col("outcome")), F.lit(0.3)))
    w = F.col("_w")
    total = F.sum(w)
    accuracy = F.coalesce(F.when(F.col("gps_accuracy_m") != 0, F.col("gps_accuracy_m")), F.lit(999.0))
    return rows.groupBy(*keys).agg(
        F.when(total == 0, F.avg(x)).otherwise(F.sum(w * F.col(x)) / total).alias("x"),
        F.when(total == 0, F.avg(y)).otherwise(F.sum(w * F.col(y)) / total).alias("y"),
        F.when(total == 0, F.count(F.lit(1)).cast("double")).otherwise(total).alias("weight"),
        F.count(F.lit(1)).alias("visits"),
        F.min(F.coalesce(integrity, F.lit(1.0))).alias("integrity"),
        F.min(accuracy).alias("accuracy"),
        F.avg(F.coalesce(F.col("dwell_s").cast("double"), F.lit(0.0))).alias("dwell"),
        F.coalesce(F.avg(F.least(F.lit(1.0), F.col("trajectory_ratio"))), F.lit(0.5)).alias("trajectory_quality"),
        F.sum(F.coalesce(integrity, F.lit(0.5))).alias("group_reliability"),
        F.min_by("visit_id", "position").alias("first_visit"),
    )


def historical_candidates(visits: DataFrame, key: str, x: str, y: str, crs: str, rules: config.CandidateRules = RULES) -> DataFrame:
    groups = weighted_centroid(visit_groups(visits, key, x, y, crs, rules), [key, "leader"], x, y)
    strongest = W.partitionBy(key).orderBy(F.col("group_reliability").desc(), "leader")
    top = groups.withColumn("_n", F.row_number().over(strongest)).filter(F.col("_n") <= rules.per_source)
    return complete(
        top, key, "history", x=F.col("x"), y=F.col("y"), source="HISTORICAL_VISIT", source_reference=F.col("first_visit"),
        source_order=F.col("_n"), supporting_visit_count=F.col("visits"), weighted_successful_visit_count=F.col("weight"),
        visit_integrity=F.col("integrity"), gps_accuracy=F.col("accuracy"), dwell_time=F.col("dwell"),
        trajectory_quality=F.col("trajectory_quality"),
    )


def nearby_candidates(neighbours: DataFrame, accounts: DataFrame, key: str, x: str, y: str, rules: config.CandidateRules = RULES) -> DataFrame:
    """``neighbours``: key, neighbour, rank. The first ten are considered; doubtful or unlocated ones are dropped."""
    facts = accounts.select(
        F.col(key).alias("neighbour"), F.col(x).alias("_x"), F.col(y).alias("_y"), "confidence", "place_cluster_id"
    )
    near = neighbours.filter(F.col("rank") <= rules.per_source).join(facts, "neighbour").filter(
        F.col("_x").isNotNull() & F.col("_y").isNotNull() & (F.col("confidence") >= 0.5)
    )
    return complete(
        near, key, "nearby", x=F.col("_x"), y=F.col("_y"), source="NEARBY_ACCOUNT", source_reference=F.col("neighbour"),
        source_order=F.col("rank"), nearby_account_support=1,
        place_cluster_support=F.when(F.col("place_cluster_id").isNotNull(), 1).otherwise(0),
    )


def cluster_candidates(near_clusters: DataFrame, clusters: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """``near_clusters``: key, neighbour (cluster id), rank; ``clusters``: cluster_id, point, n_members."""
    facts = clusters.select(F.col("cluster_id").alias("neighbour"), F.col(x).alias("_x"), F.col(y).alias("_y"), "n_members")
    rows = near_clusters.join(facts.filter(F.col("n_members") > 0), "neighbour")
    return complete(
        rows, key, "cluster", x=F.col("_x"), y=F.col("_y"), source="LANDMARK", source_reference=F.col("neighbour"),
        source_order=F.col("rank"), place_cluster_support=F.col("n_members"), landmark_similarity=0.8,
    )


def geocoder_candidates(results: DataFrame, key: str, x: str, y: str, order: str, accuracy: Column | None = None,
                        rules: config.CandidateRules = RULES) -> DataFrame:
    first = W.partitionBy(key).orderBy(order)
    rows = results.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= rules.per_source)
    return complete(
        rows, key, "geocoder", x=F.col(x), y=F.col(y), source="GEOCODER", source_order=F.col("_n"),
        commercial_geocoder_distance=0.0, gps_accuracy=accuracy,
    )


@lru_cache(maxsize=1)
def _best_name_udf():
    @F.pandas_udf("ord int, score double")
    def best_name(texts: pd.Series, names: pd.Series, threshold: pd.Series) -> pd.DataFrame:
        rows = []
        for text, gazetteer, floor in zip(texts, names, threshold):
            best, score = None, 0.0
            if text is not None and gazetteer is not None:
                letters = Counter(text)
                for place in gazetteer:
                    name = place["name"]
                    short = min(len(text), len(name))
                    # No window can share more letters than the two texts do.
                    shared = sum((letters & Counter(name)).values())
                    if short and 200.0 * shared / (short + min(short, shared)) < max(score, floor):
                        continue
                    got = fuzzy.partial_ratio(text, name)
                    if got > score and got >= floor:
                        best, score = int(place["ord"]), got
            rows.append((best, score))
        return pd.DataFrame(rows, columns=["ord", "score"])

    return best_name


def fuzzy_gazetteer_match(
    rows: DataFrame, text: str, gazetteer: DataFrame, id_col: str, name_col: str, point: tuple[str, str],
    threshold: float = RULES.fuzzy_threshold,
) -> DataFrame:
    """Best gazetteer entry of the row's town by ``partial_ratio``; the first entry (by id) wins a tie.

    Scores depend only on the text and the town, so distinct (town, text) pairs
    are scored once against the town's distinct names.
    """
    by_name = gazetteer.groupBy("town_id", F.lower(name_col).alias("name")).agg(
        F.min_by(F.struct(F.col(id_col).cast("string").alias("id"), F.col(point[0]).alias("px"), F.col(point[1]).alias("py")), id_col).alias("p"),
        F.min(id_col).alias("_first"),
    )
    names = by_name.groupBy("town_id").agg(F.array_sort(F.collect_list(F.struct("_first", "name", "p"))).alias("_list"))
    names = names.withColumn("_names", F.transform("_list", lambda v, i: F.struct(i.alias("ord"), v["name"].alias("name"))))
    texts = rows.filter(F.col(text).isNotNull() & (F.col(text) != "")).select("town_id", F.lower(text).alias("_text")).distinct()
    scored = texts.join(names, "town_id").withColumn("_m", _best_name_udf()(F.col("_text"), F.col("_names"), F.lit(threshold)))
    hit = F.get("_list", F.col("_m.ord"))["p"]
    best = scored.select(
        "town_id", "_text", hit["id"].alias("match_id"), hit["px"].alias("match_x"), hit["py"].alias("match_y"),
        (F.col("_m.score") / 100).alias("similarity"),
    ).filter(F.col("match_id").isNotNull())
    return rows.withColumn("_text", F.lower(text)).join(best, ["town_id", "_text"]).drop("_text")


def landmark_candidates(matches: DataFrame, key: str) -> DataFrame:
    return complete(
        matches, key, "landmark", x=F.col("match_x"), y=F.col("match_y"), source="LANDMARK", source_reference=F.col("match_id"),
        landmark_similarity=F.col("similarity"), gps_accuracy=50.0,
    )


def locality_candidates(matches: DataFrame, key: str) -> DataFrame:
    return complete(
        matches, key, "locality", x=F.col("match_x"), y=F.col("match_y"), source="LOCALITY", source_reference=F.col("match_id"),
        locality_similarity=F.col("similarity"), gps_accuracy=500.0,
    )


def pincode_candidates(rows: DataFrame, pincodes: DataFrame, key: str) -> DataFrame:
    """``pincodes``: pincode, locality_id, centroid_x, centroid_y (one row per pincode)."""
    return complete(
        rows.join(pincodes, "pincode"), key, "pincode", x=F.col("centroid_x"), y=F.col("centroid_y"), source="PINCODE",
        source_reference=F.col("locality_id"), gps_accuracy=1000.0,
    )


def union_sources(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_SUPPORT = ("supporting_visit_count", "weighted_successful_visit_count", "nearby_account_support", "place_cluster_support")


def merge_duplicates(candidates: DataFrame, key: str, crs: str, radius: float = RULES.dedup_radius_m) -> DataFrame:
    """Candidates within 50 m of an earlier kept one add their support to the first such one.

    At most ten rows per source and key arrive here, so a key is one short array.
    """
    pairs = F.create_map(*[F.lit(v) for kv in SOURCE_PRIORITY.items() for v in kv])
    priority = F.coalesce(F.try_element_at(pairs, F.col("source")), F.lit(99))
    order = [priority, F.col("listing"), F.col("source_order"), F.coalesce(F.col("source_reference"), F.lit(""))]
    led = assign_leaders(candidates, key, order, "x", "y", radius, crs)
    keep = [c for c in candidates.columns if c not in (key, *_SUPPORT)]
    merged = led.groupBy(key, "leader").agg(
        F.min_by(F.struct(*keep), "position").alias("_lead"), *[F.sum(c).alias(c) for c in _SUPPORT],
        F.count(F.lit(1)).alias("merged_from"),
    )
    return merged.select(key, "leader", "_lead.*", *_SUPPORT, "merged_from")


def evidence_score() -> Column:
    accuracy = F.coalesce(F.when(F.col("gps_accuracy") != 0, F.col("gps_accuracy")), F.lit(100.0))
    return (
        F.col("supporting_visit_count") * 2.0
        + F.col("weighted_successful_visit_count") * 1.5
        + F.col("nearby_account_support") * 1.5
        + F.col("place_cluster_support") * 1.0
        + (1.0 - accuracy / 1000) * 0.5
    )


def strongest(candidates: DataFrame, key: str, keep: int = RULES.keep) -> DataFrame:
    order = W.partitionBy(key).orderBy(F.col("evidence_score").desc(), "leader")
    scored = candidates.withColumn("evidence_score", evidence_score())
    return scored.withColumn("candidate_rank", F.row_number().over(order)).filter(F.col("candidate_rank") <= keep)


def neighbour_lists(accounts: DataFrame, key: str, lat: str, lon: str, related: DataFrame | None = None) -> DataFrame:
    """Up to 20 neighbours per account: by location, or by shared address parts for unlocated accounts."""
    located = proximity.box_neighbours(accounts, key, lat, lon, geo.box_degrees(1000), 20)
    if related is None:
        return located
    by_text = related.select(key, F.col("related_id").alias("neighbour"), "rank")
    return located.unionByName(by_text)
