"""All pairs of accounts whose places look alike, and the places that such pairs form.

The similarity is the weighted mean of ``place_features``. Two located accounts can only reach
the threshold within a distance that follows from the weights: they meet in a grid of that
reach. With ``every`` all other pairs of classes are judged by their signals; without it those
meet that share a pincode, a locality or a landmark, under the first of these that they share.
So each pair is made once.

Accounts fall into classes of equal landmark, locality, pincode, building, street and cross.
Pairs of classes (located ones: of classes in a cell) are bounded first: what the text and the
distance can still add decides whether the pair is dropped, certain, or open. Accounts are only
compared for open pairs, in slices of a bounded number of rows.

Places need no pairs inside them: open pairs are compared through one account of each class,
and after that only accounts that are still apart.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions import fuzzy, geo
from placewise.operators import place_features
from placewise.operators.place_features import DECAY_M, WEIGHTS
from placewise.operators.places import connected_components
from placewise.session import settled

KINDS = ("landmark", "locality", "pincode", "building", "street", "cross")
SLICE_ROWS = 1024
_NODE = ("node", "text", "lat", "lon")
_ALL = (*KINDS, "normalized_address", "lat", "lon")


def reach_m(threshold: float) -> float:
    """The distance beyond which two located accounts cannot be alike: all else equal, all signals there."""
    loss = (1 - threshold) * sum(WEIGHTS.values()) / WEIGHTS["spatial"]
    return math.inf if loss >= 1 else -DECAY_M * math.log(1 - loss)


def nodes_of(features: DataFrame) -> DataFrame:
    """account_id, node (the smallest account with the same features), and the features, blanks and zero latitudes as null."""
    told = [F.nullif(F.col(c), F.lit("")).alias(c) for c in (*KINDS, "normalized_address")]
    located = F.coalesce(F.col("latitude"), F.lit(0.0)) != 0
    rows = features.select("account_id", *told, F.when(located, F.col("latitude")).alias("lat"), F.when(located, F.col("longitude")).alias("lon"))
    same = rows.groupBy(*_ALL).agg(F.min("account_id").alias("node"))
    keys = rows.withColumn("_h", F.xxhash64(*_ALL))
    other = same.select(F.xxhash64(*_ALL).alias("_g"), "node", *[F.col(c).alias(f"o_{c}") for c in _ALL])
    joined = keys.join(other, [keys["_h"] == other["_g"], *[keys[c].eqNullSafe(other[f"o_{c}"]) for c in _ALL]])
    return joined.select("account_id", "node", *KINDS, F.col("normalized_address").alias("text"), "lat", "lon")


def _cells(lat: Column, lon: Column, side: float) -> list[Column]:
    """Cells of a cube grid around the globe: a chord is never longer than the way along the surface."""
    r = F.lit(geo.EARTH_RADIUS_M)
    spots = (r * F.cos(F.radians(lat)) * F.cos(F.radians(lon)), r * F.cos(F.radians(lat)) * F.sin(F.radians(lon)), r * F.sin(F.radians(lat)))
    return [F.floor(s / side).alias(c) for s, c in zip(spots, ("cx", "cy", "cz"))]


class Blocks:
    """Members of groups (classes, and located classes by cell) and the pairs of groups that may hold a pair at the threshold."""

    def __init__(self, nodes: DataFrame, threshold: float, every: bool = False):
        self.threshold = threshold
        side = reach_m(threshold) * 1.001
        if math.isinf(side):
            raise ValueError("a threshold so low that no distance rules a pair out")
        own = nodes.filter("node = account_id").withColumns({"located": F.col("lat").isNotNull(), "told": F.col("text").isNotNull()})
        marks = ("located", "told", *KINDS)
        own = own.withColumn("_h", F.xxhash64(*marks))
        names = own.groupBy("_h", *marks).agg(F.min("node").alias("cls"))
        self.classes = settled(names.drop("_h"))
        other = names.select(F.col("_h").alias("_g"), "cls", *[F.col(c).alias(f"o_{c}") for c in marks])
        on = [own["_h"] == other["_g"], *[own[c].eqNullSafe(other[f"o_{c}"]) for c in marks]]
        placed = own.join(other, on).select(*_NODE, "cls", *_cells(F.col("lat"), F.col("lon"), side))
        by_class = placed.select(F.concat(F.lit("k"), F.col("cls")).alias("group"), "cls", *_NODE, *[F.lit(None).cast("long").alias(c) for c in ("cx", "cy", "cz")])
        by_cell = placed.filter("lat is not null").select(F.concat_ws(":", F.lit("c"), "cls", "cx", "cy", "cz").alias("group"), "cls", *_NODE, "cx", "cy", "cz")
        self.members = settled(by_class.union(by_cell))
        self.pairs = settled(self._pairs(self._able() if every else self._sharing()))

    def _able(self) -> DataFrame:
        """Pairs of classes without a distance that can be alike if every text and name in common is equal, dealt over the squares of all tasks."""
        tasks = self.classes.sparkSession.sparkContext.defaultParallelism
        dealt = settled(self.classes.repartition(tasks, "cls"))
        l, r = dealt.alias("l"), dealt.alias("r")  # noqa: E741
        both = {k: F.col(f"l.{k}").isNotNull() & F.col(f"r.{k}").isNotNull() for k in KINDS} | {"text": F.col("l.told") & F.col("r.told")}
        able = {k: has & (F.col(f"l.{k}") == F.col(f"r.{k}")) if k in ("pincode", "cross") else has for k, has in both.items()}
        weight, most = (sum(F.when(has, F.lit(WEIGHTS[k])).otherwise(0.0) for k, has in each.items()) for each in (both, able))
        met = (F.col("l.cls") <= F.col("r.cls")) & ~(F.col("l.located") & F.col("r.located")) & (weight > 0) & (most >= self.threshold * weight - 1e-9)
        return self._unplaced(l.join(r, met))

    def _unplaced(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.col("l.cls").alias("a"), F.col("r.cls").alias("b"), F.concat(F.lit("k"), F.col("l.cls")).alias("ga"), F.concat(F.lit("k"), F.col("r.cls")).alias("gb"), F.lit(False).alias("near"))

    def _sharing(self) -> DataFrame:
        """Pairs of classes without a distance that share a pincode, a locality or a landmark."""
        keyed = self.classes.select("cls", "located", *[F.lower(c).alias(f"_{c}") for c in ("locality", "landmark")], F.col("pincode").alias("_pincode"), F.explode(F.array(
            *[F.struct(F.lit(c).alias("kind"), (F.lower(c) if c != "pincode" else F.col(c)).alias("key")) for c in ("pincode", "locality", "landmark")]
        )).alias("k")).select("*", "k.*").drop("k").filter("key is not null")
        l, r = keyed.alias("l"), keyed.alias("r")  # noqa: E741
        same = lambda c: F.coalesce(F.col(f"l._{c}") == F.col(f"r._{c}"), F.lit(False))
        kind = F.when(same("pincode"), "pincode").when(same("locality"), "locality").otherwise("landmark")
        return self._unplaced(l.join(r, [F.col("l.kind") == F.col("r.kind"), F.col("l.key") == F.col("r.key")]).filter(
            (F.col("l.cls") <= F.col("r.cls")) & ~(F.col("l.located") & F.col("r.located")) & (F.col("l.kind") == kind)
        ))

    def _pairs(self, unplaced: DataFrame) -> DataFrame:
        """ga, gb, base, weight, near: what the signals of the classes give and weigh, and whether a distance counts; ``unplaced``: pairs without one."""
        units = self.members.filter("cx is not null").select("group", "cls", "cx", "cy", "cz").distinct()
        steps = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]))
        moved = units.withColumn("s", steps).select(F.col("group").alias("ga"), F.col("cls").alias("a"), (F.col("cx") + F.col("s.x")).alias("cx"), (F.col("cy") + F.col("s.y")).alias("cy"), (F.col("cz") + F.col("s.z")).alias("cz"))
        meeting = moved.join(units.select(F.col("group").alias("gb"), F.col("cls").alias("b"), "cx", "cy", "cz"), ["cx", "cy", "cz"]).filter("ga <= gb")
        every = settled(unplaced.unionByName(meeting.select("a", "b", "ga", "gb", F.lit(True).alias("near"))))
        # Equal pairs of classes are judged once, whatever the number of their cells.
        judged = every.select("a", "b").distinct()
        for mark, key in (("l_", "a"), ("r_", "b")):
            judged = judged.join(self.classes.select(F.col("cls").alias(key), *[F.col(c).alias(f"{mark}{c}") for c in ("located", "told", *KINDS)]), key)
        signals = place_features.signals({k: F.col(f"l_{k}") for k in KINDS}, {k: F.col(f"r_{k}") for k in KINDS})
        judged = settled(judged.select("a", "b", (F.col("l_told") & F.col("r_told")).alias("told"), F.struct(*[F.when(has, value).alias(n) for n, (has, value) in signals.items()]).alias("v")))
        base = sum((F.coalesce(F.col(f"v.{n}") * WEIGHTS[n], F.lit(0.0)) for n in signals), F.lit(0.0))
        weight = sum((F.when(F.col(f"v.{n}").isNotNull(), F.lit(WEIGHTS[n])).otherwise(0.0) for n in signals), F.lit(0.0))
        text = F.when(F.col("told"), F.lit(WEIGHTS["text"])).otherwise(0.0)
        judged = judged.select("a", "b", base.alias("base"), (weight + text).alias("weight"), text.alias("text_weight"))
        out = every.join(judged, ["a", "b"]).withColumn("weight", F.col("weight") + F.when(F.col("near"), F.lit(WEIGHTS["spatial"])).otherwise(0.0))
        most = F.col("base") + F.col("text_weight") + F.when(F.col("near"), F.lit(WEIGHTS["spatial"])).otherwise(0.0)
        return out.filter((F.col("weight") > 0) & (most >= self.threshold * F.col("weight") - 1e-9)).select("ga", "gb", "base", "weight", "near")

    def tiles(self, pairs: DataFrame) -> DataFrame:
        """ga, gb, sa, sb, base, weight, near, side, group, slice and node: the members (side 0 and 1) of two slices of each of ``pairs`` of groups."""
        cut = settled(self.members.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / F.lit(SLICE_ROWS)).cast("int").alias("slices")))
        dealt = settled(self.members.join(cut, "group").withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")).select("group", "slice", *_NODE))
        parts = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
        tiles = pairs.join(cut.toDF("ga", "na"), "ga").join(cut.toDF("gb", "nb"), "gb").withColumn("sa", parts("na")).withColumn("sb", parts("nb"))
        tiles = settled(tiles.filter((F.col("ga") != F.col("gb")) | (F.col("sa") <= F.col("sb"))).select("ga", "gb", "sa", "sb", "base", "weight", "near"))
        side = lambda i, g, s: tiles.select("*", F.lit(i).alias("side"), F.col(g).alias("group"), F.col(s).alias("slice")).join(dealt, ["group", "slice"])
        return side(0, "ga", "sa").unionByName(side(1, "gb", "sb"))

    def _away(self, rows: DataFrame) -> DataFrame:
        """``rows`` with spatial: what the distance gives."""
        far = geo.haversine_m(F.col("l.lat"), F.col("l.lon"), F.col("r.lat"), F.col("r.lon"))
        return rows.withColumn("spatial", F.when(F.col("near"), F.exp(-far / DECAY_M) * WEIGHTS["spatial"]).otherwise(0.0))

    def certain(self, rows: DataFrame) -> DataFrame:
        """a, b of ``rows`` that are alike whatever their texts: text only adds to the similarity."""
        sure = F.round((F.col("base") + F.col("spatial")) / F.col("weight"), 9) >= self.threshold
        return self._away(rows).filter(sure).select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b"))

    def compared(self, rows: DataFrame, dealt: bool = False) -> DataFrame:
        """a, b, similarity of ``rows`` (l, r: structs of nodes; base, weight, near) at or above the threshold.

        ``dealt``: pairs whose texts must be read go over all tasks, whatever their bytes and groups.
        """
        told = F.col("l.text").isNotNull() & F.col("r.text").isNotNull()
        most = F.col("base") + F.col("spatial") + F.when(told, F.lit(WEIGHTS["text"])).otherwise(0.0)
        able = self._away(rows).filter(most >= self.threshold * F.col("weight") - 1e-9)
        if dealt:
            spark = rows.sparkSession
            tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
            # Written out: Spark would push the test of the texts below the shuffle.
            able = settled(able.repartition(tasks, F.xxhash64("l.node", "r.node")))
        text = F.when(told, fuzzy.token_set_ratio_col(F.coalesce("l.text", F.lit("")), F.coalesce("r.text", F.lit(""))) / 100 * WEIGHTS["text"]).otherwise(0.0)
        value = F.round((F.col("base") + F.col("spatial") + text) / F.col("weight"), 9)
        a, b = F.least("l.node", "r.node"), F.greatest("l.node", "r.node")
        return able.select(a.alias("a"), b.alias("b"), value.alias("similarity")).filter(F.col("similarity") >= self.threshold)

    def met(self, pairs: DataFrame, sliced: DataFrame, others: DataFrame, by: str) -> DataFrame:
        """``pairs`` with l and r: each member of the group ``by`` in ``sliced``, in slices of bounded size, with each member of the other in ``others``."""
        other = "gb" if by == "ga" else "ga"
        counts = sliced.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / F.lit(SLICE_ROWS)).cast("int").alias("slices"))
        dealt = sliced.join(counts, "group").withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
        spread = pairs.join(counts.withColumnRenamed("group", by), by).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
        node = F.struct(*_NODE, *[c for c in ("label",) if c in sliced.columns])
        one = dealt.select(F.col("group").alias(by), "slice", node.alias("l"))
        two = others.select(F.col("group").alias(other), node.alias("r"))
        keys = ["ga", "gb", "slice"]
        left = spread.select(*keys, "base", "weight", "near").join(one, [by, "slice"])
        right = spread.select(*keys, *[c for c in ("top",) if c in spread.columns]).join(two, other)
        if "top" in spread.columns:
            right = right.filter(F.col("r.label") != F.col("top")).drop("top")
        return left.join(right, keys)


def alike_pairs(nodes: DataFrame, threshold: float = 0.75, every: bool = False) -> DataFrame:
    """account_id, other_id, similarity of the pairs of ``nodes_of`` rows (one account for equal ones) at or above ``threshold``.

    Groups are compared slice by slice; only pairs that reach the threshold leave a task.
    """
    blocks = Blocks(nodes, threshold, every)
    found = blocks.tiles(blocks.pairs).groupBy("ga", "gb", "sa", "sb").applyInPandas(_tile_pairs(threshold), "account_id long, other_id long, similarity double")
    return found.withColumn("similarity", F.round("similarity", 9)).filter(F.col("similarity") >= threshold)


def _tile(rows: pd.DataFrame, threshold: float) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """The two sides, which of their pairs the tile holds, what the distance gives each pair, and what it lacks besides.

    Half a unit of the ninth place: the similarity is rounded there.
    """
    left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
    base, weight, near = (left[c].iloc[0] for c in ("base", "weight", "near"))
    shape = len(left), len(right)
    spatial = WEIGHTS["spatial"] * np.exp(-geo.distances_m(left["lat"], left["lon"], right["lat"], right["lon"]) / DECAY_M) if near else np.zeros(shape)
    own = np.ones(shape, bool)
    if left["group"].iloc[0] == right["group"].iloc[0] and left["slice"].iloc[0] == right["slice"].iloc[0]:
        own = left["node"].to_numpy()[:, None] < right["node"].to_numpy()
    return left, right, own, spatial, (threshold - 5e-10) * weight - base - spatial


def _tile_pairs(threshold: float):
    """The pairs of nodes of two slices that reach the threshold, with their similarity before it is rounded."""

    def list_pairs(rows: pd.DataFrame) -> pd.DataFrame:
        left, right, own, spatial, lacking = _tile(rows, threshold)
        base, weight = (left[c].iloc[0] for c in ("base", "weight"))
        if left["text"].notna().all() and right["text"].notna().all():
            # A hair less: whoever rounds the similarity decides.
            i, j, ratio = fuzzy.token_set_ratios(left["text"].tolist(), right["text"].tolist(), np.where(own, lacking * (100 / WEIGHTS["text"]) - 1e-7, np.inf))
        else:
            i, j = np.nonzero(own & (lacking <= 1e-9))
            ratio = np.zeros(len(i))
        one, two = left["node"].to_numpy()[i], right["node"].to_numpy()[j]
        value = (base + spatial[i, j] + ratio / 100 * WEIGHTS["text"]) / weight
        return pd.DataFrame({"account_id": np.minimum(one, two), "other_id": np.maximum(one, two), "similarity": value})

    return list_pairs


def _tile_links(threshold: float):
    """Counts, for the nodes of two slices, how many of the other slice's are alike.

    Shared and left-over letters of all pairs of texts come from products of word tables. They bound
    the likeness; common letters in order are only counted where the bounds leave a pair open.
    """

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        left, right, own, _, lacking = _tile(rows, threshold)
        one, two = left["node"].to_numpy(), right["node"].to_numpy()
        hits = lacking <= 0
        if left["text"].notna().all() and right["text"].notna().all():
            hits = fuzzy.token_sets_reach(left["text"].tolist(), right["text"].tolist(), lacking * (100 / WEIGHTS["text"]))
        hits &= own
        out = pd.DataFrame({"node": np.concatenate([one, two]), "links": np.concatenate([hits.sum(1), hits.sum(0)])})
        return out[out["links"] > 0]

    return count


def links(nodes: DataFrame, threshold: float = 0.75, every: bool = False) -> DataFrame:
    """account_id, node, n_links of ``nodes_of`` rows: how many other nodes the account's node is alike at or above ``threshold``.

    Certain pairs of groups are counted by their sizes; open ones are compared slice by slice, and only
    counts leave a task.
    """
    nodes = settled(nodes)
    blocks = Blocks(nodes, threshold, every)
    sure = F.round(F.col("base") / F.col("weight"), 9) >= threshold
    sizes = blocks.members.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    whole = blocks.pairs.filter(sure).select("ga", "gb")
    both = whole.union(whole.filter("ga <> gb").select("gb", "ga")).toDF("group", "other")
    certain = both.join(sizes.toDF("other", "n"), "other").groupBy("group").agg(F.sum(F.col("n") - (F.col("group") == F.col("other")).cast("long")).alias("links"))
    certain = blocks.members.join(certain, "group").select("node", "links")

    met = blocks.tiles(blocks.pairs.filter(~sure))
    counted = met.groupBy("ga", "gb", "sa", "sb").applyInPandas(_tile_links(threshold), "node long, links long")
    total = certain.unionByName(counted).groupBy("node").agg(F.sum("links").alias("n_links"))
    return nodes.select("account_id", "node").join(total, "node", "left").select("account_id", "node", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def alike_places(nodes: DataFrame, threshold: float = 0.75, every: bool = False) -> DataFrame:
    """account_id, place of each account: density clusters of two or more by similarity; other accounts have none (an only account is its own)."""
    nodes = settled(nodes)
    blocks = Blocks(nodes, threshold, every)
    pairs, members = blocks.pairs, blocks.members
    sure = F.round(F.col("base") / F.col("weight"), 9) >= threshold
    both = pairs.select("ga", "gb", "base", "weight", "near").union(pairs.filter("ga <> gb").select("gb", "ga", "base", "weight", "near"))
    every = nodes.filter("node = account_id").select("node")

    def star(rows: DataFrame) -> DataFrame:
        """Each of ``rows`` with the first one of every group that its own group pairs with."""
        node = F.struct(*_NODE, *[c for c in ("label",) if c in rows.columns])
        tops = rows.groupBy("group").agg(F.min_by(node, "node").alias("r"))
        return both.join(rows.select(F.col("group").alias("ga"), node.alias("l")), "ga").join(tops.withColumnRenamed("group", "gb"), "gb").filter("l.node <> r.node")

    # Pairs that are alike without their texts come first; texts are read only between what these leave apart.
    known = settled(blocks.certain(star(members)).distinct())
    parts = members.join(connected_components(every, known).withColumnRenamed("root", "label"), "node")
    open_ = star(settled(parts)).filter("l.label <> r.label")
    edges = settled(known.union(blocks.compared(open_, dealt=True).select("a", "b")).distinct())
    labels = settled(connected_components(every, edges).withColumnRenamed("root", "label"))

    # Groups with more than one label: their members against each other, where the labels differ.
    labelled = settled(members.join(labels, "node"))
    held = labelled.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(
        F.max_by("label", F.struct("n", "label")).alias("top"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    told = pairs.filter(~sure).join(held.select(F.col("group").alias("ga"), "top", "low", "high"), "ga").join(held.select(F.col("group").alias("gb"), F.col("low").alias("low2"), F.col("high").alias("high2")), "gb")
    apart = settled(told.filter(F.least("low", "low2") != F.greatest("high", "high2")).select("ga", "gb", "base", "weight", "near", "top"))
    flagged = labelled.join(held.select("group", "top"), "group")
    odd, main = flagged.filter("label <> top").drop("top"), flagged.filter("label = top").drop("top")
    rest = blocks.met(apart.drop("top"), labelled, odd, "gb").select("base", "weight", "near", "l", "r").union(
        blocks.met(apart, main, labelled, "ga").select("base", "weight", "near", "l", "r")
    )
    more = blocks.compared(rest.filter("l.label <> r.label"), dealt=True).select("a", "b")
    found = connected_components(every, settled(edges.union(more).distinct())).withColumnRenamed("root", "_root")
    whole = nodes.select("account_id", "node", F.coalesce(*KINDS, "text", F.col("lat").cast("string")).isNotNull().alias("_told")).join(found, "node")
    sizes = whole.filter("_told").groupBy("_root").agg(F.count(F.lit(1)).alias("n"))
    lone = nodes.limit(2).count() == 1
    place = F.when((F.col("_told") & (F.col("n") >= 2)) | F.lit(lone), F.concat(F.lit("t"), F.col("_root")))
    return whole.join(sizes, "_root", "left").select("account_id", place.alias("place"))


def merged_places(spatial: DataFrame, text: DataFrame) -> DataFrame:
    """account_id, place: the spatial place (account_id, place) where an account has one, else that by its text."""
    rows = text.select("account_id", F.col("place").alias("_text")).join(spatial.select("account_id", F.col("place").alias("_spatial")), "account_id", "full")
    return rows.select("account_id", F.coalesce("_spatial", "_text").alias("place")).filter("place is not null")
