"""Exact order statistics that stay distributed when one group is huge.

``percentile`` keeps every distinct value of a group in one aggregation buffer
and a plain window sorts a group in one task. Both break when a single key
holds a large share of the rows. Here a group above ``HOT_GROUP_ROWS`` is first
cut into value segments by a bounded sketch; counts per segment give each
segment its starting rank, and only values inside one segment are sorted
together. Smaller groups meet in one window, sorted once. Ties are collapsed to
(value, count) before any shuffle by rank, so a repeated value costs one row.

The sketch only decides where the cuts are; ranks come from exact counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placewise import config

_SEGMENTS = 256


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, hot_rows: int | None = None) -> DataFrame:
    """(keys, value, cnt, first_rank, n): zero-based rank of each distinct non-null value."""
    hot_rows = config.HOT_GROUP_ROWS if hot_rows is None else hot_rows
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if not keys:
        rows = rows.withColumn("_all", F.lit(0))
    k = keys or ["_all"]
    rows = rows.dropna(subset=keys) if keys else rows
    # Every branch below reads cnt, so all of them share this one shuffle.
    distinct = rows.groupBy(*k, "_v").agg(F.count(F.lit(1)).alias("cnt")).filter(F.col("cnt") > 0)
    # Size of each group in distinct values. Only groups of more than ``hot_rows`` are here: few rows, whatever the table.
    big = F.broadcast(distinct.groupBy(*k).agg(F.count(F.lit(1)).alias("_d")).filter(F.col("_d") > F.lit(hot_rows)).drop("_d"))
    ordered = W.partitionBy(*k).orderBy("_v")
    whole = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    small = distinct.join(big, k, "left_anti").select(
        *k, F.col("_v").alias(value), "cnt", (F.sum("cnt").over(ordered) - F.col("cnt")).alias("first_rank"), F.sum("cnt").over(whole).alias("n")
    )
    out = small.unionByName(_in_segments(distinct.join(big, k, "left_semi"), k, value))
    return out if keys else out.drop("_all")


def _in_segments(distinct: DataFrame, k: list[str], value: str) -> DataFrame:
    """``value_ranks`` of large groups, from their (keys, _v, cnt)."""
    probs = [i / _SEGMENTS for i in range(1, _SEGMENTS)]
    cuts = distinct.groupBy(*k).agg(F.percentile_approx("_v", probs, 4 * _SEGMENTS).alias("_cuts"))
    # One row for each large group.
    segmented = distinct.join(F.broadcast(cuts), k).withColumn("_seg", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    per_segment = segmented.groupBy(*k, "_seg").agg(F.sum("cnt").alias("_c"))
    by_key = W.partitionBy(*k).orderBy("_seg")
    per_segment = per_segment.select(
        *k,
        "_seg",
        (F.sum("_c").over(by_key) - F.col("_c")).alias("_base"),
        F.sum("_c").over(W.partitionBy(*k)).alias("n"),
    )
    within = W.partitionBy(*k, "_seg").orderBy("_v")
    return segmented.join(per_segment, [*k, "_seg"]).select(
        *k,
        F.col("_v").alias(value),
        "cnt",
        (F.col("_base") + F.sum("cnt").over(within) - F.col("cnt")).alias("first_rank"),
        "n",
    )


Position = Callable[[Column], Column]


def linear(p: float) -> Position:
    """Fractional rank p * (n - 1): the linear-interpolation quantile."""
    return lambda n: F.lit(p) * (n - F.lit(1))


def index(p: float) -> Position:
    """Whole rank min(n - 1, floor(n * p)): the upper element."""
    return lambda n: F.least(n - F.lit(1), F.floor(n * F.lit(p))).cast("double")


def rank_stats(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    stats: dict[str, Position],
    count_as: str | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """One row per group with the requested order statistics of ``value``."""
    keys = list(keys)
    ranks = value_ranks(df, keys, value, hot_rows)
    n, first = F.col("n"), F.col("first_rank")
    last = first + F.col("cnt") - F.lit(1)
    v = F.col(value)

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank <= last), v))

    aggs: list[Column] = [F.max("n").alias("_n")]
    for name, position in stats.items():
        pos = position(n)
        aggs.append(at(F.floor(pos)).alias(f"_lo_{name}"))
        aggs.append(at(F.ceil(pos)).alias(f"_hi_{name}"))
    grouped = ranks.groupBy(*keys).agg(*aggs)
    out = []
    for name, position in stats.items():
        pos = position(F.col("_n"))
        frac = pos - F.floor(pos)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * frac).alias(name))
    head = [F.col("_n").alias(count_as)] if count_as else []
    return grouped.select(*keys, *head, *out)


def multi_rank_stats(df: DataFrame, keys: Sequence[str], stats: dict[str, dict[str, Position]]) -> DataFrame:
    """``rank_stats`` of several value columns at once: the columns are stacked and ranked in one pass."""
    keys = list(keys)
    stacked = df.select(
        *keys,
        F.explode(F.array(*[F.struct(F.lit(v).alias("_col"), F.col(v).cast("double").alias("_val")) for v in stats])).alias("_s"),
    ).select(*keys, "_s.*")
    positions: dict[str, Position] = {}
    for per_column in stats.values():
        positions.update(per_column)
    long = rank_stats(stacked, [*keys, "_col"], "_val", positions)
    picks = [
        F.max(F.when(F.col("_col") == v, F.col(name))).alias(name) for v, per_column in stats.items() for name in per_column
    ]
    return long.groupBy(*keys).agg(*picks)


def median(df: DataFrame, keys: Sequence[str], value: str, alias: str) -> DataFrame:
    return rank_stats(df, keys, value, {alias: linear(0.5)})


def row_ranks(
    df: DataFrame, keys: Sequence[str], value: str, tiebreak: str, rank_as: str = "row_rank", n_as: str = "group_rows",
    hot_rows: int | None = None,
) -> DataFrame:
    """Every row with its exact zero-based rank by (value, tiebreak) and its group's row count.

    Groups of more than ``hot_rows`` rows are ranked by ``value_ranks``, the others in one window each.
    """
    hot_rows = config.HOT_GROUP_ROWS if hot_rows is None else hot_rows
    keys = list(keys)
    known = df.withColumn("_rv", F.col(value).cast("double")).dropna(subset=[*keys, "_rv"])
    # Few rows, whatever the table.
    big = F.broadcast(known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_d")).filter(F.col("_d") > F.lit(hot_rows)).drop("_d"))
    ordered = W.partitionBy(*keys).orderBy("_rv", tiebreak)
    whole = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    small = known.join(big, keys, "left_anti").withColumns(
        {rank_as: (F.row_number().over(ordered) - F.lit(1)).cast("long"), n_as: F.count(F.lit(1)).over(whole)}
    )
    rows = known.join(big, keys, "left_semi").select(*known.columns)
    ranked = value_ranks(rows, keys, value, hot_rows).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).alias("_v"), "first_rank", F.col("n").alias(n_as)
    )
    on = rows["_rv"] == ranked["_v"]
    for i, key in enumerate(keys):
        on = on & (rows[key] == ranked[f"_k{i}"])
    ties = W.partitionBy(*keys, "_rv").orderBy(tiebreak)
    large = rows.join(ranked, on).withColumn(rank_as, F.col("first_rank") + F.row_number().over(ties) - F.lit(1))
    columns = [c for c in df.columns if c not in (rank_as, n_as)]
    return small.select(*columns, n_as, rank_as).unionByName(large.select(*columns, n_as, rank_as))
