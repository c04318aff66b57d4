"""Nearest neighbours by inner product through a permutation index.

Every vector is represented by its ``prefix`` nearest pivots in order. Pivots are rows
of the table chosen by hash. One more coordinate makes all vectors equally long, so that
the largest inner product is the smallest distance and permutations follow it. A
block of the table posts its vectors in one inverted file for each pivot, with the place
the pivot has for them. A query sums, over the files of its own pivots, what they agree
on: that ranks by the footrule distance of the two permutations. The best share of each
block is measured again on the original vectors in double precision.

Blocks of vectors and blocks of queries are both bounded; each pair is one task. Every
usable row is indexed and searched. ``fraction`` is the trade between recall and work.

Rows with a null id, or with a vector that is null, zero, has null or non-finite
components, or is of another length than most, take no part. A query finds every row but its own: rows that
share its id are candidates, and each row of a repeated id asks for itself. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placewise.llm.shared import settled
from placewise.llm.vectors import main_dimension, matrix, usable


@dataclass(frozen=True)
class Settings:
    pivots: int = 512
    prefix: int = 64
    fraction: float = 0.35
    least: int = 256  # candidates of a block, at least
    block_rows: int = 16_384
    query_rows: int = 8_192
    least_blocks: int = 16


class Permutations:
    """Weights of the nearest pivots: ``prefix`` for the first, down to 1."""

    def __init__(self, pivots: np.ndarray, longest: float, prefix: int):
        self.longest, self.prefix = longest, min(prefix, len(pivots))
        self.pivots = self._stretched(pivots)

    def _stretched(self, rows: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - np.square(rows).sum(axis=1), 0))
        return np.column_stack([rows, rest])

    def __call__(self, rows: np.ndarray, query: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(pivots, weights) of each row, nearest first."""
        points = np.column_stack([rows, np.zeros(len(rows))]) if query else self._stretched(rows)
        order = np.argsort(-(points @ self.pivots.T), axis=1, kind="stable")[:, : self.prefix]
        weights = np.broadcast_to(np.arange(self.prefix, 0, -1, dtype=np.int32), order.shape)
        return order, weights


def _postings(order: np.ndarray, weights: np.ndarray, pivots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pivot, the rows that rank it and the weights it has for them."""
    flat = order.ravel()
    by_pivot = np.argsort(flat, kind="stable")
    bounds = np.searchsorted(flat[by_pivot], np.arange(pivots + 1))
    rows, held = by_pivot // order.shape[1], weights.ravel()[by_pivot]
    return [(rows[a:b], held[a:b]) for a, b in zip(bounds, bounds[1:])]


def search(own: np.ndarray, ids: np.ndarray, rows: np.ndarray, query_own: np.ndarray, queries: np.ndarray, permute: Permutations, k: int, settings: Settings):
    """(query's place in ``queries``, id, score) of the ``k`` best found for each query among ``rows``; ``own`` numbers tell a query's row."""
    if not len(rows) or not len(queries):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    pivots = len(permute.pivots)
    files = _postings(*permute(rows), pivots)
    take = min(len(rows), max(settings.least, int(np.ceil(settings.fraction * len(rows)))))
    out = []
    for a in range(0, len(queries), 256):
        part, part_own = queries[a : a + 256], query_own[a : a + 256]
        agreed = np.zeros((len(part), len(rows)), np.int32)
        for (asked, asked_weight), (posted, posted_weight) in zip(_postings(*permute(part, query=True), pivots), files):
            if len(asked) and len(posted):
                agreed[np.ix_(asked, posted)] += np.minimum.outer(asked_weight, posted_weight)
        near = np.argpartition(-agreed, take - 1, axis=1)[:, :take]
        for q, found in enumerate(near):
            found = found[own[found] != part_own[q]]
            scores = rows[found] @ part[q]
            if len(found) > k:
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                found, scores = found[scores >= least], scores[scores >= least]
            best = np.lexsort((ids[found], -scores))[:k]
            out.append((np.full(len(best), a + q), ids[found[best]], scores[best]))
    return tuple(np.concatenate(c) for c in zip(*out))


def nearest(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row that ``is_query`` holds for."""
    spark = table.sparkSession
    named = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks"))
    rows = named.filter(F.col("id").isNotNull() & usable(F.col("v")))
    width = main_dimension(rows, "v")
    rows = settled(rows.filter(F.size("v") == width).withColumn("own", F.monotonically_increasing_id()))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("longest"), F.count_if("asks").alias("asked")).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if not facts.n or not facts.asked:
        return spark.createDataFrame([], empty)
    chosen = rows.orderBy(F.xxhash64("id"), "id", "v").limit(max(1, min(settings.pivots, facts.n // 4))).select("v").collect()
    permute = Permutations(np.array([r.v for r in chosen]), facts.longest, settings.prefix)
    held = spark.sparkContext.broadcast(permute)
    blocks = max(settings.least_blocks, -(-facts.n // settings.block_rows))
    rounds = -(-facts.asked // settings.query_rows)
    h = F.xxhash64("own", F.lit(1))
    posted = rows.select("own", "id", "v", F.lit(False).alias("asks"), F.pmod(h, F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    asked = rows.filter("asks").select("own", "id", "v", "asks", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(h, F.lit(rounds)).cast("int").alias("round"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy()
        rows, queries = (side.sort_values(["id", "own"]) for side in (group[~asks], group[asks]))
        query, found, score = search(
            rows["own"].to_numpy(), rows["id"].to_numpy(), matrix(rows["v"], width), queries["own"].to_numpy(), matrix(queries["v"], width), held.value, k, settings
        )
        asking = queries.iloc[query]
        return pd.DataFrame({"own": asking["own"].to_numpy(), "query_id": asking["id"].to_numpy(), "vec_id": found, "score": score})

    local = posted.unionByName(asked).groupBy("block", "round").applyInPandas(run, "own long, query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("own").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
