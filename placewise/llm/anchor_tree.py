"""Hard negatives of anchors, with scores bounded along a spanning tree of the anchors.

Vectors become integers (floor of 256 x) and a score is an inner product. Anchors close to each
other form blocks, and the anchors of a block a minimum spanning tree. Along an edge of length e
the score of a candidate with norm b changes by e * b at most, so what is known at a parent bounds
the scores at its children, and theirs in turn. Only candidates whose bounds meet an anchor's
windows, and can still be among its first ones, are scored again.

Two passes: the first finds each anchor's positives (best rows of its label), the second the
first negatives (rows of other labels) inside each positive's window of scores. A task is a block
of anchors with a part of the candidates, dealt by hash. Before the second pass a candidate goes
only to the blocks whose windows its bound at the block's centre can meet. A task returns the
first rows of each anchor; windows over anchors merge them.

Rows with a null id, a null label, a null vector or null or non-finite components take no part.
Zero vectors do; a shorter vector counts as filled up with zeros. A component's integer beyond
2^23 in size counts as 2^23; scores are longs. Repeated ids and equal rows are rows of their own:
an anchor skips its own row only, and an id that several anchors share has the rows of each of
them. Ties go to the smaller id. No anchors, or no rows, give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.llm.shared import settled
from placewise.llm.vectors import finite, integers


def spanning_tree(points: np.ndarray) -> np.ndarray:
    """The parent of each row in a minimum spanning tree rooted at the row nearest to the mean (its own parent)."""
    root = int(np.square(points - points.mean(axis=0)).sum(axis=1).argmin())
    parent = np.full(len(points), root)
    gap = np.square(points - points[root]).sum(axis=1)
    gap[root] = np.inf
    outside = np.ones(len(points), bool)
    outside[root] = False
    for _ in range(len(points) - 1):
        new = int(np.where(outside, gap, np.inf).argmin())
        outside[new] = False
        away = np.square(points - points[new]).sum(axis=1)
        nearer = outside & (away < gap)
        gap[nearer], parent[nearer] = away[nearer], new
    return parent


def visits(parent: np.ndarray) -> list[int]:
    """Rows parents first, each parent's largest branch last: few parents wait for children at a time."""
    children: list[list[int]] = [[] for _ in parent]
    root = 0
    for k, p in enumerate(parent.tolist()):
        if p == k:
            root = k
        else:
            children[p].append(k)
    order, stack = [], [root]
    while stack:
        k = stack.pop()
        order.append(k)
        stack += children[k]
    size = np.ones(len(parent), np.int64)
    for k in reversed(order):
        if parent[k] != k:
            size[parent[k]] += size[k]
    order, stack = [], [root]
    while stack:
        k = stack.pop()
        order.append(k)
        stack += sorted(children[k], key=lambda c: -size[c])
    return order


class Block:
    """Candidates of a task and, anchor by anchor, the bounds of their scores."""

    def __init__(self, anchors: np.ndarray, x: np.ndarray):
        largest = max(np.abs(anchors).max(initial=0), np.abs(x).max(initial=0))
        # Doubles hold all sums of products exactly, or else the wider kind does.
        self.exact = np.float64 if float(largest) ** 2 * max(1, x.shape[1]) < 2.0**52 else np.longdouble
        self.anchors, self.x = anchors.astype(self.exact), x.astype(self.exact)
        self.norm = np.sqrt(np.square(x.astype(np.float64)).sum(axis=1))
        self.parent = spanning_tree(anchors.astype(np.float64))
        self.scored = 0

    def walk(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, lower bounds, upper bounds); ``rescore`` sharpens the yielded arrays in place."""
        waiting = np.bincount(self.parent, minlength=len(self.parent))
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in visits(self.parent):
            p = int(self.parent[k])
            if p == k:
                low = self._scores(np.arange(len(self.x)), k)
                high = low.copy()
                waiting[k] -= 1
            else:
                away = np.sqrt(np.square((self.anchors[k] - self.anchors[p]).astype(np.float64)).sum())
                pad = away * self.norm * (1 + 1e-9) + 1e-3 + 1e-12 * np.abs(held[p][0])
                low, high = held[p][0] - pad, held[p][1] + pad
                waiting[p] -= 1
                if not waiting[p]:
                    del held[p]
            yield k, low, high
            if waiting[k]:
                held[k] = low, high

    def _scores(self, rows: np.ndarray, k: int) -> np.ndarray:
        self.scored += len(rows)
        every = 2 * len(rows) > len(self.x)
        return (self.x @ self.anchors[k])[rows] if every else self.x[rows] @ self.anchors[k]

    def rescore(self, rows: np.ndarray, k: int, low: np.ndarray, high: np.ndarray) -> None:
        rows = rows[low[rows] < high[rows]]
        low[rows] = high[rows] = self._scores(rows, k)

    def first(self, k: int, able: np.ndarray, low: np.ndarray, high: np.ndarray, least: float, most: float, n: int, ids: np.ndarray) -> np.ndarray:
        """The first ``n`` of the rows ``able`` that score from ``least`` to ``most`` at anchor ``k``, best first."""
        rows = able[(high[able] >= least) & (low[able] <= most)]
        if len(rows) > 4 * n:
            # The likely best are scored first; then only rows that may reach the n-th of them are.
            guess = np.minimum((low[rows] + high[rows]) / 2, most)
            self.rescore(rows[np.argpartition(guess, len(rows) - 2 * n)[-2 * n :]], k, low, high)
            rows = rows[(high[rows] >= least) & (low[rows] <= most)]
            sure = low[rows][(low[rows] >= least) & (high[rows] <= most)]
            if len(sure) >= n:
                rows = rows[high[rows] >= np.partition(sure, len(sure) - n)[-n]]
        self.rescore(rows, k, low, high)
        rows = rows[(low[rows] >= least) & (low[rows] <= most)]
        return rows[np.lexsort((ids[rows], -low[rows]))[:n]]


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for k, row in enumerate(column):
        out[k, : len(row)] = row
    return out


def _sides(group: pd.DataFrame, width: int) -> tuple[pd.DataFrame, pd.DataFrame, Block] | None:
    anchors, rows = (group[group["side"] == s].sort_values("uid").reset_index(drop=True) for s in (0, 1))
    if not len(anchors) or not len(rows):
        return None
    return anchors, rows, Block(_matrix(anchors["x"], width), _matrix(rows["x"], width))


def _positives(group: pd.DataFrame, width: int, n: int) -> pd.DataFrame:
    found, sides = [], _sides(group, width)
    if sides:
        anchors, rows, block = sides
        uid, ids, label = (rows[c].to_numpy() for c in ("uid", "id", "label"))
        places = {x: np.flatnonzero(label == x) for x in np.unique(label)}
        for k, low, high in block.walk():
            able = places.get(anchors["label"][k], np.zeros(0, np.int64))
            able = able[uid[able] != anchors["uid"][k]]
            for r in block.first(k, able, low, high, -np.inf, np.inf, n, ids):
                found.append((anchors["uid"][k], ids[r], int(low[r])))
    return pd.DataFrame(found, columns=["anchor", "positive_id", "score"])


def _negatives(group: pd.DataFrame, width: int, n: int, low_percent: int, high_percent: int) -> pd.DataFrame:
    found, sides = [], _sides(group, width)
    if sides:
        anchors, rows, block = sides
        ids, label = rows["id"].to_numpy(), rows["label"].to_numpy()
        others = {x: np.flatnonzero(label != x) for x in anchors["label"].unique()}
        for k, low, high in block.walk():
            for number, score in enumerate(anchors["scores"][k]):
                least, most = -(-low_percent * int(score) // 100), high_percent * int(score) // 100
                if least <= most:
                    for r in block.first(k, others[anchors["label"][k]], low, high, least, most, n, ids):
                        found.append((anchors["uid"][k], number, ids[r], int(low[r])))
    return pd.DataFrame(found, columns=["anchor", "number", "negative_id", "score"])


def _farthest(sample: np.ndarray, k: int) -> np.ndarray:
    """``k`` rows, each the one farthest from those before it."""
    chosen, gap = [0], np.square(sample - sample[0]).sum(axis=1)
    while len(chosen) < min(k, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.square(sample - sample[chosen[-1]]).sum(axis=1))
    return sample[chosen]


def _cells(anchors: DataFrame, total: int, block: int, width: int) -> tuple[DataFrame, np.ndarray]:
    """``anchors`` with their cell, distance from its centre and block within it; the centres, at most 1024 from a sample."""
    taken = anchors.orderBy(F.xxhash64("uid"), "uid").limit(1024).select("x").toPandas()
    centres = _farthest(_matrix(taken["x"], width).astype(np.float64), -(-total // block))
    held = anchors.sparkSession.sparkContext.broadcast(centres)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x").to_pandas(), width).astype(np.float64)
            away = np.stack([np.sqrt(np.square(x - c).sum(axis=1)) for c in held.value], axis=1)
            cell = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(away[np.arange(len(cell)), cell])], [*batch.schema.names, "cell", "away"])

    placed = settled(anchors.mapInArrow(nearest, "uid long, id long, label long, x array<long>, cell int, away double"))
    blocks = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("blocks"))
    return settled(placed.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("uid"), "blocks"))), centres


def mine(
    table: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", label_col: str = "label",
    vector_col: str = "embedding", anchor_block: int = 2048, part_rows: int = 65_536, least_parts: int = 12,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` says which rows are anchors. A negative's score lies from ``low`` to ``high`` per cent of the positive's.
    """
    spark = table.sparkSession
    rows = table.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor")
    )
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))
    rows = settled(rows.select(F.monotonically_increasing_id().alias("uid"), "id", "label", integers(F.col("v")).alias("x"), "anchor"))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("anchors"), F.max(F.size("x")).alias("width")).first()
    if not facts.anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width = max(1, facts.width)
    parts = max(least_parts, -(-facts.n // part_rows))
    anchors, centres = _cells(rows.filter("anchor").drop("anchor"), facts.anchors, anchor_block, width)
    blocks = settled(anchors.select("cell", "block").distinct())
    part = F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(parts)).alias("part")
    keys = ["cell", "block", "part"]

    def tasks(ours: DataFrame, theirs: DataFrame) -> DataFrame:
        every = ours.select(*keys[:2], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.lit(0).alias("side"), "uid", "id", "label", "x", "scores")
        theirs = theirs.select(*keys, F.lit(1).alias("side"), "uid", "id", "label", "x", F.lit(None).cast("array<long>").alias("scores"))
        return every.union(theirs)

    # Each block of anchors meets every part of the rows.
    first = tasks(anchors.withColumn("scores", F.lit(None).cast("array<long>")), _to_cells(rows, part, centres, None, width).join(blocks, "cell"))
    found = first.groupBy(*keys).applyInPandas(lambda group: _positives(group, width, positives), "anchor long, positive_id long, score long")
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive_id")
    chosen = settled(found.withColumn("number", F.row_number().over(best) - 1).filter(F.col("number") < positives))

    scores = chosen.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "score"))), lambda s: s["score"]).alias("scores"))
    armed = settled(anchors.join(scores.withColumnRenamed("anchor", "uid"), "uid"))
    # Windows of a cell: no candidate whose bound at the centre misses all of them is sent to it.
    reach = armed.groupBy("cell").agg(
        F.max("away").alias("away"), F.min(F.array_min("scores").cast("double") * low / 100).alias("least"), F.max(F.array_max("scores").cast("double") * high / 100).alias("most")
    )
    second = tasks(armed, _to_cells(rows, part, centres, [tuple(r) for r in reach.collect()], width).join(blocks, "cell"))
    found = second.groupBy(*keys).applyInPandas(lambda group: _negatives(group, width, negatives, low, high), "anchor long, number int, negative_id long, score long")
    best = Window.partitionBy("anchor", "number").orderBy(F.desc("score"), "negative_id")
    hard = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    named = chosen.join(armed.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor").select("anchor", "anchor_id", "number", "positive_id", F.col("score").alias("positive_score"))
    return hard.join(named, ["anchor", "number"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", F.col("score").alias("negative_score"))


def _to_cells(rows: DataFrame, part: Column, centres: np.ndarray, reach: list[tuple[int, float, float, float]] | None, width: int) -> DataFrame:
    """``rows`` once for each cell whose windows they can meet (all cells without ``reach``: cell, radius, least, most)."""
    reach = reach if reach is not None else [(k, np.inf, -np.inf, np.inf) for k in range(len(centres))]
    held = rows.sparkSession.sparkContext.broadcast((centres, sorted(reach)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, cells = held.value
        for batch in batches:
            x = _matrix(batch.column("x").to_pandas(), width).astype(np.float64)
            norm = np.sqrt(np.square(x).sum(axis=1)) * (1 + 1e-9)
            for cell, away, least, most in cells:
                score = x @ middle[cell]
                pad = np.where(norm > 0, away * norm, 0) + 1 + 1e-9 * np.abs(score)
                meets = (score + pad >= least - 1e-9 * abs(least)) & (score - pad <= most + 1e-9 * abs(most))
                own = batch.filter(pa.array(meets))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array([cell] * own.num_rows, pa.int32())], [*own.schema.names, "cell"])

    return rows.select("uid", "id", "label", "x", part).mapInArrow(run, "uid long, id long, label long, x array<long>, part long, cell int")
