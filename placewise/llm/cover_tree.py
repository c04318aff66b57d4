"""Exact cosine links by walking a cover tree against itself.

On the unit sphere a cosine of at least c is a distance of at most sqrt(2 - 2c). The
top of the tree is a net of centres chosen from a bounded sample; every vector joins
its nearest centre. Below, each block holds nested levels whose radii halve, and each
node knows the radius that its members really need. Two blocks are one task, unless the
bound on their centres and radii keeps all their members apart. A task walks the two
subtrees level by level: a pair of nodes is dropped when the bound keeps it apart,
taken as a whole when the bound puts all members within reach, and opened otherwise.
Pairs of vectors are decided by their cosine in double precision.

Equal vectors are one member with a count. Cells above the block size are dealt into
blocks by hash. A task returns for each member its number of links and one edge of a
spanning forest, never the pairs.

Vectors that are null, zero, hold null or non-finite components, or are of another
length than most link with nothing. Rows with a null id are compared with nothing and
have no component. Repeated ids count as rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.llm.shared import Forest, components, settled
from placewise.llm.vectors import main_dimension, matrix, usable

RADII = (0.5, 0.25, 0.125)
MOST_BLOCKS = 1024  # bounds the list of block pairs on the driver; beyond it blocks grow
_SLACK = 1e-9


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.square(rows).sum(axis=1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def centres(sample: np.ndarray, k: int) -> np.ndarray:
    """``k`` rows, each the one farthest from those before it: a net at every radius it passes."""
    chosen = [0]
    gap = distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(k, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def levels(points: np.ndarray) -> np.ndarray:
    """For each point and radius, the point that is its centre; centres stay centres further down."""
    out = np.empty((len(points), len(RADII)), np.int64)
    groups = [np.arange(len(points))]
    for level, radius in enumerate(RADII):
        below = []
        for rest in groups:
            while len(rest):
                near = points[rest] @ points[rest[0]] >= 1 - radius * radius / 2
                near[0] = True
                out[rest[near], level] = rest[0]
                below.append(rest[near])
                rest = rest[~near]
        groups = below
    return out


class Subtree:
    """Members of a block in tree order; the nodes of a level are ranges of them."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, paths: np.ndarray, counts: np.ndarray):
        order = np.lexsort((ids, *paths.T[::-1]))
        self.ids, self.points, self.counts = ids[order], points[order], counts[order].astype(np.int64)
        paths = paths[order]
        self.before = np.concatenate([[0], np.cumsum(self.counts)])
        self.lo, self.hi, self.centre, self.radius = [], [], [], []
        for level in range(paths.shape[1]):
            new = np.concatenate([[True], (paths[1:, : level + 1] != paths[:-1, : level + 1]).any(axis=1)])
            lo = np.flatnonzero(new)
            owner = np.cumsum(new) - 1
            middle = np.flatnonzero(self.ids == paths[:, level])
            away = np.sqrt(np.square(self.points - self.points[middle][owner]).sum(axis=1))
            radius = np.zeros(len(lo))
            np.maximum.at(radius, owner, away)
            self._add(lo, np.concatenate([lo[1:], [len(ids)]]), middle, radius)
        every = np.arange(len(ids))
        self._add(every, every + 1, every, np.zeros(len(ids)))
        self.child = [np.searchsorted(self.lo[k + 1], self.lo[k]) for k in range(len(self.lo) - 1)]
        self.children = [np.searchsorted(self.lo[k + 1], self.hi[k]) - self.child[k] for k in range(len(self.lo) - 1)]

    def _add(self, lo, hi, centre, radius) -> None:
        self.lo.append(lo)
        self.hi.append(hi)
        self.centre.append(centre)
        self.radius.append(radius)


class Links:
    """Link counts and a spanning forest of the members of one or two blocks."""

    def __init__(self, a: Subtree, b: Subtree | None):
        self.a, self.b, self.shift = a, b or a, 0 if b is None else len(a.ids)
        n = len(a.ids) + (0 if b is None else len(b.ids))
        self.count = np.zeros(n, np.int64)
        self.steps = np.zeros(n + 1, np.int64)
        self.joined = np.zeros(n + 1, np.int64)
        self.forest = Forest(n)

    def pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.count, i, self.b.counts[j])
        np.add.at(self.count, j + self.shift, self.a.counts[i])
        self.forest.add(i, j + self.shift)

    def whole(self, level: int, x: np.ndarray, y: np.ndarray) -> None:
        """All members of node x link with all of node y."""
        a, b = self.a, self.b
        xl, xh, yl, yh = a.lo[level][x], a.hi[level][x], b.lo[level][y], b.hi[level][y]
        own = (xl == yl) & (self.shift == 0)
        for lo, hi, gain in ((xl, xh, b.before[yh] - b.before[yl]), (yl[~own] + self.shift, yh[~own] + self.shift, (a.before[xh] - a.before[xl])[~own])):
            np.add.at(self.steps, lo, gain)
            np.add.at(self.steps, hi, -gain)
            np.add.at(self.joined, lo, 1)
            np.add.at(self.joined, hi - 1, -1)
        # A node against itself counts each member with itself once too often.
        for lo, hi in zip(xl[own], xh[own]):
            self.count[lo:hi] -= a.counts[lo:hi]
        self.forest.add(xl, yl + self.shift)

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        count = self.count + np.cumsum(self.steps[:-1])
        tied = np.flatnonzero(np.cumsum(self.joined[:-1]) > 0)
        self.forest.add(tied, tied + 1)
        ids = self.a.ids if self.shift == 0 else np.concatenate([self.a.ids, self.b.ids])
        root = self.forest.roots(np.arange(len(ids)))
        linked = np.flatnonzero((count > 0) | (root != np.arange(len(ids))))
        return ids[linked], count[linked], ids[root[linked]]


def walk(a: Subtree, b: Subtree | None, cosine: float, chunk: int = 1 << 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, number of links, member that stands for its set) of the members with links."""
    links, other, reach = Links(a, b), b or a, np.sqrt(2 - 2 * cosine)
    last = len(a.lo) - 1
    stack: list[tuple[int, np.ndarray, np.ndarray]] = []

    def judge(level: int, x: np.ndarray, y: np.ndarray, away: np.ndarray) -> None:
        bound = a.radius[level][x] + other.radius[level][y]
        close = away <= bound + reach + _SLACK
        x, y, away, bound = x[close], y[close], away[close], bound[close]
        if level == last:
            if b is None:
                x, y = x[x < y], y[x < y]
            hit = np.einsum("ij,ij->i", a.points[x], other.points[y]) >= cosine
            links.pairs(x[hit], y[hit])
            return
        inside = away + bound <= reach - _SLACK
        if inside.any():
            links.whole(level, x[inside], y[inside])
        if not inside.all():
            stack.append((level + 1, x[~inside], y[~inside]))

    tops_a, tops_b = a.points[a.centre[0]], other.points[other.centre[0]]
    step = max(1, (1 << 21) // max(1, len(tops_b)))
    for start in range(0, len(tops_a), step):
        away = distances(tops_a[start : start + step], tops_b)
        flat = np.flatnonzero(away <= a.radius[0][start : start + step, None] + other.radius[0][None, :] + reach + _SLACK)
        x, y = np.divmod(flat, len(tops_b))
        x += start
        if b is None:
            x, y, flat = x[x <= y], y[x <= y], flat[x <= y]
        judge(0, x, y, away.ravel()[flat])
        while stack:
            level, px, py = stack.pop()
            size = a.children[level - 1][px] * other.children[level - 1][py]
            if len(px) > 1 and size.sum() > chunk:
                half = len(px) // 2
                stack += [(level, px[:half], py[:half]), (level, px[half:], py[half:])]
                continue
            for lo in range(0, int(size.sum()), chunk):
                hi = min(lo + chunk, int(size.sum()))
                owner = np.searchsorted(np.cumsum(size), np.arange(lo, hi), "right")
                place = np.arange(lo, hi) - (np.cumsum(size) - size)[owner]
                wide = other.children[level - 1][py[owner]]
                cx, cy = a.child[level - 1][px[owner]] + place // wide, other.child[level - 1][py[owner]] + place % wide
                if b is None:
                    keep = cx <= cy
                    cx, cy = cx[keep], cy[keep]
                p, q = a.points[a.centre[level][cx]], other.points[other.centre[level][cy]]
                judge(level, cx, cy, np.sqrt(np.square(p - q).sum(axis=1)))
    return links.result()


def _blocked(members: DataFrame, width: int, total: int, block_rows: int, blocks: int):
    """Members with their block; the centres of cells; the cell and the radius of each block."""
    spark = members.sparkSession
    most = max(256, -(-total // min(max(blocks, total // block_rows), MOST_BLOCKS)))
    taken = members.orderBy(F.xxhash64("id"), "id").limit(1024).select("v").collect()
    top = centres(unit(np.array([r.v for r in taken])), max(4, min(256, total // block_rows)))
    held = spark.sparkContext.broadcast(top)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = distances(unit(matrix(batch.column("v"), width)), held.value)
            cell = away.argmin(axis=1)
            columns = [*batch.columns, pa.array(cell.astype("int32")), pa.array(away[np.arange(len(cell)), cell])]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "cell", "away"])

    placed = settled(members.mapInArrow(assign, "id long, n long, v array<double>, cell int, away double"))
    sizes = {r.cell: r.n for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, parts, made = {}, {}, 0
    for cell, n in sorted(sizes.items()):
        first[cell], parts[cell] = made, -(-n // most)
        made += parts[cell]
    cells = spark.createDataFrame([(c, first[c], parts[c]) for c in sizes], "cell int, first int, parts int")
    dealt = placed.join(F.broadcast(cells), "cell").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts"))).cast("int"))
    reach = {r.block: (r.cell, r.away) for r in dealt.groupBy("block").agg(F.first("cell").alias("cell"), F.max("away").alias("away")).collect()}
    return dealt, top, reach


def links(members: DataFrame, width: int, cosine: float, block_rows: int = 8192, blocks: int = 10) -> DataFrame:
    """id, n_links, root of each of ``members`` (id, n, v) that links, once for each task that found links."""
    spark = members.sparkSession
    total = members.count()
    if not total:
        return spark.createDataFrame([], "id long, n_links long, root long")
    dealt, top, reach = _blocked(members, width, total, block_rows, blocks)
    limit, gaps, names = np.sqrt(2 - 2 * cosine) + _SLACK, distances(top, top), sorted(reach)
    apart = lambda x, y: gaps[reach[x][0], reach[y][0]] > reach[x][1] + reach[y][1] + limit
    pairs = [(x, y) for x in names for y in names if x <= y and not apart(x, y)]

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["away", "id"]).reset_index(drop=True)
        paths = group["id"].to_numpy()[levels(unit(matrix(group["v"], width)))]
        return pd.DataFrame({"block": group["block"], "id": group["id"], "n": group["n"], "v": group["v"], "path": list(paths)})

    trees = settled(dealt.select("block", "id", "n", "v", "away").groupBy("block").applyInPandas(build, "block int, id long, n long, v array<double>, path array<long>"))
    tasks = [(x, k, side) for k, pair in enumerate(pairs) for side, x in enumerate(dict.fromkeys(pair))]
    spread = spark.createDataFrame(pd.DataFrame(tasks, columns=["block", "task", "side"], dtype="int32"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for side in (0, 1):
            rows = group[group["side"].to_numpy() == side]
            if len(rows):
                sides.append(Subtree(rows["id"].to_numpy(), unit(matrix(rows["v"], width)), np.stack(list(rows["path"])), rows["n"].to_numpy()))
        member, n, root = walk(sides[0], sides[1] if len(sides) > 1 else None, cosine)
        return pd.DataFrame({"id": member, "n_links": n, "root": root})

    return trees.join(F.broadcast(spread), "block").groupBy("task").applyInPandas(run, "id long, n_links long, root long")


def classes(table: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of ``table``."""
    every = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    able = every.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    width = main_dimension(able, "v")
    able = able.filter(F.size("v") == width)
    members = settled(able.groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")).select("id", "n", "v"))
    found = settled(links(members, width, cosine))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("id"), "root")
    counts = found.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    judged = settled(members.join(counts, "id", "left").join(roots, "id", "left").select(
        "v", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id")
    ))
    able_now = F.col("vec_id").isNotNull() & usable(F.col("v")) & (F.size("v") == width)
    linked = every.filter(able_now).join(judged, "v").select("vec_id", "n_links", "component_id")
    alone = every.filter(~F.coalesce(able_now, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
