"""SimHash fingerprints of whole texts and the classes of fingerprints a few bits apart.

A fingerprint takes 64 majority votes over the XXH64 values of word shingles. Equal
fingerprints are collapsed first. The distinct ones are joined with themselves by
walking a binary trie against itself: a pair of nodes carries the bits in which it
differs so far and is dropped when these exceed the budget.

Values that share a stretch of bits form a group, one of which every close pair has in common;
large groups are split by further stretches. The trie of a group is walked against itself in
one task, which returns a spanning forest of its links, never all pairs.

Null, empty or wordless texts have fingerprint zero, which links like any other. Rows
with a null doc_id keep a fingerprint and count in no minimum. Equal rows stay apart
as rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.llm.shared import Forest, byte_texts, components, settled, slices

BITS = 64
SEED = 42
_BLOCK = 1 << 15


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Unsigned fingerprint of a whole text; bytes between ASCII white space are words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(lengths + 1) - 1
    starts = (stops - lengths)[: len(words) - k + 1].tolist()
    stops = stops[k - 1 :].tolist()
    n = len(starts)
    votes = np.zeros(BITS, np.int64)
    for a in range(0, n, _BLOCK):
        span = zip(starts[a : a + _BLOCK], stops[a : a + _BLOCK])
        hashes = np.array([xxh64_intdigest(joined[i:j], SEED) for i, j in span], ">u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, place (hash of the text), fp (the fingerprint as a signed long) of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t, shingle) for t in byte_texts(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("place"), pa.array(found.view(np.int64))], ["doc_id", "place", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("place")).mapInArrow(run, "doc_id long, place long, fp long")


class Trie:
    """Nodes of a binary trie over sorted distinct fingerprints, as ranges of the array; node 0 is the root."""

    def __init__(self, values: np.ndarray, leaf: int = 8):
        self.values, self.width = values, leaf
        levels = []
        lo, hi, made = np.array([0]), np.array([len(values)]), 1
        for depth in range(BITS + 1):
            zero, one = np.full(len(lo), -1), np.full(len(lo), -1)
            open_ = np.flatnonzero(hi - lo > leaf)
            levels.append((lo, hi, zero, one))
            if not len(open_):
                break
            shift = np.uint64(BITS - 1 - depth)
            first = (values[lo[open_]] >> shift | np.uint64(1)) << shift
            mid = np.clip(np.searchsorted(values, first), lo[open_], hi[open_])
            there = np.column_stack([mid > lo[open_], hi[open_] > mid])
            number = made - 1 + np.cumsum(there.ravel()).reshape(-1, 2)
            zero[open_] = np.where(there[:, 0], number[:, 0], -1)
            one[open_] = np.where(there[:, 1], number[:, 1], -1)
            bounds = np.column_stack([lo[open_], mid, mid, hi[open_]]).reshape(-1, 2)[there.ravel()]
            lo, hi, made = bounds[:, 0], bounds[:, 1], made + len(bounds)
        self.lo, self.hi, self.zero, self.one = (np.concatenate(part) for part in zip(*levels))
        self.leaf = (self.zero < 0) & (self.one < 0)

    def members(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of each leaf's values as a matrix, and which of its cells are real."""
        places = self.lo[nodes][:, None] + np.arange(self.width)
        real = places < self.hi[nodes][:, None]
        return np.where(real, places, self.lo[nodes][:, None]), real


def trie_links(a: Trie, b: Trie, same: bool, budget: int = 4, chunk: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i in a, j in b) at most ``budget`` bits apart; within one trie i < j.

    Node pairs are held on a stack of bounded blocks. A leaf waits for its partner
    to reach a leaf; the bits it skips count as equal.
    """
    stack = [(np.array([0]), np.array([0]), np.array([0], np.int8))]
    while stack:
        x, y, spent = stack.pop()
        if len(x) > chunk:
            half = len(x) // 2
            stack += [(x[:half], y[:half], spent[:half]), (x[half:], y[half:], spent[half:])]
            continue
        ends_x, ends_y = a.leaf[x], b.leaf[y]
        final = ends_x & ends_y
        fx, fy = x[final], y[final]
        for k in range(0, len(fx), 1 << 14):
            yield from _compare(a, b, fx[k : k + (1 << 14)], fy[k : k + (1 << 14)], same, budget)
        nx, ny, ns = [], [], []
        for mask, parts in (
            (ends_x & ~ends_y, ((None, "zero", 0), (None, "one", 0))),
            (~ends_x & ends_y, (("zero", None, 0), ("one", None, 0))),
            (~ends_x & ~ends_y, (("zero", "zero", 0), ("one", "one", 0), ("zero", "one", 1), ("one", "zero", 1))),
        ):
            px, py, ps = x[mask], y[mask], spent[mask]
            for of_a, of_b, cost in parts:
                cx = getattr(a, of_a)[px] if of_a else px
                cy = getattr(b, of_b)[py] if of_b else py
                keep = (cx >= 0) & (cy >= 0) & (ps + cost <= budget)
                if same and (of_a, of_b) == ("one", "zero"):
                    keep &= px != py
                nx.append(cx[keep])
                ny.append(cy[keep])
                ns.append(ps[keep] + np.int8(cost))
        nx = np.concatenate(nx)
        if len(nx):
            stack.append((nx, np.concatenate(ny), np.concatenate(ns)))


def _compare(a: Trie, b: Trie, x: np.ndarray, y: np.ndarray, same: bool, budget: int):
    (i, real_i), (j, real_j) = a.members(x), b.members(y)
    near = np.bitwise_count(a.values[i][:, :, None] ^ b.values[j][:, None, :]) <= budget
    pair, cell = np.divmod(np.flatnonzero(near), a.width * b.width)
    u, v = np.divmod(cell, b.width)
    keep = real_i[pair, u] & real_j[pair, v]
    i, j = i[pair[keep], u[keep]], j[pair[keep], v[keep]]
    if same:
        i, j = i[i < j], j[i < j]
    if len(i):
        yield i, j


def _shares(mask: int, budget: int, width: int) -> list[int]:
    """``mask`` with the first ``width`` bits of each of ``budget`` + 1 stretches of the bits it leaves open."""
    open_ = [k for k in range(BITS - 1, -1, -1) if not mask >> k & 1]
    edges = [len(open_) * i // (budget + 1) for i in range(budget + 2)]
    return [mask | sum(1 << k for k in open_[lo : min(hi, lo + width)]) for lo, hi in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> BITS - 1 else mask


def links(values: DataFrame, budget: int = 4, node_rows: int = 8192, least_tasks: int = 24) -> DataFrame:
    """Edges (a, b) that connect the distinct ``fp`` values exactly as all pairs within ``budget`` bits do.

    Of ``budget`` + 1 stretches of bits two such values have one in common: each value goes, for each
    stretch, to the group of values that share its first bits there. Groups above four times
    ``node_rows`` are dealt again by stretches of their other bits, so that no task grows with the
    table and a value is copied ``budget`` + 1 times in each of a few rounds. The driver sees no value.
    """
    spark = values.sparkSession
    total = values.count()
    if not total:
        return spark.createDataFrame([], "a long, b long")
    width = max(0, (total // node_rows).bit_length())
    masks = _shares(0, budget, width)
    part = F.col("fp").bitwiseAND(F.col("mask"))
    groups = values.select("fp", F.explode(F.array_distinct(F.array(*[F.lit(_signed(m)).cast("long") for m in masks]))).alias("mask"))
    dealt = None
    while True:
        groups = settled(groups.withColumn("part", part))
        hot = settled(groups.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 4 * node_rows).select("mask", "part"))
        masks = [m for m in set(masks) if BITS - m.bit_count() > 20]
        known = [_signed(m) for m in masks]
        hot = hot.filter(F.col("mask").isin(known)) if known else hot.limit(0)
        done = hot.isEmpty()
        calm = groups if done else groups.join(hot, ["mask", "part"], "left_anti").select(groups.columns)
        dealt = calm if dealt is None else dealt.unionByName(calm)
        if done:
            break
        finer = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)).cast("long"), F.array(*[F.lit(_signed(k)).cast("long") for k in _shares(m, budget, BITS)]))])
        split = groups.join(hot, ["mask", "part"], "left_semi")
        groups = split.select("fp", F.explode(finer[F.col("mask")]).alias("mask")).distinct()
        masks = [k for m in masks for k in _shares(m, budget, BITS)]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, own in group.groupby(["mask", "part"], sort=False):
            every = np.sort(own["fp"].to_numpy().view(np.uint64))
            trie, forest = Trie(every), Forest(len(every))
            for i, j in trie_links(trie, trie, True, budget):
                forest.add(i, j)
            member, root = forest.edges()
            found.append(pd.DataFrame({"a": every[member].view(np.int64), "b": every[root].view(np.int64)}))
        return pd.concat(found)

    tasks = max(least_tasks, (budget + 1) * total // node_rows)
    numbered = dealt.withColumn("task", F.pmod(F.xxhash64("mask", "part"), F.lit(tasks)))
    return numbered.groupBy("task").applyInPandas(run, "a long, b long")


def classes(docs: DataFrame, shingle: int = 4, budget: int = 4) -> DataFrame:
    """doc_id, place (hash of the text), fp, root (of the class), component_id (the class's smallest doc_id) of each row of ``docs`` (doc_id, text)."""
    each = settled(fingerprints(docs, shingle))
    firsts = settled(each.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(firsts.select("fp"), budget)).withColumnRenamed("node", "fp")
    rooted = firsts.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_value = settled(rooted.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id"))
    return each.join(by_value, "fp").select("doc_id", "place", "fp", "root", "component_id")


def first_of_class(docs: DataFrame, shingle: int = 4, budget: int = 4) -> DataFrame:
    """Rows of ``docs`` that stand for their class of fingerprints."""
    return standing(docs, classes(docs, shingle, budget))


def standing(docs: DataFrame, classed: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class, with all its columns: that of the smallest doc_id; of equal ones the first by the hash of its text.

    ``classed``: doc_id, place (hash of the text), root of each row. Classes are told apart by root, since two of them may hold
    one doc_id. Of rows with one doc_id and one text the smallest by all columns stays. Rows with a null doc_id stay.
    """
    named = classed.filter("doc_id is not null")
    first = settled(named.groupBy("root").agg(F.min(F.struct("doc_id", "place")).alias("m")).select("m.doc_id", "m.place"))
    rows = settled(named.groupBy("doc_id", "place").agg(F.count(F.lit(1)).alias("n")))
    leaving = rows.join(first, ["doc_id", "place"], "left_anti").select(F.col("doc_id").alias("_id"), F.col("place").alias("_place"))
    repeated = rows.filter("n > 1").join(first, ["doc_id", "place"], "left_semi").select(F.col("doc_id").alias("_id"), F.col("place").alias("_place"))
    own = [docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)]
    keyed = docs.select(*own, docs["doc_id"].cast("long").alias("_id"), F.xxhash64(docs["text"]).alias("_place"))
    kept = keyed.join(leaving, ["_id", "_place"], "left_anti")
    alone = kept.join(repeated, ["_id", "_place"], "left_anti")
    cells = [f"c{k}" for k in range(len(own))]
    several = kept.join(repeated, ["_id", "_place"], "left_semi").groupBy("_id", "_place").agg(F.min(F.struct(*cells)).alias("m"))
    return alone.select(*cells).union(several.select("m.*")).toDF(*docs.columns)


def digest(classed: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return classed.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
