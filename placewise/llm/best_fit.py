"""Vector best-fit packing of tokenised documents into sequences.

A document longer than a sequence is cut into full pieces and one rest. A piece asks
for three things: tokens, one document slot, and attention cost (its length squared).
Pieces are placed by decreasing length; each goes to the open sequence that can take it
under every capacity and scores best, by the smallest norm of what is left or by the
largest weighted dot product of demand and rest.

Pieces are dealt by hash into groups of a few thousand, each packed by itself: a group
wastes little more than its last sequence. Full pieces need no packing.

Null and empty texts are pieces of one token (the end id). A null doc_id is kept; equal
rows are packed once each. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.llm import word_ids
from placewise.llm.shared import byte_texts, settled, slices

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Capacity:
    """What one sequence can hold, and how much each part weighs when sequences are compared."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)
    rule: str = "norm"  # or "dot"


def pieces(docs: DataFrame, tokens: int = 4096, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of ``docs`` (doc_id, text)."""
    source = path or word_ids.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), word_ids.encode_texts(byte_texts(batch), source)):
                for k, a in enumerate(range(0, len(ids) // 4, tokens)):
                    part = ids[4 * a : 4 * (a + tokens)]
                    rows.append((doc_id, k, a, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)] if rows else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECES)


def place(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; the lengths come largest first."""
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    scale = np.sqrt(np.array(capacity.weights)) / full
    rest = np.empty((max(1, len(lengths)), 3))
    ids, at = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used = first = 0
    for k, n in enumerate(lengths.tolist()):
        need = np.array([n, 1, n * n], float)
        left = rest[first:used] - need
        fits = np.flatnonzero((left >= 0).all(axis=1))
        if len(fits):
            if capacity.rule == "norm":
                best = fits[np.argmin((np.square(left[fits] * scale)).sum(axis=1))]
            else:
                best = fits[np.argmax(((rest[first + fits] * scale) * (need * scale)).sum(axis=1))]
            b = first + int(best)
        else:
            b, used = used, used + 1
            rest[b] = full
        ids[k], at[k] = b, capacity.tokens - rest[b, 0]
        rest[b] -= need
        while first < used and (rest[first] <= 0).any():
            first += 1
    return ids, at


def pack(parts: DataFrame, capacity: Capacity = Capacity(), group_rows: int = 8192) -> DataFrame:
    """``parts`` with sequence_id and offset.

    A piece over a capacity by itself raises. Groups are numbered from a count of the
    pieces and dealt by a hash of the row and its number, so no document, source, length or
    row that repeats gathers in one of them.
    """
    parts = settled(parts)
    facts = parts.agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).first()
    longest = facts.longest or 0
    if longest > capacity.tokens or longest * longest > capacity.attention or (facts.n and capacity.documents < 1):
        raise ValueError("a piece exceeds the capacity of a sequence")
    groups = max(1, -(-facts.n // group_rows))
    dealt = parts.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, at = place(rows["length"].to_numpy(), capacity)
        out = rows[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
        out["sequence_id"] = (rows["_group"].to_numpy().astype("int64") << 32) + bins
        out["offset"] = at
        return out

    return dealt.groupBy("_group").applyInPandas(run, _PIECES + ", sequence_id long, offset long")


def packed(docs: DataFrame, capacity: Capacity = Capacity(), path: str | None = None) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack(pieces(docs, capacity.tokens, path), capacity)
