"""Benchmark passages in documents, found by Wu-Manber search for many strings at once.

Texts are lower-cased (A-Z) and cut into words of digits, a-z and characters beyond ASCII. The
strings to find are windows of ten consecutive words of an item (all words of a shorter item),
with a space before, between and after the words. Windows of as many words form one table: of
each string its first m bytes count, m the length of the shortest (255 at most). Blocks of eight bytes, hashed,
tell how far the search may jump (the distance from the block's last place in any string to its
end); where that is zero, the block's bucket holds the strings to compare directly.

A batch of documents is one buffer. It is searched in lanes that jump together; each place
belongs to one lane, so every occurrence is found once. Documents are never cut.

Pairs of window and item are dealt by hash into parts of bounded bytes; a part is what the driver
collects and ships at once. One part is the rule. With several, each part is searched in a job of
its own, only texts with a hit are moved, and their hits are merged by the text's digest.

Null, empty and wordless texts have no words and are clean; wordless items have no window. Rows
of one item_id are one item. Items without an id hit words, but are not listed. Repeated rows and
doc_ids are rows of their own; rows with a null doc_id are judged like others. Without documents
there are no rows; without items all are clean. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.llm.shared import byte_texts, in_groups, settled, slices

WINDOW = 10
BLOCK = 8
_BITS = 20
_HEAD = 255
_LANE = 256
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SPACE = 32


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def marked(words: list[bytes]) -> bytes:
    return b" %b " % b" ".join(words) if words else b""


def windows_of(words: list[bytes], window: int) -> set[tuple[int, bytes]]:
    """(words, string) of each distinct window."""
    k = min(window, len(words))
    return {(k, marked(words[i : i + k])) for i in range(len(words) - k + 1)} if k else set()


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """words, string, item (item_id as text) of each distinct pair of window and item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(k, s, item) for item, t in zip(batch.column("item").to_pylist(), byte_texts(batch)) for k, s in windows_of(words_of(t), window)]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["words", "string", "item"])

    return benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(run, "words int, string binary, item string").distinct()


def _keys(blocks: np.ndarray) -> np.ndarray:
    return ((blocks * _STEP) >> np.uint64(64 - _BITS)).astype(np.int64)


class Table:
    """Jumps and buckets of the strings with ``words`` words."""

    def __init__(self, words: int, strings: list[bytes], numbers: list[int]):
        self.words, self.m = words, min(_HEAD, *map(len, strings))
        self.block = min(BLOCK, self.m)
        self.mask = np.uint64((1 << 8 * self.block) - 1)
        heads = np.frombuffer(b"".join(s[: self.m] for s in strings), np.uint8).reshape(-1, self.m)
        padded = np.zeros((len(strings), self.m + 8), np.uint8)
        padded[:, : self.m] = heads
        self.jump = np.full(1 << _BITS, self.m - self.block + 1, np.uint8)
        for end in range(self.block, self.m + 1):
            blocks = np.ascontiguousarray(padded[:, end - self.block : end - self.block + 8]).view("<u8")[:, 0] & self.mask
            keys = _keys(blocks)
            np.minimum.at(self.jump, keys, np.uint8(self.m - end))
        self.buckets: dict[int, dict[bytes, int]] = {}
        for key, string, number in zip(keys.tolist(), strings, numbers):
            self.buckets.setdefault(key, {})[string] = number

    def stops(self, blocks: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where a string's first m bytes may end, and the bucket's key; ``blocks`` holds 8 bytes from each place."""
        if length < self.m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lanes = max(1, (length - self.m + 1) // _LANE)
        edges = np.linspace(self.m - 1, length, lanes + 1).astype(np.int64)
        at, end = edges[:-1], edges[1:]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        while len(at):
            keys = _keys(blocks[at - (self.block - 1)] & self.mask)
            jump = self.jump[keys]
            stop = jump == 0
            if stop.any():
                found.append((at[stop], keys[stop]))
            at = at + np.maximum(jump, 1)
            left = at < end
            at, end = at[left], end[left]
        return tuple(np.concatenate(part) for part in zip(*found))


class Finder:
    """Tables for one part of the windows, and the items of each window."""

    def __init__(self, rows: list[tuple[int, bytes, str | None]]):
        numbers: dict[tuple[int, bytes], int] = {}
        self.items: list[list[str]] = []
        for words, string, item in rows:
            number = numbers.setdefault((words, bytes(string)), len(numbers))
            if number == len(self.items):
                self.items.append([])
            if item is not None:
                self.items[number].append(item)
        self.tables = []
        for k in sorted({words for words, _ in numbers}):
            own = [(s, n) for (words, s), n in numbers.items() if words == k]
            self.tables.append(Table(k, [s for s, _ in own], [n for _, n in own]))

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
        """(words, ranges of hit words, items) of each text."""
        for a, b in in_groups([len(t) for t in texts]):
            yield from self._batch([words_of(t) for t in texts[a:b]])

    def _batch(self, rows: list[list[bytes]]) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
        text = b"\n".join(map(marked, rows))
        raw = np.frombuffer(text + bytes(8), np.uint8)
        blocks = np.ndarray((len(text) + 1,), "<u8", raw.data, 0, (1,))
        spaces = np.flatnonzero(raw[: len(text)] == _SPACE)
        counts = np.array([len(r) for r in rows], np.int64)
        # The k-th space of a text stands before its k-th word; the last one closes it.
        first = np.cumsum(np.where(counts > 0, counts + 1, 0)) - np.where(counts > 0, counts + 1, 0)
        steps = np.zeros(len(spaces) + 1, np.int64)
        items: dict[int, set[int]] = {}
        for table in self.tables:
            at, keys = table.stops(blocks, len(text))
            starts = at - (table.m - 1)
            begin = raw[starts] == _SPACE
            starts, keys = starts[begin], keys[begin]
            place = np.searchsorted(spaces, starts)
            whole = place + table.words < len(spaces)
            starts, keys, place = starts[whole], keys[whole], place[whole]
            ends = spaces[place + table.words] + 1
            owner = np.searchsorted(first, place, "right") - 1
            hit = []
            for k, (s, e, key, doc) in enumerate(zip(starts.tolist(), ends.tolist(), keys.tolist(), owner.tolist())):
                number = table.buckets[key].get(text[s:e]) if key in table.buckets else None
                if number is not None:
                    hit.append(k)
                    items.setdefault(doc, set()).add(number)
            np.add.at(steps, place[hit], 1)
            np.add.at(steps, place[hit] + table.words, -1)
        inside = np.concatenate([[False], np.cumsum(steps[:-1]) > 0, [False]])
        opens, closes = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
        owner = np.searchsorted(first, opens, "right") - 1
        spans: dict[int, list[tuple[int, int]]] = {}
        for doc, x, y in zip(owner.tolist(), opens.tolist(), closes.tolist()):
            spans.setdefault(doc, []).append((x - int(first[doc]), y - int(first[doc])))
        for doc, n in enumerate(counts.tolist()):
            yield n, spans.get(doc, []), {i for number in items.get(doc, ()) for i in self.items[number]}


def _digest(items: set[str]) -> str:
    return sha256(",".join(sorted(items)).encode()).hexdigest()


_FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _found_batch(first: list[pa.Array], names: list[str], found: list[tuple[int, list[tuple[int, int]], set[str]]]) -> pa.RecordBatch:
    hits = [sum(y - x for x, y in spans) for _, spans, _ in found]
    columns = [
        *first, pa.array([n for n, _, _ in found], pa.int64()), pa.array(hits, pa.int64()), pa.array([len(i) for _, _, i in found], pa.int64()),
        pa.array([_digest(i) for _, _, i in found], pa.string()), pa.array([h > 0 for h in hits], pa.bool_()),
    ]
    return pa.RecordBatch.from_arrays(columns, [*names, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    pairs = settled(windows(benchmark, window))
    size = pairs.agg(F.sum(F.length("string") + F.coalesce(F.length("item"), F.lit(0)) + 16)).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    part = F.pmod(F.xxhash64("string", "item"), F.lit(parts))
    rows = docs.select(F.col("doc_id").cast("long"), "text")

    def finder(k: int):
        return spark.sparkContext.broadcast(Finder([tuple(r) for r in pairs.filter(part == k).collect()]))

    if parts == 1:
        held = finder(0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                yield _found_batch([batch.column("doc_id")], ["doc_id"], list(held.value.search(byte_texts(batch))))

        return rows.mapInArrow(run, f"doc_id long, {_FOUND}")
    hits = settled(_hits(rows, finder(0)))
    for k in range(1, parts):
        hits = settled(hits.union(_hits(rows, finder(k))))
    merged = hits.dropDuplicates(["digest", "spans", "items"]).groupBy("digest").applyInPandas(_merged, f"digest binary, {_FOUND}").drop("n_words")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = byte_texts(batch)
            columns = [batch.column("doc_id"), pa.array([sha256(t).digest() for t in texts], pa.binary()), pa.array([len(words_of(t)) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "n_words"])

    every = rows.mapInArrow(count, "doc_id long, digest binary, n_words long").join(merged, "digest", "left")
    return every.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.lit(_digest(set()))).alias("items_sha256"), F.coalesce("contaminated", F.lit(False)).alias("contaminated"),
    )


def _hits(rows: DataFrame, held) -> DataFrame:
    """digest, spans, items of each row whose text has a hit of one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = byte_texts(batch)
            found = [(sha256(t).digest(), [x for span in spans for x in span], sorted(items)) for t, (_, spans, items) in zip(texts, held.value.search(texts)) if spans]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "spans", "items"])

    return rows.mapInArrow(run, "digest binary, spans array<long>, items array<string>")


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    """One text's ranges and items of all parts together."""
    spans = sorted((int(s[i]), int(s[i + 1])) for s in group["spans"] for i in range(0, len(s), 2))
    covered = reach = 0
    for x, y in spans:
        covered += max(0, y - max(x, reach))
        reach = max(reach, y)
    items = {i for own in group["items"] for i in own}
    return pd.DataFrame({"digest": [group["digest"].iloc[0]], "n_words": [0], "n_hit": [covered], "n_items": [len(items)], "items_sha256": [_digest(items)], "contaminated": [covered > 0]})
