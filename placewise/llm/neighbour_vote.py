"""Quality by the votes of the nearest labelled documents in a latent-semantic space.

Terms of a text are hashed words, hashed shapes of its chunks (runs of letters, capitals,
digits and signs) and signs of repetition. Each of the three blocks is weighted by
log-frequency and rarity and brought to one length. A truncated singular value
decomposition of the labelled sample gives the space. Every document is compared with
every labelled vector in blocks of exact cosine products; the nearest ones vote with
the square of their similarity.

The labelled sample has at most ``max_labelled`` rows, one for each hash bucket of
doc_id, so that its vectors can be broadcast. Null and empty texts have only the terms
of repetition. Without usable labels every score is 0.5. Repeated labels of a document
count once (the smaller label). Other columns are kept by ``keep``, ignored by ``score``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.llm.shared import ChunkTable, byte_texts, crc_of, in_groups, slices

WORDS, SHAPES, SIGNS = 4096, 1024, 24
WIDTH = WORDS + SHAPES + SIGNS
BLOCKS = ((0, WORDS, 0.5), (WORDS, WORDS + SHAPES, 1.0), (WORDS + SHAPES, WIDTH, 0.7))
THRESHOLD = 0.3
_RUNS = re.compile(r"(a+|A+|9+|(.)\2*)", re.DOTALL)


def _shape(text: str) -> str:
    kinds = "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in text)
    return _RUNS.sub(lambda m: m[0][0], kinds)


def _terms(chunk: bytes) -> tuple[int, int]:
    text = chunk.decode("utf-8", "replace")
    word = "".join(filter(str.isalnum, text.lower()))
    return crc32(word.encode()) % WORDS, WORDS + crc32(_shape(text).encode()) % SHAPES


class Terms:
    """Weighted terms of whole texts, before rarity; chunks are analysed once each."""

    def __init__(self):
        self.table = ChunkTable(lambda chunks: [w << 16 | s for w, s in map(_terms, chunks)], limit=200_000)

    def __call__(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for a, b in in_groups([len(t) for t in texts]):
            out += map(_weighted, self.table.look_up([t.split() for t in texts[a:b]], lambda ids: np.fromiter(ids, np.int64)))
        return out


@lru_cache(maxsize=1)
def _analyser() -> Terms:
    return Terms()


def _weighted(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(pairs)
    words, shapes = pairs >> 16, pairs & 0xFFFF
    terms, counts = np.unique(np.concatenate([words, shapes]), return_counts=True)
    repeats = (words[1:] == words[:-1]).mean() if n > 1 else 0.0
    distinct = len(np.unique(words)) / n if n else 0.0
    plain = float((np.bincount(shapes - WORDS, minlength=1).max() / n)) if n else 0.0
    signs = [
        int(np.searchsorted([0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8], repeats, "right")),
        8 + int(np.searchsorted([0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8], distinct, "right")),
        16 + int(np.searchsorted([0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9], plain, "right")),
    ]
    terms = np.concatenate([terms, WORDS + SHAPES + np.array(signs)])
    return terms.astype(np.int32), np.concatenate([1 + np.log(counts), np.ones(3)])


@dataclass
class Model:
    rarity: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int = 25


def _balanced(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each block brought to its share of the length."""
    out = weights.copy()
    for low, high, share in BLOCKS:
        own = (terms >= low) & (terms < high)
        out[own] *= share / max(np.sqrt(np.square(out[own]).sum()), 1e-12)
    return out


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], dimensions: int = 48, neighbours: int = 25) -> Model | None:
    """Rarity, space and labelled vectors from (label, terms, weights)."""
    if not rows:
        return None
    held = np.zeros(WIDTH)
    for _, terms, _ in rows:
        held[terms] += 1
    rarity = np.log((1 + len(rows)) / (1 + held)) + 1
    matrix = np.zeros((len(rows), WIDTH), np.float32)
    for k, (_, terms, weights) in enumerate(rows):
        matrix[k, terms] = _balanced(terms, weights * rarity[terms])
    basis = np.random.default_rng(7).standard_normal((WIDTH, min(dimensions + 8, len(rows))))
    for _ in range(4):
        left, _ = np.linalg.qr(matrix @ basis)
        basis, _ = np.linalg.qr(matrix.T @ left)
    _, _, right = np.linalg.svd(matrix @ basis, full_matrices=False)
    space = (basis @ right.T)[:, :dimensions]
    return Model(rarity, space, _unit(matrix @ space), np.array([r[0] for r in rows], np.float64), min(neighbours, len(rows)))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def votes(model: Model, found: list[tuple[np.ndarray, np.ndarray]], block: int = 256) -> np.ndarray:
    """Share of label 1 among the neighbours' votes, for each weighted text."""
    points = np.zeros((len(found), model.space.shape[1]))
    for k, (terms, weights) in enumerate(found):
        points[k] = _balanced(terms, weights * model.rarity[terms]) @ model.space[terms]
    points = _unit(points)
    out = np.empty(len(found))
    for a in range(0, len(found), block):
        cosine = points[a : a + block] @ model.vectors.T
        near = np.argpartition(cosine, -model.neighbours, axis=1)[:, -model.neighbours :]
        weight = np.square(np.clip(np.take_along_axis(cosine, near, 1), 0, 1)) + 1e-9
        out[a : a + block] = (weight * model.labels[near]).sum(axis=1) / weight.sum(axis=1)
    return np.clip(out, 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 3072) -> Model | None:
    """The model of ``docs`` (doc_id, text) with ``labels`` (doc_id, quality).

    Only rows whose crc32 of doc_id is not divisible by 5 are learned from.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (F.pmod(crc_of("doc_id"), F.lit(5)) != 0))
    h = F.xxhash64("doc_id")
    chosen = usable.groupBy(F.pmod(h, F.lit(max_labelled)).alias("b")).agg(F.min(F.struct(h.alias("h"), "doc_id", "quality")).alias("m"))
    picked = chosen.select(F.col("m.doc_id").alias("doc_id"), F.col("m.quality").cast("int").alias("quality"))
    # Of several texts of one doc_id the first in order is the labelled one.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "quality")).alias("m")).select("doc_id", "m.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _analyser()
        for batch in slices(batches):
            found = terms(byte_texts(batch))
            columns = [batch.column("doc_id"), batch.column("quality"), pa.array([t for t, _ in found], pa.list_(pa.int32())), pa.array([w for _, w in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "quality", "terms", "weights"])

    held = rows.select(F.col("doc_id").cast("long"), "quality", "text").mapInArrow(run, "doc_id long, quality int, terms array<int>, weights array<double>").toArrow().sort_by("doc_id")
    columns = [held.column(c).to_pylist() for c in ("quality", "terms", "weights")]
    return fit([(q, np.array(t, np.int64), np.array(w)) for q, t, w in zip(*columns)])


class Voter:
    def __init__(self, model: Model | None):
        self.model, self.terms = model, _analyser()

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        if self.model is None:
            return np.full(len(texts), 0.5)
        parts = [votes(self.model, self.terms(texts[a : a + 1024])) for a in range(0, len(texts), 1024)]
        return np.concatenate(parts) if parts else np.zeros(0)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, predicted of each row of ``docs`` (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voter = Voter(held.value)
        for batch in slices(batches):
            found = voter(byte_texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), pa.array((found >= THRESHOLD).astype("int32"))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, model: Model | None) -> DataFrame:
    """Rows of ``docs`` that are predicted 1, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voter = Voter(held.value)
        for batch in slices(batches):
            yield batch.filter(pa.array(voter(byte_texts(batch)) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
