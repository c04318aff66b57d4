"""Language identification by interpolated Kneser-Ney character models.

A model of order five is learned for each language from words: runs of letters, lower
case, with a boundary mark on both sides. Counts of the top order come from a bounded
sample of labelled rows, all of their n-grams; lower orders use continuation counts. All languages share one
sorted array of n-gram hashes for each order, with a column of discounted
probabilities (and, for contexts, of back-off weights) for each language.

A whole text is judged: the language with the lowest cross-entropy per character wins;
equal ones go to the first language in order. The probability is a softmax whose
temperature is fitted on sampled rows, each scored by the model of the rows outside its
fold. A text is rejected when it has no letter, or when its cross-entropy is above what
such rows of that language and its length reach. The limits follow one rule for all
languages: a language's own centre and spread, drawn towards those of all languages by as
much as its rows are few, and a margin between what own rows need and what rows of other
languages would get.

Null, empty and letterless texts are ``und`` with score 0 and rejected; so is every text
when nothing could be learned. Equal rows get equal results; other columns are kept by
``keep`` and ignored by ``predict``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.llm.shared import ChunkTable, byte_texts, crc_of, in_groups, slices

ORDER = 5
UNKNOWN = "und"
_PAD = " " * (ORDER - 1)
_LETTERS = re.compile(r"[^\W\d_]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
# Folds of the sampled rows, and the rows as which the limits of all languages count beside a language's own.
FOLDS, PRIOR_ROWS = 4, 8


@dataclass
class Level:
    """One order: sorted hashes of n-grams and contexts, and a column for each language."""

    grams: np.ndarray
    discounted: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


@dataclass
class Model:
    languages: list[str]
    levels: list[Level]
    floor: float
    temperature: float = 1.0
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    margin: float = 0.0
    scorer: Scorer | None = None


def words_of(chunk: bytes) -> list[str]:
    found = _LETTERS.findall(chunk.decode("utf-8", "replace").lower())
    if chunk.isascii():
        return found
    # The pattern also takes number characters that are no decimal digits; they end a word.
    return [part for word in found for part in ([word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).split())]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _hashes(windows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the last ``n`` characters of each window and of those without the very last."""
    context = np.full(len(windows), n, np.uint64)
    for k in range(ORDER - n, ORDER - 1):
        context = context * _STEP + windows[:, k] + np.uint64(1)
    context = _mixed(context)
    return _mixed(context * _STEP + windows[:, -1] + np.uint64(1)), context


def windows_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Every character of the words and their end marks with the characters before it, and the number of its word."""
    if not words:
        return np.zeros((0, ORDER), np.uint64), np.zeros(0, np.int64)
    points = np.frombuffer("".join(_PAD + w + " " for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    owner = np.repeat(np.arange(len(words)), lengths)
    first = np.cumsum(lengths + ORDER - 1) - lengths - (ORDER - 1)
    at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.lib.stride_tricks.sliding_window_view(points, ORDER)[at], owner


def log_probabilities(model: Model, windows: np.ndarray) -> np.ndarray:
    """Natural log-probability of each window's last character, for each language; equal windows are looked up once."""
    _, first, place = np.unique(_hashes(windows, ORDER)[0], return_index=True, return_inverse=True)
    own = windows[first]
    p = np.full((len(own), len(model.languages)), model.floor)
    for n, level in enumerate(model.levels, 1):
        gram, context = _hashes(own, n)
        p *= _rows(level.contexts, level.backoff, context, 1.0)
        p += _rows(level.grams, level.discounted, gram, 0.0)
    return np.log(p)[place]


def _rows(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], otherwise)


def fit_counts(grams: list[tuple[str, str, int]], languages: list[str] | None = None) -> Model:
    """Kneser-Ney models from (language, ORDER characters, count); a language of ``languages`` without counts knows nothing."""
    languages = languages or sorted({g[0] for g in grams})
    column = {x: k for k, x in enumerate(languages)}
    lang = np.array([column[g[0]] for g in grams], np.int64)
    windows = np.frombuffer("".join(g[1] for g in grams).encode("utf-32-le"), "<u4").astype(np.uint64).reshape(-1, ORDER)
    count = np.array([g[2] for g in grams], np.float64)
    levels = []
    for n in range(ORDER, 0, -1):
        levels.append(_level(windows, lang, count, n, len(languages)))
        # Each type of this order counts once for its ending: the continuation count of the next order.
        ending = np.column_stack([lang.astype(np.uint64), windows[:, ORDER - n + 1 :]])
        if n > 1:
            types, count = np.unique(ending, axis=0, return_counts=True)
            lang = types[:, 0].astype(np.int64)
            windows = np.column_stack([np.zeros((len(types), ORDER - n + 1), np.uint64), types[:, 1:]])
            count = count.astype(np.float64)
    alphabet = len(np.unique(windows[:, -1]))
    return Model(languages, levels[::-1], 1.0 / (alphabet + 1))


def _level(windows: np.ndarray, lang: np.ndarray, count: np.ndarray, n: int, width: int) -> Level:
    gram, context = _hashes(windows, n)
    keys, place = np.unique(context, return_inverse=True)
    total, kinds = np.zeros((len(keys), width)), np.zeros((len(keys), width))
    np.add.at(total, (place, lang), count)
    np.add.at(kinds, (place, lang), 1)
    once = np.bincount(lang, count == 1, width)
    twice = np.bincount(lang, count == 2, width)
    discount = np.clip(np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5), 0.1, 0.95)
    held = total > 0
    backoff = np.where(held, discount * kinds / np.where(held, total, 1), 1.0)
    grams, at = np.unique(gram, return_inverse=True)
    discounted = np.zeros((len(grams), width))
    np.add.at(discounted, (at, lang), np.maximum(count - discount[lang], 0) / total[place, lang])
    return Level(grams, discounted.astype(np.float32), keys, backoff.astype(np.float32))


class Scorer:
    """Sums of log-probabilities of whole texts, one evaluation for each distinct chunk."""

    def __init__(self, model: Model):
        self.model = model
        self.table = ChunkTable(self._encode, limit=100_000, trimmed=self._trimmed)
        self.sums = np.zeros((1024, len(model.languages) + 1))
        self.used = 0

    def _trimmed(self, stay: Iterable[int]) -> None:
        self.used = max(stay, default=-1) + 1

    def _encode(self, chunks: list[bytes]) -> list[int]:
        rows = [words_of(c) for c in chunks]
        out = np.zeros((len(chunks), self.sums.shape[1]))
        owner = np.repeat(np.arange(len(chunks)), [len(r) for r in rows])
        words = [w for r in rows for w in r]
        step = 1 << 14
        for a in range(0, len(words), step):
            windows, word = windows_of(words[a : a + step])
            logs = log_probabilities(self.model, windows)
            at = owner[a + word]
            for k in range(logs.shape[1]):
                out[:, k] += np.bincount(at, logs[:, k], len(chunks))
            out[:, -1] += np.bincount(at, minlength=len(chunks))
        while self.used + len(chunks) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        first, self.used = self.used, self.used + len(chunks)
        self.sums[first : self.used] = out
        return range(first, self.used)

    def entropies(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character for each language, number of characters) of each text."""
        h, n = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts))
        for a, b in in_groups([len(t) for t in texts], 1 << 20):
            found = self.table.look_up([t.split() for t in texts[a:b]], lambda ids: np.fromiter(ids, np.int64))
            for k, ids in enumerate(found, a):
                total = self.sums[ids].sum(axis=0)
                n[k] = total[-1]
                h[k] = -total[:-1] / max(total[-1], 1)
        return h, n


def scorer_of(model: Model) -> Scorer:
    """One scorer for a model in each worker, kept from task to task."""
    if model.scorer is None:
        model.scorer = Scorer(model)
    return model.scorer


def judge(model: Model, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the language, its probability, whether it is accepted) of each text."""
    best = h.argmin(axis=1)
    scaled = -(h - h.min(axis=1, keepdims=True)) / model.temperature
    p = 1 / np.exp(scaled).sum(axis=1)
    limit = model.centre[best] + model.margin + 6 * model.spread[best] / np.sqrt(np.maximum(n, 1))
    lowest = h[np.arange(len(h)), best]
    return best, p, (n > 0) & (lowest <= limit)


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """lang, text, fold of at most ``per_language`` labelled rows of each language, chosen by hash.

    Rows whose crc32 of doc_id leaves 2 on division by 4 are never taken. Each of
    ``per_language`` hash buckets gives its first row; only ids are grouped. Rows that
    share a chosen doc_id and language come with it.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.pmod(crc_of("doc_id"), F.lit(4)) != 2))
    h = F.xxhash64("doc_id")
    chosen = rows.groupBy("lang", F.pmod(h, F.lit(per_language)).alias("b")).agg(F.min(F.struct(h.alias("h"), "doc_id")).alias("m"))
    picked = chosen.select("lang", F.col("m.doc_id").alias("doc_id"), F.pmod(F.col("b"), F.lit(FOLDS)).cast("int").alias("fold"))
    return rows.select("lang", "doc_id", "text").join(F.broadcast(picked), ["lang", "doc_id"]).select("lang", "text", "fold")


def train(docs: DataFrame, per_language: int = 768) -> Model | None:
    """The calibrated model of ``docs`` (doc_id, text, lang); None when no labelled row has a letter.

    The sample bounds what the driver holds: the n-grams of its rows by fold, and one
    row of numbers for each of its rows.
    """
    rows = sample(docs.select("doc_id", "text", "lang"), per_language).repartition(16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], Counter] = {}
        for batch in slices(batches):
            words: dict[tuple[str, int], Counter] = {}
            for lang, fold, text in zip(batch.column("lang").to_pylist(), batch.column("fold").to_pylist(), byte_texts(batch)):
                words.setdefault((lang, fold), Counter()).update(words_of(text))
            for key, counts in words.items():
                _add_grams(found.setdefault(key, Counter()), counts)
            if sum(map(len, found.values())) > 500_000:
                yield _count_batch(found)
                found = {}
        yield _count_batch(found)

    counted = rows.mapInArrow(count, "lang string, fold int, gram string, n long").groupBy("lang", "gram", "fold").agg(F.sum("n").alias("n"))
    by_fold = [F.sum(F.when(F.col("fold") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(FOLDS)]
    grams = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"), *by_fold).orderBy("lang", "gram").toArrow()
    if not grams.num_rows:
        return None
    lang, gram = grams.column("lang").to_pylist(), grams.column("gram").to_pylist()
    total = grams.column("n").to_numpy()
    model = fit_counts(list(zip(lang, gram, total.tolist())))
    measured = []
    for fold in range(FOLDS):
        rest = total - grams.column(f"n{fold}").to_numpy()
        if rest.any():
            measured += _measured(rows.filter(F.col("fold") == fold), fit_counts([(x, g, n) for x, g, n in zip(lang, gram, rest.tolist()) if n], model.languages))
    return calibrated(model, measured)


def _measured(rows: DataFrame, model: Model) -> list[tuple[str, list[float], float]]:
    """(language, cross-entropies, characters) of each row with a letter."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(held.value)
        for batch in slices(batches):
            h, n = scorer.entropies(byte_texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(h.tolist(), pa.list_(pa.float64())), pa.array(n)], ["lang", "h", "n"])

    known = rows.filter(F.col("lang").isin(model.languages)).select("lang", "text")
    return [(r.lang, r.h, r.n) for r in known.mapInArrow(measure, "lang string, h array<double>, n double").filter("n > 0").collect()]


def _add_grams(own: Counter, words: Counter) -> None:
    for word, k in words.items():
        padded = _PAD + word + " "
        for i in range(len(word) + 1):
            own[padded[i : i + ORDER]] += k


def _count_batch(found: dict[tuple[str, int], Counter]) -> pa.RecordBatch:
    rows = [(lang, fold, gram, n) for (lang, fold), own in found.items() for gram, n in own.items()]
    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["lang", "fold", "gram", "n"])


def calibrated(model: Model, rows: list[tuple[str, list[float], float]]) -> Model:
    """Temperature, centres, spreads and margin from (language, cross-entropies, characters) of rows that their model has not seen.

    The limits of all languages count as ``PRIOR_ROWS`` rows of each. The margin lies halfway
    between the 99.9th percentile of what rows exceed their own language's limit by and the 5th
    of what they exceed the nearest other one's by, and never below the former. Without rows
    only texts no worse than half of a uniform guess are accepted.
    """
    rows = sorted((r for r in rows if r[2] > 0), key=lambda r: (r[0], r[2], r[1]))
    width = len(model.languages)
    uniform = -np.log(model.floor)
    if not rows:
        model.centre, model.spread = np.full(width, uniform / 2), np.zeros(width)
        return model
    h, n = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    true = np.array([model.languages.index(r[0]) for r in rows])
    every, own = np.arange(len(rows)), h[np.arange(len(rows)), true]
    pooled = _centre(own, n)
    model.centre, model.spread = np.full(width, pooled[0]), np.full(width, pooled[1])
    for k in range(width):
        held = true == k
        if held.any():
            share = held.sum() / (held.sum() + PRIOR_ROWS)
            centre, spread = _centre(own[held], n[held])
            model.centre[k] += share * (min(centre, uniform) - pooled[0])
            model.spread[k] += share * (spread - pooled[1])
    excess = h - model.centre - 6 * model.spread / np.sqrt(n)[:, None]
    needed = max(0.0, float(np.quantile(excess[every, true], 0.999)))
    model.margin = needed
    if width > 1:
        excess[every, true] = np.inf
        model.margin = max(needed, (needed + float(np.quantile(excess.min(axis=1), 0.05))) / 2)
    grid = np.geomspace(0.02, 2.0, 25)
    gap = h - own[:, None]
    losses = [np.log(np.exp(np.minimum(-gap / t, 700)).sum(axis=1)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(losses))])
    return model


def _centre(h: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Median cross-entropy and its robust spread at one character."""
    centre = float(np.median(h))
    return centre, float(np.median(np.abs(h - centre) * np.sqrt(n)) / 0.6745)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, accepted of each row of ``docs`` (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(held.value) if held.value else None
        for batch in slices(batches):
            lang, p, ok = _judged(scorer, byte_texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lang, p, ok], ["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def keep(docs: DataFrame, model: Model | None) -> DataFrame:
    """Rows of ``docs`` whose language is accepted, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(held.value) if held.value else None
        for batch in slices(batches):
            yield batch.filter(_judged(scorer, byte_texts(batch))[2])

    return docs.mapInArrow(run, docs.schema)


def _judged(scorer: Scorer | None, texts: list[bytes]) -> tuple[pa.Array, pa.Array, pa.Array]:
    if scorer is None or not texts:
        n = len(texts)
        return pa.array([UNKNOWN] * n, pa.string()), pa.array([0.0] * n, pa.float64()), pa.array([False] * n, pa.bool_())
    h, n = scorer.entropies(texts)
    best, p, ok = judge(scorer.model, h, n)
    names = [scorer.model.languages[k] if some else UNKNOWN for k, some in zip(best.tolist(), (n > 0).tolist())]
    return pa.array(names, pa.string()), pa.array(np.where(n > 0, p, 0.0)), pa.array(ok)
