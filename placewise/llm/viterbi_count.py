"""Token counts under a unigram vocabulary, without making tokens.

The tokenizer: spaces become markers, a text is cut before each marker, and each part is
segmented by the highest sum of piece scores. A character that no piece covers alone is
unknown: it costs the lowest score less 10 and counts as its UTF-8 bytes. An
Aho-Corasick automaton over the vocabulary yields all pieces that end at each
position; dynamic programming keeps the best score and its number of pieces. Of
equal scores the longest last piece wins, since candidates are met in the order of
their starts and only a better one replaces another.

Each distinct part is solved once. Null and empty texts have 0 tokens. Other columns
are ignored; equal rows give equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.llm.shared import ChunkTable, byte_texts, in_groups, slices

MARK = "▁"
UNKNOWN_COST = 10.0


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Piece counts of the best segmentation of single parts.

    The piece with id ``unknown_id`` stands for unknown text wherever it occurs itself;
    neighbouring unknown stretches are one, which is a piece if the vocabulary holds
    it and bytes otherwise.
    """

    def __init__(self, pieces: list[tuple[str, float]], unknown_id: int = 0):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for k, (piece, score) in enumerate(pieces):
            if piece:
                self.automaton.add_word(piece, (len(piece), score, k == unknown_id))
        self.automaton.make_automaton()
        self.longest = max(len(p) for p, _ in pieces)
        self.unknown = min(s for _, s in pieces) - UNKNOWN_COST

    def best(self, part: str) -> tuple[float, int]:
        """(score, number of pieces) of one part."""
        size = len(part)
        scores: list[float | None] = [None] * (size + 1)
        counts, runs = [0] * (size + 1), [-1] * (size + 1)
        scores[0] = 0.0
        # Bytes before each character, so that a long unknown run is never cut out again.
        self.bytes = None if part.isascii() else [0, *accumulate(len(ch.encode()) for ch in part)]
        done, covered = 0, False
        # Matches come by their ends, longest first at each end.
        for last, (length, score, unknown) in self.automaton.iter(part):
            end = last + 1
            while done + 1 < end:
                done += 1
                if not covered:
                    self._unknown(part, done, scores, counts, runs)
                covered = False
            start = end - length
            total = scores[start] + score
            covered |= length == 1
            if scores[end] is None or total > scores[end]:
                scores[end] = total
                self._step(part, start, end, unknown, counts, runs)
        while done < size:
            done += 1
            if not covered:
                self._unknown(part, done, scores, counts, runs)
            covered = False
        return scores[size], counts[size]

    def _unknown(self, part: str, end: int, scores: list, counts: list, runs: list) -> None:
        total = scores[end - 1] + self.unknown
        if scores[end] is None or total > scores[end]:
            scores[end] = total
            self._step(part, end - 1, end, True, counts, runs)

    def _step(self, part: str, start: int, end: int, unknown: bool, counts: list, runs: list) -> None:
        if not unknown:
            counts[end], runs[end] = counts[start] + 1, -1
            return
        first = runs[start] if runs[start] >= 0 else start
        known = end - first <= self.longest and part[first:end] in self.automaton
        length = end - first if self.bytes is None else self.bytes[end] - self.bytes[first]
        counts[end] = counts[first] + (1 if known else length)
        runs[end] = first


def parts_of(text: bytes) -> list[bytes]:
    """Parts of a text, each beginning with a marker."""
    if not text:
        return []
    mark = MARK.encode()
    marked = text.replace(b" ", mark)
    return marked[len(mark) :].split(mark) if marked.startswith(mark) else marked.split(mark)


@lru_cache(maxsize=2)
def _table(path: str) -> ChunkTable:
    counter = Counter(vocabulary(path))
    return ChunkTable(lambda parts: [counter.best(MARK + p.decode("utf-8", "replace"))[1] for p in parts], limit=500_000)


def count_texts(texts: list[bytes], path: str) -> Iterator[int]:
    table = _table(path)
    for a, b in in_groups([len(t) for t in texts]):
        yield from table.look_up([parts_of(t) for t in texts[a:b]], sum)


def counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens of each row of ``docs`` (doc_id, text)."""
    source = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = pa.array(list(count_texts(byte_texts(batch), source)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long")
