"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the model holds a white-space marker after another character, so no
merge crosses from a chunk (markers, then other characters) into the next one. Each
distinct chunk is segmented once by the library and its ids are joined back by
position. A model with pieces that cross markers is refused.

Null and empty texts give the begin and end ids alone. Equal rows give equal results;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.llm.shared import ChunkTable, byte_texts, in_groups, slices

_MARK = "▁".encode()
_CHUNK = re.compile(b"(?:" + _MARK + b")+(?:(?!" + _MARK + b").)*", re.DOTALL)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    if any("▁" in p.lstrip("▁") for p in pieces):
        raise ValueError("a piece crosses a white-space marker")

    def encode(chunks: list[bytes]) -> list[bytes]:
        found = model.encode([c.decode("utf-8", "replace") for c in chunks], num_threads=1)
        return [array("I", ids).tobytes() for ids in found]

    return model, ChunkTable(encode), array("I", [model.bos_id()]).tobytes(), array("I", [model.eos_id()]).tobytes()


def chunks_of(text: bytes) -> list[bytes]:
    """Chunks in order, each without the marker that the library puts before a text."""
    if not text:
        return []
    parts = text.split(b" ")
    if b"" in parts or _MARK in text:
        marked = _MARK + text.replace(b" ", _MARK)
        return [c[len(_MARK) :] for c in _CHUNK.findall(marked)]
    return parts


def encode_texts(texts: list[bytes], path: str) -> Iterator[bytes]:
    """Ids of each whole text with begin and end, as little-endian unsigned 32-bit integers."""
    _, table, begin, end = _model(path)
    for start, stop in in_groups([len(t) for t in texts]):
        rows = [chunks_of(t) for t in texts[start:stop]]
        lone = {i for i, row in enumerate(rows) if row and b"" in row}
        for i, ids in enumerate(table.look_up([[c for c in row if c] if k in lone else row for k, row in enumerate(rows)])):
            if i in lone:
                rest, lone_mark = iter(ids), _lone(path)
                ids = [next(rest) if c else lone_mark for c in rows[i]]
            yield begin + b"".join(ids) + end


@lru_cache(maxsize=2)
def _lone(path: str) -> bytes:
    """The ids of one marker alone, which the library never gets as a text of its own."""
    model = _model(path)[0]
    return array("I", [model.piece_to_id("▁")]).tobytes()


def decode_ids(ids: bytes, path: str) -> str:
    return _model(path)[0].decode(np.frombuffer(ids, "<u4").tolist())


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of ``docs`` (doc_id, text)."""
    model = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, of_ids, of_text = [], [], []
            for ids in encode_texts(byte_texts(batch), model):
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(decode_ids(ids, model).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids of each row."""
    model = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [np.frombuffer(ids, "<u4").astype("int32") for ids in encode_texts(byte_texts(batch), model)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows doc_id, ids."""
    model = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [_model(model)[0].decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
