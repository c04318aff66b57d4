"""Token ids by the word-level byte-pair tokenizer, one encoding for each distinct run.

The tokenizer drops white space and never merges across it. Most texts are plain: Latin
letters, digits, common signs and ASCII white space. The tokenizer's normalizer only
lowers these and its splitter cuts them into runs of letters, single digits and runs of
signs, so the library's model encodes each distinct run once and ids are joined by
position. Other texts are cut at ASCII white space and each distinct chunk is encoded:
a plain one by its runs, any other by the whole library.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

from placewise.llm.shared import ChunkTable, in_groups

END = (1).to_bytes(4, "little")
# No apostrophe (contractions) and no "<" (special tokens): those take the long way.
_PLAIN = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ÿ!-&(-;=-@\[-`{-~ \t-\r]*")
_RUN = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^ \t-\ra-z0-9ß-öø-ÿ]+")


def _shown_bytes() -> dict[int, str]:
    """Latin letters as the characters that byte-level vocabularies write their UTF-8 bytes with.

    Bytes that print in Latin-1 stand for themselves, the others follow from 256 on.
    """
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(prints)]
    shown = {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}
    return {point: "".join(shown[b] for b in chr(point).encode()) for point in range(0xC0, 0x100)}


_SHOWN = _shown_bytes()
_SPACE = re.compile(r"[ \t-\r]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def _tables(path: str) -> tuple[ChunkTable, ChunkTable]:
    """(runs of plain text, whole chunks)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model = tokenizer.model
    runs = ChunkTable(lambda found: [array("I", [t.id for t in model.tokenize(r.translate(_SHOWN))]).tobytes() for r in found], limit=400_000)

    def encode(chunks: list[str]) -> list[bytes]:
        cut = [_RUN.findall(c.lower()) if _PLAIN.fullmatch(c) else None for c in chunks]
        whole = iter(tokenizer.encode_batch([t for t, c in zip(chunks, cut) if c is None], add_special_tokens=False))
        plain = iter(runs.look_up([c for c in cut if c is not None], b"".join))
        return [array("I", next(whole).ids).tobytes() if c is None else next(plain) for c in cut]

    return runs, ChunkTable(encode, limit=100_000)


def encode_texts(texts: list[bytes], path: str):
    """Little-endian unsigned 32-bit ids of each whole text, with the end id."""
    runs, chunks = _tables(path)
    for start, end in in_groups([len(t) for t in texts]):
        read = [t.decode("utf-8", "replace") for t in texts[start:end]]
        cut = [_RUN.findall(t.lower()) if _PLAIN.fullmatch(t) else None for t in read]
        plain = iter(runs.look_up([c for c in cut if c is not None], b"".join))
        others = iter(chunks.look_up([_SPACE.split(t) for t, c in zip(read, cut) if c is None], b"".join))
        for c in cut:
            yield next(others if c is None else plain) + END
