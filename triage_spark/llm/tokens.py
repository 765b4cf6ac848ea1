"""Token ids of whole texts by the tokenizers library, with a cache of text chunks.

Both vocabularies split a text into words before they merge, and no word
spans the cuts made here, so the ids of a text are those of its chunks in a
row.  Each worker keeps a dictionary chunk -> ids, bounded in bytes.  For a chunk not in it,
a plain word goes straight to the library's merges, anything else through the whole
tokenizer.  Texts for which the cuts are not proven (rare white space,
special-token strings) are encoded by the library as a whole.

Where texts are cut:

* at plain white space, which byte-level words take as one leading space
  and the other kind drops;
* between a word of plain letters and the full stops or commas after it, which the
  word pattern of both vocabularies never joins.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable
from functools import cache

import numpy as np

#: Letters that need no normalisation but lower case.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: For tokenizers whose words hold no white space and which drop it and the case.
WORD_CHUNKS = rf"[{LETTERS}]+(?![^ \n\t\r.,])|[.,]+(?![^ \n\t\r])|[^ \n\t\r]+"
#: For byte-level words with their leading space; of longer white space the last character stays apart.
BYTE_CHUNKS = rf" ?[{LETTERS}]+(?![^ \n\t\r.,])|[.,]+(?![^ \n\t\r])| ?[^ \n\t\r]+|[ \n\t\r]+(?![^ \n\t\r])|[ \n\t\r]+"
#: White space beyond the plain kind, on whose nature regex libraries differ or which can join a run of it.
RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏    　﻿]")
#: Bytes that remembered chunks may take before a worker starts anew, and those of an entry besides its text and ids.
CACHE_BYTES, ENTRY_BYTES = 16_000_000, 200
#: Characters of the longest chunk that is remembered.
LONGEST_KEPT = 64


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Chunks(dict):
    """chunk -> id bytes; what is missing is encoded and kept."""

    def __init__(self, encode):
        super().__init__()
        self.of, self.size = encode, 0

    def __missing__(self, chunk: str) -> bytes:
        ids = self.of(chunk)
        if len(chunk) <= LONGEST_KEPT:
            self[chunk] = ids
            self.size += len(chunk) + len(ids) + ENTRY_BYTES
        return ids

    def clear(self) -> None:
        super().clear()
        self.size = 0


class ChunkEncoder:
    """Encodes texts to little-endian id bytes; ``chunks`` is WORD_CHUNKS or BYTE_CHUNKS."""

    def __init__(self, path: str, chunks: str, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.vocab_size = max(self.tok.get_vocab(with_added_tokens=True).values()) + 1
        self.dtype = np.dtype("<u2" if self.vocab_size <= 1 << 16 else "<u4")
        self.find = re.compile(chunks).findall
        self.drops_space = chunks == WORD_CHUNKS
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.plain = re.compile(rf" ?[{LETTERS}]+").fullmatch
        self.alphabet, self.merge = byte_alphabet(), self.tok.model.tokenize
        self.cache, self.cache_bytes = _Chunks(self._chunk), cache_bytes

    def _chunk(self, chunk: str) -> bytes:
        if not self.plain(chunk):
            return self.whole(chunk)
        word = chunk.lower() if self.drops_space else chunk
        return array(self.code, [t.id for t in self.merge(word.encode().decode("latin-1").translate(self.alphabet))]).tobytes()

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def in_one(self, text: str) -> bool:
        """Whether the text must go to the library as a whole."""
        return not self.drops_space and (RARE_SPACE.search(text) is not None or any(s in text for s in self.special))

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The id bytes of each text."""
        if self.cache.size > self.cache_bytes:
            self.cache.clear()
        get = self.cache.__getitem__
        return [self.whole(t) if self.in_one(t) else b"".join(map(get, self.find(t))) for t in texts]


@cache
def chunk_encoder(path: str, chunks: str, cache_bytes: int = CACHE_BYTES) -> ChunkEncoder:
    """One encoder for each Python worker, so the tasks it runs share vocabulary and cache."""
    return ChunkEncoder(path, chunks, cache_bytes)
