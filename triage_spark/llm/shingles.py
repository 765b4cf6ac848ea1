"""Hashed words and word shingles of many texts at once.

A word is a run without ASCII white space, in lower case.  A shingle is five
words in a row; a text with one to four words has one shingle of all of them.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
WORDS = 5
#: What repetition adds to a shingle's weight; small, as likeness is judged on sets in the end.
WEIGHT = 0.125
_STEP = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (splitmix64's finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Factors for the bytes of a word; they repeat in longer words, whose length counts too.
_PLACES = mix(np.arange(1, 4097, dtype=U64) * _STEP) | U64(1)
_TURNS = mix(np.arange(5001, 5001 + WORDS, dtype=U64) * _STEP) | U64(1)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words in a row, number of words of each text)."""
    data = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(d) + 1 for d in data], np.int64)
    buf = np.frombuffer(b"\n".join([*data, b""]), np.uint8)
    if not len(buf):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    begin = ~space
    begin[1:] &= space[:-1]
    at = np.flatnonzero(begin)
    counts = np.diff(np.searchsorted(at, np.append(0, np.cumsum(sizes))))
    if not len(at):
        return np.zeros(0, U64), counts
    span = np.diff(at, append=len(buf))
    lead = at[0]
    place = np.arange(lead, len(buf)) - np.repeat(at, span)
    # The place also turns over with each full round of factors, so that long words with moved parts differ.
    part = (buf[lead:].astype(U64) + U64(1) + (place >> 12).astype(U64)) * _PLACES[place & 4095]
    part[space[lead:]] = 0
    length = np.add.reduceat((~space[lead:]).astype(np.int64), at - lead)
    return mix(np.add.reduceat(part, at - lead) + length.astype(U64) * _STEP), counts


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all shingles in a row, index of their text)."""
    words, counts = word_hashes(texts)
    padded = np.append(words, np.zeros(WORDS, U64))
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    place = np.arange(len(words)) - np.repeat(first, counts)
    # Where shingles begin: in short texts at the first word only.
    begins = np.flatnonzero(place < np.repeat(np.maximum(counts - WORDS + 1, np.minimum(counts, 1)), counts))
    owner = owner[begins]
    left = counts[owner] - place[begins]
    total = np.zeros(len(begins), U64)
    for i in range(WORDS):
        total += np.where(i < left, padded[begins + i] * _TURNS[i], U64(0))
    return mix(total), owner


def weighted_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, weight, text index) of the distinct shingles, by text; a shingle that a text has n times weighs 1 + WEIGHT * ln n."""
    hashes, owner = shingle_hashes(texts)
    order = np.lexsort((hashes, owner)) if len(texts) > 1 else np.argsort(hashes)
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return hashes[at], 1 + WEIGHT * np.log(np.diff(at, append=len(hashes))), owner[at]
