"""Cross-tokenizer alignment by lockstep vectorised merging.

Every text is encoded twice: space + text by a byte-level vocabulary (A), the text by
pieces with a space in front (B).  Both token lists cover the same bytes, so they
are merged like two sorted lists of byte ends.  One NumPy state vector holds an A and a B pointer for
all documents of a block; each step emits the link of the two tokens that every pair of
pointers stands on, emits a cut where both tokens end, moves the pointers whose token ends first, and
drops the documents that are finished.  Long documents enter as several lanes of ``LANE`` A tokens (a
lane begins at an A token and at the B token over its first byte), so the number of steps is bounded.

An id pair's count is the number of documents that hold it linked.  Blocks count their own
documents first, Spark adds the blocks' counts, finds each A id's highest, and joins both back by
(block, pair), so what is shuffled is a block's distinct pairs, not its links.

Defined results: rows with null or empty text, or whose joined A or B bytes differ from space +
text (U+2581 in a text), have no tokens: zeros and ''.  Special-token strings are plain text.  Repeated rows (also of one
doc_id, null included) are documents of their own and count each.  An empty table gives an
empty result.  Only ``doc_id`` and ``text`` are read, so other columns cannot clash.  No vocabulary
pair is left out, and texts are never cut.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triage_spark.llm.common import saved, table, text_steps
from triage_spark.llm.tokens import BYTE_CHUNKS, ChunkEncoder, byte_alphabet

#: A tokens of a document that one lane merges at most.
LANE = 512
#: Bytes of text in a block, one text at least.
BLOCK_BYTES = 3_000_000
#: Bytes of remembered chunks of the byte-level encoder, and number of those of the piece encoder.
CACHE_BYTES = 64_000_000
CACHE_CHUNKS = 100_000
SPACE = "▁"


class BytePieces:
    """Side A: ids and token bytes of a byte-level vocabulary; special-token strings are plain text."""

    def __init__(self, path: str):
        self.encoder = ChunkEncoder(path, BYTE_CHUNKS, CACHE_BYTES)
        self.encoder.tok.encode_special_tokens = True
        self.encoder.special = []
        back = {ch: b for b, ch in byte_alphabet().items()}
        self.bytes = [b""] * self.encoder.vocab_size
        for token, i in self.encoder.tok.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = bytes(back[ch] for ch in token) if all(ch in back for ch in token) else token.encode()
        #: Whether anything encoded so far did not give its bytes back; chunks and whole texts are looked at once, when they are encoded.
        self.odd = False
        self.encoder.cache.of, self.encoder.whole = self._noted(self.encoder.cache.of), self._noted(self.encoder.whole)

    def _noted(self, encode: Callable[[str], bytes]) -> Callable[[str], bytes]:
        def run(text: str) -> bytes:
            ids = encode(text)
            self.odd = self.odd or b"".join(map(self.bytes.__getitem__, memoryview(ids).cast(self.encoder.code))) != text.encode()
            return ids

        return run

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(ids, self.encoder.dtype).astype(np.int32) for ids in self.encoder.encode([f" {t}" for t in texts])]


class SpacePieces:
    """Side B: ids and token bytes of a piece vocabulary that puts a space in front.

    No piece has a space behind another character, so no merge spans the place before a run of
    spaces: the ids of a text are those of its chunks (spaces, then a word), which are remembered.
    One space at the end of a text stays with the word before it: alone it would be encoded as an empty text.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.find = re.compile(r" +[^ ]+(?: \Z)?| +" if apart else "(?s).+").findall
        self.known: dict[str, bytes] = {}
        #: Whether any chunk so far did not give its bytes back.
        self.odd = False

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CACHE_CHUNKS:
            self.known.clear()
        parts = [self.find(f" {t}") for t in texts]
        new = list({c for p in parts for c in p} - self.known.keys())
        # Long chunks are rarely met again, so they are not kept beyond this block.
        encoded = self.model.encode([c[1:] for c in new], num_threads=1)
        self.odd = self.odd or any(b"".join(map(self.bytes.__getitem__, ids)) != c.encode() for c, ids in zip(new, encoded))
        fresh = {c: array("i", ids).tobytes() for c, ids in zip(new, encoded)}
        both = fresh | self.known if len(self.known) < len(fresh) else self.known | fresh
        self.known.update((c, ids) for c, ids in fresh.items() if len(c) <= 32)
        return [np.frombuffer(b"".join(map(both.__getitem__, p)), np.int32) for p in parts]


@cache
def _sides(path_a: str, path_b: str) -> tuple[BytePieces, SpacePieces]:
    """Loaded once in each Python worker."""
    return BytePieces(path_a), SpacePieces(path_b)


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, doc_a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (A places, B places) and cuts (A places, B places; ascending) of token lists over the same bytes.

    ``ends``: byte end of each token, rising over all documents of the block; ``doc_a``: first A token of
    each document, then the number of all A tokens.
    """
    starts = np.concatenate([np.arange(s, e, LANE) for s, e in zip(doc_a[:-1], doc_a[1:])] or [np.zeros(0, np.int64)]).astype(np.int64)
    stops = np.minimum(starts + LANE, doc_a[np.searchsorted(doc_a, starts, "right")]) if len(starts) else starts
    first = np.where(starts > 0, ends_a[starts - 1], 0) if len(starts) else starts
    state = np.stack([starts, np.searchsorted(ends_b, first, "right"), stops])
    links, cuts = [], []
    while state.shape[1]:
        a, b = state[0], state[1]
        end_a, end_b = ends_a[a], ends_b[b]
        links.append(state[:2].copy())
        both = end_a == end_b
        cuts.append(state[:2, both])
        # Both steps are taken from the same ends.
        a += end_a <= end_b
        b += end_b <= end_a
        live = a < state[2]
        if not live.all():
            state = state[:, live]
    none = np.zeros((2, 0), np.int64)
    linked, cut = np.concatenate(links or [none], axis=1), np.concatenate(cuts or [none], axis=1)
    return linked[0], linked[1], np.sort(cut[0]), np.sort(cut[1])


class Aligned:
    """The alignment of a block of texts; ``None`` and texts that do not round-trip have no tokens."""

    def __init__(self, texts: list[str | None], path_a: str, path_b: str):
        self.sides = _sides(path_a, path_b)
        whole = [t or "" for t in texts]
        ids = [list(side.encode(whole)) for side in self.sides]
        # A text is its chunks in a row, so it comes back whole if each of them did.
        odd = [(side, i) for side, i in zip(self.sides, ids) if side.odd]
        for d, t in enumerate(whole):
            if not t or odd and any(b"".join(map(side.bytes.__getitem__, i[d].tolist())) != f" {t}".encode() for side, i in odd):
                ids[0][d] = ids[1][d] = np.zeros(0, np.int32)
        self.ids = [np.concatenate(i or [np.zeros(0, np.int32)]) for i in ids]
        self.docs = [np.cumsum([0, *map(len, i)]) for i in ids]
        ends = []
        for side, i in zip(self.sides, self.ids):
            ends.append(np.cumsum(np.array([len(b) for b in side.bytes], np.int64)[i]))
        self.link_a, self.link_b, self.cut_a, self.cut_b = lockstep(*ends, self.docs[0])
        self.n_groups = np.diff(np.searchsorted(self.cut_a, self.docs[0]))
        self.link_doc = np.searchsorted(self.docs[0], self.link_a, "right") - 1

    def groups(self) -> Iterator[str]:
        """The groups of each document as text: A ids, a bar, B ids; groups apart by semicolons."""
        (a, b), (doc_a, doc_b) = self.ids, self.docs
        width = max(len(side.bytes) for side in self.sides)
        # Where tokens come to stand when each group's B tokens follow its A tokens.
        at_a = np.arange(len(a)) + np.append(0, self.cut_b + 1)[np.searchsorted(self.cut_a, np.arange(len(a)))]
        at_b = np.arange(len(b)) + np.append(self.cut_a, 0)[np.searchsorted(self.cut_b, np.arange(len(b)))] + 1
        mixed = np.zeros(len(a) + len(b), np.int64)
        mixed[at_a], mixed[at_b] = a, b
        mixed[at_a[self.cut_a]] += width
        mixed[at_b[self.cut_b]] += 2 * width
        get = _shown(width).__getitem__
        bounds = doc_a + doc_b
        for s, e in zip(bounds[:-1], bounds[1:]):
            yield "".join(map(get, mixed[s:e].tolist()))[:-1]


@cache
def _shown(width: int) -> list[str]:
    """Ids with the mark that follows them."""
    return [f"{i}{mark}" for mark in ",|;" for i in range(width)]


ALIGNED = "doc_id long, a_ids array<int>, b_ids array<int>, groups string, links_a array<int>, links_b array<int>"


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, a_ids, b_ids, groups (as text), and links as places in the two id lists, in order of the A tokens: one row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in text_steps(batches, "text", BLOCK_BYTES):
            got = Aligned(step.column(1).to_pylist(), path_a, path_b)
            order = np.lexsort((got.link_b, got.link_a))
            doc = got.link_doc[order]
            ends = np.searchsorted(doc, np.arange(len(step) + 1))
            links = [_lists(x[order] - start[doc], ends, pa.int32()) for x, start in ((got.link_a, got.docs[0]), (got.link_b, got.docs[1]))]
            ids = [_lists(i, d, pa.int32()) for i, d in zip(got.ids, got.docs)]
            yield pa.RecordBatch.from_arrays([step.column(0), *ids, pa.array(got.groups(), pa.string()), *links], ["doc_id", "a_ids", "b_ids", "groups", "links_a", "links_b"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ALIGNED)


BLOCK = (
    "block long, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, "
    "pairs array<bigint>, held array<int>, pair_at binary, times binary, pair_ends array<bigint>"
)


def _narrow(values: np.ndarray) -> bytes:
    """The width of the numbers in one byte, then the numbers in that many bytes."""
    top = int(values.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row for each block of documents: their counts and digests, the block's distinct id pairs (A id * 2^32 + B id) with the number of its
    documents that hold them, and for each document (up to its pair_ends) the pairs it holds, as places in that list, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for n, step in enumerate(text_steps(batches, "text", BLOCK_BYTES)):
            got = Aligned(step.column(1).to_pylist(), path_a, path_b)
            pairs, at = np.unique(got.ids[0][got.link_a].astype(np.int64) << 32 | got.ids[1][got.link_b], return_inverse=True)
            # Distinct pairs of each document.
            many = max(len(pairs), 1)
            held, times = np.unique(got.link_doc * many + at, return_counts=True)
            doc, place = held // many, held % many
            digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in got.groups()]
            sizes = [np.diff(got.docs[0]), np.diff(got.docs[1]), got.n_groups, np.bincount(got.link_doc, minlength=len(step))]
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            values = [pa.array([part << 32 | n], pa.int64()), one(step.column(0).to_pylist(), pa.int64()), *[one(s, pa.int64()) for s in sizes], one(digests, pa.string())]
            values += [one(pairs, pa.int64()), one(np.bincount(place, minlength=len(pairs)), pa.int32()), pa.array([_narrow(place)], pa.binary()), pa.array([_narrow(times)], pa.binary())]
            values.append(one(np.searchsorted(doc, np.arange(len(step)), "right"), pa.int64()))
            yield pa.RecordBatch.from_arrays(values, [c.split()[0] for c in BLOCK.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCK)


def pair_counts(held: DataFrame) -> DataFrame:
    """pair, pair_count (documents that hold it linked), best (no other pair of its A id has more) from rows (pair, held)."""
    counts = saved(held.groupBy("pair").agg(F.sum("held").alias("pair_count")), "pair-counts")
    a_id = F.shiftright("pair", 32)
    top = counts.groupBy(a_id.alias("a_id")).agg(F.max("pair_count").alias("top"))
    return counts.withColumn("a_id", a_id).join(top, "a_id").select("pair", "pair_count", (F.col("pair_count") == F.col("top")).alias("best"))


SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _score(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of a block with the sums over their links; ``right`` has place, pair_count and best of the block's pairs."""
    block = left.to_pylist()[0]
    place = right.column("place").to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place], best[place] = right.column("pair_count").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
    at, times, ends = _wide(block["pair_at"]), _wide(block["times"]), np.array([0, *block["pair_ends"]])
    sums = [np.diff(np.append(0, np.cumsum(x[at] * times))[ends]) for x in (best, count)]
    plain = [pa.array(block[c], pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.Table.from_arrays([*plain, *[pa.array(s, pa.int64()) for s in sums], pa.array(block["groups_sha256"], pa.string())], [c.split()[0] for c in SCORED.split(", ")])


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair_count is the highest of their A id), count_sum (pair_count over all links), groups_sha256."""
    cut = saved(blocks(docs, path_a, path_b), "align-blocks")
    held = cut.select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "p")).select("block", "place", F.col("p.pairs").alias("pair"), F.col("p.held").alias("held"))
    back = held.select("block", "place", "pair").join(pair_counts(held), "pair").select(F.col("block").alias("of_block"), "place", "pair_count", "best")
    return cut.drop("pairs", "held").groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(_score, SCORED)


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
