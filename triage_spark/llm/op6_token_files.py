"""Token-id files by fixed-width bit packing.

File format (little-endian), one file for each range of documents::

    magic "TKBITS1\\0"
    blocks of BLOCK ids, each id in ``bits`` bits (lowest first), each block from a whole byte
    footer: block offsets u64[], doc ids i64[], null flags u8[], ends u64[] (ids up to each document's end)
    trailer: footer offset u64, ids u64, documents u64, blocks u64, bits u32, block u32, magic

``bits`` is the least width that holds the vocabulary.  Fixed widths and the
block offsets let a reader fetch any span of ids with numpy alone.

Documents lie in ascending doc_id order (null first; equal ids by a hash of
their text) over the files, whose names ascend too.  Ranges of ids are cut at
quantiles of the whole doc_id column (``common.in_ranges``).  A task encodes the
sorted rows of a range and streams them into files of bounded size; it writes under a temporary
name and renames, so a repeated task gives the same files again.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triage_spark.llm.common import in_ranges, saved, text_col, text_steps
from triage_spark.llm.tokens import BYTE_CHUNKS, chunk_encoder
from triage_spark.session import scratch_path

MAGIC = b"TKBITS1\0"
BLOCK = 1 << 16
TRAILER = struct.Struct("<QQQQII8s")
#: Characters of text for each range of documents, the work of one task.
RANGE_CHARS = 24_000_000
#: Bytes of chunks that a worker remembers.
CACHE_BYTES = 96_000_000
#: Ids after which a task goes on in a new file; bounds what a reader holds of one file.
FILE_IDS = 16_000_000


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(wide[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, n: int, start: int = 0) -> np.ndarray:
    """``n`` ids of a block from place ``start``; reads their bytes only."""
    first, skip = divmod(start * bits, 8)
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n, first).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, np.uint8, (skip + n * bits + 7) // 8, first), count=skip + n * bits, bitorder="little")
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat[skip:].reshape(n, bits)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


class TokenFileWriter:
    """Streams documents into one file."""

    def __init__(self, fs: pafs.FileSystem, path: str, bits: int):
        self.fs, self.path, self.bits = fs, path, bits
        head, _, name = path.rpartition("/")
        self.temp = f"{head}/.{name}-{uuid.uuid4().hex}"
        self.out = fs.open_output_stream(self.temp)
        self.out.write(MAGIC)
        self.at, self.total = len(MAGIC), 0
        self.rest: list[np.ndarray] = []
        self.held = 0
        self.offsets, self.docs, self.nulls, self.ends = [], [], [], []

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.total += len(ids)
        self.ends.append(self.total)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            flat = np.concatenate(self.rest)
            full = self.held // BLOCK * BLOCK
            for i in range(0, full, BLOCK):
                self._block(flat[i : i + BLOCK])
            self.rest, self.held = [flat[full:]], self.held - full

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.rest))
        for values, kind in ((self.offsets, "<u8"), (self.docs, "<i8"), (self.nulls, "u1"), (self.ends, "<u8")):
            self.out.write(np.asarray(values, kind).tobytes())
        self.out.write(TRAILER.pack(self.at, self.total, len(self.docs), len(self.offsets), self.bits, BLOCK, MAGIC))
        self.out.close()
        self.fs.move(self.temp, self.path)


class TokenFile:
    """Random access to the bytes of one file."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        foot, self.n_ids, n, blocks, self.bits, self.block, magic = TRAILER.unpack(self.data[-TRAILER.size :])
        if magic != MAGIC or bytes(self.data[:8]) != MAGIC:
            raise ValueError("not a token file")
        at = foot
        self.offsets = np.frombuffer(self.data, "<u8", blocks, at)
        self.doc_ids = np.frombuffer(self.data, "<i8", n, at := at + 8 * blocks)
        self.nulls = np.frombuffer(self.data, "u1", n, at := at + 8 * n)
        self.ends = np.frombuffer(self.data, "<u8", n, at + n)

    def span(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from position ``start``; touches only their bytes."""
        stop = min(start + n, self.n_ids)
        parts = []
        for b in range(start // self.block, (max(stop, start + 1) - 1) // self.block + 1 if stop > start else 0):
            low, high = max(0, start - b * self.block), min(self.block, stop - b * self.block)
            parts.append(unpack(self.data[int(self.offsets[b]) :], self.bits, high - low, low))
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def doc(self, i: int) -> np.ndarray:
        start = int(self.ends[i - 1]) if i else 0
        return self.span(start, int(self.ends[i]) - start)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text: str = "text", range_chars: int = RANGE_CHARS, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode, append ``end_id`` and write the files into ``path``; returns their manifest (part, file, n_docs, n_ids).

    Null texts are empty (just the end id), null ids come first, repeated
    rows are all kept, other columns are not read.  An empty table gives no file.
    """
    spark = docs.sparkSession
    enc = chunk_encoder(tokenizer, BYTE_CHUNKS, CACHE_BYTES)
    bits, dtype = max(1, (enc.vocab_size - 1).bit_length()), enc.dtype
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col(text).alias("text"))
    placed, parts = in_ranges(src, range_chars)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = chunk_encoder(tokenizer, BYTE_CHUNKS, CACHE_BYTES)
        end = np.asarray([end_id], dtype).tobytes()
        fs, folder = pafs.FileSystem.from_uri(path)
        fs.create_dir(folder)
        out, part, done = None, None, []

        def close() -> None:
            out.close()
            done.append((part, f"{out.path.rpartition('/')[2]}", len(out.docs), out.total))

        for b in text_steps(batches, "text"):
            for p, doc_id, data in zip(b.column("part").to_pylist(), b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist())):
                if out and (p != part or out.total >= file_ids):
                    close()
                    out = None
                if out is None:
                    nth = len(done) if p == part else 0
                    part, out = p, TokenFileWriter(fs, f"{folder}/part-{p:08d}-{nth:06d}.tok", bits)
                out.add(doc_id, np.frombuffer(data + end, dtype))
        if out:
            close()
        cols = list(zip(*done)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["part", "file", "n_docs", "n_ids"])

    # The texts move once and are encoded where their file is written.
    dealt = placed.repartitionById(parts, "part").sortWithinPartitions("part", "k", "share", "h")
    return saved(dealt.select("part", "doc_id", "text").mapInArrow(write, "part int, file string, n_docs long, n_ids long"), "token-manifest")


def read_token_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and position of each document in the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("file").to_pylist(), b.column("content")):
                f = TokenFile(data.as_buffer())
                starts = np.concatenate([[0], f.ends[:-1]]).astype(np.int64) if len(f.ends) else np.zeros(0, np.int64)
                crcs = [zlib.crc32(f.doc(i).tobytes()) for i in range(len(f.ends))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(crcs), pa.string()), pa.array(f.doc_ids, mask=f.nulls.astype(bool)), pa.array(starts), pa.array(f.ends.astype(np.int64) - starts), pa.array(crcs, pa.int64())],
                    ["file", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.tok").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    docs = files.mapInArrow(read, "file string, doc_id long, local long, n_tokens long, ids_crc32 long")
    # One row for each file.
    before = manifest.select("file", (F.sum("n_ids").over(Window.orderBy("file")) - F.col("n_ids")).alias("base"))
    return docs.join(before, "file").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "token-files")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, path, manifest)
