"""BPE encoding and decoding of whole texts, long unsplit runs by tree concatenation.

A text whose runs without white space are short is encoded in one step
(``tokens.ChunkEncoder``).  A run longer than ``leaf_chars`` (a base64 blob, a text in a
script without spaces) is one piece of work that no cut at white space
divides, and a word inside it may be as long.  Such texts take this path:

1. cut: the run is normalised and split into words by the tokenizer; a word
   longer than ``leaf_chars`` is halved until its pieces are short enough.
2. encode: all pieces of all texts are dealt over the cluster and encoded.
   Pieces before the last get the merges without the end-of-word mark.
3. join: pieces of one word are joined pairwise, as a tree.  A window of k
   tokens on each side of the join is encoded again; if its first token
   is the left side's token there and its last the right side's, the three
   are spliced, else k doubles.  Every pair of neighbours in the result then
   comes from one encoding, and a sequence of BPE tokens in which each pair
   of neighbours is stable is the encoding of its text, so the ids
   equal those of the whole word.  At worst the window is the whole word.

A step holds one document at most, never a group of documents.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triage_spark.llm.common import text_col, text_steps
from triage_spark.llm.tokens import WORD_CHUNKS, chunk_encoder

#: Longest run that is encoded in one piece.
LEAF_CHARS = 16_384
#: Bytes of text that are encoded at a time, in and out of a task's memory together.
STEP_BYTES = 500_000
#: Tokens on each side of a join in the first window.
FIRST_WINDOW = 8
PIECES = "row long, doc_id long, seq long, kind string, run long, last boolean, pieces array<string>"


class WordModel:
    """The merges of a tokenizer file on single words, with and without the end-of-word mark."""

    def __init__(self, path: str):
        from tokenizers.models import BPE

        self.enc = chunk_encoder(path, WORD_CHUNKS)
        with open(path) as f:
            spec = json.load(f)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["merges"]]
        self.mark = spec.get("end_of_word_suffix") or ""
        self.whole = self.enc.tok.model
        self.inner = BPE(vocab=spec["vocab"], merges=merges) if self.mark else self.whole

    def ids(self, piece: str, ends_word: bool) -> list[int]:
        return [t.id for t in (self.whole if ends_word else self.inner).tokenize(piece)]

    def text(self, ids: list[int], ends_word: bool) -> str:
        s = "".join(map(self.enc.tok.id_to_token, ids))
        return s.removesuffix(self.mark) if ends_word and self.mark else s


@cache
def word_model(path: str) -> WordModel:
    """One model for each Python worker."""
    return WordModel(path)


def join_pair(left: list[int], right: list[int], ends_word: bool, model: WordModel) -> list[int]:
    """The encoding of two neighbouring pieces of one word, from theirs."""
    k = FIRST_WINDOW
    while True:
        a, b = left[-k:], right[:k]
        at_end = len(b) == len(right) and ends_word
        again = model.ids(model.text(a, False) + model.text(b, at_end), at_end)
        if (len(a) == len(left) or again[0] == a[0]) and (len(b) == len(right) or again[-1] == b[-1]):
            return left[: len(left) - len(a)] + again + right[len(b) :]
        k *= 2


def join_tree(parts: list[list[int]], ends_word: bool, model: WordModel) -> list[int]:
    """Neighbours are joined level by level."""
    while len(parts) > 1:
        last = len(parts) - 1
        parts = [join_pair(parts[i], parts[i + 1], ends_word and i + 1 == last, model) if i < last else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def halves(word: str, leaf: int) -> list[str]:
    if len(word) <= leaf:
        return [word]
    mid = len(word) // 2
    return halves(word[:mid], leaf) + halves(word[mid:], leaf)


def cut(text: str, leaf: int, model: WordModel) -> Iterator[tuple[str, int, bool, list[str]]]:
    """(kind, run, last, pieces): 'text' for the library, 'words' for the merges, 'half' for a piece of word ``run``."""
    tok, held, size, run = model.enc.tok, [], 0, 0
    special = re.compile("(" + "|".join(map(re.escape, model.enc.special)) + ")") if model.enc.special else None
    for chunk in model.enc.find(text):
        if len(chunk) <= leaf and size + len(chunk) <= leaf:
            held.append(chunk)
            size += len(chunk)
            continue
        if held:
            yield "text", 0, True, [" ".join(held)]
            held, size = [], 0
        if len(chunk) <= leaf:
            held, size = [chunk], len(chunk)
            continue
        for part in special.split(chunk) if special else [chunk]:
            if part in model.enc.special:
                yield "text", 0, True, [part]
                continue
            words, n = [], 0
            for word, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(part)) if part else ():
                if words and n + len(word) > leaf:
                    yield "words", 0, True, words
                    words, n = [], 0
                if len(word) <= leaf:
                    words.append(word)
                    n += len(word)
                    continue
                run += 1
                pieces = halves(word, leaf)
                for i, piece in enumerate(pieces):
                    yield "half", run, i + 1 == len(pieces), [piece]
            if words:
                yield "words", 0, True, words
    if held:
        yield "text", 0, True, [" ".join(held)]


def _id_lists(lists: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(x) for x in lists])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*lists, np.zeros(0, np.int32)]).astype(np.int32)))


def _decode(tok, ids: list[np.ndarray]) -> list[str]:
    return tok.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, ids array<int>, decoded string: one row for each row of ``docs``.

    Null texts are empty (no ids, empty decoded text); null and repeated
    doc_ids and repeated rows each keep their row; other columns are not
    read, so their names cannot clash.  An empty table gives an empty one.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col(text).alias("text"))
    long_run = (F.length("text") > leaf_chars) & F.col("text").rlike(rf"[^ \n\t\r]{{{leaf_chars + 1}}}")
    return _plain(src.filter(~long_run), tokenizer).unionByName(_tree(src.filter(long_run), tokenizer, leaf_chars))


def _plain(src: DataFrame, tokenizer: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = chunk_encoder(tokenizer, WORD_CHUNKS)
        for b in text_steps(batches, "text", STEP_BYTES):
            ids = [np.frombuffer(x, enc.dtype) for x in enc.encode(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _id_lists(ids), pa.array(_decode(enc.tok, ids), pa.string())], ["doc_id", "ids", "decoded"])
        # The worker goes on to other stages.
        enc.cache.clear()

    return src.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def _tree(src: DataFrame, tokenizer: str, leaf: int) -> DataFrame:
    def cut_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = word_model(tokenizer)
        for f in frames:
            for row, doc_id, t in zip(f["row"], f["doc_id"], f["text"]):
                rows = [(row, doc_id, i, *x) for i, x in enumerate(cut(t, leaf, model))] or [(row, doc_id, 0, "text", 0, True, [""])]
                yield pd.DataFrame(rows, columns=["row", "doc_id", "seq", "kind", "run", "last", "pieces"]).astype({"doc_id": "Int64"})

    def encode_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = word_model(tokenizer)
        for f in frames:
            ids = [
                np.frombuffer(model.enc.encode([p[0]])[0], model.enc.dtype).tolist() if kind == "text" else [i for w in p for i in model.ids(w, last)]
                for kind, last, p in zip(f["kind"], f["last"], f["pieces"])
            ]
            yield f[["row", "doc_id", "seq", "kind", "run", "last"]].assign(ids=ids).astype({"doc_id": "Int64"})

    def join_rows(f: pd.DataFrame) -> pd.DataFrame:
        model = word_model(tokenizer)
        f, out, parts = f.sort_values("seq"), [], []
        for kind, last, ids in zip(f["kind"], f["last"], f["ids"]):
            if kind != "half":
                out.extend(ids)
                continue
            parts.append(list(map(int, ids)))
            if last:
                out.extend(join_tree(parts, True, model))
                parts = []
        ids = np.asarray(out, np.int32)
        return pd.DataFrame({"doc_id": f["doc_id"].iloc[:1].astype("Int64"), "ids": [ids], "decoded": _decode(model.enc.tok, [ids])})

    width = src.sparkSession.conf.get("spark.sql.shuffle.partitions")
    pieces = src.withColumn("row", F.monotonically_increasing_id()).mapInPandas(cut_rows, PIECES)
    encoded = pieces.repartition(int(width), "row", "seq").mapInPandas(encode_rows, "row long, doc_id long, seq long, kind string, run long, last boolean, ids array<int>")
    return encoded.groupBy("row").applyInPandas(join_rows, "doc_id long, ids array<int>, decoded string")


def op3_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the hashes of ids and decoded text."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
