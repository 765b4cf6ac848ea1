import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from triage_spark.llm.op6_token_files import BLOCK, TokenFile, TokenFileWriter, op6_token_files, pack, read_token_files, unpack, write_token_files
from triage_spark.llm.tokens import BYTE_CHUNKS, ChunkEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("alphabet", ["a \n", "  ab\n\t\r.", "x \xa0\n", "a \x1c\n", "1 2'll", " \n", "é中 '", "A b \n"])
def test_chunks_equal_library(alphabet, library):
    rnd, enc = random.Random(5), ChunkEncoder(PATH, BYTE_CHUNKS)
    for i in range(200):
        s = "".join(rnd.choice(alphabet) for _ in range(rnd.choice([4, 20, 60])))
        s = f"{s[:9]}<|endoftext|>{s[9:]}" if i % 7 == 0 else s
        assert np.frombuffer(enc.encode([s])[0], enc.dtype).tolist() == library.encode(s, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype("<u4")
    data = pack(ids, bits)
    assert len(data) == (1001 * bits + 7) // 8
    assert np.array_equal(unpack(data, bits, 1001), ids)
    assert np.array_equal(unpack(data, bits, 13, 501), ids[501:514])


@pytest.mark.parametrize("bits", [16, 17])
def test_file_random_access(tmp_path, bits):
    import pyarrow.fs as pafs

    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 1 << bits, n).astype("<u4") for n in (0, 5, BLOCK - 3, 2 * BLOCK + 11, 1)]
    w = TokenFileWriter(pafs.LocalFileSystem(), str(tmp_path / "a.tok"), bits)
    for i, d in enumerate(docs):
        w.add(None if i == 0 else i, d)
    w.close()
    f, flat = TokenFile((tmp_path / "a.tok").read_bytes()), np.concatenate(docs)
    assert [p.name for p in tmp_path.iterdir()] == ["a.tok"]
    assert all(np.array_equal(f.doc(i), d) for i, d in enumerate(docs))
    for start, n in ((0, 1), (BLOCK - 2, 4), (BLOCK, BLOCK), (len(flat) - 1, 1), (len(flat), 5), (3, 0)):
        assert np.array_equal(f.span(start, n), flat[start : start + n])
    assert f.nulls.tolist() == [1, 0, 0, 0, 0]


def test_edge_rows_over_many_files(spark, tmp_path, library):
    cols = "doc_id long, text string, h long, ids string, part int, k long, share double"
    texts = {0: None, 1: "", 2: "one two", -5: "x\n\n y", 9: "word " * 3000}
    rows = [(i, t, 1, "c", 1, 1, 0.0) for i, t in texts.items()] + [(7, f"hot {i}", 1, "c", 1, 1, 0.0) for i in range(60)] + [(None, "no id", 1, "c", 1, 1, 0.0)] * 2
    path = f"file://{tmp_path}/t"
    manifest = write_token_files(spark.createDataFrame(rows, cols), path, PATH, range_chars=900, file_ids=500)
    got = read_token_files(spark, path, manifest).orderBy("start").collect()
    assert manifest.count() > 3
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids + [0]
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    crc = lambda t: zlib.crc32(np.asarray(ids(t), "<u4").tobytes())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((r[0] is None, r[0] or 0, len(ids(r[1])), crc(r[1])) for r in rows)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert write_token_files(docs, f"file://{tmp_path}/t", PATH).count() == 0


def test_query_equals_library(spark, sf_small, library):
    start = 0
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op6_token_files(spark, sf_small).collect()}
    for d in docs:
        ids = library.encode(d.text, add_special_tokens=False).ids + [0]
        assert got[d.doc_id] == (start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)
