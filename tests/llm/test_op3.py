import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from triage_spark.llm.op3_bpe_tree import WordModel, cut, digests, encode_decode, join_tree, op3_bpe_tree

PATH = public_tokenizers.path("word_bpe_49k.json")
COLS = "doc_id long, text string, ids string, row long, seq int, kind string"


@pytest.fixture(scope="module")
def model():
    return WordModel(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def by_tree(text, leaf, model):
    out, parts = [], []
    for kind, _, last, pieces in cut(text, leaf, model):
        if kind == "text":
            out += np.frombuffer(model.enc.encode(pieces)[0], model.enc.dtype).tolist()
        elif kind == "words":
            out += [i for w in pieces for i in model.ids(w, True)]
        else:
            parts.append(model.ids(pieces[0], last))
            if last:
                out += join_tree(parts, True, model)
                parts = []
    return out


@pytest.mark.parametrize("alphabet", ["ab", "aaaab", "hel", "theandr", "éàü中文日本", "a.b'sé 9 \n", "A İßẞΣéé\x1c\xa0", "<|endoftext|>a"])
def test_tree_equals_library(alphabet, model, library):
    rnd = random.Random(7)
    for i in range(150):
        s = "".join(rnd.choice(alphabet) for _ in range(rnd.choice([3, 20, 90, 600])))
        s = f"{s[:9]}<|endoftext|>{s[9:]}" if i % 7 == 0 else s
        assert by_tree(s, rnd.choice([2, 3, 5, 16, 40]), model) == library.encode(s, add_special_tokens=False).ids


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_edge_rows(spark, library):
    rnd = random.Random(3)
    run = "".join(rnd.choice("theandr") for _ in range(9_000))
    texts = [None, "", " \n", "The cat.", "The cat.", f"one {run} two", run[:4000], "\xa0" * 500, f"x<|endoftext|>{run}", "日本" * 900]
    rows = [(i if i != 3 else None, t, "x", 0, 0, "k") for i, t in enumerate(texts)] + [(3, "twice", "x", 0, 0, "k")] * 2
    got = digests(encode_decode(spark.createDataFrame(rows, COLS), PATH, leaf_chars=300)).collect()
    want = [(r[0], *expected(library, r[1])) for r in rows]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert encode_decode(spark.createDataFrame([], COLS), PATH).count() == 0


def test_query_equals_library(spark, sf_small, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op3_bpe_tree(spark, sf_small).collect()}
    assert got == {i: expected(library, t) for i, t in docs.items()}
