import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from triage_spark.llm import op13_token_align as A

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLS = "doc_id long, text string, block long, pair long, place int, held string, n_a string"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATH_B)


def shown_bytes():
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


def spans(parts):
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def one(text, libraries, back=shown_bytes()):
    """(A ids, B ids, groups, links as places) of one text, token by token."""
    if not text:
        return [], [], [], []
    a, b = libraries[0].encode(" " + text, add_special_tokens=False), libraries[1].encode(text)
    bytes_a = [bytes(back[c] for c in t) for t in a.tokens]
    pieces = [libraries[1].id_to_piece(i) for i in b]
    bytes_b = [bytes([int(p[3:5], 16)]) if libraries[1].is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], [], [], []
    span_a, span_b = spans(bytes_a), spans(bytes_b)
    ends = sorted({e for _, e in span_a} & {e for _, e in span_b})
    groups = []
    for lo, hi in zip([0, *ends], ends):
        groups.append(([i for i, s in zip(a.ids, span_a) if lo < s[1] <= hi], [i for i, s in zip(b, span_b) if lo < s[1] <= hi]))
    links, first = [], 0
    for i, (s, e) in enumerate(span_a):
        while span_b[first][1] <= s:
            first += 1
        j = first
        while j < len(span_b) and span_b[j][0] < e:
            links.append((i, j))
            j += 1
    return a.ids, b, groups, links


def brute(texts, libraries):
    got = [one(t, libraries) for t in texts]
    count = Counter(p for a, b, _, links in got for p in {(a[i], b[j]) for i, j in links})
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for a, b, groups, links in got:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(count[a[i], b[j]] == top[a[i]] for i, j in links)
        out.append((len(a), len(b), len(groups), len(links), best, sum(count[a[i], b[j]] for i, j in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


ODD = [None, "", " ", "  \n a", "the cat's <s> <|endoftext|> <0x41> hat", "a▁b", "a▁ b", "\0x", "日本語 テキスト 🙂🙂", "tail   ", "\xa0　x\x1c", "x" * 3000, " ".join(["Überall"] * 900), "1234567 89,0.1\t\tz\r\n"]


def rows_of(seed, n):
    rnd = random.Random(seed)
    words = ["the", "Their", "naïve", "don't", "\n", "  ", "foo_bar", "日本", "🙂", "2024", "...", "zzqx", "éè", "a"]
    return [" ".join(rnd.choice(words) + rnd.choice(["", "", ".", str(rnd.randrange(99))]) for _ in range(rnd.randrange(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("lane, block", [(512, 3_000_000), (1, 200), (3, 3_000_000)])
def test_against_brute_force(spark, monkeypatch, libraries, lane, block):
    texts = ODD + rows_of(lane, 60)
    monkeypatch.setattr(A, "LANE", lane)
    monkeypatch.setattr(A, "BLOCK_BYTES", block)
    got = A.Aligned(texts, PATH_A, PATH_B)
    want = [one(t, libraries) for t in texts]
    assert got.ids[0].tolist() == [i for w in want for i in w[0]] and got.ids[1].tolist() == [i for w in want for i in w[1]]
    assert list(got.groups()) == [";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in w[2]) for w in want]
    starts = list(zip(got.docs[0], got.docs[1]))
    links = sorted(zip(got.link_a.tolist(), got.link_b.tolist()))
    assert links == sorted((starts[d][0] + i, starts[d][1] + j) for d, w in enumerate(want) for i, j in w[3])


@pytest.mark.parametrize("block", [3_000_000, 150])
def test_edge_rows_over_blocks(spark, monkeypatch, libraries, block):
    monkeypatch.setattr(A, "BLOCK_BYTES", block)
    texts = ODD + rows_of(5, 40) + ["the same", "the same"]
    ids = [None if i == 3 else 7 if i > len(texts) - 3 else i * 10 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, "h", "n") for i, t in zip(ids, texts)], COLS).repartition(3)
    got = sorted(map(tuple, A.align(docs, PATH_A, PATH_B).collect()), key=str)
    assert got == sorted([(i, *w) for i, w in zip(ids, brute(texts, libraries))], key=str)


def test_alignments_hold_groups_and_links(spark, libraries):
    texts = ODD + rows_of(8, 20)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for r in A.alignments(docs, PATH_A, PATH_B).collect():
        a, b, _, links = one(texts[r.doc_id], libraries)
        assert (r.a_ids, r.b_ids, list(zip(r.links_a, r.links_b))) == (a, b, links)


def test_one_space_at_the_end(spark, libraries):
    texts = ["tail ", "tail", "x y ", "a\n ", "日本 ", "tail. ", " ", "  ", "tail  ", "▁ ", "long" * 20 + " "]
    got = A.Aligned(texts, PATH_A, PATH_B)
    assert [n for n, t in zip(np.diff(got.docs[1]), texts) if t != "▁ "] == [len(libraries[1].encode(t)) for t in texts if t != "▁ "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rows = sorted(map(tuple, A.align(docs, PATH_A, PATH_B).collect()))
    assert rows == [(i, *w) for i, w in enumerate(brute(texts, libraries))]


def test_empty_table(spark):
    docs = spark.createDataFrame([], COLS)
    assert A.align(docs, PATH_A, PATH_B).count() == 0 and A.alignments(docs, PATH_A, PATH_B).count() == 0


def test_steps_are_bounded_by_lanes():
    ends = np.arange(1, 100_001)
    link_a, link_b, cut_a, cut_b = A.lockstep(ends, ends, np.array([0, 100_000]))
    assert np.array_equal(np.sort(link_a), np.arange(100_000)) and np.array_equal(cut_a, cut_b) and len(cut_a) == 100_000


def test_query_against_brute_force(spark, sf_small, libraries):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    want = {d.doc_id: w for d, w in zip(docs, brute([d.text for d in docs], libraries))}
    got = A.op13_token_align(spark, sf_small).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(docs)


def test_texts_are_compared_as_a_whole_only_after_odd_chunks(libraries):
    sides = A.BytePieces(PATH_A), A.SpacePieces(PATH_B)
    plain = rows_of(6, 20) + [t for t in ODD if t and "▁" not in t]
    for side in sides:
        side.encode([t for t in plain if t])
    assert [s.odd for s in sides] == [False, False]
    for side in sides:
        side.encode(["x▁y"])
    assert [s.odd for s in sides] == [False, True]
    sides[0].bytes = [b"?"] * len(sides[0].bytes)
    sides[0].encode(["never_met_before"])
    assert sides[0].odd
