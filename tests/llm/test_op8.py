import hashlib
import random

import numpy as np
import pytest

from triage_spark.llm import op8_fingerprints as A

COLS = "doc_id long, text string, part int, k string, fingerprint string, n_chars int"
M = (1 << 64) - 1


def mix(x):
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & M
    return x ^ x >> 31


def toss(own, left):
    low = (own ^ left) & -(own ^ left)
    return 2 * (low.bit_length() - 1) + bool(own & low)


def level_up(symbols):
    """One level of one text, symbol by symbol."""
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    names = [s if n == 1 else mix((s * 0xD6E8FEB86659FD93 + n) & M) for s, n in runs]
    lab = [toss(s, names[i - 1]) if i else int(not s & 1) * 0 + (s & 1) for i, s in enumerate(names)]
    for _ in range(3):
        lab = [toss(x, lab[i - 1]) if i else x & 1 for i, x in enumerate(lab)]
    assert all(a != b for a, b in zip(lab, lab[1:])) and max(lab, default=0) < 6
    starts = [i for i in range(len(lab)) if not i or i < len(lab) - 1 and lab[i] > lab[i - 1] and lab[i] > lab[i + 1]]
    out = []
    for a, b in zip(starts, [*starts[1:], len(lab)]):
        total = sum(names[j] * int(A.PLACES[(j - a) & 127]) for j in range(a, b)) + (b - a) * 0x9E3779B97F4A7C15
        out.append(mix(total & M))
    return out


def slow(text):
    symbols, lists, level = [ord(c) for c in text], {}, 0
    if not text:
        return 0, [[] for _ in A.SKETCH]
    while level < A.SKETCH[0][0] or len(symbols) > 1:
        symbols, level = level_up(symbols), level + 1
        lists[level] = sorted({mix(s ^ 0xD6E8FEB86659FD93) >> 32 for s in symbols})
    return symbols[0], [lists[level][:k] for level, k, _ in A.SKETCH]


def texts(rnd):
    return ["", "a", "aa", "ab", "aaaaaaaaab", "abababababab", "x" * 3000, "é中😀" * 50, *["".join(rnd.choice(al) for _ in range(rnd.choice([3, 40, 900]))) for al in ["ab", "abc ", "thequickbrown ", "éa\U0001f600\n"] * 5]]


def test_against_symbol_by_symbol():
    rnd = random.Random(3)
    many = texts(rnd)
    for text, (name, lists) in zip(many, A.sketches(many)):
        want = slow(text)
        assert name == want[0] and [x.tolist() for x in lists] == want[1], text[:20]


def test_equal_substrings_share_names_at_any_offset():
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    shared = word(2000)

    def names(text, levels):
        s, f = np.frombuffer(text.encode("utf-32-le"), "<u4"), np.array([0])
        for _ in range(levels):
            s, f = A.next_level(s, f)
        return s.tolist()

    inner = names(shared, 3)
    for offset in (0, 1, 2, 7, 130):
        whole = names(word(offset) + shared + word(50), 3)
        common = set(inner) & set(whole)
        assert len(common) > 0.9 * len(set(inner))


def test_likeness():
    rnd = random.Random(2)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    other = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    a, same, near, far = A.sketches([text, text, text[:1500] + "x" + text[1500:], other])
    assert A.as_text(a) == A.as_text(same) and A.likeness(a, same) == 1.0
    assert 0.85 < A.likeness(a, near) < 1 and A.likeness(a, far) < 0.1
    assert A.likeness(*A.sketches(["", ""])) == 1.0 and A.likeness(*A.sketches(["", "abc"])) == 0.0


def expected(rows):
    """By doc_id: the results, one after the other."""
    key = lambda r: (r[0] is not None, r[0] or 0)
    order = sorted(rows, key=key, reverse=True)
    out = {}
    for i, (doc, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        edited = A.edit(text, following)
        own, other, then = A.sketches([text]), A.sketches([edited]), A.sketches([following])
        out[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), A.as_text(own[0]), A.as_text(other[0]), A.likeness(own[0], other[0]), A.likeness(own[0], then[0]))
    return out


def test_edit():
    assert A.edit("abcdefg", "xyz1") == "abcdxyz" and A.edit("abcdefg", "x") == "abcdx" and A.edit("a", "x") == "a" and A.edit("", "x") == ""


@pytest.mark.parametrize("range_chars", [10**9, 2000])
def test_neighbours_against_brute_force(spark, range_chars):
    rnd = random.Random(1)
    rows = [(3 * i, t) for i, t in enumerate(texts(rnd))] + [(None, "no id"), (1000, None), (-5, "low " * 4000)]
    frame = spark.createDataFrame([(*r, 1, "k", "f", 0) for r in rows], COLS)
    got = A.compare_neighbours(frame, range_chars=range_chars).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == expected(rows) and len(got) == len(rows)


def test_repeated_rows_and_empty(spark):
    rows = [(7, f"text number {i}" * 9) for i in range(40)] + [(7, "same same")] * 5 + [(None, "n")] * 2
    got = A.compare_neighbours(spark.createDataFrame([(*r, 1, "k", "f", 0) for r in rows], COLS), range_chars=300).collect()
    assert len(got) == len(rows) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert A.compare_neighbours(spark.createDataFrame([], COLS)).count() == 0
    one = A.compare_neighbours(spark.createDataFrame([(1, "abcd", 1, "k", "f", 0)], COLS)).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one[0].near_next == 1.0


def test_fingerprint_column(spark):
    got = A.fingerprint(spark.createDataFrame([(1, None, 1, "k", "f", 0), (2, "abc " * 9, 1, "k", "f", 0)], COLS)).collect()
    assert [r.lcp_fingerprint for r in got] == [A.as_text(s) for s in A.sketches(["", "abc " * 9])]


def test_query(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    assert {r.doc_id: tuple(r)[1:] for r in A.op8_fingerprints(spark, sf_small).collect()} == expected(rows)


def test_ranges_ascend_at_any_number(spark, monkeypatch):
    from triage_spark.llm.common import in_ranges

    rows = [(i * 3 % 997, f"text {i}") for i in range(900)] + [(5, f"hot {i}") for i in range(600)] + [(None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for chars in (10**9, 900, 60):
        placed, parts = in_ranges(docs, chars)
        got = sorted(((r.k, r.share, r.h), r.part) for r in placed.collect())
        assert [p for _, p in got] == sorted(p for _, p in got) and 0 <= got[0][1] and got[-1][1] < parts
        if parts > 10:
            sizes = np.bincount([p for _, p in got])
            assert sizes.max() < 0.2 * len(rows)
