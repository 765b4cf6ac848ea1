import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from triage_spark.llm import op9_near_dedup as A
from triage_spark.llm.components import components
from triage_spark.llm.shingles import WEIGHT, shingle_hashes, weighted_shingles, word_hashes

COLS = "doc_id long, text string, node long, kept string, class_id int, h int, a int"


def shingles(text):
    w = (text or "").lower().split()
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def classes(rows):
    """Brute force: doc_id -> least id of its class (ids distinct)."""
    sets = {i: frozenset(shingles(t)) for i, t in rows}
    texts, by, root = dict(rows), defaultdict(list), {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    seen = Counter((a, b) for ids in by.values() for n, a in enumerate(ids) for b in ids[n + 1 :])
    linked = [p for p, k in seen.items() if k / (len(sets[p[0]]) + len(sets[p[1]]) - k) >= 0.8]
    first = {}
    linked += [(first.setdefault(t or "", i), i) for i, t in texts.items()]
    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def test_words_and_shingles():
    texts = ["", " \n", "One two", "a b c d e f", "x\ty  z\n", "ÉA éa", "a\0 a", "w" * 9000, "w" * 9001]
    words, counts = word_hashes(texts)
    assert counts.tolist() == [len(t.split()) for t in texts]
    names = [w for t in texts for w in t.lower().split()]
    assert len(set(words.tolist())) == len(set(names)) and [words.tolist().index(x) for x in words.tolist()] == [names.index(x) for x in names]
    hashes, owner = shingle_hashes(texts)
    assert np.bincount(owner, minlength=len(texts)).tolist() == [len(shingles(t)) for t in texts]
    _, weights, _ = weighted_shingles(["a b c d e f a b c d e f a b c d e", "q"])
    assert sorted(weights.round(6)) == sorted(round(1 + WEIGHT * np.log(n), 6) for n in [*Counter(shingles("a b c d e f a b c d e f a b c d e")).values(), 1])
    assert word_hashes([])[1].tolist() == []


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 1 << 63, 90).astype(np.uint64)
    a, b = dict(zip(ids[:60], rng.uniform(0.2, 5, 60))), dict(zip(ids[20:], rng.uniform(0.2, 5, 70)))
    want = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in ids) for d in ids if d in a and d in b)
    s = A.signatures(np.array([*a, *b], np.uint64), np.array([*a.values(), *b.values()]), np.repeat([0, 1], [60, 70]), 2, 6000)
    assert (s[0] == s[1]).mean() == pytest.approx(want, abs=0.03)
    # Alone or in a batch, a text has the same signature; weights by a common factor change nothing of who wins.
    alone = A.signatures(np.array([*a], np.uint64), np.array([*a.values()]), np.zeros(60, int), 1, 6000)
    assert (alone[0] == s[0]).all()


def test_every_pair_above_the_bound_shares_a_band():
    assert (1 - 0.8**A.ROWS) ** A.BANDS < 2e-5


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)] + [(5, 5), (1, 0)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, 3, 4) for r in rows], COLS)


def test_planted_groups_against_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice(["alpha", "beta", "Gamma", "delta", "of", "the"]) + str(rnd.randrange(60))
    rows, base = [], [[word() for _ in range(rnd.choice([3, 8, 60, 200]))] for _ in range(30)]
    for i in range(420):
        b = base[0] if i % 3 == 0 else rnd.choice(base)
        w = b[:]
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            w[rnd.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join([*base[i][:40], *[word() for _ in range(80)]])) for i in range(20)]
    got = A.near_classes(frame(spark, rows)).collect()
    assert {r.doc_id: r.class_id for r in got} == classes(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_links_beyond_the_hub_are_kept(spark):
    # A chain whose ends are unlike, in buckets of shared shingles: most links are not with a hub.
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(150)]
    rows, w = [], words[:]
    for i in range(60):
        rows.append((i * 7 % 61, " ".join(w)))
        w[rnd.randrange(150)] = f"new{i}"
    got = {r.doc_id: r.class_id for r in A.near_classes(frame(spark, rows)).collect()}
    assert got == classes(rows)


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(5, None), (3, ""), (9, " \n"), (1, "one two"), (2, "One  two"), (4, "one two three"), (7, long), (6, long + " end"), (None, "one two"), (None, "no id"), (8, "a b c d e"), (8, "a b c d e")]
    got = sorted(((r.doc_id, r.class_id, r.kept) for r in A.near_classes(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 3, False), (3, 3, True), (9, 9, True), (1, 1, True), (2, 1, False), (4, 4, True), (7, 6, False), (6, 6, True), (None, 1, False), (None, None, True), (8, 8, True), (8, 8, True)], key=str)
    assert A.near_classes(frame(spark, [])).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: r.class_id for r in A.op9_near_dedup(spark, sf).collect()} == classes(rows)


def test_keep_first(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(4, long), (2, long + " end"), (None, long), (3, "other text"), (3, "other text"), (3, "third text"), (None, None), (None, ""), (9, "x y"), (9, "x y")]
    docs = spark.createDataFrame([(*r, i, "k", 2, 3, 4) for i, r in enumerate(rows)], COLS.replace("node", "k_id").replace("kept", "nth"))
    got = A.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text or "") for r in got.collect()), key=str) == sorted([(2, long + " end"), (3, "other text"), (3, "third text"), (None, ""), (9, "x y")], key=str)
    assert A.keep_first(docs.limit(0)).count() == 0


def family(rnd, members, edits, words=300):
    base = [f"b{i}" for i in range(words)]
    rows = []
    for d in range(members):
        own = base[:]
        for _ in range(rnd.choice(edits)):
            own[rnd.randrange(words)] = f"e{rnd.randrange(10**6)}"
        rows.append(" ".join(own))
    return rows


@pytest.mark.parametrize("edits, rounds", [([8, 9], 3), ([3, 5, 6, 7, 8, 10, 14], 3), ([3, 5, 6, 7, 8, 10, 14], 1), ([5, 7], 0)])
def test_a_family_below_the_bound_is_not_paired_up(spark, monkeypatch, edits, rounds):
    """Many texts of one base, most of them less alike than asked for; some have a copy with one more edit."""
    monkeypatch.setattr(A, "HUB_ROUNDS", rounds)
    rnd = random.Random(sum(edits))
    texts = family(rnd, 150, edits)
    texts += [t.replace(f"b{rnd.randrange(300)} ", "copy ") for t in texts[::5]] + family(rnd, 40, edits, 200)
    tested, kept = [], A._verified
    monkeypatch.setattr(A, "_verified", lambda docs, nodes, pairs, s: (tested.append(pairs.count()), kept(docs, nodes, pairs, s))[1])
    rows = list(enumerate(texts))
    got = A.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.class_id for r in got} == classes(rows)
    if rounds and min(edits) >= 8:
        assert sum(tested) < 8 * len(rows)
