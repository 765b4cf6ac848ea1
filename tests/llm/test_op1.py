import random

import pytest

from triage_spark.llm import op1_line_dedup as A

COLS = "doc_id long, text string, no int, n int, prefix string, g_id long, removed string"


def tokens(line):
    """Five-word shingles, or all words of a line that has one to four."""
    w = tuple(x for x in line.replace("\t", " ").replace("\r", " ").lower().split(" ") if x)
    return frozenset(w[i : i + 5] for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """{doc_id: removed numbers}; ids distinct."""
    lines = [(doc, i, tokens(line)) for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)) for i, line in enumerate((text or "").split("\n"))]
    out = {doc: [] for doc, _ in rows}
    by = {}
    for at, (doc, i, t) in enumerate(lines):
        near = {j for x in t for j in by.get(x, ())}
        if any(9 * len(t & lines[j][2]) >= 4 * (len(t) + len(lines[j][2])) for j in near):
            out[doc].append(i)
        for x in t:
            by.setdefault(x, []).append(at)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "p", 3, "r") for r in rows], COLS)


def corpus(rnd, docs=150):
    words = [f"w{i}" for i in range(40)] + ["the", "of", "and"] * 5
    passages = [[rnd.choice(words) + str(rnd.randrange(9)) for _ in range(n)] for n in (8, 25, 60, 60)]
    rows = []
    for d in range(docs):
        lines = []
        for _ in range(rnd.randrange(1, 7)):
            base = rnd.choice(passages)[:] if rnd.random() < 0.6 else [rnd.choice(words) + str(rnd.randrange(50)) for _ in range(rnd.choice([2, 5, 9, 40]))]
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                base[rnd.randrange(len(base))] = f"x{rnd.randrange(999)}"
            if rnd.random() < 0.2:
                base = [f"y{rnd.randrange(99)}" for _ in range(30)] + base
            lines.append(" ".join(base))
        rows.append((rnd.randrange(10**6) * docs + d, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("heavy, hubs", [(32, 4), (2, 1), (10**6, 4)])
def test_random_against_brute_force(spark, monkeypatch, heavy, hubs):
    monkeypatch.setattr(A, "HEAVY", heavy)
    monkeypatch.setattr(A, "HUBS", hubs)
    rows = corpus(random.Random(heavy))
    got = A.removed_lines(frame(spark, rows)).collect()
    assert {r.doc_id: r.removed for r in got} == brute(rows) and len(got) == len(rows)
    assert {r.doc_id: r.n_lines for r in got} == {d: t.count("\n") + 1 for d, t in rows}


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    line = "one two three four five six"
    rows = [(2, f"{line}\nshort line\n\n{line.upper()}"), (1, f"short line\r\n\tone two  three four five\tsix \r\n{long}"), (3, None), (4, ""), (5, f"{long} end"), (None, line), (6, f"{line}\nkept words of the last line"), (6, f"{line}\nkept words of the last line"), (7, "\n\n")]
    docs = frame(spark, rows)
    got = {r.doc_id: r.removed for r in A.removed_lines(docs).collect()}
    assert got == {None: [], 1: [1], 2: [0, 1, 3], 3: [], 4: [], 5: [0], 6: [0], 7: []}
    texts = sorted(((r.doc_id, r.text) for r in A.dedup_lines(docs).collect()), key=str)
    assert texts == sorted([(None, line), (1, f"short line\r\n{long}"), (2, ""), (3, None), (4, ""), (5, ""), *[(6, "kept words of the last line")] * 2, (7, "\n\n")], key=str)
    assert A.dedup_lines(docs).columns == docs.columns
    empty = spark.createDataFrame([], COLS)
    assert A.removed_lines(empty).count() == 0 and A.dedup_lines(empty).count() == 0


def test_only_first_of_like_lines_stays(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:30] + [f"edit{i}"] + words[31:])) for i in range(50)]
    assert {r.doc_id: r.removed for r in A.removed_lines(frame(spark, rows)).collect()} == {i: [] if i == 0 else [0] for i in range(50)}


def test_query_and_plan(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    got = A.op1_line_dedup(spark, sf_small)
    assert {r.doc_id: r.removed_lines for r in got.collect()} == {d: ",".join(map(str, x)) for d, x in brute(rows).items()}
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("heavy", [32, 2])
def test_short_lines_against_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(A, "HEAVY", heavy)
    rnd = random.Random(9)
    short = ["all rights reserved.", "of, edti oner.", "one", "a b c d", "a b c d e"]
    rows = [(d, "\n".join([text, *(rnd.choice([x, x.upper(), x.replace(" ", "  "), f"\t{x}\r", "", f"{x} {d}"]) for x in rnd.sample(short, 3))])) for d, text in corpus(rnd, 80)]
    want = brute(rows)
    assert {r.doc_id: r.removed for r in A.removed_lines(frame(spark, rows)).collect()} == want
    assert sum(0 < len(t.split("\n")[i].split()) < 5 for d, t in rows for i in want[d]) > 100


def test_short_lines_of_equal_words_go_and_lines_without_words_stay(spark):
    rows = [(1, "All rights reserved.\n\n \nb a"), (2, "all  rights\treserved.\n\n \na b"), (3, "rights reserved.\nall rights reserved. x y\na b"), (4, None)]
    assert {r.doc_id: r.removed for r in A.removed_lines(frame(spark, rows)).collect()} == {1: [], 2: [0], 3: [2], 4: []}
    assert {r.doc_id: r.text for r in A.dedup_lines(frame(spark, rows)).collect()}[2] == "\n \na b"


def test_lines_that_share_a_small_part_are_not_read_again(spark, monkeypatch):
    rnd = random.Random(3)
    shared = [f"p{i}" for i in range(12)]
    rows = [(d, " ".join(shared + [f"w{rnd.randrange(10**9)}" for _ in range(60)])) for d in range(100)]
    rows += [(100 + d, rows[d][1] + " end") for d in range(3)]
    asked, kept = [], A.fetch_sets
    monkeypatch.setattr(A, "fetch_sets", lambda docs, classes, keys, *a: (asked.append(keys.count()), kept(docs, classes, keys, *a))[1])
    got = {r.doc_id: r.removed for r in A.removed_lines(frame(spark, rows)).collect()}
    assert got == {d: [0] if d >= 100 else [] for d, _ in rows} and 6 <= asked[0] < 30


def test_prefixes_of_matching_lines_share_what_is_required(spark):
    from pyspark.sql import functions as F

    from triage_spark.llm import setjoin as S

    rnd = random.Random(4)
    pairs = spark.range(1, 300).selectExpr("int(id) AS x").crossJoin(spark.range(1, 300).selectExpr("int(id) AS y")).filter("y <= x AND 5 * y >= 4 * x")
    got = {(r.x, r.y): (r.c, r.r) for r in pairs.select("x", "y", S.least_common(F.col("x"), F.col("y"), 4, 5).alias("c"), S.required(F.col("x"), F.col("y"), 4, 5).alias("r")).collect()}
    assert got == {(x, y): (c, c + 1 - -(-4 * x // 5)) for x, y in got for c in [-(-4 * (x + y) // 9)]}
    for (x, y), (c, r) in rnd.sample(sorted(got.items()), 3000):
        tokens = rnd.sample(range(10**6), x + y - c)
        a, b = sorted(tokens[:x]), sorted(tokens[x - c :])
        fronts = [set(t[: len(t) - -(-4 * len(t) // 5) + 1]) for t in (a, b)]
        assert len(b) == y and len(fronts[0] & fronts[1]) >= r >= 1


def test_tokens_are_counted_once_for_each_class_of_equal_lines(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    copied, near = " ".join(words), " ".join(words[:-1] + ["end"])
    rows = [(d, copied if d % 2 else f"{copied}\n{copied.upper()}") for d in range(100)] + [(100, near), (101, " ".join(reversed(words)))]
    kept, seen = A.saved, {}
    monkeypatch.setattr(A, "saved", lambda df, name: seen.setdefault(name, (df.inputFiles(), kept(df, name)))[1])
    got = {r.doc_id: r.removed for r in A.removed_lines(frame(spark, rows)).collect()}
    assert got == {0: [1], **{d: [0] if d % 2 else [0, 1] for d in range(1, 100)}, 100: [0], 101: []}
    # Counted over the classes, not over all lines: 150 equal lines make no token heavy.
    assert seen["line-shared"][0] and all("/line-classes-" in f for f in seen["line-shared"][0])
    assert seen["line-classes"][1].count() == 3 and [r.heavy for r in seen["line-shared"][1].select("heavy").distinct().collect()] == [False]


def test_verification_moves_only_the_sets_in_pairs(spark):
    rows = [(i, (i, 0, 0), [10 * i + t for t in range(9)] if i != 1 else [*range(8), 9]) for i in range(2000)]
    sets = spark.createDataFrame(rows, "c1 long, first struct<doc_id: long, dh: long, no: int>, s array<long>")
    sets = A.saved(sets.selectExpr("*", "size(s) AS n", f"{A.PARITY.format(0)} AS g0", f"{A.PARITY.format(6)} AS g1"), "test-sets")
    # 1 and 0 have 8 of 10 tokens in common, 2 and 0 none.
    got = A.verified(spark.createDataFrame([(1, 0), (2, 0), (3, 3)], "a long, b long"), sets)
    assert sorted((r.a, r.b, r.a_first.doc_id, r.b_first.doc_id) for r in got.collect()) == [(1, 0, 1, 0), (3, 3, 3, 3)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # The sets of one side meet the broadcast pairs, those of the other are filtered by them before they are joined.
    assert "LeftSemi" in plan and "strategy=broadcast" in plan


def test_whole_sets_and_classes_are_not_shuffled_to_meet_a_few_keys(spark, monkeypatch):
    monkeypatch.setattr(A, "HEAVY", 2)
    rows = corpus(random.Random(8), 60)
    kept, plans, counts = A.saved, {}, {}

    def noted(df, name):
        plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
        out = kept(df, name)
        counts.setdefault(name, out.count())
        return out

    monkeypatch.setattr(A, "saved", noted)
    assert {r.doc_id: r.removed for r in A.removed_lines(frame(spark, rows)).collect()} == brute(rows)
    assert counts["line-heavy-sets"] == counts["line-heavy"] > 0
    # By a hint, so whatever Spark's own threshold for broadcasts is.
    assert all("strategy=broadcast" in plans[name] for name in ("line-wanted", "line-heavy-sets"))


def test_only_lines_that_go_are_gathered(spark):
    # (6, 60) is no copy of (6, 61): c2 tells them apart.
    lines = [(1, 11, -1, 0, 0, 3), (1, 11, 0, 5, 50, 9), (1, 11, 1, 6, 60, 9), (1, 11, 2, 5, 50, 9), (None, 10, -1, 0, 0, 1), (None, 10, 0, 5, 50, 9), (2, 12, -1, 0, 0, 2), (2, 12, 0, 6, 61, 9), (2, 12, 1, 7, 70, 9)]
    lines += lines[6:]
    classes = [(5, 50, (None, 10, 0)), (6, None, (1, 11, 1)), (6, 61, (2, 12, 0)), (7, 70, (2, 12, 1))]
    frames = [spark.createDataFrame(lines, "doc_id long, dh long, no int, c1 long, c2 long, n int"), spark.createDataFrame(classes, "c1 long, c2 long, first struct<doc_id: long, dh: long, no: int>"), spark.createDataFrame([((1, 11, 1),), ((2, 12, 1),)], "first struct<doc_id: long, dh: long, no: int>")]
    got = A.numbers_by_document(*frames).collect()
    assert sorted((r.dh, r.doc_id, r.n_lines, r.removed) for r in got) == [(10, None, 1, []), (11, 1, 3, [0, 1, 2]), (12, 2, 2, [1])]


def test_lines_that_stay_are_not_joined_again(spark):
    rows = corpus(random.Random(12), 60)
    got = A.removed_lines(frame(spark, rows))
    assert {r.doc_id: r.removed for r in got.collect()} == brute(rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "strategy=broadcast" in plan
