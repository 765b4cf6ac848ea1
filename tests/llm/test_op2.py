import hashlib
import random
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from triage_spark.llm.op2_source_mix import budgets, mix, op2_source_mix

COLS = "doc_id long, text string, a string, b string, m_tokens string, name string, weight int, cap int, total int"


def weights(spark, w):
    return spark.createDataFrame(list(w.items()) + [(None, 3), ("x", None)], "path string, weight long")


def pour(caps, ws, budget):
    """Water filling by repeated sharing, in whole numbers at the end."""
    live = {k for k in caps if caps[k] > 0 and ws[k] > 0}
    out, left = dict.fromkeys(caps, 0), budget
    while live:
        total = sum(ws[k] for k in live)
        over = {k for k in live if Fraction(left * ws[k], total) >= caps[k]}
        if not over:
            return out | {k: left * ws[k] // total for k in live}
        for k in over:
            out[k] = caps[k]
            left -= caps[k]
        live -= over
    return out


def test_budgets_against_brute_force(spark):
    rnd = random.Random(2)
    for _ in range(4):
        leaves = {(a, b): rnd.choice([0, 1, 5, 40, 900]) for a in "xyz" for b in "pqrs"}
        w = {k: rnd.randrange(5) for k in ["x", "y", "z", *(f"{a}/{b}" for a, b in leaves)] if rnd.random() < 0.8}
        budget = rnd.choice([0, 7, 300, 10_000])
        dead = {k for k in leaves if not w.get(k[0], 1) or not w.get("/".join(k), 1)}
        caps = {k: 0 if k in dead else n for k, n in leaves.items()}
        top = {a: sum(n for k, n in caps.items() if k[0] == a) for a in "xyz"}
        given = pour(top, {a: w.get(a, 1) for a in top}, min(budget, sum(top.values())))
        want = {}
        for a in top:
            want |= pour({k: n for k, n in caps.items() if k[0] == a}, {k: w.get("/".join(k), 1) for k in caps if k[0] == a}, given[a])
        df = spark.createDataFrame([(*k, n) for k, n in leaves.items()], "l0 string, l1 string, cap long")
        got = {(r.l0, r.l1): r.alloc for r in budgets(df, ["l0", "l1"], weights(spark, w), budget).collect()}
        assert got == {k: v for k, v in want.items() if caps[k] > 0 and k in got} and sum(got.values()) == sum(want.values())


def test_prefix_and_epochs_against_brute_force(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(["w"] * rnd.randrange(1, 30)), "hot" if i % 3 else rnd.choice("uv"), rnd.choice("pq"), "x", "y", 1, 1, 1) for i in range(300)]
    df, w = spark.createDataFrame(rows, COLS), {"hot": 1, "u": 2, "v": 2, "u/p": 3}
    got = mix(df, [F.col("a"), F.col("b")], weights(spark, w), 100, 3, 7).collect()
    tokens = defaultdict(int)
    for r in rows:
        tokens[r[2], r[3]] += len(r[1].split())
    caps = {k: 3 * n for k, n in tokens.items()}
    top = {a: sum(n for k, n in caps.items() if k[0] == a) for a in ("hot", "u", "v")}
    given, want = pour(top, {a: w[a] for a in top}, sum(tokens.values())), set()
    for a in top:
        for leaf, budget in pour({k: n for k, n in caps.items() if k[0] == a}, {k: w.get("/".join(k), 1) for k in caps if k[0] == a}, given[a]).items():
            for epoch in range(4):
                key = lambda r: hashlib.md5(f"7|{epoch}|{r[0]}|{hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest()  # noqa: E731, B023
                for r in sorted((r for r in rows if (r[2], r[3]) == leaf), key=key):
                    n = len(r[1].split())
                    if budget > 0:
                        want.add((r[0], epoch, n, min(n, budget)))
                        budget -= n
    assert len(got) == len(want) and {(r.doc_id, r.m_epoch, r.m_tokens, r.m_take) for r in got} == want
    assert got[0].__fields__ == [c for c in df.columns if c != "m_tokens"] + ["m_levels", "m_epoch", "m_tokens", "m_take"]


def test_edge_rows(spark):
    rows = [(None, "a b", None, "p", None, None, 1, 1, 1), (1, None, "u", "p", "x", "y", 1, 1, 1), (2, "", "u", None, "x", "y", 1, 1, 1), (3, "c " * 50_000, "u", "p", "x", "y", 1, 1, 1)] + [(4, "d d", "u", "p", "x", "y", 1, 1, 1)] * 2
    got = mix(spark.createDataFrame(rows, COLS), [F.col("a"), F.col("b")], weights(spark, {}), 200, 2, 1).collect()
    count = defaultdict(int)
    for r in got:
        count[r.doc_id] += 1
    assert count == {None: 2, 1: 2, 3: 2, 4: 4}  # the leaf (u, null) has no words
    assert mix(spark.createDataFrame([], COLS), [F.col("a")], weights(spark, {})).count() == 0


def test_no_python_in_plan(spark, sf_small):
    plan = op2_source_mix(spark, sf_small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
