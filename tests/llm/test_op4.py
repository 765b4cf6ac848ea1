import numpy as np
import pytest
from pyspark.sql import functions as F

from triage_spark.llm.op4_ann_graph import build_graph, build_index, greedy, nearest, op4_ann_graph, prune, search_index

COLS = "vec_id long, embedding array<float>, label int, v string, score double, shard int, ids string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "v", 0.5, 7, "i") for i, v in rows], COLS)


def brute(rows, ids, k):
    """{query: [(vec_id, score)]} in exact order."""
    out = {}
    x = np.array([v for _, v in rows], np.float32).astype(float)
    for i, v in rows:
        if ids(i):
            s = x @ np.array(v, np.float32).astype(float)
            out[i] = sorted(((j, s[n]) for n, (j, _) in enumerate(rows) if j != i), key=lambda p: (-p[1], p[0]))[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_prune_keeps_diverse_neighbours():
    x = np.array([[0, 0, 1], [0.1, 0, 1], [0.11, 0, 1], [0, 0.2, 1], [-0.5, 0, 1]], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = prune(x, np.array([0]), np.array([[2, 1, 3, 4, 1, -1, 0]]), 1.2, 3)
    assert got.tolist() == [[1, 3, 4]]  # 2 is nearer to 1 than to 0


def test_graph_search_finds_the_nearest():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    edges, entries = build_graph(x)
    assert edges.shape == (1500, 32) and (edges >= 0).sum(axis=1).min() > 0 and not (edges == np.arange(1500)[:, None]).any()
    got = greedy(x, edges, x[:100], entries, 64)[:, :20]
    want = np.argsort(-(x[:100] @ x.T), axis=1)[:, :20]
    assert np.mean([len({*a} & {*b}) / 20 for a, b in zip(got, want)]) > 0.95


@pytest.mark.parametrize("shard_rows", [100_000, 70])
def test_small_tables_against_brute_force(spark, shard_rows):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate((rng.normal(size=(200, 8)) * rng.uniform(0.1, 3, (200, 1))).astype(np.float32))]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(2000, [0.0, *rows[5][1][1:]]), (2001, [-0.0, *rows[5][1][1:]])]
    got = found(nearest(frame(spark, rows + rows[:9]), F.col("vec_id") % 10 == 0, 20, shard_rows=shard_rows, beam=400))
    want = brute(rows, lambda i: i % 10 == 0, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 2]), (1, [2, 1]), (20, None), (2, [0, 0]), (3, [nan, 1]), (4, [inf, 1]), (5, [None, 1]), (6, []), (7, [1, 2, 3]), (None, [1, 2]), (8, [1, 2]), (40, [0, -1])]
    got = found(nearest(frame(spark, rows), F.col("vec_id") % 20 == 0))
    assert got == {0: [(8, 5.0), (1, 4.0), (40, -2.0)], 40: [(1, -1.0), (0, -2.0), (8, -2.0)]}
    assert found(nearest(frame(spark, [(0, [1, 2])]), F.col("vec_id") % 20 == 0)) == {}
    assert found(nearest(frame(spark, []), F.col("vec_id") % 20 == 0)) == {}
    assert found(nearest(frame(spark, [(1, [1, 2])]), F.col("vec_id") % 20 == 0)) == {}


def test_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = found(op4_ann_graph(spark, sf)), brute(rows, lambda i: i % 20 == 0, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) > 0.97


def test_recall_with_a_few_long_vectors(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:105] *= 1e4
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = found(nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, shard_rows=1000)), brute(rows, lambda i: i % 20 == 0, 20)
    assert got.keys() == want.keys()
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) > 0.97


def test_doubles_keep_their_precision(spark):
    rng = np.random.default_rng(11)
    rows = [(i, (1.0 + rng.normal(size=4) * 1e-10).tolist()) for i in range(60)] + [(100, [1e300, 0.0, 0.0, 1.0]), (101, [1e-300, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(nearest(df, F.col("vec_id") % 20 == 0, 5, shard_rows=30, beam=100))
    for q in (i for i, _ in rows if i % 20 == 0):
        v = np.array(dict(rows)[q])
        want = sorted(((j, float(np.array(w) @ v)) for j, w in rows if j != q), key=lambda p: (-p[1], p[0]))[:5]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want], rtol=1e-15)
        assert got[q][0][0] == want[0][0]
    whole = spark.createDataFrame([(0, [1, 2]), (1, [2, 1])], "vec_id long, embedding array<int>")
    assert found(nearest(whole, F.col("vec_id") % 20 == 0)) == {0: [(1, 4.0)]}


def test_a_task_takes_in_one_shard(spark):
    rng = np.random.default_rng(13)
    vectors = frame(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 8)))]).selectExpr("vec_id", "embedding AS v")
    index = build_index(vectors, 21, shard_rows=50)
    assert index.select("shard").distinct().count() == 8
    assert index.groupBy(F.input_file_name().alias("file")).agg(F.countDistinct("shard").alias("n")).agg(F.max("n")).first()[0] == 1
    search = search_index(index, vectors.selectExpr("vec_id AS query_id", "v"), 20)
    plan = search._jdf.queryExecution().executedPlan().toString()
    # Index and queries meet by one shuffle, without a copy of the index for each block of queries.
    assert "MapInArrow" in plan and "FlatMapCoGroups" not in plan and plan.count("REPARTITION_BY_NUM") == 1
