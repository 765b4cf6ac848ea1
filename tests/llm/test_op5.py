import numpy as np
import pytest
from pyspark.sql import functions as F

from triage_spark.llm.op5_toxicity import Ordinal, best_cut, fit, fit_model, likelihood_steps, op5_toxicity, score, sigmoid, train, word_features, words_of


def test_slopes_against_differences():
    rng = np.random.default_rng(0)
    eta, y, theta = rng.normal(size=40), rng.integers(0, 4, 40), np.array([-0.5, 0.4, 1.7])
    _, by_eta, by_theta = likelihood_steps(eta, y, theta)
    at = lambda e, t: likelihood_steps(e, y, t)[0]
    for i in range(40):
        d = np.eye(40)[i] * 1e-5
        assert by_eta[i] == pytest.approx((at(eta + d, theta) - at(eta - d, theta)) / 2e-5, abs=1e-5)
    for j in range(3):
        d = np.eye(3)[j] * 1e-5
        assert by_theta[j] == pytest.approx((at(eta, theta + d) - at(eta, theta - d)) / 2e-5, abs=1e-4)


def test_fit_finds_an_ordered_scale():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, (800, 5)).astype(float)
    eta = x @ np.array([1.5, -1.0, 0, 0, 0.5]) + rng.logistic(size=800) * 0.3
    y = np.searchsorted([0, 2, 4], eta)
    rows, cols = np.nonzero(x)
    beta, theta = fit(rows, cols, x[rows, cols], y, np.full(5, 1e-5))
    assert (np.diff(theta) > 0).all() and beta[0] > beta[4] > abs(beta[2]) and beta[1] < 0
    said = (sigmoid((x @ beta)[:, None] - theta[None, :]) > 0.5).sum(axis=1)
    assert (said == y).mean() > 0.8


def test_cut_and_degenerate_samples():
    assert 0.4 < best_cut(np.array([0.1, 0.3, 0.5, 0.9]), np.array([False, False, True, True])) <= 0.5 or best_cut(np.array([0.1, 0.3, 0.5, 0.9]), np.array([False, False, True, True])) == pytest.approx(0.4)
    assert train([], np.array([])).thresholds == []
    assert train([np.array([1])] * 3, np.array([1, 1, 1])).thresholds == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = F.xxhash64("doc_id") % 3 == 0
    model = fit_model(docs, labels.filter(~odd))
    assert np.all(np.diff(model.thresholds) > 0) and len(model.thresholds) == 3
    got = score(docs.join(labels.select("doc_id", "toxic"), "doc_id").filter(odd), model).select("toxic", "tox_p", "tox_severity").toPandas()
    said = got.tox_p >= model.cut
    assert said[got.toxic == 1].mean() > 0.8 and said[got.toxic == 0].mean() < 0.005  # some toxic labels here have no toxic word in the text
    assert got.tox_severity[got.toxic == 1].mean() > 1 > 0.1 > got.tox_severity[got.toxic == 0].mean()


def test_score_against_brute_force_and_edges(spark):
    weights = {f: w for word, w in (("idiot", 2.0), ("clown", 1.5), ("fine", -1.0)) for f in word_features(word)[:1]}
    strong = frozenset(word_features("idiot")[:1])
    model = Ordinal(weights, [1.0, 3.0], 0.5, strong, 0.25)
    texts = [None, "", "IDIOT, clown! idiot", "fine words", "idiot " * 30_000 + "fine", "1234 ..."]
    rows = [(i if i else None, t, "a", 0.5, 1, "cut") for i, t in enumerate(texts)] + [(2, texts[2], "a", 0.5, 1, "cut")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, tox_p string, eta double, grade int, weights string")
    got = score(df, model).collect()
    assert len(got) == len(rows)
    for r in got:
        eta = sum(weights[f] for w in words_of(r.text or "") for f in word_features(w) if f in weights)
        eta += 0.25 * ("idiot" in words_of(r.text or ""))
        p = sigmoid(eta - np.array([1.0, 3.0]))
        assert r.tox_p == pytest.approx(p[0]) and r.tox_severity == pytest.approx(p.sum())
        assert r.tox_grade == int(np.argmax([1 - p[0], p[0] - p[1], p[1]]))
    assert score(df.limit(0), model).count() == 0
    assert {r.tox_severity for r in score(df, Ordinal()).collect()} == {0.0}


def test_query(spark, sf_small):
    got = op5_toxicity(spark, sf_small).collect()
    assert len(got) == spark.read.parquet(f"{sf_small}/documents.parquet").count()
    none = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")
    assert fit_model(spark.read.parquet(f"{sf_small}/documents.parquet"), none).thresholds == []
