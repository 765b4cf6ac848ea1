"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features of a text: each distinct word (a run of letters, lower case) gives
itself and its first four and five letters; a feature's value is the number of distinct words
that give it.  Prefixes carry over to inflected forms that the sample lacks.

Model: P(grade <= k) = sigmoid(theta_k - x.beta) with ordered thresholds theta and
one weight vector beta for all of them, fitted by proximal gradient steps
with an L1 penalty, so beta is sparse.  Expected severity is the sum over k >= 1 of P(grade >= k).

The ``labels`` table knows toxic 0/1 only.  Grades of toxic rows come from
their evidence: a first fit on the two grades finds the words that speak
for toxicity, and the toxic sample is split at the terciles of their number into grades 1 to 3.

The fit reads a bounded sample: the ``sample_rows`` labelled documents
of lowest hashed id.  It runs in one task; only the weights reach the driver.  Scoring reads every whole text,
in Arrow batches, with the non-zero weights alone (at most ``max_features``).
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage_spark.llm.common import text_col, text_steps

#: Labelled documents that the fit may see at most.
SAMPLE_ROWS = 10_000
#: Features that the fit may weigh at most; the best by a test of association.
MAX_FEATURES = 4_096
#: L1 penalty of a feature, over the number of sample rows that have it.
L1 = 4e-3
#: A feature's value is cut here.
MOST = 5
#: Weight in the fit on two grades from which a feature is strong evidence.
STRONG = 1.0
WORD = re.compile(r"[^\W\d_]+")
CACHE_WORDS = 400_000
#: The columns that scoring adds.
ADDED = {"tox_severity": T.DoubleType(), "tox_p": T.DoubleType(), "tox_grade": T.IntegerType()}


def word_features(word: str) -> list[int]:
    names = ("w" + word, "4" + word[:4], "5" + word[:5]) if len(word) > 5 else ("w" + word, "4" + word[:4]) if len(word) > 4 else ("w" + word,)
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) for n in names]


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(x, -700, 700)))


@dataclass
class Ordinal:
    """Weights by feature, the ordered thresholds and the P(grade >= 1) from which a text is rejected; without thresholds every text has grade 0."""

    weights: dict[int, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)
    cut: float = 0.5
    #: Features of which one at least adds ``any_weight``, once.
    strong: frozenset[int] = frozenset()
    any_weight: float = 0.0

    def eta(self, counts: dict[int, int]) -> float:
        """x.beta of a text from its number of words for each feature."""
        known = sorted((f, n) for f, n in counts.items() if f in self.weights)
        return sum(self.weights[f] * min(n, MOST) for f, n in known) + self.any_weight * any(f in self.strong for f, _ in known)

    def at_least(self, eta: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..: one column for each threshold."""
        return sigmoid(np.asarray(eta)[:, None] - np.asarray(self.thresholds)[None, :])


def likelihood_steps(eta: np.ndarray, y: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of grades ``y``, its slope by eta for each row, and by each threshold."""
    upper = np.append(theta, np.inf)[y]
    lower = np.insert(theta, 0, -np.inf)[y]
    above, below = sigmoid(upper - eta), sigmoid(lower - eta)
    p = np.maximum(above - below, 1e-12)
    by_theta = np.zeros(len(theta))
    np.add.at(by_theta, y[y < len(theta)], (above * (1 - above) / p)[y < len(theta)])
    np.subtract.at(by_theta, y[y > 0] - 1, (below * (1 - below) / p)[y > 0])
    return float(np.log(p).sum()), above + below - 1, by_theta


def fit(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, l1: np.ndarray, rounds: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """beta and theta for the sparse matrix (rows, cols, values), grades 0..K-1 and each column's L1 penalty."""
    n, k, width = len(y), int(y.max()) + 1, len(l1)
    share = np.cumsum(np.bincount(y, minlength=k))[:-1] / n
    theta = np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    theta = np.maximum.accumulate(theta + 1e-3 * np.arange(k - 1))
    times = lambda b: np.bincount(rows, values * b[cols], minlength=n)
    back = lambda r: np.bincount(cols, values * r[rows], minlength=width)
    v = np.ones(width)
    for _ in range(30):  # largest eigenvalue of X'X
        v = back(times(v / np.linalg.norm(v)))
    step = n / (0.5 * np.linalg.norm(v) + 1e-9)
    beta = ahead = np.zeros(width)
    t = 1.0
    for _ in range(rounds):
        _, by_eta, _ = likelihood_steps(times(ahead), y, theta)
        moved = ahead + step * back(by_eta) / n
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        beta, ahead, t = new, new + (t - 1) / t_new * (new - beta), t_new
        eta = times(beta)
        _, _, by_theta = likelihood_steps(eta, y, theta)
        theta = np.maximum.accumulate(theta + np.clip(4 * by_theta / n, -0.2, 0.2))
        theta = np.maximum(theta, theta[0] + 1e-3 * np.arange(k - 1))
    return beta, theta


def train(features: list[np.ndarray], toxic: np.ndarray, max_features: int = MAX_FEATURES) -> Ordinal:
    """The model from each sample row's feature numbers (repeated by value) and toxic 0/1."""
    toxic = np.asarray(toxic, bool)
    if not len(toxic) or toxic.all() or not toxic.any():
        return Ordinal()
    found = [np.unique(np.asarray(f, np.uint32), return_counts=True) for f in features]
    ids, values = np.concatenate([f for f, _ in found]), np.concatenate([n for _, n in found]).astype(np.uint16)
    rows = np.repeat(np.arange(len(found), dtype=np.int32), [len(f) for f, _ in found])
    vocabulary, seen = np.unique(ids, return_counts=True)
    hits = np.bincount(np.searchsorted(vocabulary, ids[toxic[rows]]), minlength=len(vocabulary))
    rate = toxic.mean()
    # Distance of a feature's toxic share from the sample's, in standard errors.
    z = np.abs(hits - seen * rate) / np.sqrt(seen * rate * (1 - rate))
    kept = np.flatnonzero((seen >= 3) & (z > 4))
    kept = np.sort(kept[np.argsort(-z[kept], kind="stable")[:max_features]])
    if not len(kept):
        return Ordinal()
    kept, seen = vocabulary[kept], seen[kept]
    cols = np.minimum(np.searchsorted(kept, ids), len(kept) - 1)
    use = kept[cols] == ids
    rows, cols, values = rows[use], cols[use], np.minimum(values[use], MOST).astype(float)
    # Rare features, whose association is more often chance, pay more.
    l1 = L1 / seen
    beta, _ = fit(rows, cols, values, toxic.astype(int), l1)
    strong = beta >= STRONG
    evidence = np.bincount(rows, values * (beta[cols] > 0), minlength=len(toxic))
    cuts = np.unique(np.quantile(evidence[toxic], [1 / 3, 2 / 3]))
    grade = np.where(toxic, 1 + np.searchsorted(cuts, evidence, "left"), 0)
    grade = np.unique(grade, return_inverse=True)[1]
    # One more column for "some strong evidence": the first word says more than the next.
    has = np.unique(rows[strong[cols]])
    rows, cols = np.append(rows, has), np.append(cols, np.full(len(has), len(kept)))
    values = np.append(values, np.ones(len(has)))
    beta, theta = fit(rows, cols, values, grade, np.append(l1, L1 / max(1, len(has))))
    weights = {int(f): float(b) for f, b, s in zip(kept, beta, strong) if b or s}
    model = Ordinal(weights, theta.tolist(), 0.5, frozenset(int(f) for f in kept[strong]), float(beta[-1]))
    model.cut = best_cut(model.at_least(np.bincount(rows, values * beta[cols], minlength=len(toxic)))[:, 0], toxic)
    return model


def best_cut(p: np.ndarray, toxic: np.ndarray, false_cost: float = 5.0) -> float:
    """The bound on ``p`` with the lowest cost on the sample, a clean text above it counting ``false_cost``; in the middle of its gap."""
    values = np.unique(np.append(p, [0.0, 1.0]))
    missed = np.searchsorted(np.sort(p[toxic]), values[1:], "left")
    clean = np.sort(p[~toxic])
    wrong = len(clean) - np.searchsorted(clean, values[1:], "left")
    best = int(np.argmin(missed + false_cost * wrong))
    return float((values[best] + values[best + 1]) / 2)


def sample_features(docs: DataFrame, labels: DataFrame, sample_rows: int, id_col: str, text: str) -> DataFrame:
    """toxic, features of the sample: rows of ``docs`` whose label is among the chosen ones."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select(F.col("doc_id").alias("l_id"), "toxic")
    # Broadcast: sample_rows rows of two numbers at most.
    texts = docs.select(F.col(id_col).alias("d_id"), text_col(text).alias("text")).join(F.broadcast(chosen), F.col("d_id") == F.col("l_id"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches, "text"):
            lists = [[f for w in words_of(t) for f in word_features(w)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("l_id"), b.column("toxic"), pa.array(lists, pa.list_(pa.int64()))], ["l_id", "toxic", "features"])

    got = texts.select("l_id", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(features, "l_id long, toxic int, features array<long>")
    # Repeated rows of a chosen id keep the bound.
    return got.orderBy("l_id", F.hash("features")).limit(sample_rows)


def fit_model(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, max_features: int = MAX_FEATURES, id_col: str = "doc_id", text: str = "text") -> Ordinal:
    """The model of the labelled sample, fitted in one task on at most ``sample_rows`` rows of feature numbers."""

    def fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, toxic = [], []
        for b in batches:
            lists += [np.asarray(f.values, np.uint32) for f in b.column("features")]
            toxic += b.column("toxic").to_pylist()
        m = train(lists, np.array(toxic), max_features)
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps([list(m.weights.items()), m.thresholds, m.cut, sorted(m.strong), m.any_weight])])], ["model"])

    sample = sample_features(docs, labels, sample_rows, id_col, text)
    got = sample.select("toxic", "features").coalesce(1).mapInArrow(fit_rows, "model string").first()
    if got is None:
        return Ordinal()
    weights, thresholds, cut, strong, any_weight = json.loads(got.model)
    return Ordinal({f: w for f, w in weights}, thresholds, cut, frozenset(strong), any_weight)


def score(docs: DataFrame, model: Ordinal, text: str = "text") -> DataFrame:
    """All columns of ``docs``, then tox_severity, tox_p (P(grade >= 1)) and tox_grade (the most likely grade).

    One row for each row: null and empty texts are scored by the thresholds
    alone, ids play no part.  A column of ``docs`` with one of these
    names is replaced.  An empty table gives an empty one; without a
    labelled sample of both classes every text has severity 0.
    """
    # The closure holds the non-zero weights, at most max_features of them.

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple] = {}
        for b in text_steps(batches, text):
            etas = []
            for t in b.column(text).to_pylist():
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                got: dict[int, int] = {}
                for w in words_of(t or ""):
                    hit = cache.get(w)
                    if hit is None:
                        hit = cache[w] = tuple(f for f in word_features(w) if f in model.weights)
                    for f in hit:
                        got[f] = got.get(f, 0) + 1
                etas.append(model.eta(got))
            p = model.at_least(np.asarray(etas, float))
            steps = np.hstack([np.ones((len(etas), 1)), p, np.zeros((len(etas), 1))])
            grade = np.argmax(steps[:, :-1] - steps[:, 1:], axis=1)
            new = [pa.array(p.sum(axis=1)), pa.array(p[:, 0] if p.shape[1] else np.zeros(len(etas))), pa.array(grade.astype(np.int32))]
            keep = [n for n in b.schema.names if n not in ADDED]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in keep] + new, keep + list(ADDED))

    kept = docs.drop(*[c for c in ADDED if c != text])
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *[T.StructField(n, k) for n, k in ADDED.items()]]))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", F.col("tox_severity").alias("severity"), F.col("tox_p").alias("p_toxic"), F.col("tox_grade").alias("grade"), (F.col("tox_p") >= model.cut).alias("toxic"))
