"""Approximate nearest neighbours by inner product on robust-pruned directed graphs.

Equal vectors form one class, so copies of a vector are one node; a class keeps its
smallest ids, as many as any answer can need.  Classes are dealt to shards
of about ``shard_rows`` by a hash of the vector.  In each shard a graph is built
in one task: from a random start, greedy beam searches propose neighbours
for every node, and relaxed distance pruning keeps diverse ones (a
candidate goes if a kept neighbour is closer to it by the factor alpha), in two
passes with reverse edges.  The index is a table (shard, node, vector,
ids, edges).  A query is searched in every shard by beam search: a task takes in one shard, each of
which is shuffled once, and streams the queries past it batch by batch, so it holds one shard and one
batch however many queries there are.  The best of all shards are merged.

Largest inner product becomes least distance by one more component,
sqrt(M^2 - |x|^2) with M the largest norm of all vectors (queries have 0 there), so all
nodes have norm M and the build works on true distances.  These are taken from the original
vectors, and the difference of the components from their norms, so a few long
vectors do not drown the distances of the rest; the longest nodes are entries too.  Scores are
inner products of the original vectors in double precision: floats stay floats, other numbers are
taken as doubles, and graphs and searches work on vectors scaled by a power of two, so that no size of
a number overflows there.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from triage_spark.llm.common import saved

SHARD_ROWS, SEARCH_BATCH = 8_192, 512
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA, ENTRIES = 32, 64, 128, 1.2, 16
BUILD_BATCH, EXPAND = 512, 4


class Level:
    """Squared distances of vectors that one more component brings to the norm ``norm`` (their largest, if none is given)."""

    def __init__(self, x: np.ndarray, norm: float | None = None):
        self.sq = np.einsum("ij,ij->i", x, x, dtype=np.float64)
        self.rest = np.sqrt(np.maximum((self.sq.max() if norm is None else norm * norm) - self.sq, 0))

    def gap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rest[a] - rest[b], by the difference of squares as the two may be large and all but equal."""
        total = self.rest[a] + self.rest[b]
        return (self.sq[b] - self.sq[a]) / np.where(total > 0, total, np.inf)

    def apart(self, a: np.ndarray, b: np.ndarray, dots: np.ndarray) -> np.ndarray:
        """Squared distances of the nodes a and b with the inner products ``dots`` of their original vectors."""
        return self.sq[a] + self.sq[b] - 2 * dots.astype(np.float64) + self.gap(a, b) ** 2


def greedy(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int, level: Level | None = None, own: np.ndarray | None = None) -> np.ndarray:
    """Beam search for many queries at once: the ``beam`` best nodes met, best first, -1 where there are fewer; edges: (n, degree), -1 for none.

    Best is the largest inner product; with ``level``, for queries that are the nodes ``own``, the least distance.
    """
    n, q = len(x), len(queries)
    beam = min(beam, n)
    entries = entries[: max(1, beam)]
    ids = np.full((q, beam), -1)
    sims = np.full((q, beam), -np.inf, np.float32 if level is None else np.float64)
    first = queries @ x[entries].T
    ids[:, : len(entries)], sims[:, : len(entries)] = entries, first if level is None else -level.apart(own[:, None], entries, first)
    done = np.ones((q, beam), bool)
    done[:, : len(entries)] = False
    met = np.zeros((q, n + 1), bool)
    met[:, entries] = True
    met[:, n] = True  # stands for "no edge"
    live = np.arange(q)
    while len(live):
        s = np.where(done[live], -np.inf, sims[live])
        pick = np.argpartition(-s, min(EXPAND, beam - 1), axis=1)[:, :EXPAND]
        at = np.take_along_axis(s, pick, 1) > -np.inf
        going = at.any(axis=1)
        live, pick, at = live[going], pick[going], at[going]
        if not len(live):
            break
        near = edges[np.take_along_axis(ids[live], pick, 1)]
        near = np.where(at[:, :, None] & (near >= 0), near, n).reshape(len(live), -1)
        d = done[live]
        np.put_along_axis(d, pick, True, 1)
        near = np.where(met[live[:, None], near], n, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n  # one visit for a node met twice in this step
        met[live[:, None], near] = True
        row, col = np.nonzero(near < n)
        new = np.full(near.shape, -np.inf, sims.dtype)
        dots = np.einsum("ij,ij->i", x[near[row, col]], queries[live[row]])
        new[row, col] = dots if level is None else -level.apart(own[live[row]], near[row, col], dots)
        all_sims = np.hstack([sims[live], new])
        best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        sims[live] = np.take_along_axis(all_sims, best, 1)
        ids[live] = np.take_along_axis(np.hstack([ids[live], np.where(near < n, near, -1)]), best, 1)
        done[live] = np.take_along_axis(np.hstack([d, near >= n]), best, 1)
    return np.take_along_axis(ids, np.argsort(-sims, axis=1, kind="stable"), 1)


def prune(x: np.ndarray, nodes: np.ndarray, cands: np.ndarray, alpha: float, degree: int, level: Level | None = None) -> np.ndarray:
    """(len(nodes), degree) diverse neighbours out of the candidate lists, nearest first; -1 for none."""
    level = level or Level(x)
    b, c = cands.shape
    cands = np.where(cands == nodes[:, None], -1, cands)
    cands = np.sort(cands, axis=1)
    cands[:, 1:][cands[:, 1:] == cands[:, :-1]] = -1
    vectors = x[cands]
    dist = level.apart(nodes[:, None], cands, np.einsum("bcd,bd->bc", vectors, x[nodes]))
    dist[cands < 0] = np.inf
    order = np.argsort(dist, axis=1, kind="stable")
    cands, dist = np.take_along_axis(cands, order, 1), np.take_along_axis(dist, order, 1)
    vectors = np.take_along_axis(vectors, order[:, :, None], 1)
    dots = vectors @ vectors.transpose(0, 2, 1)
    alive = np.isfinite(dist)
    out, rows = np.full((b, degree), -1), np.arange(b)
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        first = np.argmax(alive, axis=1)
        out[some, k] = cands[some, first[some]]
        apart = level.apart(cands[rows, first][:, None], cands, dots[rows, first])
        alive &= ~(alpha * alpha * apart <= dist)
        alive[rows, first] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 0, norm: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """edges (n, degree) and entry nodes for vectors that are levelled to ``norm``."""
    n, rng, level = len(x), np.random.default_rng(seed), Level(x, norm)
    middle = np.argmax(x @ x.mean(axis=0) + level.gap(np.arange(n), np.argmin(level.sq)) * level.rest.mean())
    longest = np.argsort(-level.sq, kind="stable")[:ENTRIES]
    entries = np.unique(np.concatenate([[middle], rng.integers(0, n, ENTRIES), longest]))
    if n <= degree + 1:
        every = np.broadcast_to(np.arange(n), (n, n)).copy()
        every[np.arange(n), np.arange(n)] = -1
        return every, entries
    room = 2 * degree
    edges, count = np.full((n, room), -1), np.full(n, degree)
    edges[:, :degree] = rng.integers(0, n, (n, degree))
    for factor in (1.0, alpha):
        order = rng.permutation(n)
        for i in range(0, n, BUILD_BATCH):
            batch = order[i : i + BUILD_BATCH]
            found = greedy(x, edges, x[batch], entries, beam, level, batch)
            kept = prune(x, batch, np.hstack([found, edges[batch]]), factor, degree, level)
            edges[batch] = -1
            edges[batch, :degree] = kept
            count[batch] = (kept >= 0).sum(axis=1)
            src, dst = np.repeat(batch, degree), kept.ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            to, start, extra = np.unique(dst, return_index=True, return_counts=True)
            tight = count[to] + extra > room
            place = np.arange(len(dst)) - np.repeat(start, extra)
            free = ~np.repeat(tight, extra)
            edges[dst[free], count[dst[free]] + place[free]] = src[free]
            count[to[~tight]] += extra[~tight]
            if tight.any():
                full, most = to[tight], int(extra[tight].max())
                more = np.full((len(full), most), -1)
                row = np.repeat(np.arange(len(full)), extra[tight])
                more[row, place[~free]] = src[~free]
                for j in range(0, len(full), BUILD_BATCH):
                    part = full[j : j + BUILD_BATCH]
                    slim = prune(x, part, np.hstack([edges[part], more[j : j + BUILD_BATCH]]), factor, degree, level)
                    edges[part] = -1
                    edges[part, :degree] = slim
                    count[part] = (slim >= 0).sum(axis=1)
    out = edges[:, :degree].copy()
    for j in range(0, n, BUILD_BATCH):
        part = np.arange(j, min(n, j + BUILD_BATCH))
        part = part[count[part] > degree]
        if len(part):
            out[part] = prune(x, part, edges[part], alpha, degree, level)
    return out, entries


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def vectors_of(embeddings: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v: the distinct rows that take part, all of the most frequent length (of equals the least); rows without an id are left out."""
    of = embeddings.schema[vector].dataType
    kind = "float" if isinstance(of, ArrayType) and isinstance(of.elementType, FloatType) else "double"
    rows = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast(f"array<{kind}>").alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    return rows.filter(F.size("v") == (width.w if width else 0)).select("vec_id", F.transform("v", lambda c: c + F.lit(0).cast(kind)).alias("v")).distinct()


def power(most: float) -> float:
    """The power of two that brings numbers of up to ``most`` to one or less, as far as a double holds it."""
    return 2.0 ** -max(-1000, min(1000, math.frexp(most)[1]))


def build_index(vectors: DataFrame, keep: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """shard, node, v, ids (the ``keep`` smallest of the class), edges, entry; one row for each distinct vector."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    classes = vectors.withColumn("place", place).filter(F.col("place") <= keep).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = saved(classes, "ann-classes")
    n, most = classes.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs))).cast("double")).first()
    shards, scale = max(1, math.ceil(n / shard_rows)), power(most or 1.0)
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + (c.cast("double") * scale) * (c.cast("double") * scale))
    norm = classes.agg(F.max(F.sqrt(square))).first()[0]

    def build(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("ids", key=lambda s: s.str[0], kind="stable").reset_index(drop=True)
        edges, entries = build_graph((np.stack(f["v"].to_numpy()).astype(np.float64) * scale).astype(np.float32), norm=norm)
        entry = np.zeros(len(f), bool)
        entry[entries] = True
        return f.assign(node=np.arange(len(f)), edges=[e[e >= 0] for e in edges], entry=entry)[["shard", "node", "v", "ids", "edges", "entry"]]

    # One task for each shard: a graph is the unit of work, so shards are not packed together.
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")).repartitionById(shards, "shard")
    kind = classes.schema["v"].dataType.simpleString()
    return saved(dealt.groupBy("shard").applyInPandas(build, f"shard int, node int, v {kind}, ids array<long>, edges array<int>, entry boolean"), "ann-index")


def stacked(lists: pa.Array) -> np.ndarray:
    """Lists of one length, none null, as the rows of a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


class Shard:
    """One shard's graph as arrays, for searches."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("node").combine_chunks()
        columns = {c: rows.column(c).combine_chunks() for c in ("v", "ids", "edges", "entry")}
        self.v = stacked(columns["v"]).astype(np.float64)
        self.x = (self.v * power(np.abs(self.v).max())).astype(np.float32)
        lists = columns["edges"].to_pylist()
        self.edges = np.full((len(lists), max(1, max(map(len, lists)))), -1)
        for i, e in enumerate(lists):
            self.edges[i, : len(e)] = e
        self.ids = [np.array(i, np.int64) for i in columns["ids"].to_pylist()]
        self.entries = np.flatnonzero(columns["entry"].to_numpy(zero_copy_only=False))

    def search(self, own: np.ndarray, q: np.ndarray, k: int, beam: int) -> Iterator[tuple[int, int, float]]:
        """(query, member, score) of the k nearest met for each query, with all ties of the last node."""
        small = (q * np.array([power(m) for m in np.abs(q).max(axis=1)])[:, None]).astype(np.float32)
        for j, nodes in enumerate(greedy(self.x, self.edges, small, self.entries, max(beam, k + 1))):
            nodes = nodes[nodes >= 0]
            # The last step is exact on what the search has met.
            scores = self.v[nodes] @ q[j]
            order = np.argsort(-scores, kind="stable")
            taken, last = 0, None
            for node, score in zip(nodes[order], scores[order]):
                if taken >= k and score != last:
                    break
                members = self.ids[node][self.ids[node] != own[j]][:k]
                yield from ((own[j], m, score) for m in members)
                taken, last = taken + len(members), score


def _searcher(k: int, beam: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come by shard, in each first its nodes, then the queries.
        nodes, shard, at = [], None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "asks")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(keys)]):
                part = batch.slice(start, end - start)
                if not part.num_rows:
                    continue
                number, asks = keys[start]
                if number != at:
                    nodes, shard, at = [], None, number
                if not asks:
                    nodes.append(part)
                    continue
                if shard is None and nodes:
                    shard, nodes = Shard(pa.Table.from_batches(nodes)), []
                if shard is None:
                    continue
                for i in range(0, part.num_rows, SEARCH_BATCH):
                    some = part.slice(i, SEARCH_BATCH)
                    out = [*shard.search(some.column("node").to_numpy(), stacked(some.column("v")).astype(np.float64), k, beam)]
                    own, ids, scores = zip(*out) if out else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], ["query_id", "vec_id", "score"])

    return search


def search_index(index: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row of ``queries`` (query_id, v), ties to the smaller vec_id."""
    last = index.agg(F.max("shard")).first()[0]
    shards = 1 if last is None else last + 1
    held = index.select("shard", F.lit(False).alias("asks"), F.col("node").cast("long").alias("node"), "v", "ids", "edges", "entry")
    # The stated query set meets every shard.
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), F.col("query_id").alias("node"), "v")
    met = held.unionByName(asked, allowMissingColumns=True).repartitionById(shards, "shard").sortWithinPartitions("shard", "asks")
    found = met.mapInArrow(_searcher(k, beam), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM) -> DataFrame:
    """The k nearest other rows by inner product of the rows for which ``queries`` holds (on vec_id).

    Null vectors, zero vectors, vectors with null or non-finite components or of
    another length than most, and rows without an id take no part;
    repeated rows count once; other columns are not read.  With fewer than k other rows all
    are returned; an empty table gives an empty result.
    """
    vectors = saved(vectors_of(embeddings, id_col, vector), "ann-vectors")
    # k answers and the query itself are the most that one class can give.
    index = build_index(vectors, k + 1, shard_rows)
    return search_index(index, vectors.filter(queries).select(F.col("vec_id").alias("query_id"), "v"), k, beam)


def op4_ann_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
