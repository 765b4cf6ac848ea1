"""Near duplicates by ProbMinHash: weighted word shingles, banding, verification, classes.

Signature: every distinct shingle of a text starts a Poisson process whose
rate is its weight; each arrival falls into one of ``SLOTS`` slots and a slot keeps the
shingle of its earliest arrival.  All processes of a text run in step, and one
ends as soon as its next arrival is later than the latest slot.  Two texts agree in a slot with the
probability of their probability Jaccard likeness
J = sum over common d of 1 / sum over d' of max(a_d'/a_d, b_d'/b_d), which for equal
weights is the Jaccard likeness.

Bands of ``ROWS`` slots give candidates: at J = 0.8 a pair shares none of the
16 bands with probability (1 - 0.8^3)^16 = 1e-5.  Weights are close to 1
(see ``weighted_shingles``), so J stays close to the plain Jaccard likeness of the shingle
sets, on which every candidate pair is verified exactly.

Classes, without pairing up a bucket: exact copies are one node.  Every node of a
bucket is compared with one hub, its node with the most company, and what is linked is joined to classes; that
settles most groups of near copies with rows in proportion to their size.  Where
buckets still hold nodes of different classes, all their nodes go through an exact set-similarity join:
shingles in order of rarity among these nodes, and only nodes of different classes that share one in
their prefixes can be linked.  In such a bucket the nodes are compared with one hub after the other, and
nodes around one hub meet each other only by what sets them apart from it (``_around_hubs``), so the members of a family
that are less alike than asked for do not meet, however many they are.  No link between different texts
is lost among the candidates.  Hubs with many members are dealt over several tasks, with their text.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triage_spark.llm.common import saved, text_col, text_steps, unused
from triage_spark.llm.components import components
from triage_spark.llm.setjoin import fits, rare_prefixes, side
from triage_spark.llm.shingles import U64, mix, weighted_shingles

SIMILARITY = 0.8
BANDS, ROWS = 16, 3
SLOTS = BANDS * ROWS
#: Members of a hub that one task compares.
HUB_MEMBERS = 256
#: Rows of (id, hub) up to which they are broadcast to the scan of the texts, about 100 bytes each.
BROADCAST_ROWS = 200_000
#: Rows of (id, hash) up to which they are broadcast to the scan, about 30 bytes each.
BROADCAST_KEYS = 1_000_000
#: Counted shingles up to which they are broadcast, 16 bytes each.
BROADCAST_TOKENS = 1_000_000
STEP = 1_500_000
#: Hubs that a rarity bucket is compared with before what is left of it is paired up.
HUB_ROUNDS = 3

_STEP, _SLOT = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
_BAND = mix(np.arange(9001, 9001 + SLOTS, dtype=U64) * _STEP) | U64(1)


def signatures(shingles: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """(n, slots) shingles of the earliest arrivals; rows of texts without shingles stay 0."""
    best = np.full(n * slots, np.inf)
    winner = np.zeros(n * slots, U64)
    at = np.zeros(len(shingles))
    turn = 0
    latest = np.full(n, np.inf)
    while len(shingles):
        turn += 1
        draw = mix(shingles + U64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        at = at - np.log((draw >> U64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / weights
        live = at < latest[owner]
        shingles, weights, owner, at, draw = shingles[live], weights[live], owner[live], at[live], draw[live]
        slot = owner * slots + ((mix(draw ^ _SLOT) >> U64(32)) * U64(slots) >> U64(32)).astype(np.int64)
        np.minimum.at(best, slot, at)
        won = at == best[slot]
        winner[slot[won]] = shingles[won]
        latest = best.reshape(n, slots).max(axis=1)
        live = at < latest[owner]
        shingles, weights, owner, at = shingles[live], weights[live], owner[live], at[live]
    return winner.reshape(n, slots)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(n, BANDS) hashes of the bands' slots."""
    return mix((signature * _BAND).reshape(len(signature), BANDS, ROWS).sum(axis=2, dtype=U64)).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of shingles, each distinct; 0 if one is empty."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if common else 0.0


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    shingles, _, owner = weighted_shingles(texts)
    return np.split(shingles, np.searchsorted(owner, np.arange(1, len(texts))))


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, h, copy (md5 of the text), bands of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches, "text", STEP):
            texts = b.column("text").to_pylist()
            shingles, weights, owner = weighted_shingles(texts)
            keys = band_keys(signatures(shingles, weights, owner, len(texts)))
            has = np.bincount(owner, minlength=len(texts)) > 0
            ends = np.append(0, np.cumsum(has * BANDS))
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[has].ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), b.column("copy"), bands], ["doc_id", "h", "copy", "bands"])

    return docs.mapInArrow(run, "doc_id long, h long, copy string, bands array<long>")


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a: hub, b: member) whose texts are as like as ``similarity``.

    Hubs with many members are dealt over several parts, each with the hub's text.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_MEMBERS).cast("int").alias("parts"))
    member = pairs.join(parts.withColumnRenamed("a", "p_a"), F.col("a") == F.col("p_a")).select("a", F.pmod(F.hash("b"), F.col("parts")).alias("part"), F.col("b").alias("node"))
    heads = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("node"))
    rows = _text_rows(docs, nodes, member.unionByName(heads))
    dealt = rows.repartition("a", "part").sortWithinPartitions("a", "part", (F.col("node") != F.col("a")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, hub = None, None
        for b in text_steps(batches, "text", STEP):
            sets = shingle_sets(b.column("text").to_pylist())
            found = []
            for a, part, node, own in zip(b.column("a").to_pylist(), b.column("part").to_pylist(), b.column("node").to_pylist(), sets):
                if (a, part) != group:
                    group, hub = (a, part), own
                if node != a and jaccard(hub, own) >= similarity:
                    found.append((a, node))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _text_rows(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The columns of ``wanted`` (with node) and the text of each of its nodes."""
    named = wanted.join(nodes.select(F.col("node").alias("n_node"), "rep", F.col("h").alias("n_h")), F.col("node") == F.col("n_node")).drop("n_node")
    named = saved(named, "near-wanted")
    side_ = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
    return docs.join(side_, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("h") == F.col("n_h"))).select(*wanted.columns, "text")


def _prefix_pairs(docs: DataFrame, nodes: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes of different classes that can be as like as ``similarity``; held: distinct node, root."""
    p, q = Fraction(similarity).limit_denominator(1000).as_integer_ratio()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches, "text", STEP):
            sets = shingle_sets(b.column("text").to_pylist())
            ends = np.cumsum([0, *map(len, sets)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("node"), lists], ["c1", "s"])

    texts = _text_rows(docs, nodes, held.select("node"))
    sets = saved(texts.mapInArrow(run, "c1 long, s array<long>").dropDuplicates(["c1"]), "near-sets")
    entries = rare_prefixes(sets, p, q, BROADCAST_TOKENS).join(held.select(F.col("node").alias("c1"), "root"), "c1")
    entries = saved(entries, "near-rare")
    sizes = entries.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    open_ = saved(entries.join(sizes.select("token"), "token"), "near-mixed")
    found = []
    for _ in range(HUB_ROUNDS):
        if open_.isEmpty():
            break
        linked, maybe, open_ = _around_hubs(open_, sets, p, q)
        found += [linked, maybe]
    # The exact rest: nodes of a bucket that were unlike each of its hubs.
    cols = ["c1", "n", "at", "root"]
    met = side(open_, "x", cols).join(side(open_, "y", cols), "token").filter("x_root <> y_root AND x_c1 < y_c1").filter(fits("x", "y", p, q))
    return reduce(DataFrame.unionAll, found, met.select(F.col("x_c1").alias("a"), F.col("y_c1").alias("b"))).distinct()


def _around_hubs(entries: DataFrame, sets: DataFrame, p: int, q: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every node (token, c1, n, at, root) against one hub of its bucket: (pairs linked with a hub, other pairs that can be linked, entries unlike their hub).

    A node x differs from its hub h in a set of D shingles.  Two nodes differ in D_x + D_y - 2 * common of them, so with
    e = (p + q) * D - (q - p) * n they are linked if and only if 2 * (p + q) * common >= e_x + e_y: a join of the sets of
    differences, again by rarity prefixes and positions.  A node is linked with its hub if e <= (q - p) * n_h, and no e is less than
    -(q - p) * n_h; so two nodes of which the hub links at most one share differences, and of random edits none.

    Only nodes at least half like the hub look for partners here; by the triangle inequality those are not much less like it.
    The others come back for the next hub.
    """
    c, k = q - p, p + q
    company = entries.groupBy("c1").agg(F.count("*").alias("company"))
    hubs = entries.join(company, "c1").groupBy("token").agg(F.max(F.struct("company", "c1"))["c1"].alias("hub"))
    around = saved(entries.join(hubs, "token").filter("c1 <> hub"), "near-around")
    own, hub = sets.select("c1", "s"), sets.select(F.col("c1").alias("hub"), F.col("s").alias("h"))
    both = around.select("hub", "c1", "root").distinct().join(own, "c1").join(hub, "hub")
    differ = both.select("hub", "c1", "root", F.size("s").alias("n"), F.size("h").alias("nh"), F.concat(F.array_except("s", "h"), F.array_except("h", "s")).alias("diff"))
    differ = differ.withColumn("d", F.size("diff")).withColumn("e", F.expr(f"{k} * d - {c} * n"))
    differ = differ.withColumns({"linked": F.expr(f"e <= {c} * nh"), "near": F.expr("3 * d <= n + nh")})
    # Partners of a node half like the hub are at least (p / q - 1 / 2) like it.
    differ = saved(differ.withColumn("partner", F.expr(f"d * {2 * p + q} <= {max(3 * q - 2 * p, 0)} * (n + nh)") if 2 * p > q else F.lit(True)), "near-differ")

    each = differ.filter("partner").select("hub", "c1", F.explode("diff").alias("token"))
    counts = each.groupBy("hub", "token").agg(F.count("*").alias("df"))
    order = each.join(counts, ["hub", "token"]).groupBy("hub", "c1").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("order"))
    met = differ.filter("partner").drop("diff").join(order, ["hub", "c1"])
    least = f"greatest(1, (e - {c} * nh + {2 * k - 1}) div {2 * k})"
    among = f"(e + {c} * nh + 1 + {2 * k - 1}) div {2 * k}"
    met = met.withColumns({"long": F.expr(f"d + 1 - CASE WHEN linked THEN {among} ELSE {least} END"), "short": F.expr(f"d + 1 - {among}")})
    front = met.filter("long > 0").selectExpr("*", "posexplode(slice(order, 1, long)) AS (i, t)").filter("t.df > 1")
    front = front.select("hub", "t.token", "c1", "root", "d", "e", "linked", "near", (F.col("i") + 1).alias("at"), F.expr("linked OR i < short").alias("short"))
    front = saved(front, "near-front")
    cols = [x for x in front.columns if x not in ("hub", "token")]
    x, y = (front.select(F.struct("hub", "token").alias("key"), *[F.col(v).alias(f"{name}_{v}") for v in cols]) for name in "xy")
    most = 1 + F.least(F.col("x_d") - F.col("x_at"), F.col("y_d") - F.col("y_at"))
    ask = "x_c1 < y_c1 AND x_root <> y_root AND (x_near OR y_near) AND NOT (x_linked AND y_linked) AND (x_linked OR y_linked OR x_short AND y_short)"
    pairs = x.join(y, "key").filter(ask).filter(most * (2 * k) >= F.col("x_e") + F.col("y_e"))
    linked = differ.filter("linked").select(F.least("hub", "c1").alias("a"), F.greatest("hub", "c1").alias("b"))
    far = around.join(differ.filter("NOT near").select("hub", "c1"), ["hub", "c1"]).select("token", "c1", "n", "at", "root")
    return linked, saved(pairs.select(F.col("x_c1").alias("a"), F.col("y_c1").alias("b")).distinct(), "near-maybe"), saved(far, "near-far")


def _rooted(docs: DataFrame, similarity: float, id_col: str, text: str) -> DataFrame:
    """doc_id, h (hash of the text), root (number of the class), class_id of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col(text).alias("text")).withColumn("h", F.xxhash64("text"))
    signed = saved(_signed(rows.select("doc_id", "text", "h", F.md5("text").alias("copy"))), "near-signed")
    nodes = signed.groupBy("copy").agg(F.min("doc_id").alias("rep"), F.first("h").alias("h"), F.first("bands").alias("bands"))
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    buckets = nodes.select("node", F.posexplode("bands").alias("band", "hash")).select(F.xxhash64("band", "hash").alias("key"), "node")
    shared = buckets.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    # Buckets with one node, most of all, are gone from here on.
    buckets = saved(buckets.join(shared, "key"), "near-buckets")
    # The hub is the node with the most company in all its buckets: of a family of copies, one with few edits.
    company = buckets.groupBy("node").agg(F.sum("size").alias("company"))
    met = buckets.join(company.withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node")).select("key", "node", "company")
    hubs = met.groupBy("key").agg(F.max(F.struct("company", "node")).alias("hub")).select(F.col("key").alias("h_key"), F.col("hub.node").alias("hub"))
    pairs = buckets.join(hubs, F.col("key") == F.col("h_key")).filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    pairs = saved(pairs.distinct(), "near-pairs")
    links = saved(_verified(rows, nodes, pairs, similarity), "near-links")
    root = saved(components(links), "near-roots").withColumnRenamed("node", "r_node")
    held = saved(buckets.join(root, F.col("node") == F.col("r_node"), "left").select("key", "node", F.coalesce("root", "node").alias("root")), "near-held")
    open_ = held.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    held = saved(held.join(open_, "key", "left_semi").select("node", "root").distinct(), "near-open")
    if not held.isEmpty():
        pairs = saved(_prefix_pairs(rows, nodes, held, similarity), "near-pairs")
        links = saved(_verified(rows, nodes, pairs, similarity).unionAll(links), "near-links")
        root = saved(components(links), "near-roots").withColumnRenamed("node", "r_node")
    of = nodes.join(root, F.col("node") == F.col("r_node"), "left").select("copy", "rep", F.coalesce("root", "node").alias("root"))
    least = of.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = of.join(least, "root").select(F.col("copy").alias("n_copy"), "root", "class_id")
    return signed.join(named, F.col("copy") == F.col("n_copy")).select("doc_id", "h", "root", "class_id")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id, kept: one row for each row of ``docs``.

    class_id is the least doc_id of the row's class: rows joined by a chain of
    links of at least ``similarity``.  kept holds for rows whose id it is (for all
    rows of a class without any id).  Texts that are equal are one class, null
    ones count as empty; texts without words are like equal ones only.  Repeated rows
    are all returned.  Only the two columns are read.  An empty table gives an empty result.
    """
    got = _rooted(docs, similarity, id_col, text)
    return got.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_first(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each class, with all its columns: the one of least doc_id (null last), then of least text hash.

    Of rows equal in both the one of least hash over all columns stays.
    """
    k_id, k_h = unused(docs, "k_id", "k_h")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    best = _rooted(docs, similarity, id_col, text).groupBy("root", "doc_id", "h").agg(F.count("*").alias("rows")).groupBy("root").agg(F.min(F.struct(place.alias("place"), "rows")).alias("best"))
    best = saved(best.select(F.col("best.place.doc_id").alias(k_id), F.col("best.place.h").alias(k_h), F.col("best.rows").alias("rows")), "near-best")
    on = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(k_id)) & (F.xxhash64(text_col(text)) == F.col(k_h))

    def rows(keys: DataFrame) -> DataFrame:
        keys = keys.select(k_id, k_h)
        return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on)

    mine = [F.col(f"`{c}`") for c in docs.columns]
    once, often = best.filter("rows = 1"), best.filter("rows > 1")
    kept = rows(once).select(*mine)
    if often.isEmpty():
        return kept
    # Only repeated rows are ranked; all but the first of each go before the exchange.
    (nth,) = unused(docs, "nth")
    rank = F.row_number().over(Window.partitionBy(k_id, k_h).orderBy(F.xxhash64(*mine)))
    return kept.unionAll(rows(often).withColumn(nth, rank).filter(F.col(nth) == 1).select(*mine))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
