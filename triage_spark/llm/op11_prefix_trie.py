"""Prefix trie of rebuilt conversations by whole-sequence collapse.

Conversation c is rebuilt from the first h turns of conversation c - c % 100 and its own turns from place h
on, h = crc32(decimal c) % 6.  A node of depth d is a distinct sequence of d turns (role, text).

1. Turns get their rank by one global order of (conv_id, turn, role, text), cut into ranges: a conversation of very
   many turns spreads over ranges.  From there on a turn is two 64-bit hashes and its code points.
2. A sequence's key is its length and the XOR of the hashes of (place, turn) over its turns, two of 64 bits.  XOR
   adds up over any parts, so whole sequences and prefixes need no chain: rebuilt conversations are cut
   into chunks of ``CHUNK`` places, each with the XOR of the chunks before it.
3. Collapse: conversations with one key are one weighted sequence, with its least conv_id, its
   weight and its end list (chunks of ids, hashed in order as a stream).  Only one of them goes on.
4. Leaves are the sequences that are no proper prefix: an anti-join of their keys against the keys of all prefixes that go on.
5. Prefix rows (sequence, depth) carry weights into one aggregate for each node.  Of a node's subtree,
   sum of n_convs * chars = sum over its sequences of weight * (chars from this depth on), and the sum of chars over distinct nodes
   counts each node with the sequence of its least conv_id, which owns all nodes from some depth on along its path: so both are sums over prefix rows.

A first turn or a conversation that a third of all share is a group of aggregates that combine before the shuffle.

Defined results: rows with null conv_id belong to no conversation and are left out; null role or text
is empty; null turns come first, rows of one turn are ordered by role, then text; repeated rows are turns of their own; % keeps
the sign of conv_id.  An empty table gives no nodes, not even the root.  Only the four columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triage_spark.llm.common import CRC_SQL, crc32_sql, in_order, saved, table, with_rank

#: Conversations whose first has its opening turns in all of them, and the number of choices for how many.
FAMILY, MOST_SHARED = 100, 6
#: Places of a rebuilt conversation that one window looks at.
CHUNK = 4096
#: Bits of conv_id within one piece of an end list.
PIECE_BITS = 12
KEY = ["depth", "k1", "k2"]


def ranked_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, r (rank from 0), t1, t2 (hashes of role and text), n (code points of the text)."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *texts).filter("conv_id IS NOT NULL")
    ordered = in_order(turns, ["conv_id", "turn", "role", "text"], "place")
    short = ordered.select("conv_id", "place", F.xxhash64("role", "text").alias("t1"), F.xxhash64("text", F.lit(1), "role").alias("t2"), F.length("text").cast("long").alias("n"))
    return with_rank(saved(short, "trie-turns"), ["conv_id"], "place", "r").drop("place")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, x1, x2, n) of all rebuilt turns, x: hashes of turn and place; and all conv_ids, of conversations without turns too."""
    turns = saved(turns.withColumn("chunk", F.floor(F.col("r") / CHUNK)), "trie-ranked")
    sizes = saved(turns.groupBy("conv_id", "chunk").agg(F.count("*").alias("rows")), "trie-sizes")
    convs = sizes.groupBy("conv_id").agg(F.sum("rows").alias("rows"))
    convs = convs.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    bases = convs.filter(f"conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("base"), F.col("rows").alias("base_rows"))
    convs = saved(convs.join(bases, "base", "left").withColumn("shared", F.least("h", F.coalesce("base_rows", F.lit(0)))).drop("base_rows"), "trie-convs")
    # By (conversation, chunk), so that a long conversation is not one group of the join.
    moves = sizes.select("conv_id", "chunk").join(convs.select("conv_id", "h", "shared"), "conv_id")
    own = turns.join(moves, ["conv_id", "chunk"]).filter("r >= h").selectExpr("conv_id", "r - h + shared AS pos", "t1", "t2", "n")
    heads = turns.filter(f"conv_id % {FAMILY} = 0 AND r < {MOST_SHARED}").selectExpr("conv_id AS base", "r", "t1", "t2", "n")
    opening = heads.join(convs, "base").filter("r < shared").selectExpr("conv_id", "r AS pos", "t1", "t2", "n")
    rows = own.unionByName(opening).selectExpr("conv_id", "pos", "xxhash64(pos, t1, t2) AS x1", "xxhash64(t2, pos, t1, 1) AS x2", "n")
    return saved(rows.withColumn("chunk", F.floor(F.col("pos") / CHUNK)), "trie-rebuilt"), convs.select("conv_id")


def collapse(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keys of each conversation; weighted sequences: key, s (least conv_id), w, chars; chunks of each conversation with what lies before them)."""
    chunks = rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("rows"), F.expr("bit_xor(x1)").alias("x1"), F.expr("bit_xor(x2)").alias("x2"), F.sum("n").alias("n"))
    chunks = saved(chunks, "trie-chunks")
    whole = chunks.groupBy("conv_id").agg(F.sum("rows").alias("depth"), F.expr("bit_xor(x1)").alias("k1"), F.expr("bit_xor(x2)").alias("k2"), F.sum("n").alias("chars"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in (*KEY, "chars")]
    members = saved(convs.join(whole, "conv_id", "left").select("conv_id", *zero), "trie-members")
    sequences = saved(members.groupBy(*KEY).agg(F.min("conv_id").alias("s"), F.count("*").alias("w"), F.max("chars").alias("chars")), "trie-sequences")
    return members, sequences, chunks


def _xor_before(c: str, window) -> Column:
    return F.coalesce(F.expr(f"bit_xor({c})").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def prefixes(rows: DataFrame, sequences: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row for each turn of each distinct sequence: s, key, parent's key (p1, p2), n, before (code points of the turns before it), w, chars."""
    by = Window.partitionBy("conv_id").orderBy("chunk")
    carry = [_xor_before("x1", by).alias("c1"), _xor_before("x2", by).alias("c2"), F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("c_n")]
    of = sequences.select(F.col("s").alias("conv_id"), "w", "chars")
    kept = chunks.join(of, "conv_id").select("conv_id", "chunk", "w", "chars", *carry)
    inside = Window.partitionBy("conv_id", "chunk").orderBy("pos")
    met = rows.join(kept, ["conv_id", "chunk"]).withColumns(
        {"p1": F.col("c1").bitwiseXOR(_xor_before("x1", inside)), "p2": F.col("c2").bitwiseXOR(_xor_before("x2", inside)), "before": F.col("c_n") + F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")}
    )
    return met.selectExpr("conv_id AS s", "pos + 1 AS depth", "p1 ^ x1 AS k1", "p2 ^ x2 AS k2", "p1", "p2", "n", "before", "w", "chars")


def leaves(paths: DataFrame, sequences: DataFrame) -> DataFrame:
    """s of the sequences that no other one begins with."""
    inner = paths.selectExpr("depth - 1 AS depth", "p1 AS k1", "p2 AS k2").distinct()
    return sequences.join(inner, KEY, "left_anti").select("s")


def end_hashes(members: DataFrame) -> DataFrame:
    """key, ends_sha256: of the comma-joined ascending conv_ids of each sequence; pieces of ids side by side, read in order as a stream."""
    piece = F.shiftright("conv_id", PIECE_BITS).alias("piece")
    pieces = members.groupBy(*KEY, piece).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            out = []
            for key, ids in zip(zip(*[batch.column(i).to_pylist() for i in range(3)]), batch.column(4).to_pylist()):
                if key == last:
                    digest.update(b"," + ids.encode())
                else:
                    out.append((last, digest))
                    last, digest = key, hashlib.sha256(ids.encode())
            yield _hashes(out)
        yield _hashes([(last, digest)])

    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def _hashes(done: list) -> pa.RecordBatch:
    done = [(*key, digest.hexdigest()) for key, digest in done if key is not None]
    columns = [list(c) for c in zip(*done)] or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()])], [*KEY, "ends_sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    rows, convs = rebuilt(ranked_turns(conversations))
    members, sequences, chunks = collapse(rows, convs)
    paths = saved(prefixes(rows, sequences, chunks), "trie-paths")
    owned = saved(paths.groupBy(*KEY).agg(F.min("s").alias("conv_id"), F.max("before").alias("before"), F.max("n").alias("n"), F.max("p1").alias("p1"), F.max("p2").alias("p2")), "trie-owned")

    # Of each sequence: whether it is a leaf, and the code points before the nodes that it owns (all of its own, if it owns none).
    first = owned.groupBy(F.col("conv_id").alias("s")).agg(F.min("before").alias("first"))
    flags = sequences.join(leaves(paths, sequences).withColumn("leaf", F.lit(1)), "s", "left").join(first, "s", "left")
    flags = saved(flags.select("s", "w", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("first", "chars").alias("first"), F.floor((F.col("depth") - 1) / CHUNK).alias("last")), "trie-flags")
    spread = flags.select("s", "leaf", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("last", F.lit(0)))).alias("chunk"))
    marked = paths.withColumn("chunk", F.floor((F.col("depth") - 1) / CHUNK)).join(spread, ["s", "chunk"])
    gain = F.sum(F.col("w") * (F.col("chars") - F.col("before"))) - F.sum(F.col("chars") - F.greatest("before", "first"))
    sums = saved(marked.groupBy(*KEY).agg(F.sum("w").alias("n_convs"), F.sum("leaf").alias("n_leaves"), gain.alias("saved_tokens")), "trie-sums")

    # A node that does not begin its owner's part has the same owner's node above it; only the others look theirs up.
    top = owned.groupBy("conv_id").agg(F.min("depth").alias("from"))
    begin = owned.join(top, "conv_id")
    inside = begin.filter("depth > from").select(*KEY, "conv_id", "p1", "p2", F.col("conv_id").alias("parent_conv_id"))
    above = owned.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    looked = begin.filter("depth = from AND depth > 1").select(*KEY, "conv_id", "p1", "p2").join(above, ["depth", "p1", "p2"]).select(*inside.columns)
    root_id = members.agg(F.min("conv_id").alias("parent_conv_id"))
    below_root = begin.filter("depth = from AND depth = 1").select(*KEY, "conv_id", "p1", "p2").join(F.broadcast(root_id)).select(*inside.columns)
    nodes = inside.unionByName(looked).unionByName(below_root)

    children = owned.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.join(F.broadcast(flags.agg(F.sum("leaf").alias("n_leaves"))))
    root = root.join(F.broadcast(sums.filter("depth = 1").agg(F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))))
    zero = [F.lit(0).cast("long").alias(c) for c in KEY]
    root = root.select(*zero, "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_leaves", "saved_tokens")
    every = nodes.join(sums, KEY).select(*root.columns).unionByName(root)
    every = every.join(children, KEY, "left").join(end_hashes(members), KEY, "left")
    none = hashlib.sha256(b"").hexdigest()
    return every.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: Plain DuckDB: every rebuilt conversation as a list, every prefix as a text key.
ORACLE_SQL = f"""
WITH {CRC_SQL},
o AS (SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, ts, CAST({crc32_sql("CAST(c AS VARCHAR)")} % {MOST_SHARED} AS BIGINT) AS h FROM o, crc),
b AS (SELECT h.c, list_concat(coalesce(list_slice(o.ts, 1, h), []), list_slice(h.ts, h + 1, len(h.ts))) AS ts FROM h LEFT JOIN o ON o.c = h.c - h.c % {FAMILY}),
p AS (SELECT c, d, CAST(list_slice(ts, 1, d) AS VARCHAR) AS node, CAST(list_slice(ts, 1, d - 1) AS VARCHAR) AS up, d = len(ts) AS ends, CASE WHEN d > 0 THEN length(ts[d].text) ELSE 0 END AS n FROM b, unnest(range(0, len(ts) + 1)) r(d)),
n AS (SELECT d, node, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends) AS ends FROM p GROUP BY d, node),
k AS (SELECT d - 1 AS d, up AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (d, node)),
q AS (SELECT DISTINCT v.d, v.node, a.d AS below_d, a.node AS below FROM v JOIN p x USING (d, node) JOIN p a ON a.c = x.c AND a.d >= x.d),
t AS (SELECT q.d, q.node, count(*) FILTER (WHERE w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.n) AS saved_tokens FROM q JOIN v w ON w.d = q.below_d AND w.node = q.below GROUP BY ALL)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, t.n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN t USING (d, node) LEFT JOIN v u ON v.d > 0 AND u.d = v.d - 1 AND u.node = v.up
"""
