"""Sharding by a hierarchical weighted hash tree.

Shards stand in racks, racks in regions; a node weighs what its shards weigh.  A document descends
the three levels.  At each node every child draws -ln(u) / weight, where u in (0, 1) is the hash of (doc_id,
name of the child), and the smallest draw wins: a child is taken in proportion to its weight.  A
draw depends on nothing but the child's own name and weight.  So a change of a shard's weight changes
one draw a level, those of its region, its rack and itself: rows between other subtrees never
move, and rows that leave or enter do so through the changed nodes.  A shard that opens a region of its own takes
rows into itself alone.

``topology`` fills racks and regions in the order of the shards, so 40 shards are four full regions
and shard 40 opens the fifth.  The law that holds is `key`: doc_id and the number of shards decide.

The tree is a literal in the plan (one entry a shard); rows are placed without a shuffle, then written in the
order of (shard, doc_id, text hash) by ranges, so no task holds a whole shard and a hot shard is only a longer range.  Slots come from
counts of (shard, range).

Defined results: a null doc_id is a key of its own; null texts have size 16 and the checksum of the
empty text; rows of one doc_id share a shard, in the order of a hash of their text, equal rows in any order.
An empty table gives no rows.  Names of own columns that clash get underscores (see ``unused``).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triage_spark.llm.common import CRC_SQL, crc32_sql, in_order, table, unused, with_rank
from triage_spark.session import scratch_path

SHARDS = 40
SHARDS_A_RACK, RACKS_A_REGION = 5, 2
#: Bytes that a document takes besides its text.
OVERHEAD = 16


class Shard(NamedTuple):
    region: str
    rack: str
    number: int
    weight: float = 1.0


def topology(shards: int, shards_a_rack: int = SHARDS_A_RACK, racks_a_region: int = RACKS_A_REGION) -> list[Shard]:
    """Shards of weight 1 that fill racks, and these regions, in order."""
    return [Shard(f"region{i // (shards_a_rack * racks_a_region)}", f"rack{i // shards_a_rack}", i) for i in range(shards)]


def tree(shards: list[Shard]) -> list[list[list[tuple[str, float, int]]]]:
    """Three levels; each has for each parent its children as (name, weight, place in the next level; for a shard its number).  Children without weight are left out."""
    levels: list[list[list[tuple[str, float, int]]]] = []
    groups = [[s for s in shards if s.weight > 0]]
    if not groups[0] or any(s.weight < 0 for s in shards):
        raise ValueError("a tree needs a positive weight and no negative one")
    for depth in range(1, 4):
        path = lambda s: "/".join(map(str, s[:depth]))  # noqa: B023, E731
        level, following = [], []
        for group in groups:
            names = list(dict.fromkeys(map(path, group)))
            parts = [[s for s in group if path(s) == n] for n in names]
            level.append([(n, sum(s.weight for s in p), p[0].number if depth == 3 else len(following) + i) for i, (n, p) in enumerate(zip(names, parts))])
            following += parts
        levels.append(level)
        groups = following
    return levels


def _draw(key: Column, children: Column) -> Column:
    """The place of the child with the smallest draw."""
    digits = lambda c: F.substring(F.md5(F.concat_ws("/", key, c["name"]).cast("binary")), 1, 13)
    u = lambda c: (F.conv(digits(c), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
    return F.array_min(F.transform(children, lambda c: F.struct((-F.log(u(c)) / c["weight"]).alias("draw"), c["at"].alias("at"))))["at"]


def placed(docs: DataFrame, shards: list[Shard], shard: str, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the number of each row's shard as the column ``shard``; no shuffle."""
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    entry = lambda name, weight, at: F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight"), F.lit(at).alias("at"))
    at: Column = F.lit(0)
    for level in tree(shards):
        # Each level is a column of its own, so that none is computed twice.
        children = F.get(F.array(*[F.array(*[entry(*c) for c in group]) for group in level]), at)
        docs = docs.withColumn(shard, _draw(key, children))
        at = F.col(f"`{shard}`")
    return docs


class ShardFiles(NamedTuple):
    path: str
    rows: DataFrame
    shard: str
    slot: str


def write_shards(docs: DataFrame, path: str, shards: list[Shard], id_col: str = "doc_id", text: str = "text") -> ShardFiles:
    """Write the rows as Parquet under ``path``, a folder for each shard; returns them as read back, with the columns shard and slot."""
    shard, place, slot, h = unused(docs, "shard", "place", "slot", "text_hash")
    rows = placed(docs, shards, shard, id_col).withColumn(h, F.xxhash64(text))
    rows = in_order(rows, [shard, id_col, h], place).drop(h)
    rows.write.partitionBy(shard).parquet(path)
    stored = docs.sparkSession.read.schema(rows.schema).parquet(path)
    return ShardFiles(path, with_rank(stored, [shard], place, slot).drop(place), shard, slot)


def op12_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = placed(table(spark, sf_dir, "documents").select("doc_id", "text"), topology(SHARDS + 1), "grown_shard")
    files = write_shards(docs, scratch_path(spark, "shards"), topology(SHARDS))
    return files.rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col(files.shard).cast("int").alias("shard"),
        F.col(files.slot).cast("long").alias("slot"),
        F.col("grown_shard").cast("int").alias("grown_shard"),
    )


def _nodes_sql(shards: list[Shard]) -> str:
    rows = [f"({depth}, {parent}, '{name}', {weight}, {at})" for depth, level in enumerate(tree(shards)) for parent, group in enumerate(level) for name, weight, at in group]
    return f"(VALUES {', '.join(rows)}) n(depth, parent, name, weight, node)"


def _descent_sql(prefix: str, shards: list[Shard]) -> str:
    """Tables <prefix>1 to <prefix>3 (k: row, node): the node that each row takes at each level."""
    u = "((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || name), 1, 13) AS BIGINT) + 0.5) / 4503599627370496)"
    out = []
    for depth in range(3):
        source = "d" if depth == 0 else f"d JOIN {prefix}{depth} p USING (k)"
        parent = "0" if depth == 0 else "p.node"
        out.append(f"{prefix}{depth + 1} AS (SELECT k, arg_min(n.node, -ln({u}) / weight) AS node FROM {source}, {_nodes_sql(shards)} WHERE n.depth = {depth} AND n.parent = {parent} GROUP BY k)")
    return ",\n".join(out)


ORACLE_SQL = f"""
WITH {CRC_SQL},
d AS (SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id, coalesce(text, '') AS text FROM documents),
{_descent_sql("s", topology(SHARDS))},
{_descent_sql("g", topology(SHARDS + 1))}
SELECT doc_id, CAST(strlen(text) + {OVERHEAD} AS BIGINT) AS size, CAST({crc32_sql("text")} AS BIGINT) AS text_crc32, 'key' AS law, CAST(s3.node AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY s3.node ORDER BY doc_id NULLS FIRST) - 1 AS slot, CAST(g3.node AS INTEGER) AS grown_shard
FROM d JOIN s3 USING (k) JOIN g3 USING (k), crc
"""
