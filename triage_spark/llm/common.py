"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triage_spark.session import scratch_path

#: Characters that one numpy step works on at a time inside a task (bounds its memory).
STEP_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder (with the writer's ``options``) and read it back: cuts the lineage and outlives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_hashes(df: DataFrame, name: str) -> DataFrame:
    """``saved`` for a table of mostly hashes: as they hardly repeat, no dictionary is tried."""
    return saved(df, name, **{"parquet.enable.dictionary": "false"})


def text_col(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


#: Ranges that rows are cut into at most, whatever their number; larger inputs get larger ranges.
MOST_RANGES = 10_000
LOWEST = -(1 << 63)


def _passed(bounds: list[int], key: Column, strict: bool) -> Column:
    """How many of the ascending bounds lie below ``key`` (or at it, unless ``strict``); two short scans instead of a long one."""
    longs = lambda v: F.array(*map(F.lit, v)).cast("array<bigint>")
    below = lambda a: F.size(F.filter(a, (lambda c: c < key) if strict else (lambda c: c <= key)))
    if len(bounds) <= 64:
        return below(longs(bounds))
    step = int(len(bounds) ** 0.5)
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    full = below(longs([g[-1] for g in groups]))
    inside = below(F.get(F.array(*map(longs, groups)), full))
    return full * step + F.coalesce(inside, F.lit(0)) if len(bounds) % step == 0 else F.least(full * step + F.coalesce(inside, F.lit(0)), F.lit(len(bounds)))


def in_ranges(rows: DataFrame, chars: int) -> tuple[DataFrame, int]:
    """``rows`` (doc_id, text) with k (doc_id, null lowest), h (hash of the text), share (h as a part of one) and part, and the number of parts.

    Parts are ranges of (k, share, h) that ascend with part, cut at quantiles of the whole doc_id
    column, one for each ``chars`` characters of text.  Rows with one id at several cuts spread
    over the parts that meet there by their hash, so no part depends on one id.
    """
    rows = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(LOWEST)).alias("k"), F.xxhash64("text").alias("h"))
    total = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    parts = min(MOST_RANGES, total // chars + 1)
    bounds = rows.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else []
    bounds = [int(b) for b in bounds or []]
    share = F.shiftrightunsigned("h", 32).cast("double") / F.lit(float(1 << 32))
    placed = rows.withColumns({"share": share, "low": _passed(bounds, F.col("k"), True), "high": _passed(bounds, F.col("k"), False)})
    part = F.col("low") + F.floor(F.col("share") * (F.col("high") - F.col("low") + 1))
    return placed.withColumn("part", part.cast("int")).drop("low", "high"), parts


def in_order(rows: DataFrame, order: list[str], place: str) -> DataFrame:
    """``rows`` in one global order of the columns (nulls first), dealt over the tasks by ranges, with ``place``, a number that rises with it.

    The row numbers break ties, so that many equal rows spread over tasks.  Ids of tasks are in the places, so write the result before two uses.
    """
    (tie,) = unused(rows, "tie")
    cols = [F.col(f"`{c}`") for c in order]
    spread = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*cols, tie).sortWithinPartitions(*cols, tie)
    return spread.drop(tie).withColumn(place, F.monotonically_increasing_id())


def with_rank(rows: DataFrame, keys: list[str], place: str, rank: str) -> DataFrame:
    """Stored rows of ``in_order`` with their rank from 0 among the rows of the same keys, by which they were ordered first; keys are not null.

    A key's rows lie side by side in each task's range, so one aggregate over (key, range) gives what is to be added
    to their places; a key of very many rows meets its sums range by range.
    """
    part, low, count, move = unused(rows, "part", "low", "count", "move")
    kept = [F.col(f"`{c}`") for c in rows.columns]
    rows = rows.withColumn(part, F.shiftright(place, 33))
    spans = rows.groupBy(*keys, part).agg(F.min(place).alias(low), F.count("*").alias(count))
    before = F.sum(count).over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    moves = spans.select(*keys, part, (F.coalesce(before, F.lit(0)) - F.col(low)).alias(move))
    return rows.join(moves, [*keys, part]).select(*kept, (F.col(place) + F.col(move)).alias(rank))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as make it new to ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def text_steps(batches: Iterator[pa.RecordBatch], text_name: str, max_chars: int = STEP_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``max_chars`` bytes of text each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text_name))
        sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(sizes):
            if i > start and size + n > max_chars:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)


#: DuckDB: a table ``crc`` whose one row holds the 256 numbers (t) that a CRC-32 looks up.
CRC_SQL = (
    "crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v"
    " FROM range(256) r(i)))"
)


def crc32_sql(text: str) -> str:
    """DuckDB: the unsigned CRC-32 of a text in UTF-8, beside the table ``crc``."""
    octets = f"[CAST('0x' || h AS BIGINT) FOR h IN regexp_extract_all(hex(encode({text})), '..')]"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda v, b: xor(v >> 8, t[(xor(v, b) & 255) + 1])))"
