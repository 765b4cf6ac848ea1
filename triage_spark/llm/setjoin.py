"""Parts of an exact set-similarity join: rarity prefixes, length and position filters.

Two sets of x and y tokens have a Jaccard likeness of p/q at least if and only if
(p + q) * common >= p * (x + y).  Under any one order of all tokens such sets share
a token among their first n - ceil(n * p / q) + 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage_spark.llm.common import saved


def prefix_size(n: str, p: int, q: int) -> str:
    """SQL of the length of a prefix of ``n`` tokens in order."""
    return f"greatest(0, {n} - ({p} * {n} + {q - 1}) div {q} + 1)"


def fits(a: str, b: str, p: int, q: int) -> Column:
    """Length and position filter of two prefix entries (columns x_n, x_at from 1): can enough tokens be common?"""
    na, nb, ia, ib = (F.col(f"{x}_{c}") for c in ("n", "at") for x in (a, b))
    most = 1 + F.least(na - ia, nb - ib)
    return (F.least(na, nb) * q >= F.greatest(na, nb) * p) & (most * (p + q) >= (na + nb) * p)


def lengths_fit(a: str, b: str, p: int, q: int) -> Column:
    """Length filter of two sets with so many tokens."""
    return F.least(a, b) * q >= F.greatest(a, b) * p


def least_common(x: Column, y: Column, p: int, q: int) -> Column:
    """How many tokens sets of x and y tokens must have in common."""
    return F.ceil((x + y) * p / F.lit(p + q)).cast("int")


def required(x: Column, y: Column, p: int, q: int) -> Column:
    """How many tokens the prefixes of matching sets of x and y <= x tokens must share.

    The set whose prefix ends first in the order has all but n - common of that prefix's tokens in the other
    one's, too: prefix_size(n) - (n - common), which is least for the larger set.
    """
    return least_common(x, y, p, q) + 1 - F.ceil(x * p / F.lit(q)).cast("int")


def side(df: DataFrame, name: str, cols: list[str]) -> DataFrame:
    """``token`` and the columns, these with ``name`` in front, as one side of a join on token."""
    return df.select("token", *[F.col(c).alias(f"{name}_{c}") for c in cols])


def small(df: DataFrame, limit: int) -> DataFrame:
    """The saved table ``df``, with a broadcast hint if it has few rows."""
    return F.broadcast(df) if df.count() <= limit else df


def rare_prefixes(sets: DataFrame, p: int, q: int, limit: int) -> DataFrame:
    """token, c1, n, at: the prefix of each set (c1, s: distinct tokens) by rising number of sets that have a token, without tokens of one set only.

    The counts cover all the sets; up to ``limit`` counted tokens are broadcast.
    """
    every = sets.select("c1", F.explode("s").alias("token"))
    counts = saved(every.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1").withColumnRenamed("token", "d_token"), "token-counts")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "token"))).alias("order")
    ranked = every.join(small(counts, limit), F.col("token") == F.col("d_token"), "left").groupBy("c1").agg(order)
    front = ranked.selectExpr("c1", "size(order) AS n", f"posexplode(slice(order, 1, {prefix_size('size(order)', p, q)})) AS (i, e)")
    return front.filter("e.df > 1").select("e.token", "c1", "n", (F.col("i") + 1).alias("at"))
