"""Mixing sources to target weights by hierarchical budgeting.

Documents hang under a tree of levels (domain, language, source).  The token
budget goes down the tree: a node's budget is shared among its children by
weight, no child gets more than its subtree can give (its tokens times
``max_epochs``), and what a short child leaves goes to its siblings by weight.
Only when all siblings are full does the shortage pass to the parent's own
siblings, since the parent's budget was limited by the same capacity.  With
children sorted by capacity/weight the full ones are a prefix, found with
running sums, so one level is one window over the nodes.  All sums are integers.

A leaf with budget A over T tokens gives A div T whole epochs and of the next
one the prefix of A mod T tokens in that epoch's seeded order (md5 of seed,
epoch, doc_id and text).  The prefix is found without sorting a leaf: tokens are
summed by the first digits of the key (at most 16^DIGITS rows for each leaf),
the bucket in which the budget ends is known from these, and only its documents are
ranked.  What is left of a leaf is one row (epochs, last key), so
documents are chosen in a map-side join with the table of leaves and their text is never shuffled.
The tables that are shuffled have the narrow keys only, summed before the exchange.

Rows equal in doc_id and text share one place in the order and are chosen alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triage_spark.llm.common import saved, text_col

#: Hex digits of the order key that make a bucket.
DIGITS = 4
#: Leaves up to which their table is broadcast (about 200 bytes a row).
BROADCAST_LEAVES = 20_000
#: Columns that ``mix`` adds.
ADDED = ("m_levels", "m_epoch", "m_tokens", "m_take")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \n\t\r]+")).cast("long")


def share_out(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``alloc`` to nodes (cap, weight, budget of the parent, name): the parent's budget by weight, capped, leftovers to siblings."""
    order = Window.partitionBy(*parent).orderBy((F.col("cap") / F.col("weight")).asc_nulls_last(), "name")
    all_of = Window.partitionBy(*parent)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    open_ = nodes.filter("weight > 0 AND cap > 0")
    full = open_.withColumn("full", (F.col("budget") - before) * F.col("weight") >= F.col("cap") * weight_left)
    rest = full.withColumn("left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(all_of), F.lit(0)))
    rest = rest.withColumn("shares", F.sum(F.when(~F.col("full"), F.col("weight"))).over(all_of))
    return rest.withColumn("alloc", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("left * weight div shares"))).drop("full", "left", "shares")


def budgets(leaves: DataFrame, levels: list[str], weights: DataFrame, budget: int) -> DataFrame:
    """leaves (levels..., cap) with ``alloc``; leaves that get nothing are left out.

    weights: path (level values from the top, joined by '/'), weight (whole
    number of 0 or more; a path without a row has 1, of repeated paths the largest counts).
    """
    known = weights.filter("path IS NOT NULL AND weight IS NOT NULL").groupBy("path").agg(F.max("weight").cast("long").alias("weight"))
    # A subtree under a weight of 0 can give nothing.
    for k in range(1, len(levels) + 1):
        path = F.concat_ws("/", *levels[:k])
        leaves = leaves.join(known.select(F.col("path").alias("w_path"), F.col("weight").alias(f"w{k}")), path == F.col("w_path"), "left").drop("w_path").withColumn(f"w{k}", F.coalesce(f"w{k}", F.lit(1)))
    leaves = leaves.filter(" AND ".join(f"w{k} > 0" for k in range(1, len(levels) + 1)) + " AND cap > 0")
    given = None
    for k in range(1, len(levels) + 1):
        up, here = levels[: k - 1], levels[:k]
        nodes = leaves.groupBy(*here).agg(F.sum("cap").alias("cap"), F.first(f"w{k}").alias("weight")).withColumn("name", F.col(here[-1]))
        if given is None:
            nodes = nodes.withColumn("budget", F.least(F.lit(budget).cast("long"), F.sum("cap").over(Window.partitionBy())))
        else:
            nodes = nodes.join(given.select(*up, F.col("alloc").alias("budget")), up)
        given = share_out(nodes, up)
    return given.select(*levels, "alloc")


def order_key(seed: int, epoch: Column) -> Column:
    """The place of a document in an epoch; needs the columns doc_id and digest."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("m_doc").cast("string"), F.lit("")), F.col("m_digest")))


def mix(
    docs: DataFrame, levels: list[Column], weights: DataFrame, budget_percent: int = 100, max_epochs: int = 2, seed: int = 42,
    id_col: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The chosen rows: all columns of ``docs`` and m_levels, m_epoch, m_tokens, m_take.

    A row comes once for each epoch it is chosen in; m_take is m_tokens, but for the last
    document of a leaf, of which the prefix of m_take words fits.  budget: ``budget_percent`` of all words.
    Null level values are the group '', null ids are allowed, null and empty
    texts have no words: they come with whole epochs of their leaf, or
    in a prefix if their place is before its end.  Columns of ``docs`` with the name of one of
    the four new ones are left out.  An empty table gives an empty result.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    names = [f"m_l{i}" for i in range(len(levels))]
    marks = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in zip(levels, names)]
    body = text_col(text)
    own = [F.col(id_col).cast("long").alias("m_doc"), F.md5(body).alias("m_digest"), word_count(body).alias("m_tokens")]
    narrow = saved(docs.select(*marks, *own), "mix-tokens")
    leaf = narrow.groupBy(*names).agg(F.sum("m_tokens").alias("total")).filter("total > 0")
    total = leaf.agg(F.sum("total")).first()[0] or 0
    given = budgets(leaf.withColumn("cap", F.col("total") * max_epochs), names, weights, total * budget_percent // 100)
    leaf = leaf.join(given, names).select(*names, "total", F.expr("alloc div total").alias("m_full"), F.expr("alloc % total").alias("m_rest"))
    leaf = saved(leaf, "mix-leaves")
    small = leaf.count() <= BROADCAST_LEAVES
    near = (lambda d: F.broadcast(d)) if small else (lambda d: d)

    placed = narrow.join(near(leaf.filter("m_rest > 0")), names).withColumn("m_key", order_key(seed, F.col("m_full")))
    placed = placed.withColumn("m_bucket", F.substring("m_key", 1, DIGITS))
    buckets = placed.groupBy(*names, "m_rest", "m_bucket").agg(F.sum("m_tokens").alias("n"))
    end = F.sum("n").over(Window.partitionBy(*names).orderBy("m_bucket"))
    border = buckets.withColumn("stop", end).filter("stop >= m_rest AND stop - n < m_rest")
    border = border.select(*names, "m_bucket", (F.col("m_rest") - F.col("stop") + F.col("n")).alias("more"))
    inside = placed.join(near(border), [*names, "m_bucket"]).groupBy(*names, "more", "m_key").agg(F.sum("m_tokens").alias("n"))
    done = F.sum("n").over(Window.partitionBy(*names).orderBy("m_key")) - F.col("n")
    last = inside.withColumn("start", done).filter("start < more")
    last = last.groupBy(*names).agg(F.max("m_key").alias("m_last"), F.max_by(F.col("more") - F.col("start"), "m_key").alias("m_most"))
    leaf = saved(leaf.join(last, names, "left"), "mix-ends")

    # Own columns under numbers, so that no name of theirs is met here.
    kept = [F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(docs.columns)]
    full = docs.select(*kept, *marks, *own).join(near(leaf.drop("total")), names)
    key = order_key(seed, F.col("m_full"))
    epochs = F.when(F.coalesce(key <= F.col("m_last"), F.lit(False)), F.col("m_full") + 1).otherwise(F.col("m_full"))
    rows = full.withColumn("m_key", key).withColumn("m_epochs", epochs).filter("m_epochs > 0")
    rows = rows.withColumn("m_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m_epochs") - 1)))
    cut = (F.col("m_epoch") == F.col("m_full")) & (F.col("m_key") == F.col("m_last"))
    take = F.when(cut, F.least("m_tokens", "m_most")).otherwise(F.col("m_tokens"))
    mine = [F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)]
    return rows.select(*mine, *[c.alias(n) for c, n in zip((F.array(*names), F.col("m_epoch"), F.col("m_tokens"), take), ADDED)])


# The query's tree and weights.  The documents name no domain, so one is given by the number in ``source``.
DOMAINS = ("web", "books", "forum", "code")
WEIGHTS = {"web": 3, "books": 4, "forum": 2, "code": 1, "web/en": 3, "web/de": 2, "books/en": 2, "books/fr": 3, "forum/es": 4, "web/en/src0": 2, "books/en/src1": 5, "code/de": 0}
SEED, BUDGET_PERCENT, MAX_EPOCHS = 42, 120, 2


def domain_of(source: Column) -> Column:
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]+)$", 1)
    return F.when(number == "", "none").otherwise(F.element_at(F.array(*map(F.lit, DOMAINS)), (F.substring(number, -6, 6).cast("int") % len(DOMAINS) + 1).cast("int")))


def tree() -> list[Column]:
    return [domain_of(F.col("source")), F.col("lang"), F.col("source")]


def weight_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{p}', {w}L)" for p, w in WEIGHTS.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(path, weight)")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    chosen = mix(docs, tree(), weight_table(spark), BUDGET_PERCENT, MAX_EPOCHS, SEED)
    return chosen.select("doc_id", F.col("m_levels")[0].alias("domain"), "lang", "source", F.col("m_epoch").alias("epoch"), F.col("m_tokens").alias("n_tokens"), F.col("m_take").alias("n_take"))


def _level(k: int) -> str:
    """SQL of one level: nodes with their share of the parent's budget."""
    cols = [f"l{i}" for i in range(k)]
    up = ", ".join(cols[:-1]) or "1"
    budget = f"JOIN g{k - 1} u USING ({', '.join(cols[:-1])})" if k > 1 else f", (SELECT least(sum(total) * {BUDGET_PERCENT} // 100, (SELECT sum(cap) FROM c)) AS alloc FROM t) u"
    return f"""
n{k} AS (SELECT {', '.join('n.' + c for c in cols)}, n.cap, n.weight, u.alloc AS budget FROM (SELECT {', '.join(cols)}, sum(cap) AS cap, min(w{k}) AS weight FROM c GROUP BY ALL) n {budget}),
f{k} AS (SELECT *, (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight >= cap * sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS is_full
  FROM n{k} WINDOW o AS (PARTITION BY {up} ORDER BY cap / weight, l{k - 1})),
g{k} AS (SELECT {', '.join(cols)}, CASE WHEN is_full THEN cap ELSE (budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER p, 0)) * weight // sum(CASE WHEN NOT is_full THEN weight END) OVER p END AS alloc
  FROM f{k} WINDOW p AS (PARTITION BY {up}))"""


#: Plain DuckDB: the same shares, and a running sum over each leaf for the prefix.
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS body, regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS num FROM documents),
t AS (
  SELECT doc_id, lang, source, CASE WHEN num = '' THEN 'none' ELSE list_extract([{', '.join(f"'{x}'" for x in DOMAINS)}], CAST(CAST(right(num, 6) AS INTEGER) % {len(DOMAINS)} + 1 AS INTEGER)) END AS l0,
         coalesce(lang, '') AS l1, coalesce(source, '') AS l2, md5(body) AS digest, CAST(len(regexp_extract_all(body, '[^ \\n\\t\\r]+')) AS BIGINT) AS total FROM d),
w(path, weight) AS (VALUES {', '.join(f"('{p}', {w})" for p, w in WEIGHTS.items())}),
c AS (
  SELECT x.*, coalesce(a.weight, 1) AS w1, coalesce(b.weight, 1) AS w2, coalesce(e.weight, 1) AS w3
  FROM (SELECT l0, l1, l2, sum(total) AS total, sum(total) * {MAX_EPOCHS} AS cap FROM t GROUP BY ALL) x
  LEFT JOIN w a ON a.path = l0 LEFT JOIN w b ON b.path = l0 || '/' || l1 LEFT JOIN w e ON e.path = l0 || '/' || l1 || '/' || l2
  WHERE cap > 0 AND coalesce(a.weight, 1) > 0 AND coalesce(b.weight, 1) > 0 AND coalesce(e.weight, 1) > 0),{_level(1)},{_level(2)},{_level(3)},
leaf AS (SELECT l0, l1, l2, alloc // c.total AS whole, alloc % c.total AS rest FROM g3 JOIN c USING (l0, l1, l2)),
k AS (SELECT t.*, whole, rest, md5('{SEED}|' || CAST(CAST(whole AS BIGINT) AS VARCHAR) || '|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || digest) AS key FROM t JOIN leaf USING (l0, l1, l2)),
s AS (SELECT *, sum(total) OVER (PARTITION BY l0, l1, l2 ORDER BY key ROWS UNBOUNDED PRECEDING) - total AS start FROM k)
SELECT doc_id, l0 AS domain, lang, source, CAST(epoch AS BIGINT) AS epoch, total AS n_tokens, CAST(total AS BIGINT) AS n_take FROM k, range(0, {MAX_EPOCHS}) r(epoch) WHERE epoch < whole
UNION ALL
SELECT doc_id, l0, lang, source, CAST(whole AS BIGINT), total, CAST(least(total, rest - start) AS BIGINT) FROM s WHERE start < rest
"""
