"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct shingles of five words (lower case, split at
spaces and tabs); a line of one to four words has one token, the hash of all its words, so
it matches the lines of the same words.  Only lines without words have none and stay.  Two lines match if the Jaccard likeness of
their tokens is at least 4/5, and a line goes if an earlier line, in the order of
(doc_id, text hash, line number), matches it.  All bounds are whole numbers: with
x + y tokens in all, 9 * common >= 4 * (x + y).

The join, on classes of equal lines (the first line stands for its class):

1. Filter.  Under any one order of the tokens, matching lines share a token among their
   first n - ceil(4n/5) + 1.  Order by hash needs no statistics, so a first pass counts the tokens of this prefix,
   once for each class, and keeps the lines that share one with another line: a small part.
2. Pairs in light buckets (tokens in fewer than ``HEAVY`` prefixes) are tested by length, position and
   the number of prefix tokens that matching lines must share (``required``).
3. Lines in heavy buckets (passages that many lines share, near copies) stay if the bucket has lines of a length
   with which theirs can share as many prefix tokens as both have in common with others.  They are joined again among
   themselves with their tokens ordered by rarity, counted over all their tokens: what many share
   goes last, so only lines that consist of it meet in its bucket.  There lines are compared with the
   bucket's earliest lines first, one hub after the other; a matched line is done,
   and only lines without a match are compared with all earlier ones of their buckets.
4. Pairs are tested by two bitmaps of the parities of their hashed tokens: matching lines differ in
   (x + y) / 9 tokens at most, so in as many bits.  What passes is verified on the whole token sets, of which
   only those in such pairs move.

A match needs one earlier line only, so a group of near copies costs rows in proportion to its
size.  Everything is DataFrame code; counts and prefixes cover all lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triage_spark.llm.common import saved, saved_hashes, text_col, unused
from triage_spark.llm.setjoin import fits, least_common, lengths_fit, prefix_size, rare_prefixes, required, side, small

WORDS = 5
#: The least Jaccard likeness, P / Q.
P, Q = 4, 5
#: Number of prefixes from which a token is heavy.
HEAVY = 32
#: Hubs that are tried before all earlier lines.
HUBS = 1
#: Rows up to which a table of tokens or line keys is broadcast (8 to 60 bytes each).
BROADCAST_ROWS = 1_000_000

#: Shingle hashes of the words ``w`` in a row; of one to four words the hash of all of them, of none null.
SHINGLES = f"CASE WHEN size(w) >= {WORDS} THEN transform(slice(w, 1, size(w) - {WORDS - 1}), (x, i) -> xxhash64(x, {', '.join(f'w[i + {j}]' for j in range(1, WORDS))})) WHEN size(w) > 0 THEN array(xxhash64(w)) END"
#: Each expression is bound once by a lambda, so that nothing is computed twice.
WORDS_OF = "array_remove(split(line, ' '), '')"
SHINGLES_OF = f"inline(transform(array({WORDS_OF}), w -> struct({SHINGLES} AS t)))"
#: The sorted distinct tokens; apart from the lambda, as Spark compiles no code for what is inside one.
TOKENS_OF = "explode(array(sort_array(array_distinct(t)))) AS s"
#: A bitmap of the parities of the tokens ``s`` in 64 buckets, by the given bits of the hash.
PARITY = "aggregate(s, 0L, (a, x) -> a ^ shiftleft(1L, CAST(shiftrightunsigned(x, {}) & 63 AS INT)))"


def lines_of(text: Column) -> Column:
    """The lines of a text, with tabs and carriage returns as spaces."""
    odd = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r"))
    return F.split(F.when(odd, F.translate(text, "\t\r", "  ")).otherwise(text), "\n")


def judged_lines(docs: DataFrame) -> DataFrame:
    """doc_id, dh, no, c1, c2, n, prefix of each line with tokens, and one row with no = -1 and the number of lines as n for each document."""
    # The null line in front stands for the document.
    listed = docs.select("doc_id", F.xxhash64("text").alias("dh"), F.explode(F.array(lines_of(F.col("text")))).alias("ls"))
    numbered = listed.select("doc_id", "dh", F.size("ls").alias("lines"), F.posexplode(F.concat(F.array(F.lit(None).cast("string")), "ls")).alias("place", "raw"))
    numbered = numbered.withColumn("line", F.lower("raw"))
    words = numbered.selectExpr("doc_id", "dh", "place - 1 AS no", "lines", "xxhash64(line) AS c1", "xxhash64(1, line) AS c2", SHINGLES_OF)
    sets = words.filter("no < 0 OR t IS NOT NULL").selectExpr("doc_id", "dh", "no", "lines", "c1", "c2", TOKENS_OF)
    # Tokens are sorted by hash, so the prefix is the front of the list.
    return sets.selectExpr("doc_id", "dh", "no", "c1", "c2", "CASE WHEN no < 0 THEN lines ELSE size(s) END AS n", f"slice(s, 1, {prefix_size('size(s)', P, Q)}) AS prefix")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b: class keys) whose token sets are as like as asked for, with a_first and b_first; first by the bitmaps, then whole."""
    maps = [sets.select(F.col("c1").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "g0", "g1")]) for x in "ab"]
    most = (F.col("a_n") + F.col("b_n")) * (Q - P)
    near = pairs.join(maps[0], "a").join(maps[1], "b")
    for g in ("g0", "g1"):
        near = near.filter(F.bit_count(F.col(f"a_{g}").bitwiseXOR(F.col(f"b_{g}"))) * (P + Q) <= most)
    near = saved(near.select("a", "b"), "line-near")
    few = near.count() <= BROADCAST_ROWS
    met = F.broadcast(near) if few else near
    left, right = (sets.select(F.col("c1").alias(x), F.col("s").alias(f"{x}_s"), F.col("first").alias(f"{x}_first")) for x in "ab")
    # b, the hub of many pairs, meets the pairs first; of the other sets only those in a pair are shuffled.
    both = right.join(met, "b").join(left.join(met.select("a"), "a", "left_semi"), "a")
    return both.filter(F.size(F.array_intersect("a_s", "b_s")) * (P + Q) >= (F.size("a_s") + F.size("b_s")) * P).select("a", "b", "a_first", "b_first")


def fetch_sets(docs: DataFrame, classes: DataFrame, keys: DataFrame, repeated: bool) -> DataFrame:
    """c1, first, s (all tokens), n, g0, g1 (number and bitmaps of the tokens) of the classes with the given keys, read from their first line.

    ``keys`` is a saved table.  ``repeated``: whether there are rows equal in id and text.
    """
    wanted = classes.join(small(keys, BROADCAST_ROWS), "c1").groupBy("first.doc_id", "first.dh").agg(F.collect_list(F.struct(F.col("first.no").alias("no"), "c1", "first")).alias("lines"))
    wanted = saved(wanted.select(F.col("doc_id").alias("w_id"), F.col("dh").alias("w_dh"), "lines"), "line-wanted")
    on = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.xxhash64("text") == F.col("w_dh"))
    got = docs.join(small(wanted, BROADCAST_ROWS // 4), on).select(F.col("lines").alias("ls"), lines_of(F.col("text")).alias("ts"))
    got = got.selectExpr("inline(transform(ls, l -> struct(l.c1 AS c1, l.first AS first, lower(ts[l.no]) AS line)))")
    sets = got.selectExpr("c1", "first", SHINGLES_OF).selectExpr("c1", "first", TOKENS_OF)
    # Repeated rows of a document give their lines repeatedly; without them the sets need no shuffle.
    sets = sets.dropDuplicates(["c1"]) if repeated else sets
    return sets.selectExpr("*", "size(s) AS n", f"{PARITY.format(0)} AS g0", f"{PARITY.format(6)} AS g1")


def light_pairs(entries: DataFrame) -> DataFrame:
    """a, b: pairs of classes that share a light token and can match: the light tokens that they share, and the heavy ones that each has, bound what is common."""
    cols = ["c1", "n", "at", "h"]
    light = entries.filter(~F.col("heavy"))
    met = side(light, "x", cols).join(side(light, "y", cols), "token").filter("x_c1 < y_c1").filter(lengths_fit("x_n", "y_n", P, Q))
    # The position filter holds for the first common token only, so all are counted.
    pairs = met.groupBy("x_c1", "y_c1", "x_n", "y_n", "x_h", "y_h").agg(F.count("*").alias("k"), F.max(fits("x", "y", P, Q)).alias("fits"))
    enough = F.col("k") + F.least("x_h", "y_h") >= required(F.greatest("x_n", "y_n"), F.least("x_n", "y_n"), P, Q)
    return pairs.filter(F.col("fits") & enough).select(F.col("x_c1").alias("a"), F.col("y_c1").alias("b")).distinct()


def heavy_classes(entries: DataFrame) -> DataFrame:
    """c1 of the classes that can match another by a first common token that is heavy.

    Judged by the lengths (x the longer) that meet in a bucket, not by pairs of lines: a length's lines have
    ``m`` shared prefix tokens at most and stand at place ``at`` at least.
    """
    heavy = entries.filter("heavy")
    lengths = saved(heavy.groupBy("token", "n").agg(F.count("*").alias("k"), F.max("m").alias("m"), F.min("at").alias("at")), "line-lengths")
    cols = ["n", "k", "m", "at"]
    met = side(lengths, "x", cols).join(side(lengths, "y", cols), "token").filter("y_n < x_n OR y_n = x_n AND x_k > 1").filter(lengths_fit("x_n", "y_n", P, Q))
    common = least_common(F.col("x_n"), F.col("y_n"), P, Q)
    met = met.withColumns({"least": required(F.col("x_n"), F.col("y_n"), P, Q), "x_most": F.col("x_n") - common + 1, "y_most": F.col("y_n") - common + 1})
    met = met.filter("x_m >= least AND y_m >= least AND x_at <= x_most AND y_at <= y_most")
    ends = met.select("token", F.explode(F.array(*[F.struct(F.col(f"{x}_n").alias("n"), "least", F.col(f"{x}_most").alias("most")) for x in "xy"])).alias("e"))
    need = ends.groupBy("token", F.col("e.n").alias("n")).agg(F.min("e.least").alias("least"), F.max("e.most").alias("most"))
    return heavy.join(need, ["token", "n"]).filter("m >= least AND at <= most").select("c1").distinct()


def later(pairs: DataFrame) -> DataFrame:
    """Of each matching pair the first line of the class whose first line comes later."""
    return pairs.select(F.greatest("a_first", "b_first").alias("first"))


def heavy_removed(sets: DataFrame) -> DataFrame:
    """first of the sets that match an earlier one, by rarity prefixes and hubs."""
    entries = saved(rare_prefixes(sets, P, Q, BROADCAST_ROWS).join(sets.select("c1", "first"), "c1"), "line-rare")
    removed, hubs, open_ = None, None, entries
    for turn in range(HUBS + 1):
        if turn < HUBS:
            left = entries if hubs is None else entries.join(hubs.withColumnRenamed("first", "h_first"), "token").filter("first > h_first").drop("h_first")
            hubs = saved(left.groupBy("token").agg(F.min("first").alias("first")), "line-hubs")
            early = entries.join(hubs, ["token", "first"])
        else:
            # The exact rest: every earlier line of the bucket beyond the hubs.
            early = entries.join(hubs.withColumnRenamed("first", "h_first"), "token").filter("first > h_first")
        cols = ["c1", "first", "n", "at"]
        met = side(open_, "x", cols).join(side(early, "y", cols), "token").filter(F.col("y_first") < F.col("x_first")).filter(fits("x", "y", P, Q))
        pairs = saved(met.select(F.col("x_c1").alias("a"), F.col("y_c1").alias("b")).distinct(), "line-pairs")
        found = saved(verified(pairs, sets).select(F.col("a").alias("c1"), F.col("a_first").alias("first")).distinct(), "line-found")
        removed = found if removed is None else removed.unionAll(found)
        open_ = saved(open_.join(found, "c1", "left_anti"), "line-open")
    return removed.select("first")


def numbers_by_document(lines: DataFrame, classes: DataFrame, gone: DataFrame) -> DataFrame:
    """doc_id, dh, n_lines, removed of each document: the first lines of the classes that go (``gone``, first) and all lines that are not the first of their class.

    Only what goes is gathered, not the lines that stay; lines are looked up in the classes of several lines.
    """
    several = classes.filter("c2 IS NOT NULL").select(F.col("c1").alias("s_c1"), F.col("c2").alias("s_c2"), "first")
    met = lines.filter("no >= 0").join(small(several, BROADCAST_ROWS), (F.col("c1") == F.col("s_c1")) & (F.col("c2") == F.col("s_c2")))
    again = met.filter("NOT (doc_id <=> first.doc_id AND dh = first.dh AND no = first.no)").select("doc_id", "dh", "no")
    rows = gone.select("first.doc_id", "first.dh", "first.no").unionAll(again).withColumn("n", F.lit(None).cast("int"))
    seen = lines.filter("no < 0").select("doc_id", "dh", F.lit(None).cast("int").alias("no"), "n").unionAll(rows)
    return seen.groupBy("doc_id", "dh").agg(F.max("n").alias("n_lines"), F.sort_array(F.collect_set("no")).alias("removed"))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, dh (hash of the text), n_lines, removed (ascending numbers from 0 of the lines that go): one row for each document.

    Rows equal in id and text are one document here.  Null ids come first in the order, null texts are empty (one
    line, without words).  Only the two columns are read.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col(text).alias("text"))
    lines = saved_hashes(judged_lines(rows), "lines")
    judged = lines.filter("no >= 0")
    # Equal lines have equal prefixes: a class has that of its first line, so each token is counted and looked up once for a class.
    classes = judged.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "dh", "no", "n", "prefix")).alias("f"), F.count("*").alias("k"))
    # c2 is kept for the classes of several lines only.
    classes = saved(classes.select("c1", F.when(F.col("k") > 1, F.col("c2")).alias("c2"), F.struct("f.doc_id", "f.dh", "f.no").alias("first"), "f.n", "f.prefix"), "line-classes")

    counts = classes.select(F.explode("prefix").alias("s_token")).groupBy("s_token").agg(F.count("*").alias("k"))
    shared = saved(counts.filter("k > 1").select("s_token", (F.col("k") >= HEAVY).alias("heavy")), "line-shared")
    entry = classes.selectExpr("c1", "n", "posexplode(prefix) AS (i, token)")
    met = entry.join(small(shared, BROADCAST_ROWS), F.col("token") == F.col("s_token"))
    # m: tokens of a class's prefix that others have in theirs, h: the heavy ones among them.
    of = met.groupBy("c1", "n").agg(F.count("*").alias("m"), F.count_if("heavy").alias("h"), F.collect_list(F.struct("token", (F.col("i") + 1).alias("at"), "heavy")).alias("entries"))
    counted = saved(of, "line-entries").selectExpr("c1", "n", "m", "h", "inline(entries)")
    heavy = saved(heavy_classes(counted), "line-heavy")
    pairs = saved(light_pairs(counted), "line-pairs")

    wanted = saved(heavy.unionAll(pairs.select("a")).unionAll(pairs.select("b")).distinct(), "line-keys")
    repeated = not lines.filter("no < 0").groupBy("doc_id", "dh").count().filter("count > 1").isEmpty()
    sets = saved(fetch_sets(rows, classes, wanted, repeated), "line-sets")
    heavy_sets = saved(sets.join(small(heavy, BROADCAST_ROWS), "c1"), "line-heavy-sets")
    gone = later(verified(pairs, sets)).unionAll(heavy_removed(heavy_sets))
    return numbers_by_document(lines, classes, saved(gone, "line-gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the removed lines cut out of ``text``: the same rows and columns; texts without removed lines are unchanged, null stays null."""
    g_id, g_dh, g_no = unused(docs, "g_id", "g_dh", "g_no")
    gone = removed_lines(docs, id_col, text).filter(F.size("removed") > 0).select(F.col("doc_id").alias(g_id), F.col("dh").alias(g_dh), F.col("removed").alias(g_no))
    met = docs.join(gone, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(g_id)) & (F.xxhash64(text_col(text)) == F.col(g_dh)), "left")
    left = F.filter(F.split(F.col(text), "\n"), lambda line, i: ~F.array_contains(g_no, i))
    return met.withColumn(text, F.when(F.col(g_no).isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = removed_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


#: Plain DuckDB: all pairs of lines that share a token, counted.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, string_split(translate(coalesce(text, ''), chr(9) || chr(13), '  '), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i - 1 AS no, [x FOR x IN string_split(lower(ls[i]), ' ') IF x <> ''] AS w FROM d, unnest(range(1, len(ls) + 1)) r(i)),
j AS (SELECT doc_id, no, array_to_string(w, ' ') AS line, w FROM l WHERE len(w) > 0),
c AS (SELECT line, any_value(w) AS w, min(doc_id * 1000000000 + no) AS pos FROM j GROUP BY line),
t AS (SELECT DISTINCT pos, array_to_string(w[i : i + {WORDS - 1}], ' ') AS token FROM c, unnest(range(1, greatest(2, len(w) - {WORDS - 2}))) r(i)),
n AS (SELECT pos, count(*) AS n FROM t GROUP BY pos),
m AS (SELECT a.pos AS a, b.pos AS b, count(*) AS k FROM t a JOIN t b ON a.token = b.token AND a.pos < b.pos GROUP BY ALL),
gone AS (SELECT DISTINCT b AS pos FROM m JOIN n x ON x.pos = a JOIN n y ON y.pos = b WHERE k * {P + Q} >= (x.n + y.n) * {P}),
stay AS (SELECT pos FROM c WHERE pos NOT IN (SELECT pos FROM gone)),
r AS (SELECT doc_id, no FROM j WHERE doc_id * 1000000000 + no NOT IN (SELECT pos FROM stay))
SELECT d.doc_id, CAST(any_value(len(ls)) AS BIGINT) AS n_lines, count(r.no) AS n_removed, coalesce(string_agg(CAST(r.no AS VARCHAR), ',' ORDER BY r.no), '') AS removed_lines
FROM d LEFT JOIN r ON d.doc_id = r.doc_id GROUP BY d.doc_id
"""
