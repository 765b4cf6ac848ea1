"""URL filters by a temporal join with dated block and allow lists.

A list is a set of dated entries (pattern, action, listed_on).  A pattern is
a host or any parent domain of it with two labels at least
(``ads.example.com``, ``example.com``), or a host and its first path segment
(``example.com/shop``).  An entry holds from its day until the day before
the next entry of the same pattern; ``drop`` ends the one before and opens none.
Of several entries of one pattern on one day, block goes before allow before drop.

A capture is judged by the entries active on the day it was fetched; the
most specific pattern decides (path, then more labels).

All of it is DataFrame code.  Captures are first reduced to distinct (host, segment,
day) and these to distinct (pattern, day), both with partial aggregation, so a host with a
third of all captures sends one row for each of its days.  The as-of join is an equi-join on
(pattern, month) of those pairs with the intervals, cut at month borders,
and a test of the days; at most one entry is active for a pair.  The verdicts go back to
the captures by (host, segment, day), which spreads a hot host over its days;
nothing is broadcast by hint, and AQE splits what is left of the skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
SEGMENT = r"^[a-z][a-z0-9+.-]*://[^/?#]+/([^/?#]+)"
#: Actions by rising priority on one day.
ACTIONS = ("drop", "allow", "block")


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and a trailing dot; null if there is none."""
    host = F.regexp_replace(F.regexp_extract(F.lower(url), HOST, 1), r"\.+$", "")
    return F.when(host != "", host)


def segment_of(url: Column) -> Column:
    segment = F.regexp_extract(F.lower(url), SEGMENT, 1)
    return F.when(segment != "", segment)


def patterns_of(host: Column, segment: Column) -> Column:
    """array<struct<pattern, depth>>: parent domains from two labels up, the host, host/segment."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    low = F.least(F.lit(2), n)
    domains = F.transform(F.sequence(low, n), lambda k: F.struct(F.array_join(F.slice(labels, n - k + 1, k), ".").alias("pattern"), k.alias("depth")))
    path = F.when(segment.isNotNull(), F.array(F.struct(F.concat(host, F.lit("/"), segment).alias("pattern"), (n + 1).alias("depth"))))
    return F.concat(domains, F.coalesce(path, F.array().cast("array<struct<pattern:string,depth:int>>")))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, action, listed_on, until (the first day it no longer holds; null: open).  Rows with a null or an unknown action are left out."""
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.lower("action"))
    known = entries.select(F.lower("pattern").alias("pattern"), F.col("listed_on").cast("date").alias("listed_on"), rank.alias("rank"))
    known = known.filter("pattern IS NOT NULL AND listed_on IS NOT NULL AND rank > 0")
    # One row for each pattern and day, so the window below is bounded by the calendar.
    daily = known.groupBy("pattern", "listed_on").agg(F.max("rank").alias("rank"))
    until = F.lead("listed_on").over(Window.partitionBy("pattern").orderBy("listed_on"))
    return daily.withColumn("until", until).filter("rank > 1").select("pattern", F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("rank").cast("int")).alias("action"), "listed_on", "until")


def active_on(days: DataFrame, spans: DataFrame) -> DataFrame:
    """As-of join: (pattern, day) with the entry active on that day; pairs without one are left out."""
    first, last = F.trunc("listed_on", "month"), F.trunc(F.date_sub("until", 1), "month")
    lo, hi = days.agg(F.trunc(F.min("day"), "month"), F.trunc(F.max("day"), "month")).first()
    if lo is None:
        return days.select("pattern", "day", F.lit(None).cast("string").alias("action"), F.col("day").alias("listed_on")).limit(0)
    months = F.sequence(F.greatest(first, F.lit(lo)), F.least(F.coalesce(last, F.lit(hi)), F.lit(hi)), F.expr("INTERVAL 1 MONTH"))
    inside = (first <= F.lit(hi)) & (F.coalesce(last, F.lit(hi)) >= F.lit(lo))
    cut = spans.filter(inside).select("pattern", "action", "listed_on", "until", F.explode(months).alias("month"))
    asked = days.withColumn("month", F.trunc("day", "month"))
    met = asked.join(cut, ["pattern", "month"])
    return met.filter("listed_on <= day AND (until IS NULL OR day < until)").select("pattern", "day", "action", "listed_on")


def filter_urls(pages: DataFrame, entries: DataFrame, id_col: str = "page_id", url: str = "url", fetched: str = "fetched_on") -> DataFrame:
    """page_id, host, fetched_on, verdict, pattern, listed_on: one row for each row of ``pages``.

    verdict: blocked, allowed (an allow entry decides), unlisted (none active),
    undated (null day), invalid (null, empty or host-less URL).  Repeated rows
    and null ids are judged alike and all returned; only the three
    columns are read, so other columns cannot clash.  Empty pages give an
    empty result, an empty list gives unlisted.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url)).alias("host"), segment_of(F.col(url)).alias("segment"), F.col(fetched).cast("date").alias("fetched_on"))
    keys = rows.filter("host IS NOT NULL AND fetched_on IS NOT NULL").select("host", "segment", F.col("fetched_on").alias("day")).distinct()
    asked = keys.select("host", "segment", "day", F.inline(patterns_of(F.col("host"), F.col("segment"))))
    active = active_on(asked.select("pattern", "day").distinct(), intervals(entries))
    best = asked.join(active, ["pattern", "day"]).groupBy("host", "segment", "day").agg(F.max(F.struct("depth", "pattern", "action", "listed_on")).alias("best"))
    verdict = best.select(F.col("host").alias("v_host"), F.col("segment").alias("v_segment"), F.col("day").alias("v_day"), "best.action", "best.pattern", "best.listed_on")
    on = (F.col("host") == F.col("v_host")) & F.col("segment").eqNullSafe(F.col("v_segment")) & (F.col("fetched_on") == F.col("v_day"))
    said = F.when(F.col("host").isNull(), "invalid").when(F.col("fetched_on").isNull(), "undated").when(F.col("action") == "block", "blocked").when(F.col("action") == "allow", "allowed").otherwise("unlisted")
    return rows.join(verdict, on, "left").select("page_id", "host", "fetched_on", said.alias("verdict"), "pattern", "listed_on")


# The query's inputs are derived from ``pages`` alone.
FIRST_DAY, DAYS, CHANGES = "2024-01-01", 366, 6


def captures_and_list(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures with a fetch day from page_id; a list with CHANGES dated entries for each host, parent domain and host/segment."""
    day = lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(n, F.lit(DAYS)).cast("int"))
    captures = pages.select("page_id", "url", day(F.col("page_id") * 7919).alias("fetched_on"))
    seen = pages.select(host_of(F.col("url")).alias("host"), segment_of(F.col("url")).alias("segment")).filter("host IS NOT NULL").distinct()
    listed = seen.select(F.explode(patterns_of(F.col("host"), F.col("segment"))).alias("p")).select("p.pattern").distinct()
    change = listed.select("pattern", F.explode(F.sequence(F.lit(1), F.lit(CHANGES))).alias("k"))
    digest = F.md5(F.concat("pattern", F.lit("#"), F.col("k").cast("string")))
    number = lambda at: F.conv(F.substring(digest, at, 4), 16, 10).cast("long")
    action = F.element_at(F.array(*map(F.lit, ACTIONS)), (number(5) % 3 + 1).cast("int"))
    return captures, change.select("pattern", action.alias("action"), day(number(1)).alias("listed_on"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, listed = captures_and_list(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return filter_urls(captures, listed)


#: Plain DuckDB: every page against every interval of its patterns.
ORACLE_SQL = rf"""
WITH p AS (
  SELECT page_id, nullif(regexp_replace(regexp_extract(lower(url), '{HOST}', 1), '\.+$', ''), '') AS host,
         nullif(regexp_extract(lower(url), '{SEGMENT}', 1), '') AS segment,
         DATE '{FIRST_DAY}' + CAST(((page_id * 7919) % {DAYS} + {DAYS}) % {DAYS} AS INTEGER) AS fetched_on
  FROM pages),
k AS (SELECT DISTINCT host, segment, string_split(host, '.') AS labels FROM p WHERE host IS NOT NULL),
a AS (
  SELECT host, segment, array_to_string(labels[len(labels) - d + 1 :], '.') AS pattern, d AS depth
  FROM k, unnest(range(2, len(labels) + 1)) r(d)
  UNION ALL SELECT host, segment, host, 1 FROM k WHERE len(labels) = 1
  UNION ALL SELECT host, segment, host || '/' || segment, len(labels) + 1 FROM k WHERE segment IS NOT NULL),
e AS (
  SELECT pattern, DATE '{FIRST_DAY}' + CAST(CAST('0x' || substr(md5(pattern || '#' || i), 1, 4) AS INTEGER) % {DAYS} AS INTEGER) AS listed_on,
         max(CAST('0x' || substr(md5(pattern || '#' || i), 5, 4) AS INTEGER) % 3) AS act
  FROM (SELECT DISTINCT pattern FROM a), range(1, {CHANGES + 1}) t(i) GROUP BY ALL),
s AS (SELECT pattern, act, listed_on, lead(listed_on) OVER (PARTITION BY pattern ORDER BY listed_on) AS until FROM e),
m AS (
  SELECT p.page_id, a.depth, s.* FROM p JOIN a ON p.host = a.host AND p.segment IS NOT DISTINCT FROM a.segment
  JOIN s ON s.pattern = a.pattern AND s.act > 0 AND s.listed_on <= p.fetched_on AND (s.until IS NULL OR p.fetched_on < s.until)),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY depth DESC, pattern DESC) = 1)
SELECT p.page_id, p.host, p.fetched_on,
       CASE WHEN p.host IS NULL THEN 'invalid' WHEN b.act = 2 THEN 'blocked' WHEN b.act = 1 THEN 'allowed' ELSE 'unlisted' END AS verdict,
       b.pattern, b.listed_on
FROM p LEFT JOIN b USING (page_id)
"""
