"""Point lookups read few row groups; an at-least-once feed goes on once with bounded state."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import rows
from triage_spark.sinks import points as P
from triage_spark.streaming import jobs as SJ


@pytest.fixture(scope="module")
def table(spark):
    df = spark.range(60_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), "id", F.repeat(F.lit("x"), 100).alias("body"))
    path = tempfile.mkdtemp(prefix="points-", dir="/tmp") + "/t"
    return P.write_sorted(df, path, "k", files=3, group_bytes=256 << 10, group_keys=3_000)


def scanned(df):
    """Rows that came out of the scan of a collected plan."""
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_lookup_reads_few_groups(table):
    keys = [r.k for r in table.filter("id % 6000 = 0").select("k").collect()]
    got = P.lookup(table, "k", [*keys, keys[0], None])
    assert sorted(r.id for r in got.collect()) == list(range(0, 60_000, 6_000))
    assert 0 < scanned(got) < 60_000 * 0.6
    one = P.lookup(table, "k", keys[:1])
    assert one.count() == 1 and one.collect() and scanned(one) < 6_000


def test_bloom_filter_skips_groups_of_absent_keys(table):
    absent = [r.k for r in table.filter("id < 40").select(F.reverse("k").alias("k")).collect()]
    got = P.lookup(table, "k", absent)
    assert got.collect() == [] and scanned(got) < 60_000 * 0.1
    # Their range alone would not: each lies between the least and the largest key of some group.
    low, high = table.agg(F.min("k"), F.max("k")).first()
    assert all(low < k < high for k in absent)


def test_lookup_edges(spark, table):
    assert P.lookup(table, "k", []).count() == 0
    with pytest.raises(ValueError, match="join"):
        P.lookup(table, "k", [str(i) for i in range(P.MOST_KEYS + 1)])
    path = tempfile.mkdtemp(prefix="points-", dir="/tmp")
    few = spark.createDataFrame([("a", 1), (None, 2), ("a", 3)], "k string, v int")
    assert rows(P.lookup(P.write_sorted(few, f"{path}/few", "k"), "k", ["a", "b"]), "v") == [(1,), (3,)]
    assert P.lookup(P.write_sorted(few.limit(0), f"{path}/none", "k"), "k", ["a"]).count() == 0


SCHEMA = "event_id long, created_at timestamp_ntz, body string"


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def test_redeliveries_inside_and_beyond_the_bound(spark):
    root = tempfile.mkdtemp(prefix="redeliveries-", dir="/tmp")
    run = SJ.new_run(spark, "t", root)
    parts = [
        # copies in one part; a null id is an id
        [(1, at(0), "a"), (1, at(0), "a"), (2, at(30), "b"), (None, at(1), "n")],
        # again inside the bound; first copy late but inside; the part that moves the watermark to 90 h
        [(2, at(30), "b"), (3, at(29), "c"), (4, at(100), "d"), (None, at(1), "n")],
        # again beyond the bound; first copy at the watermark (late) and just after it; an empty part follows
        [(1, at(0), "a"), (5, at(90), "e"), (6, at(90.001), "f"), (4, at(100), "d")],
        [],
        [(6, at(90.001), "f"), (7, at(101), "g")],
    ]
    went = []
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/feed")
        once = SJ.redelivery_stream(spark, f"{root}/feed", spark.createDataFrame([], SCHEMA).schema, run, "10 hours")
        went.append(sorted((r.event_id or 0) for r in once.collect()))
    # 3 is inside the bound of the first part (30 h less 10 h); every id once
    assert went == [[0, 1, 2], [0, 1, 2, 3, 4], [0, 1, 2, 3, 4, 6], [0, 1, 2, 3, 4, 6], [0, 1, 2, 3, 4, 6, 7]]
    feed = spark.read.parquet(f"{root}/feed")
    assert rows(SJ.late_rows(feed, once)) == [(5, 1)]


def test_state_of_redeliveries_is_bounded(spark):
    """Ids that the watermark has passed by the bound leave the state."""
    root = tempfile.mkdtemp(prefix="redeliveries-", dir="/tmp")
    run, schema = SJ.new_run(spark, "t", root), spark.createDataFrame([], SCHEMA).schema
    kept = []
    for part in range(4):
        rows_ = [(100 * part + i, at(100 * part + i / 100), "x") for i in range(100)]
        spark.createDataFrame(rows_, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/feed")
        SJ.redelivery_stream(spark, f"{root}/feed", schema, run, "2 hours")
        state = spark.read.format("statestore").load(run.ck("redeliveries"))
        kept.append(state.count())
    assert kept == [100] * 4 and spark.read.parquet(f"{root}/once").count() == 400


def test_bucketed_layout_is_looked_up_and_joined_without_a_shuffle(spark, tmp_path):
    df = spark.range(400).selectExpr("concat('K', id % 200) AS k", "id AS v").unionByName(spark.createDataFrame([(None, -1)], "k string, v long"))
    stored = P.write_sorted(df, str(tmp_path / "t"), "k", buckets=4)
    assert rows(stored, "v") == rows(df, "v") and stored.columns == df.columns
    assert rows(P.lookup(stored, "k", ["K7", "K199", "absent", None]), "v") == [(7,), (199,), (207,), (399,)]
    other = P.write_sorted(df.select("k").distinct(), str(tmp_path / "o"), "k", buckets=4)
    joined = stored.join(other.hint("merge"), "k")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 400
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("points_")]
