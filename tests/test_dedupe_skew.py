"""Dedupe and hot-key joins: properties and brute-force agreement."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from triage_spark.operators.dedupe import duplicate_keys, first_per_key, replay, with_key
from triage_spark.operators.skew import heavy_hitters, hot_keys, skew_join
from triage_spark.sources import fixtures as FX


def _requests(spark, sf):
    return with_key(FX.ticket_requests(FX.table(spark, sf, "events")))


def test_first_per_key_matches_row_number(spark, sf_small):
    req = _requests(spark, sf_small)
    got = rows(first_per_key(req), "key", "ticket_id")
    w = Window.partitionBy("key").orderBy("created_at", "ticket_id")
    brute = req.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    assert got == rows(brute, "key", "ticket_id")
    assert len(got) == req.select("key").distinct().count()


def test_first_per_key_is_idempotent(spark, sf_small):
    once = first_per_key(_requests(spark, sf_small))
    assert rows(first_per_key(once)) == rows(once)


def test_counts_match_fixture_notes(spark, sf_small):
    req = _requests(spark, sf_small)
    n = req.count()
    firsts = first_per_key(req).count()
    assert n == 1000
    assert n - firsts == 192  # repeats
    assert req.filter(F.col("idempotency_key").isNull() | (F.col("idempotency_key") == "")).count() == 161
    dup = duplicate_keys(req)
    assert dup.agg(F.sum(F.col("n_rows") - 1)).first()[0] == 192


def test_skew_join_equals_plain_join_when_salted(spark, sf_small):
    req = _requests(spark, sf_small).withColumn("hot", F.lit("ONE"))  # every row on one key
    small = spark.createDataFrame([("ONE", 1)], "hot string, v int")
    assert hot_keys(req, ["hot"], 10).count() == 1
    salted = skew_join(req, small, ["hot"], "inner", salt_by=["ticket_id"], hot_rows=10, n_salts=8)
    plain = req.join(small, "hot", "inner")
    assert rows(salted, "ticket_id", "v") == rows(plain, "ticket_id", "v")
    # the hot key really is spread: its rows fall in several salts
    spread = req.select(F.pmod(F.xxhash64("ticket_id"), F.lit(8)).alias("s")).distinct().count()
    assert spread == 8


def test_skew_join_anti_and_left(spark, sf_small):
    req = _requests(spark, sf_small)
    keys = first_per_key(req).select("key").limit(100)
    for how in ("left_anti", "left_semi", "left"):
        a = skew_join(req, keys.withColumn("m", F.lit(1)), ["key"], how, salt_by=["ticket_id"], hot_rows=2)
        b = req.join(keys.withColumn("m", F.lit(1)), "key", how)
        assert rows(a, "ticket_id") == rows(b, "ticket_id"), how


def test_replay_marks_repeats(spark, sf_small):
    req = _requests(spark, sf_small)
    firsts = first_per_key(req).select("key", "ticket_id", "created_at")
    r = replay(req, firsts, hot_rows=2)
    assert r.count() == 1000
    assert r.filter("cached").count() == 192
    assert r.filter(~F.col("cached")).filter(F.col("req_ticket_id") != F.col("first_ticket_id")).count() == 0


def test_heavy_hitters_with_empty_partitions(spark):
    """More shuffle partitions than sketches, not coalesced: partitions without a sketch are nothing to merge."""
    names = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        df = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id)) AS k")
        assert [(r.k, r.n) for r in heavy_hitters(df, "k", 500).collect()] == [("hot", 1000)]
        assert heavy_hitters(df.limit(0), "k", 1).collect() == []
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
