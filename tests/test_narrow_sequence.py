"""The narrow tier-change branch of ``resolve``: same picks, same sequence, pruned when unused."""

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import rows
from triage_spark.functions.rules import classify_columns
from triage_spark.operators.dedupe import first_fields, first_per_key, with_key
from triage_spark.plans import ledger_flow as LF
from triage_spark.plans import queries as Q
from triage_spark.plans import triage as TR
from triage_spark.sources import fixtures as FX


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_fields_picks_the_same_row_under_ties(spark, sf_small):
    req = with_key(FX.ticket_requests(FX.table(spark, sf_small, "events")))
    # every row of a key shares created_at and ticket_id: only the rest differs
    tied = req.withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).withColumn(
        "ticket_id", F.lit("TCK-SAME")
    )
    wide = first_per_key(tied).select("key", "event_id", "subject")
    narrow = first_fields(tied, {"event_id": F.col("event_id"), "subject": F.col("subject")})
    assert rows(wide) == rows(narrow, "key", "event_id", "subject")


def _brute_sequence(spark, sf):
    """previous_tier / seats_after from one plain window per account over first tickets."""
    i = TR.load(spark, sf)
    d = first_per_key(with_key(i.requests)).select("*", *classify_columns())
    d = d.withColumn("account_id", F.upper(F.regexp_replace(F.regexp_replace("customer_id", r"^\s+", ""), r"\s+$", "")))
    t = i.tiers.select(F.col("tier_key").alias("tk"), F.col("name").alias("tier_name"), "max_seats")
    d = d.join(F.broadcast(t), F.upper(F.trim("target_tier")) == F.col("tk"), "left")
    a = i.accounts.select("account_id", "current_tier", "seats_allocated")
    d = d.join(a, "account_id", "left").withColumn("is_change", (F.col("category") == "SUBSCRIPTION") & F.col("tk").isNotNull())
    w = Window.partitionBy("account_id").orderBy("created_at", "ticket_id")
    ct = F.when(F.col("is_change"), F.col("tier_name"))
    half = F.when(F.col("is_change"), F.floor(F.col("max_seats") / 2).cast("int"))
    base_tier = F.coalesce(F.col("current_tier"), F.lit("Professional"))
    base_seats = F.coalesce(F.col("seats_allocated"), F.lit(25))
    return d.filter("is_change").select(
        "ticket_id",
        F.coalesce(F.last(ct, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), base_tier).alias("p"),
        F.greatest(base_seats, F.max(half).over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("s"),
    )


def test_resolve_sequence_equals_plain_window(spark, sf_small):
    i = TR.load(spark, sf_small)
    got = TR.resolve(i.requests, i.accounts, i.tiers).filter("is_change").select("ticket_id", "previous_tier", "seats_after")
    assert rows(got) == rows(_brute_sequence(spark, sf_small))


def test_unused_sequence_branch_is_pruned(spark, sf_small):
    # response_text reads no sequence column: no window at all in its plan
    assert "Window" not in _plan(E.queries()["response_text"](spark, sf_small))
    # tier_change_results needs it: the window runs, but no wide row goes through it
    p = _plan(E.queries()["tier_change_results"](spark, sf_small))
    assert "Window" in p


def test_reports_do_not_shuffle_the_body(spark, sf_small):
    """Responses never show the ticket body, so the dedupe struct leaves it out; the ledger keeps it."""
    def dedupe_structs(df):
        return [ln for ln in _plan(df).splitlines() if "partial_min(struct(" in ln]

    assert not any("body, body" in ln for ln in dedupe_structs(E.queries()["response_text"](spark, sf_small)))
    assert any("body, body" in ln for ln in dedupe_structs(LF.new_tickets(LF.prepare(spark, sf_small))))


def test_reports_and_responses_pick_the_same_first_row(spark, sf_small):
    """Under ties on (created_at, ticket_id) decide and resolve still agree on every key's first ticket."""
    i = TR.load(spark, sf_small)
    tied = i.requests.withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).withColumn(
        "ticket_id", F.lit("TCK-SAME")
    )
    d = TR.decide(tied, keep=["event_id"]).select("key", "event_id")
    r = TR.resolve(tied, i.accounts, i.tiers, keep=Q.RESOLVED_KEEP).select("key", "event_id")
    assert rows(d) == rows(r)


def test_resolve_with_hot_account_equals_unsalted(spark, sf_small):
    """A third of all tickets on one account: salting and adaptive chunks change no result."""
    i = TR.load(spark, sf_small)
    req = i.requests.withColumn(
        "customer_id", F.when(F.col("event_id") % 3 == 0, F.lit("CUST-7")).otherwise(F.col("customer_id"))
    )
    cols = ["ticket_id", "account_id", "category", "status", "confidence_score", "previous_tier", "seats_after",
            "customer_reply"]
    hot = TR.resolve(req, i.accounts, i.tiers, hot_rows=50).select(*cols)
    cold = TR.resolve(req, i.accounts, i.tiers, hot_rows=10**9).select(*cols)
    assert rows(hot) == rows(cold)
    assert "xxhash64" in _plan(TR.resolve(req, i.accounts, i.tiers, hot_rows=50))


def test_first_row_queries_shuffle_no_body(spark, sf_small):
    for name in ("dedupe_first", "account_state", "new_tickets"):
        picks = [x for x in _plan(Q.QUERIES[name](spark, sf_small)).splitlines() if "min(struct(" in x]
        assert picks and not any("body, body" in x for x in picks), name


def shuffled_inputs(df):
    """The input columns of every exchange in the plan."""
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", text)


def test_ledger_texts_are_not_shuffled_again(spark, sf_small):
    """The load and the new tickets are stored by key: lookups, sequence and upsert move narrow rows only."""
    li = LF.prepare(spark, sf_small)
    moved = shuffled_inputs(LF.upserted(li))
    assert moved and not [m for m in moved if re.search("body|customer_reply|reasoning", m)]
    assert LF.points(li).inputFiles() == li.seed.inputFiles()


def test_misses_of_firsts_are_firsts_of_misses(spark):
    from triage_spark.operators import ledger as L
    from triage_spark.operators.dedupe import first_per_key

    asked = spark.createDataFrame([("a", 2, "t2", 1), ("a", 1, "t1", 2), ("b", 1, "t3", 3), ("c", 1, "t4", 5), ("c", 1, "t4", 5), ("d", 5, "t5", 6), ("d", 4, "t6", 7)], "key string, created_at int, ticket_id string, event_id int")
    stored = spark.createDataFrame([("a", "RESOLVED"), ("b", "PENDING"), ("d", "ESCALATED"), ("d", "RESOLVED"), ("x", "RESOLVED")], "idempotency_key string, status string")
    want = first_per_key(L.misses(asked, stored))
    assert rows(L.misses(first_per_key(asked), stored, hot_rows=None)) == rows(want) == [("b", 1, "t3", 3), ("c", 1, "t4", 5)]
