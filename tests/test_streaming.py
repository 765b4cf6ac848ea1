"""Streams equal their batch twins, also when the feed arrives in several micro-batches."""

import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import rows
from triage_spark.operators import ledger as L
from triage_spark.operators.dedupe import first_per_key, with_key
from triage_spark.plans import queries as Q
from triage_spark.plans import triage as TR
from triage_spark.sources import fixtures as FX
from triage_spark.streaming import jobs as SJ


@pytest.fixture(scope="module")
def split_events(spark, sf_small):
    """The events table cut into 4 time-ordered files (a feed arriving in 4 parts)."""
    d = tempfile.mkdtemp(prefix="events-split-", dir="/tmp")
    ev = FX.table(spark, sf_small, "events")
    bounds = ev.select(F.percentile_approx("ts", [0.25, 0.5, 0.75]).alias("q")).first().q
    edges = [None, *bounds, None]
    for i in range(4):
        part = ev
        if edges[i] is not None:
            part = part.filter(F.col("ts") >= F.lit(edges[i]))
        if edges[i + 1] is not None:
            part = part.filter(F.col("ts") < F.lit(edges[i + 1]))
        part.coalesce(1).write.parquet(f"{d}/part={i:02d}")
    return d


def _source(spark, sf_small, d):
    return SJ.event_stream(spark, sf_small, max_files=1, path=f"{d}/part=*/*.parquet")


def test_dedupe_stream_multi_batch(spark, sf_small, split_events):
    run = SJ.new_run(spark, "t-dedupe", tempfile.mkdtemp(prefix="t-dedupe-", dir="/tmp"))
    got = SJ.dedupe_stream(spark, sf_small, run, source=_source(spark, sf_small, split_events))
    want = first_per_key(with_key(FX.ticket_requests(FX.table(spark, sf_small, "events"))))
    assert rows(got, "key", "ticket_id") == rows(want, "key", "ticket_id")
    # 4 batches committed, each with its own rows only
    assert sorted(p.name for p in Path(run.root, "_done").iterdir() if not p.name.startswith(".")) == ["0", "1", "2", "3"]
    written = spark.read.parquet(f"{run.root}/firsts")
    assert written.count() == want.count() and written.select("lo").distinct().count() == 4


def test_ledger_and_state_stream_multi_batch(spark, sf_small, split_events):
    run = SJ.new_run(spark, "t-ledger", tempfile.mkdtemp(prefix="t-ledger-", dir="/tmp"))
    job = SJ.ledger_stream(spark, sf_small, run, source=_source(spark, sf_small, split_events))
    i = TR.load(spark, sf_small)
    batch = L.ledger_rows(TR.resolve(i.requests, i.accounts, i.tiers))
    cols = ["idempotency_key", "ticket_id", "status", "confidence_score", "resolution_summary", "customer_reply", "actions_taken"]
    assert rows(job.ledger.read(), *cols) == rows(batch, *cols)
    state_cols = ["account_id", "current_tier", "seats_allocated", "tier_changes", "tool_calls", "is_new"]
    want_state = Q.q_account_state(spark, sf_small)
    assert rows(job.state.read(), *state_cols) == rows(want_state, *state_cols)
    # two audit rows per processed ticket, written per batch
    audit = spark.read.parquet(job.audit_root)
    assert audit.count() == 2 * batch.count()


class Stopped(Exception):
    pass


def _outputs(job):
    """Everything a ledger job left, as sorted rows."""
    audit = job.committed_rows(job.audit_root).drop("log_date")
    replies = job.committed_rows(job.replies_root)
    routes = job.committed_rows(job.routes_root).drop("message")
    return rows(job.ledger.read()), rows(job.state.read()), rows(audit), rows(replies), rows(routes)


@pytest.fixture(scope="module")
def clean(spark, sf_small, split_events):
    run = SJ.new_run(spark, "t-clean", tempfile.mkdtemp(prefix="t-clean-", dir="/tmp"))
    job = SJ.ledger_stream(spark, sf_small, run, source=_source(spark, sf_small, split_events))
    return _outputs(job)


@pytest.mark.parametrize("mode, fail_at", [("static", 2), ("dynamic", 3), ("static", 4), ("dynamic", 5), ("static", 6)])
def test_failed_batch_replays_to_the_clean_result(spark, sf_small, split_events, clean, monkeypatch, mode, fail_at):
    """The second batch stops before its n-th write (replies, ledger, audit, routes, state, commit) and starts again."""
    from triage_spark.sinks import runs as V

    spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    try:
        run = SJ.new_run(spark, "t-fail", tempfile.mkdtemp(prefix="t-fail-", dir="/tmp"))
        whole, seen = V.overwrite, []

        def stopping(df, path, *by):
            seen.append(path)
            if "batch_id=1" in path or "/lo=1/" in path:
                count(path)
            whole(df, path, *by)

        def count(path):
            stopping.n += 1
            if stopping.n == fail_at:
                raise Stopped(path)

        mark = V.Commits.commit

        def stopping_mark(self, batch):
            if batch == 1:
                count("marker")
            mark(self, batch)

        stopping.n = 0
        monkeypatch.setattr(V, "overwrite", stopping)
        monkeypatch.setattr(SJ, "overwrite", stopping)
        monkeypatch.setattr(V.Commits, "commit", stopping_mark)
        with pytest.raises(Exception, match="Stopped"):
            SJ.ledger_stream(spark, sf_small, run, source=_source(spark, sf_small, split_events))
        monkeypatch.setattr(V, "overwrite", whole)
        monkeypatch.setattr(SJ, "overwrite", whole)
        monkeypatch.setattr(V.Commits, "commit", mark)
        job = SJ.ledger_stream(spark, sf_small, run, source=_source(spark, sf_small, split_events))
        assert _outputs(job) == clean
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")


def test_live_runs_cover_all_batches_and_stay_few():
    from triage_spark.sinks.runs import FAN, live

    for n in range(0, 1200):
        runs = live(n)
        assert [b for lo, size in runs for b in range(lo, lo + size)] == list(range(n)) and len(runs) <= 4 * (FAN - 1)
    assert live(8) == [(0, 8)] and live(74) == [(0, 64), (64, 8), (72, 1), (73, 1)]


def test_runs_merge_on_read_fold_and_drop_old_folders(spark, tmp_path, monkeypatch):
    """Twelve batches with folds of two: the latest row of each key, before and after every commit, and few folders."""
    from triage_spark.sinks import runs as V

    monkeypatch.setattr(V, "FAN", 2)
    monkeypatch.setattr(V, "KEEP", 2)
    schema = spark.createDataFrame([], "k string, v long").schema
    base = spark.createDataFrame([("a", -1), ("z", -1)], schema)
    want = {"a": -1, "z": -1}
    root = f"file://{tmp_path}/t"
    for n in range(12):
        commits = V.Commits(spark, root)
        table = V.KeyedRuns(commits, "rows", "k", schema, base)
        assert commits.newest() == n - 1 and dict(map(tuple, table.read().collect())) == want
        batch = {k: n for i, k in enumerate("abcdef") if (n + i) % 3 == 0}
        table.append(spark.createDataFrame(list(batch.items()), schema), n)
        # Nothing is visible before the marker; a replay writes the same folders.
        assert dict(map(tuple, table.read().collect())) == want
        table.append(spark.createDataFrame(list(batch.items()), schema), n)
        commits.commit(n)
        want |= batch
        some = spark.createDataFrame([("a",), ("b",), ("a",), ("none",)], "k string")
        assert dict(map(tuple, table.read(some).collect())) == {k: v for k, v in want.items() if k in "ab"}
    assert commits.committed(11) and not commits.committed(12)
    folders = sorted(str(p.relative_to(tmp_path / "t" / "rows")) for p in (tmp_path / "t" / "rows").glob("lo=*/size=*"))
    # The live runs, those of the last two commits, and what they folded.
    assert len(folders) <= 10 and {"lo=0/size=8", "lo=8/size=4"} <= set(folders) and not {"lo=0/size=1", "lo=0/size=2", "lo=2/size=1"} & set(folders)
    assert len([p for p in (tmp_path / "t" / "_done").iterdir() if not p.name.startswith(".")]) <= 3


def test_a_fold_holds_the_latest_row_of_each_key(spark, tmp_path, monkeypatch):
    from triage_spark.sinks import runs as V

    monkeypatch.setattr(V, "FAN", 2)
    schema = spark.createDataFrame([], "k string, v long").schema
    commits = V.Commits(spark, f"file://{tmp_path}/t")
    table = V.KeyedRuns(commits, "rows", "k", schema)
    assert commits.newest() == -1 and table.read().count() == 0
    for n in range(2):
        table.append(spark.createDataFrame([("a", n), (f"only{n}", n)], schema), n)
        commits.commit(n)
    assert rows(spark.read.parquet(f"file://{tmp_path}/t/rows/lo=0/size=2")) == [("a", 1), ("only0", 0), ("only1", 1)]
    assert rows(table.read()) == [("a", 1), ("only0", 0), ("only1", 1)]


def test_triage_and_failure_streams(spark, sf_small):
    run = SJ.new_run(spark, "t-tri", tempfile.mkdtemp(prefix="t-tri-", dir="/tmp"))
    tri = SJ.triage_stream(spark, sf_small, run)
    assert tri.count() == 1000
    audit_root, alert_root = SJ.failure_stream(spark, sf_small, run)
    n_err = FX.table(spark, sf_small, "events").filter("event_type = 'error'").count()
    assert spark.read.parquet(audit_root).count() == spark.read.parquet(alert_root).count() == n_err


def test_contract_stream_loses_no_request(spark, sf_small, split_events):
    run = SJ.new_run(spark, "t-contract", tempfile.mkdtemp(prefix="t-contract-", dir="/tmp"))
    SJ.contract_stream(spark, sf_small, run, source=_source(spark, sf_small, split_events))
    good, bad, audit = (spark.read.parquet(f"{run.root}/{x}") for x in ("accepted", "fallback", "audit"))
    assert good.count() + bad.count() == FX.table(spark, sf_small, "events").count()
    assert audit.count() == 2 * bad.count() > 0
    want = Q.q_fallback_rows(spark, sf_small).collect()
    assert sorted(map(tuple, bad.drop("batch_id").collect()), key=str) == sorted(map(tuple, want), key=str)


def test_ledger_stream_sets_broken_requests_aside(spark, sf_small, split_events):
    run = SJ.new_run(spark, "t-mixed", tempfile.mkdtemp(prefix="t-mixed-", dir="/tmp"))
    feed = lambda ev: FX.broken_requests(ev).withColumn("customer_email", F.lit(None).cast("string"))
    job = SJ.ledger_stream(spark, sf_small, run, source=_source(spark, sf_small, split_events), requests=feed)
    good, bad = Q.split_requests(feed(FX.table(spark, sf_small, "events")))
    ledger, firsts = job.ledger.read(), first_per_key(with_key(good))
    assert rows(ledger.withColumnRenamed("idempotency_key", "key"), "key", "ticket_id") == rows(firsts, "key", "ticket_id")
    fallback = job.committed_rows(job.fallback_root)
    assert bad.count() > 0 and rows(fallback, "event_id", "violation_text") == rows(bad, "event_id", "violation_text")
    audit = job.committed_rows(job.audit_root)
    assert audit.count() == 2 * (firsts.count() + bad.count())
    assert audit.filter(F.col("step_name") == "FALLBACK_EXCEPTION_HANDLER").count() == bad.count()


def test_checked_stream_counts_and_keeps_every_request(spark, sf_small, split_events):
    run = SJ.new_run(spark, "t-checked", tempfile.mkdtemp(prefix="t-checked-", dir="/tmp"))
    got = SJ.checked_stream(spark, sf_small, run, source=_source(spark, sf_small, split_events))
    total = {r.rule: r.n for r in got.groupBy("rule").agg(F.sum("n_rows").alias("n")).collect()}
    stored = spark.read.parquet(f"{run.root}/checked")
    assert got.filter("rule = 'rows'").count() == 4
    assert total["rows"] == stored.count() == FX.table(spark, sf_small, "events").count()
    assert total["broken"] == stored.filter("broken = 'true'").count() > 0
    for rule in ("SUBJECT_EMPTY", "BODY_REQUIRED", "TICKET_ID_REQUIRED", "SUBJECT_REQUIRED"):
        assert total[rule] == stored.filter(F.array_contains("violations", rule)).count()


def test_batch_keeps_only_what_its_outputs_read(spark, sf_small, tmp_path, monkeypatch):
    """The resolved batch is kept without account columns, with its actions as text; an unwritten table adds no empty part."""
    seen = []
    rows_of = SJ.L.ledger_rows
    monkeypatch.setattr(SJ.L, "ledger_rows", lambda res, *a, **k: seen.append(res.columns) or rows_of(res, *a, **k))
    job = SJ.ledger_stream(spark, sf_small, SJ.new_run(spark, "kept", str(tmp_path / "run")))
    assert seen and all(set(c) == {*SJ.KEPT, "actions_text"} and not [x for x in c if x.startswith("acct_")] for c in seen)
    empty = SJ.ledger_job(spark, sf_small, SJ.new_run(spark, "none", str(tmp_path / "none")))
    assert "Union" not in empty.state.read()._jdf.queryExecution().optimizedPlan().toString()
    assert empty.state.read().count() == spark.read.parquet(f"{sf_small}/customer.parquet").count() and empty.ledger.read().count() == 0
    assert job.ledger.read().count() > 0
