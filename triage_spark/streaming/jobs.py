"""Structured Streaming jobs (STR-1..5).

Each job reads a file stream, applies the same DataFrame functions as the
batch queries, and writes through ``foreachBatch`` so that one micro-batch
can feed several sinks and be replayed safely:

* every write of batch ``n`` goes to a folder named by ``n`` (overwrite), so
  a replay after a failure rewrites the same folders;
* one marker over all outputs of the batch is made last; a batch
  reads only what earlier batches committed, and is skipped if its own marker is there.

Order: tickets are applied in arrival (micro-batch) order, and by
``(created_at, ticket_id)`` inside a batch.  The stream equals the batch
query when batches arrive in time order, as the service saw them.  Keys are
remembered for ever (the ledger is the memory), so no watermark is needed
for correctness.  In front of it, ``redelivery_stream`` takes out copies of one delivery with
bounded memory: there a copy is the same row, so it matters neither which one stays nor that old ones are forgotten.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.text import epoch_micros
from ..operators import accounts as A
from ..operators import audit as AU
from ..operators import contract as CT
from ..operators import ledger as L
from ..operators import routing as RT
from ..operators.dedupe import ORDER, first_fields, first_per_key, with_key
from ..operators.gate import gate
from ..plans import triage as TR
from ..session import scratch_path
from ..sinks.runs import Commits, KeyedRuns, overwrite
from ..sources import feeds as FD
from ..sources import fixtures as FX
from . import account_fold as AF


def table_glob(sf_dir: str, name: str) -> str:
    """A glob naming one parquet file (a file stream needs a directory or a glob)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    return path[:-1] + "[" + path[-1] + "]"


def event_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None, path: str | None = None) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.parquet(path or table_glob(sf_dir, "events"))


def _run(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:  # pragma: no cover - surfaced to caller
        raise query.exception()


@dataclass
class StreamRun:
    root: str
    spark: SparkSession

    def ck(self, name: str) -> str:
        return f"{self.root}/_checkpoints/{name}"


def new_run(spark: SparkSession, name: str, root: str | None = None) -> StreamRun:
    return StreamRun(root=(root or scratch_path(spark, name)).rstrip("/"), spark=spark)


# --------------------------------------------------------------------- STR-1
def triage_stream(spark: SparkSession, sf_dir: str, run: StreamRun, source: DataFrame | None = None) -> DataFrame:
    """STR-1: every incoming request classified and gated (stateless, append sink)."""
    ev = source if source is not None else event_stream(spark, sf_dir)
    out = gate(TR.classify(with_key(FX.ticket_requests(ev))))
    q = (
        out.select("event_id", "ticket_id", "key", "category", "target_tier", "confidence_score", "status")
        .writeStream.format("parquet")
        .option("checkpointLocation", run.ck("triage"))
        .trigger(availableNow=True)
        .start(f"{run.root}/triage")
    )
    _run(q)
    return spark.read.parquet(f"{run.root}/triage")


# --------------------------------------------------------------------- SRC-1
def feed_stream(spark: SparkSession, path: str, run: StreamRun, max_files: int | None = None) -> DataFrame:
    """SRC-1: JSON-lines files of requests as a stream; broken lines stay as rows with their raw text."""
    read = FD.stream_requests(spark, path, max_files)
    out = FD.feed_report(read)
    _run(out.writeStream.format("parquet").option("checkpointLocation", run.ck("feed")).trigger(availableNow=True).start(f"{run.root}/feed"))
    return spark.read.schema(out.schema).parquet(f"{run.root}/feed")


# --------------------------------------------------------------------- STR-2
def dedupe_stream(spark: SparkSession, sf_dir: str, run: StreamRun, source: DataFrame | None = None) -> DataFrame:
    """STR-2: first request per key against everything seen so far.

    Per batch: first per key inside the batch (partial aggregate), then an
    anti join with the stored firsts of its keys; only the new firsts are written.
    """
    commits = Commits(spark, run.root)
    store = KeyedRuns(commits, "firsts", "key", S.FIRSTS_SCHEMA)

    def step(batch: DataFrame, batch_id: int) -> None:
        if commits.committed(batch_id):
            return
        names = S.FIRSTS_SCHEMA.fieldNames()
        narrow = {c: F.col(c) for c in names if c not in ("key", *ORDER)}
        firsts = first_fields(with_key(FX.ticket_requests(batch)), narrow).select(*names)
        firsts = firsts.persist()
        store.append(firsts.join(store.read(firsts.select("key")).select("key"), "key", "left_anti"), batch_id)
        commits.commit(batch_id)
        firsts.unpersist()

    ev = source if source is not None else event_stream(spark, sf_dir)
    _run(ev.writeStream.foreachBatch(step).option("checkpointLocation", run.ck("dedupe")).trigger(availableNow=True).start())
    return store.read()


def redelivery_stream(spark: SparkSession, path: str, schema: T.StructType, run: StreamRun, bound: str, id_col: str = "event_id", time: str = "created_at") -> DataFrame:
    """STR-2 with bounded memory: each row of an at-least-once feed goes on once, whatever the number of its copies.

    Reads what is new under ``path`` since the last call (same ``run``) and stops.  An id is kept in the state store
    until the watermark (the largest time read by earlier batches, in whole milliseconds, less ``bound``) has passed its time by ``bound``; a row
    whose time the watermark has passed does not go on.  So a copy that comes later than the
    bound is late as well, and no id goes on twice.  Rows without a time are not late and are one delivery for each id; a null id is an id.
    Returns all rows that went on; ``late_rows`` gives those that did not, so that none is lost.
    """
    read = spark.readStream.schema(schema).parquet(path)
    timed = read.withColumn("event_time", F.timestamp_micros(epoch_micros(time))).withWatermark("event_time", bound)
    out = timed.dropDuplicatesWithinWatermark([id_col]).drop("event_time")
    # The state needs no more memory than the feed of two bounds has ids; its rows are in RocksDB if the session says so.
    _run(out.writeStream.format("parquet").option("checkpointLocation", run.ck("redeliveries")).trigger(availableNow=True).start(f"{run.root}/once"))
    return spark.read.schema(schema).parquet(f"{run.root}/once")


def late_rows(feed: DataFrame, once: DataFrame, id_col: str = "event_id") -> DataFrame:
    """id and number of copies of the deliveries of which no copy went on."""
    copies = feed.groupBy(id_col).agg(F.count("*").alias("n_copies"))
    return copies.join(once.select(F.col(id_col).alias("once_id")), F.col(id_col).eqNullSafe(F.col("once_id")), "left_anti")


# ------------------------------------------------------------------ STR-3/4
#: Columns of a resolved batch that its outputs read, besides the actions.
KEPT = [c for c in dict.fromkeys([*L.RESOLVED_FOR_LEDGER, "gate_status", "gate_message", *A.TOOL_CALL_COLUMNS]) if c != "actions_taken"]


@dataclass
class LedgerJob:
    commits: Commits
    ledger: KeyedRuns
    state: KeyedRuns
    audit_root: str
    replies_root: str
    routes_root: str
    fallback_root: str

    def committed_rows(self, root: str) -> DataFrame:
        """The rows of an append-only output that belong to committed batches."""
        return self.commits.spark.read.parquet(root).filter(F.col("batch_id") <= self.commits.newest())


def ledger_job(spark: SparkSession, sf_dir: str, run: StreamRun) -> LedgerJob:
    accounts = FX.accounts(FX.table(spark, sf_dir, "customer")).select(
        "*", F.lit(0).cast("bigint").alias("tier_changes"), F.lit(0).cast("bigint").alias("tool_calls"),
        F.lit(False).alias("is_new"),
    )
    commits = Commits(spark, run.root)
    return LedgerJob(
        commits=commits,
        ledger=KeyedRuns(commits, "ledger", "idempotency_key", S.LEDGER_SCHEMA),
        state=KeyedRuns(commits, "accounts", "account_id", S.ACCOUNT_STATE_SCHEMA, base=accounts),
        audit_root=f"{run.root}/audit",
        replies_root=f"{run.root}/replies",
        routes_root=f"{run.root}/routes",
        fallback_root=f"{run.root}/fallback",
    )


def ledger_stream(
    spark: SparkSession, sf_dir: str, run: StreamRun, source: DataFrame | None = None, requests: Callable[[DataFrame], DataFrame] = FX.ticket_requests
) -> LedgerJob:
    """STR-3 + STR-4: per micro-batch, one transaction-like step.

    Requests (``requests`` of the batch) that break the contract (CON-1) get the fallback response and two audit rows and
    touch neither the ledger nor an account; of the others,
    hits -> cached replies; misses -> first per key -> resolve against the
    account state left by earlier batches -> changed ledger rows + audit rows + the state of the
    accounts in the batch.  All writes of batch ``n`` are keyed by ``n``, in proportion to the batch,
    and become visible together, by one marker at the end.
    """
    from ..plans.queries import fallback_outcomes, split_requests

    job = ledger_job(spark, sf_dir, run)
    tiers = FX.tiers(spark)

    def step(batch: DataFrame, batch_id: int) -> None:
        if job.commits.committed(batch_id):
            return
        # A request is a projection of its event: reading it again costs less than keeping it.
        asked = requests(batch)
        good, bad = split_requests(asked)
        bad = bad.persist()
        keyed = with_key(good.select(*asked.columns))
        known, firsts = None, first_per_key(keyed)
        if job.commits.newest() < 0:
            # nothing stored yet: no repeats of earlier batches
            new = firsts
        else:
            known = job.ledger.read(keyed.select(F.col("key").alias("idempotency_key"))).persist()
            replies = L.hits(keyed, known).select("event_id", "key", "stored_ticket_id", "stored_status", *L.cached_columns())
            overwrite(replies, f"{job.replies_root}/batch_id={batch_id}")
            new = L.misses(firsts, known, hot_rows=None)
        new = TR.classify(new).persist()
        state_t = job.state.read(new.select(A.normalize_id("customer_id").alias("account_id"))).persist()
        hot = A.hot_accounts(new).persist()
        res = TR.resolve(new, state_t.select("account_id", *A.ACCOUNT_FIELDS), tiers, deduped=True, hot=hot, classified=True)
        # Kept once, as the outputs need it: the actions as text, no account columns.
        res = res.select(*KEPT, L.actions_json().alias("actions_text")).persist()
        actions = F.col("actions_text")
        rows = L.ledger_rows(res, actions=actions)
        if known is not None:
            rows = L.upsert(known, rows).filter("change <> 'KEPT'").drop("change")
        job.ledger.append(rows, batch_id)
        # SNK-2: append-only audit, one folder per batch (replay-safe), by log date inside
        steps = AU.step_rows(res).select(*AU.AUDIT_COLUMNS).unionAll(AU.fallback_step_rows(bad).select(*AU.AUDIT_COLUMNS))
        overwrite(AU.with_log_date(steps), f"{job.audit_root}/batch_id={batch_id}", "log_date")
        overwrite(fallback_outcomes(bad), f"{job.fallback_root}/batch_id={batch_id}")
        # SNK-3, SNK-4, SNK-7: one folder per route, each row with its message and the full response
        routed = RT.with_route(res).withColumn("message", RT.route_message(actions))
        routed = routed.select("key", "ticket_id", "message", RT.response_json(actions).alias("response"), "route")
        overwrite(routed, f"{job.routes_root}/batch_id={batch_id}", "route")
        job.state.append(A.account_state(state_t, A.tool_calls(res)), batch_id)
        job.commits.commit(batch_id)
        for d in (res, state_t, hot, new, bad, known):
            if d is not None:
                d.unpersist()

    ev = source if source is not None else event_stream(spark, sf_dir)
    _run(ev.writeStream.foreachBatch(step).option("checkpointLocation", run.ck("ledger")).trigger(availableNow=True).start())
    return job


def account_fold_stream(spark: SparkSession, path: str, accounts: DataFrame, run: StreamRun) -> DataFrame:
    """STR-4 with keyed state in the state store: applies the tool calls that are new under ``path`` and stops.

    ``accounts`` is the account table before the first call; later calls with the same ``run`` go on from the checkpoint.  Each
    batch stores the accounts that it moved, replay-safe; returns all accounts as of the last batch.
    """
    base = accounts.withColumns({"tier_changes": F.lit(0).cast("long"), "tool_calls": F.lit(0).cast("long"), "is_new": F.lit(False)}).select(*S.ACCOUNT_STATE_SCHEMA.fieldNames())
    commits = Commits(spark, run.root)
    store = KeyedRuns(commits, "accounts", "account_id", S.ACCOUNT_STATE_SCHEMA, base=base)

    def step(batch: DataFrame, batch_id: int) -> None:
        if not commits.committed(batch_id):
            store.append(AF.with_fields(batch, base, A.default_account_values(F.col("account_id"))), batch_id)
            commits.commit(batch_id)

    calls = spark.readStream.schema(AF.CALLS).parquet(path)
    with AF.rocksdb(spark):
        moved = AF.moved_accounts(calls, base)
        _run(moved.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", run.ck("accounts")).trigger(availableNow=True).start())
    return store.read()


# --------------------------------------------------------------------- STR-5
def failure_stream(spark: SparkSession, sf_dir: str, run: StreamRun, source: DataFrame | None = None) -> tuple[str, str]:
    """STR-5: failure feed -> audit rows and alert rows, two sinks from one batch."""
    from ..operators.routing import ops_alert
    from ..plans.queries import failure_audit

    audit_root, alert_root = f"{run.root}/failure_audit", f"{run.root}/alerts"

    def step(batch: DataFrame, batch_id: int) -> None:
        f = FD.parse_failures(FX.workflow_failures_raw(batch)).persist()
        overwrite(failure_audit(f), f"{audit_root}/batch_id={batch_id}")
        overwrite(f.select(ops_alert().alias("a")).select("a.*"), f"{alert_root}/batch_id={batch_id}")
        f.unpersist()

    ev = source if source is not None else event_stream(spark, sf_dir)
    _run(ev.writeStream.foreachBatch(step).option("checkpointLocation", run.ck("failures")).trigger(availableNow=True).start())
    return audit_root, alert_root


# --------------------------------------------------------------------- STR-6
def contract_stream(spark: SparkSession, sf_dir: str, run: StreamRun, source: DataFrame | None = None) -> None:
    """STR-6: requests that keep the contract go on, the others get the fallback response and two audit rows.

    Three outputs of one batch, under ``accepted``, ``fallback`` and ``audit``; no
    request is lost and none stops the job.
    """
    from ..plans.queries import fallback_outcomes, split_requests

    def step(batch: DataFrame, batch_id: int) -> None:
        requests = FX.broken_requests(batch).persist()
        good, bad = split_requests(requests)
        overwrite(good.select(*requests.columns), f"{run.root}/accepted/batch_id={batch_id}")
        overwrite(fallback_outcomes(bad), f"{run.root}/fallback/batch_id={batch_id}")
        overwrite(AU.fallback_step_rows(bad).select(*AU.AUDIT_COLUMNS), f"{run.root}/audit/batch_id={batch_id}")
        requests.unpersist()

    ev = source if source is not None else event_stream(spark, sf_dir)
    _run(ev.writeStream.foreachBatch(step).option("checkpointLocation", run.ck("contract")).trigger(availableNow=True).start())


# --------------------------------------------------------------------- CON-1, one pass
def checked_stream(spark: SparkSession, sf_dir: str, run: StreamRun, source: DataFrame | None = None) -> DataFrame:
    """CON-1: good and quarantined requests of each batch, stored in one pass that also counts them.

    Returns contract, rule, n_rows with one row for each rule and batch; a replayed batch writes its counts again.
    """
    from ..plans.queries import count_rows

    rules = CT.request_rules()

    def step(batch: DataFrame, batch_id: int) -> None:
        counts = CT.store_checked(CT.check(FX.broken_requests(batch), rules), rules, f"{run.root}/checked/batch_id={batch_id}")
        overwrite(count_rows(batch.sparkSession, {"request": counts}), f"{run.root}/counts/batch_id={batch_id}")

    ev = source if source is not None else event_stream(spark, sf_dir)
    _run(ev.writeStream.foreachBatch(step).option("checkpointLocation", run.ck("checked")).trigger(availableNow=True).start())
    return spark.read.parquet(f"{run.root}/counts").drop("batch_id")
