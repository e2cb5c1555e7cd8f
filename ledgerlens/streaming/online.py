"""The online job: one streaming query from records to every output table, one commit per micro-batch.

A micro-batch is a table, so it goes through the operators of the batch job, continued from the state that the
batches before it left (``streaming.state``).  Records are read and parsed once; outputs, invalid records and state
become visible together by the batch's commit.  The rule set is resolved once per batch, from the accepted
snapshots, and pinned by the commit.  There is no watermark: late rows are evaluated, never dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.functions.ids import event_fingerprint
from ledgerlens.operators import assessment, identity
from ledgerlens.operators.ordering import with_arrival
from ledgerlens.operators.rules import MAX_DEPTH, RuleSet
from ledgerlens.operators.rulesets import ACTIVE_KEY, accept_snapshots, load_rulesets as compile_accepted, validate_snapshots
from ledgerlens.plans.incremental import advance
from ledgerlens.plans.risk import DEFAULT_BUCKETS, with_bucket
from ledgerlens.session import ensure_checkpoint_dir, materialize, staging
from ledgerlens.sources.ingest import TRANSACTION_TOPIC, invalid_references, parse_events
from ledgerlens.sources.records import OUTPUTS, write_records
from ledgerlens.sources.tables import write_outputs
from ledgerlens.streaming.commits import Commits
from ledgerlens.streaming.state import ARRIVAL, State

RULESETS = "_rulesets"
RECORDS = "_records"
WRITERS = 5
SNAPSHOT_COLUMNS = ("version", "payload", "arrival_seq")
Loader = Callable[[SparkSession, set[int]], Mapping[int, RuleSet]]


class NotReady(RuntimeError):
    """No valid rule set is loaded, so the job must not start."""


def require_ruleset(accepted: DataFrame) -> None:
    if accepted.isEmpty():
        raise NotReady("NO_VALID_RULESET_LOADED")


# ---------------------------------------------------------------- rule sets


def _node_type(depth: int) -> str:
    children = f",children:array<{_node_type(depth - 1)}>" if depth > 1 else ""
    return f"struct<windowSeconds:string{children}>"


def windows_of(payload: Column) -> Column:
    """The windows a sound snapshot's rules look at, from its parsed definitions, read as the compiler reads numbers."""
    rules = F.from_json(payload, f"rules array<struct<definition:{_node_type(MAX_DEPTH)}>>")["rules"]
    nodes, found = F.transform(rules, lambda r: r["definition"]), []
    for depth in range(MAX_DEPTH, 0, -1):
        found.append(F.transform(nodes, lambda n: n["windowSeconds"].try_cast("double").cast("int")))
        if depth > 1:
            nodes = F.flatten(F.transform(F.filter(nodes, lambda n: n["children"].isNotNull()), lambda n: n["children"]))
    return F.array_distinct(F.filter(F.concat(*found), lambda s: s.isNotNull()))


def accept_rulesets(snapshots: DataFrame, out: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Keep the sound snapshots of rising versions as a table; a commit's ``version`` is the highest so far."""
    spark = snapshots.sparkSession

    def accept(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        commits = Commits(session, f"{out}/{RULESETS}")
        if commits.get(batch_id):
            return
        current = (commits.before(batch_id) or {}).get("version")
        with staging(session):
            sound = validate_snapshots(batch.where(F.col("key") == ACTIVE_KEY))
            newer = materialize(sound if current is None else sound.where((F.col("version") > current) | F.col("version").isNull()))
            accepted = accept_snapshots(newer).where("disposition = 'accepted'").select(
                *SNAPSHOT_COLUMNS, windows_of(F.col("payload")).alias("windows"))
            write_outputs({"accepted": accepted}, f"{out}/{RULESETS}", batch_id)
            highest = session.read.parquet(f"{out}/{RULESETS}/accepted/batch_id={batch_id}").agg(F.max("version")).first()[0]
        commits.put(batch_id, {"version": current if highest is None else highest})

    ensure_checkpoint_dir(spark)
    return (snapshots.writeStream.foreachBatch(accept).outputMode("append")
            .option("checkpointLocation", f"{checkpoint}/rulesets").trigger(**trigger).start())


def active_version(spark: SparkSession, out: str) -> int | None:
    """Version of the highest accepted rule set, None before the first."""
    commits = Commits(spark, f"{out}/{RULESETS}")
    return (commits.get(commits.last()) or {}).get("version")


def stored_rulesets(spark: SparkSession, out: str) -> Loader:
    """Compiles the asked versions from the accepted snapshots; those already compiled are kept."""
    known: dict[int, RuleSet] = {}

    def load(session: SparkSession, versions: set[int]) -> Mapping[int, RuleSet]:
        missing = versions - set(known)
        if missing:
            known.clear()
            known.update(compile_accepted(Commits(session, f"{out}/{RULESETS}").visible("accepted"), versions))
        return known

    return load


# ---------------------------------------------------------------- events


def event_outputs(resolved: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    """What is said about the records of a micro-batch themselves, with the expressions of the batch job."""
    return {
        "disposition": resolved.select("arrival_seq", "outcome"),
        "quarantine": identity.quarantine_references(resolved, TRANSACTION_TOPIC),
        "invalid": invalid_references(events),
    }


def alert_outputs(assessed: DataFrame) -> dict[str, DataFrame]:
    alerted = assessment.alerts(assessed)
    return {"alert": alerted, "notification_request": assessment.notification_requests(alerted)}


def prepared(records: DataFrame, buckets: int = DEFAULT_BUCKETS, bucket: Column | None = None) -> DataFrame:
    """Parsed records with bucket and fingerprint; ``arrival_seq`` is NULL where the source gives none."""
    if "arrival_seq" not in records.columns:
        records = records.withColumn("arrival_seq", F.lit(None).cast("long"))
    parsed = parse_events(records).drop("violations")
    parsed = with_bucket(parsed, buckets) if bucket is None else parsed.withColumn("bucket", bucket.cast("long"))
    return parsed.withColumn("fingerprint", F.when(F.col("valid"), event_fingerprint(F.col("occurred_us"))))


def process(batch: DataFrame, batch_id: int, out: str, load_rulesets: Loader, *, numbered: bool = True, records: bool = False,
            on_written: Callable[[int], None] | None = None) -> None:
    """Evaluate one micro-batch of prepared records and commit it; does nothing if it is committed already.

    ``numbered`` says whether they have an arrival number; else they get one from their offsets.  With ``records`` every output
    is also written as key and JSON value, below ``RECORDS``.
    """
    spark = batch.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "true")  # a micro-batch is planned like any table
    commits = Commits(spark, out)
    if commits.get(batch_id):
        return
    commit = commits.before(batch_id)
    state, version = State(spark, out, commit), active_version(spark, out)
    if version is None:
        raise NotReady("NO_VALID_RULESET_LOADED")
    rules = load_rulesets(spark, {version})
    with staging(spark):
        seen, came, following = Observation(), None, (commit or {}).get("next_seq", 0)
        events = batch.withColumn("ruleset_version", F.lit(version).cast("long"))
        if not numbered:
            events, came = with_arrival(materialize(events.drop("arrival_seq")), state.clocks().where(F.col("stage") == ARRIVAL), following,
                                        stamp=F.col("received_us"))
        events = materialize(events.observe(seen, F.max("arrival_seq").alias("last")))
        step = advance(events, state.clocks(), state.entries, rules[version].windows())
        clocks = step.clocks if came is None else step.clocks.unionByName(came.withColumn("stage", F.lit(ARRIVAL)))

        with ThreadPoolExecutor(WRITERS) as pool:  # tables that do not depend on each other
            def later(outputs: dict[str, DataFrame]) -> list:
                return [pool.submit(put, {name: df}, to, batch_id) for name, df in outputs.items()
                        for put, to in ((write_outputs, out), (write_records, f"{out}/{RECORDS}")) if put is write_outputs or records and name in OUTPUTS]

            writing = later(event_outputs(step.resolved, events))
            kept = pool.submit(state.advanced, batch_id, step.entries, clocks)
            write_outputs({"assessment": assessment.assessments(assessment.evaluate(step.evaluable, {version: rules[version]}))}, out, batch_id)
            assessed = spark.read.parquet(f"{out}/assessment/batch_id={batch_id}")
            writing += later(alert_outputs(assessed))
            if records:
                writing.append(pool.submit(write_records, {"assessment": assessed}, f"{out}/{RECORDS}", batch_id))
            for w in writing:
                w.result()
            kept = kept.result()
        following = following if seen.get["last"] is None else seen.get["last"] + 1
    if on_written:
        on_written(batch_id)
    commits.put(batch_id, {"ruleset_version": version, "next_seq": following, "state": kept})
    state.forget(kept)


def start(
    records: DataFrame,
    snapshots: DataFrame,
    load_rulesets: Loader | None,
    out: str,
    checkpoint: str,
    *,
    partitions: int | None = None,
    buckets: int = DEFAULT_BUCKETS,
    bucket: Column | None = None,
    state_partitions: int | None = None,
    trigger: dict | None = None,
    as_records: bool = False,
    on_written: Callable[[int], None] | None = None,
) -> tuple[StreamingQuery, ...]:
    """Start the evaluating query, after the snapshots that are there have been looked at.

    ``records`` has the columns of a topic (key, value, partition, offset, timestamp); an ``arrival_seq`` is used if there is one.
    ``load_rulesets`` gives compiled rule sets by version; None compiles the accepted snapshots.  Raises NotReady if no sound
    rule set was ever published.  With a recurring ``trigger`` a second query goes on accepting snapshots.
    ``as_records`` also writes every output in the form that goes to a topic.  ``bucket`` replaces the default hash of the customer.  ``on_written`` is told the number of a batch whose tables are
    written and not yet committed; what it raises stops the query, and the batch is done again.  ``partitions`` and ``state_partitions`` are not needed any more: work follows
    the keys of a batch, by the shuffle settings of the session.
    """
    spark = records.sparkSession
    first = accept_rulesets(snapshots, out, checkpoint, {"availableNow": True})
    first.awaitTermination()
    if first.exception() is not None:
        raise first.exception()
    if active_version(spark, out) is None:
        raise NotReady("NO_VALID_RULESET_LOADED")
    commits = Commits(spark, out)
    State(spark, out, commits.get(commits.last())).sweep()
    loader = load_rulesets or stored_rulesets(spark, out)
    more = [accept_rulesets(snapshots, out, checkpoint, trigger)] if trigger and "availableNow" not in trigger and "once" not in trigger else []

    def write(batch: DataFrame, batch_id: int) -> None:
        process(batch, batch_id, out, loader, numbered=numbered, records=as_records, on_written=on_written)

    numbered = "arrival_seq" in records.columns
    main = (prepared(records, buckets, bucket).writeStream.foreachBatch(write).outputMode("append")
            .option("checkpointLocation", f"{checkpoint}/evaluate").trigger(**(trigger or {"availableNow": True})).start())
    return (main, *more)


def read_output(spark: SparkSession, out: str, name: str) -> DataFrame:
    """Committed rows of an output table."""
    return Commits(spark, out).visible(name)


def read_records(spark: SparkSession, out: str, name: str) -> DataFrame:
    """Committed (key, value) records of an output."""
    return Commits(spark, out).visible(f"{RECORDS}/{name}").select("key", "value")
