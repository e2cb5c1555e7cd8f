"""The delivery ledger online: requests and delivery outcomes in, ledger rows and result records out.

One query over a log in arrival order (``at``): requests as records (kind CLAIM, key and JSON value) and outcomes of whoever delivers.
A micro-batch continues the ledger rows of its requests; the rows it changes are appended as a run with the batch's number as version,
and runs are merged now and then, so a batch costs what its requests cost.  Outputs and ledger become visible by one commit.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.operators import notifications
from ledgerlens.session import ensure_checkpoint_dir, materialize, staging
from ledgerlens.sources.records import from_records, write_records
from ledgerlens.sources.tables import write_outputs
from ledgerlens.streaming.commits import Commits
from ledgerlens.streaming.state import State, Table

LOG = ("kind string, at long, at_us long, key string, value string, notificationRequestId string, attempt int, "
       "channel string, providerReference string, reasonCode string")
LEDGER = {"ledger": Table(f"{notifications.LEDGER}, version long", key=("notificationRequestId",))}
RESULT = "notification_result"


def delivery_log(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log with the request's fields on its claims, and the claims that are no sound request (key, at, reject_reason)."""
    claims = notifications.check_requests(rows.where("kind = 'CLAIM'").select("kind", "at", "at_us", "key", "value")).drop("notificationRequestId")
    fields = [F.unix_micros(c).alias(c) if c == "requestedAt" else F.col(c) for c in notifications.REQUEST_FIELDS]
    sound = from_records("notification_request", claims.where("reject_reason IS NULL").drop("reject_reason")).select(
        "kind", "at", "at_us", "notificationRequestId", *fields)
    outcomes = rows.where("kind <> 'CLAIM'").drop("key", "value")
    return outcomes.unionByName(sound, allowMissingColumns=True), claims.where("reject_reason IS NOT NULL").select("key", "at", "reject_reason")


def process(batch: DataFrame, batch_id: int, out: str) -> None:
    """Bring the ledger forward by one micro-batch; does nothing if that is committed already."""
    spark = batch.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    commits = Commits(spark, out)
    if commits.get(batch_id):
        return
    state = State(spark, out, commits.before(batch_id), LEDGER)
    with staging(spark):
        rows, rejected = delivery_log(materialize(batch))
        rows = materialize(rows)
        prior = materialize(state.entries("ledger", rows.select("notificationRequestId")).drop("version"))
        resolved = materialize(notifications.with_results(rows, prior))
        found = materialize(notifications.results(resolved, prior))
        ledger = notifications.ledger_rows(resolved, prior).withColumn("version", F.lit(batch_id).cast("long"))
        with ThreadPoolExecutor(4) as pool:  # tables that do not depend on each other
            writing = [pool.submit(write_outputs, {RESULT: found, "refused": notifications.refusals(resolved), "rejected": rejected}, out, batch_id),
                       pool.submit(write_records, {RESULT: found}, f"{out}/_records", batch_id)]
            kept = state.advanced(batch_id, {"ledger": ledger})
            for w in writing:
                w.result()
    commits.put(batch_id, {"state": kept})
    state.forget(kept)


def start(log: DataFrame, out: str, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Start the query over a log with the columns of ``LOG``."""
    spark = log.sparkSession
    ensure_checkpoint_dir(spark)
    commits = Commits(spark, out)
    State(spark, out, commits.get(commits.last()), LEDGER).sweep()

    def write(batch: DataFrame, batch_id: int) -> None:
        process(batch, batch_id, out)

    return (log.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{checkpoint}/delivery")
            .trigger(**(trigger or {"availableNow": True})).start())


def read_ledger(spark: SparkSession, out: str) -> DataFrame:
    """Committed ledger rows, one per request."""
    commits = Commits(spark, out)
    return State(spark, out, commits.get(commits.last()), LEDGER).entries("ledger").drop("version")


def read_results(spark: SparkSession, out: str, *, records: bool = False) -> DataFrame:
    """Committed result rows, or their records."""
    return Commits(spark, out).visible(f"_records/{RESULT}" if records else RESULT).drop("batch_id")
