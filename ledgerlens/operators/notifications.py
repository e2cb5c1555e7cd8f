"""Notification requests, contacts and the delivery ledger.

The attempt log of a request (claims and outcomes in order) is resolved without
walking it row by row: attempt n ends at the first outcome numbered n after its
claim, and the next claim after a failure opens attempt n + 1.  Both are "first at
or after" look-ups, so a request with a very long log is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ordering import first_at_or_after, follow_chain
from ledgerlens.session import materialize
from ledgerlens.sources.contracts import flat_struct, same_text, values_conform, violations

# Channel and reason codes.
CHANNEL = "EMAIL"
CONTACT_FAILED = "CONTACT_RESOLUTION_FAILED"
CHANNEL_FAILED = "CHANNEL_DELIVERY_FAILED"
IN_PROGRESS = "DELIVERY_ALREADY_IN_PROGRESS"
NOT_SENDING = "DELIVERY_NOT_SENDING"

CELL = 1 << 16


def check_requests(records: DataFrame) -> DataFrame:
    """Add reject_reason to request records (key, value): contract first, then the key.

    Most records are written in declared order and sound: only the others are parsed as JSON of any shape.
    """
    contract, text = "notification_request", F.col("value").cast("string")
    t, v = F.col("__t"), F.col("__v")
    sound = records.withColumn("__t", F.from_json(text, flat_struct(contract))).withColumn(
        "__sound", same_text(contract, t, text) & values_conform(contract, t)).withColumn("__v", F.when(~F.col("__sound"), F.try_parse_json(text)))
    reason = F.when(~F.col("__sound") & (F.size(violations(contract, text, v)) > 0), "INVALID_NOTIFICATION_REQUEST").when(
        ~F.coalesce(F.col("key") == F.col("notificationRequestId"), F.lit(False)), "KEY_MISMATCH")
    request_id = F.when(F.col("__sound"), t["notificationRequestId"]).otherwise(F.try_variant_get(v, "$.notificationRequestId", "string"))
    # The generator keeps filters on the reason from being rewritten in terms of the whole check, which would evaluate it once per filter.
    return sound.withColumn("notificationRequestId", request_id).withColumn("reject_reason", F.explode(F.array(reason))).drop("__t", "__v", "__sound")


def with_contact(requests: DataFrame, contacts: DataFrame) -> DataFrame:
    """Add the contact and, where there is none, the failure reason.

    Contacts are one row per customer; the join follows their measured size.
    """
    return requests.join(contacts, "customerId", "left").withColumn(
        "contact_failure", F.when(F.col("contact").isNull(), CONTACT_FAILED))


def new_requests(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """Requests not yet in the ledger, once each: the first to arrive is inserted.

    Arrival is ``arrival_seq`` where there is one, else ``requestedAt``, else the least row.
    """
    rid = "notificationRequestId"
    order = next((c for c in ("arrival_seq", "requestedAt") if c in requests.columns), None)
    row = F.struct(*requests.columns)
    once = requests.groupBy(F.col(rid).alias("__rid")).agg(
        (F.min_by(row, order) if order else F.min(row)).alias("first")).select("first.*")
    return once.join(ledger.select("notificationRequestId"), "notificationRequestId", "left_anti")


def to_send(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """What a claim would do for each request: ACQUIRE, ALREADY_SENT or IN_PROGRESS."""
    state = ledger.select("notificationRequestId", F.col("status").alias("ledger_status"),
                          F.col("attempt_count").alias("ledger_attempts"))
    return requests.join(state, "notificationRequestId", "left").withColumn(
        "claim",
        F.when(F.col("ledger_status") == "SENT", "ALREADY_SENT")
        .when(F.col("ledger_status") == "SENDING", "IN_PROGRESS").otherwise("ACQUIRE"),
    ).withColumn(
        "attempt_count",
        F.coalesce("ledger_attempts", F.lit(0)) + F.when(F.col("claim") == "ACQUIRE", 1).otherwise(0))


def replayed_results(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """Stored result re-emitted for requests that were sent before."""
    sent = ledger.filter("status = 'SENT'")
    return requests.select("notificationRequestId").join(sent, "notificationRequestId", "inner")


def outcome_reason(contact_ok, channel_ok):
    """Failure reason of an attempt; NULL when it was sent."""
    return F.when(~contact_ok, CONTACT_FAILED).when(~channel_ok, CHANNEL_FAILED)


def resolve_attempts(log: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Add result and attempt_no to each row of an attempt log.

    ``log``: notificationRequestId, at (unique per request), kind (CLAIM, SENT or
    FAILED), attempt (the number an outcome reports).  Results: ACQUIRED, ALREADY_SENT,
    IN_PROGRESS for claims; APPLIED or DELIVERY_NOT_SENDING for outcomes.
    ``prior`` are ledger rows (status, attempt_count) that the log continues.
    """
    rid = "notificationRequestId"
    log = materialize(log.select(rid, "at", "kind", "attempt"))
    claims = log.filter("kind = 'CLAIM'").select(rid, "at")
    outcomes = log.filter("kind <> 'CLAIM'")
    numbered = outcomes.select(rid, F.col("attempt").alias("no"), "at")

    first_claim = claims.groupBy(rid).agg(F.min("at").alias("claimed")).withColumn("no", F.lit(1))
    already = None
    if prior is not None:
        # before the first row of a request, its ledger row says what is open, done or counted
        begun = materialize(log.groupBy(rid).agg((F.min("at") - 1).alias("before")).join(
            prior.select(rid, F.col("status").alias("was"), F.col("attempt_count").alias("counted")), rid))
        free = first_claim.drop("no").join(begun, rid, "left").filter("was IS NULL OR was IN ('PENDING', 'FAILED')")
        first_claim = free.select(rid, "claimed", (F.coalesce("counted", F.lit(0)) + 1).cast("int").alias("no"))
        already = begun.filter("was = 'SENT'").select(rid, F.col("before").alias("sent_at"))
    opened = first_claim.withColumn("src", F.col("claimed"))
    if prior is not None:
        opened = opened.unionByName(begun.filter("was = 'SENDING'").select(
            rid, F.col("before").alias("claimed"), F.col("counted").cast("int").alias("no"), F.col("before").alias("src")))
    start = _first_outcome(opened, numbered)
    start = start.filter(F.col("nxt").isNotNull()).select(rid, F.col("nxt").alias("src"))

    failed = outcomes.filter("kind = 'FAILED'")
    reclaim = materialize(first_at_or_after(
        claims, failed.select(rid, F.col("at").alias("src"), (F.col("at") + 1).alias("at")), [rid], CELL,
    ).filter(F.col("nxt").isNotNull()).withColumnRenamed("nxt", "claimed"))
    following = reclaim.join(
        failed.select(rid, F.col("at").alias("src"), (F.col("attempt") + 1).alias("no")), [rid, "src"])
    links = _first_outcome(following, numbered)
    applied = follow_chain(start, links, [rid]).withColumnRenamed("src", "at")

    effective = materialize(applied.join(outcomes, [rid, "at"]))
    acquired = first_claim.select(rid, F.col("claimed").alias("at"), F.col("no").alias("attempt_no")).unionByName(
        effective.filter("kind = 'FAILED'").select(rid, F.col("at").alias("src"), (F.col("attempt") + 1).alias("attempt_no"))
        .join(reclaim, [rid, "src"]).select(rid, F.col("claimed").alias("at"), "attempt_no"))
    sent = effective.filter("kind = 'SENT'").select(rid, F.col("at").alias("sent_at"))
    if already is not None:
        sent = sent.unionByName(already)
    marks = acquired.withColumn("mark", F.lit("ACQUIRED")).unionByName(
        effective.select(rid, "at", F.col("attempt").alias("attempt_no"), F.lit("APPLIED").alias("mark")))
    return (
        log.join(marks, [rid, "at"], "left").join(sent, rid, "left")
        .withColumn("result", F.coalesce(
            "mark",
            F.when(F.col("kind") != "CLAIM", NOT_SENDING)
            .when(F.col("at") > F.col("sent_at"), "ALREADY_SENT").otherwise("IN_PROGRESS")))
        .drop("mark", "sent_at")
    )


def _first_outcome(claimed: DataFrame, numbered: DataFrame) -> DataFrame:
    """First outcome of attempt ``no`` after ``claimed``; returns request, src, nxt."""
    rid = "notificationRequestId"
    probes = claimed.select(rid, "no", "src", (F.col("claimed") + 1).alias("at"))
    return first_at_or_after(numbered, probes, [rid, "no"], CELL).select(rid, "src", "nxt")


def ledger(resolved: DataFrame) -> DataFrame:
    """Current ledger row per request: status, attempt_count, sent_at."""
    return resolved.groupBy("notificationRequestId").agg(
        F.count_if(F.col("result") == "ACQUIRED").alias("attempt_count"),
        F.count_if((F.col("result") == "APPLIED") & (F.col("kind") == "FAILED")).alias("__failed"),
        F.max(F.when((F.col("result") == "APPLIED") & (F.col("kind") == "SENT"), F.col("at"))).alias("sent_at"),
    ).withColumn(
        "status",
        F.when(F.col("sent_at").isNotNull(), "SENT")
        .when(F.col("attempt_count") == 0, "PENDING")
        .when(F.col("attempt_count") > F.col("__failed"), "SENDING").otherwise("FAILED"),
    ).drop("__failed")


# ---------------------------------------------------------------- the whole ledger row

# What the insert of a request keeps, and what its row says besides.
REQUEST_FIELDS = ("alertId", "customerId", "transactionId", "category", "templateId", "locale", "requestedAt", "traceId")
LEDGER = ("notificationRequestId string, alertId string, customerId string, transactionId string, category string, templateId string, "
          "locale string, requestedAt long, traceId string, status string, attempt_count int, channel string, providerReference string, "
          "lastErrorCode string, created_us long, updated_us long")
LEDGER_COLUMNS = tuple(c.split()[0] for c in LEDGER.split(", "))


def with_results(log: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """The whole rows of a delivery log with result and attempt_no.

    ``log`` has, besides what ``resolve_attempts`` needs, at_us, channel, providerReference and reasonCode
    (of outcomes) and the request's fields (of claims).
    """
    found = resolve_attempts(log, prior).select("notificationRequestId", "at", "result", "attempt_no")
    said = log.withColumn("channel", F.when(F.col("kind") != "CLAIM", F.coalesce("channel", F.lit(CHANNEL))))
    return said.join(found, ["notificationRequestId", "at"])


def refusals(resolved: DataFrame) -> DataFrame:
    """Rows of a resolved log that changed nothing and gave no result, with the reason."""
    reason = F.when(F.col("result") == "IN_PROGRESS", IN_PROGRESS).when(F.col("result") == NOT_SENDING, NOT_SENDING)
    return resolved.select("notificationRequestId", "at", "kind", reason.alias("reasonCode")).filter("reasonCode IS NOT NULL")


def ledger_rows(resolved: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Ledger rows of all requests of a resolved log, after it.

    The first claim inserts the request.  A claim that is acquired clears reference and error and keeps the channel of
    the attempt before; an applied outcome says all three.  Outcomes of requests nobody claimed leave no row.
    """
    rid, took = "notificationRequestId", F.col("result").isin("ACQUIRED", "APPLIED")
    row = F.struct("at_us", "attempt_no", "kind", "channel", "providerReference", "reasonCode")
    now = resolved.groupBy(rid).agg(
        F.min_by(F.when(F.col("kind") == "CLAIM", F.struct(*REQUEST_FIELDS, "at_us")), F.when(F.col("kind") == "CLAIM", F.col("at"))).alias("inserted"),
        F.max_by(row, F.when(took, F.col("at"))).alias("last"),
        F.max_by("channel", F.when(F.col("result") == "APPLIED", F.col("at"))).alias("through"))
    if prior is None:
        now = now.withColumn("old", F.lit(None).cast(f"struct<{', '.join(c.replace(' ', ':', 1) for c in LEDGER.split(', ')[1:])}>"))
    else:
        now = now.join(prior.select(rid, F.struct(*LEDGER_COLUMNS[1:]).alias("old")), rid, "left")
    known, last = F.col("old").isNotNull(), F.col("last")
    status = F.when(last.isNull(), F.coalesce("old.status", F.lit("PENDING"))).when(last["kind"] == "CLAIM", "SENDING").otherwise(last["kind"])
    return now.filter(known | F.col("inserted").isNotNull()).select(
        rid, *[F.when(known, F.col(f"old.{c}")).otherwise(F.col(f"inserted.{c}")).alias(c) for c in REQUEST_FIELDS],
        status.alias("status"), F.coalesce(last["attempt_no"], "old.attempt_count", F.lit(0)).cast("int").alias("attempt_count"),
        F.coalesce("through", "old.channel").alias("channel"),
        F.when(last.isNull(), F.col("old.providerReference")).when(last["kind"] == "SENT", last["providerReference"]).alias("providerReference"),
        F.when(last.isNull(), F.col("old.lastErrorCode")).when(last["kind"] == "FAILED", last["reasonCode"]).alias("lastErrorCode"),
        F.coalesce("old.created_us", "inserted.at_us").alias("created_us"),
        F.coalesce(last["at_us"], "old.updated_us", "inserted.at_us").alias("updated_us"))


def results(resolved: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Result records: one per applied outcome, and the stored one again for every claim of a request that was sent.

    Claims of a request in delivery and outcomes nobody waits for give none.
    """
    rid = "notificationRequestId"
    shape = (F.lit(1).alias("schemaVersion"), rid, "channel", F.col("kind").alias("status"), F.col("attempt_no").alias("attemptCount"),
             "providerReference", "reasonCode", F.col("at_us").alias("updatedAt"), "traceId")
    claimed = resolved.filter("kind = 'CLAIM'")
    traces = claimed.groupBy(rid).agg(F.min_by("traceId", "at").alias("first_trace"))
    if prior is not None:
        traces = traces.join(prior.select(rid, F.col("traceId").alias("old_trace")), rid, "full").select(
            rid, F.coalesce("old_trace", "first_trace").alias("first_trace"))
    applied = resolved.filter("result = 'APPLIED'").drop("traceId").join(traces.withColumnRenamed("first_trace", "traceId"), rid).select("at", *shape)
    stored = applied.filter("status = 'SENT'").drop("at")
    if prior is not None:
        stored = stored.unionByName(prior.filter("status = 'SENT'").select(
            F.lit(1).alias("schemaVersion"), rid, "channel", "status", F.col("attempt_count").alias("attemptCount"), "providerReference",
            F.col("lastErrorCode").alias("reasonCode"), F.col("updated_us").alias("updatedAt"), "traceId"))
    again = claimed.filter("result = 'ALREADY_SENT'").select(rid, "at").join(stored, rid)
    return applied.unionByName(again)
