"""Behaviour of the whole batch job on small, hand-written streams."""

import pytest

from helpers import amount, count, event, record_frame, ruleset
from ledgerlens.plans.risk import run_batch
from ledgerlens.sources.ingest import parse_events
from pyspark.sql import functions as F

HOUR = 3600


def run(spark, events, *definitions, severities=None, buckets_same=True, **options):
    parsed = parse_events(record_frame(spark, events)).withColumn("ruleset_version", F.lit(1).cast("long"))
    if buckets_same:
        parsed = parsed.withColumn("bucket", F.lit(0).cast("long"))
    return run_batch(parsed, {1: ruleset(*definitions, severities=severities)}, **options)


def statuses(out):
    return {r.eventId: r.status for r in out.assessments.select("eventId", "status").collect()}


def outcomes(out):
    return [r.outcome for r in out.dispositions.orderBy("arrival_seq").collect()]


def test_below_at_and_above_the_limit(spark):
    out = run(spark, [event(1, amountMinor=9999), event(2, amountMinor=10000), event(3, amountMinor=20000, currency="USD")],
              amount(10000))
    assert statuses(out) == {"event-1": "NOT_SUSPICIOUS", "event-2": "SUSPICIOUS", "event-3": "NOT_SUSPICIOUS"}
    [alert], [request] = out.alerts.collect(), out.requests.collect()
    assert request.alertId == alert.alertId and alert.eventId == "event-2"
    assert [(m.ruleId, m.evidenceCodes) for m in alert.matchedRules] == [("rule-0", ["AMOUNT_AT_OR_ABOVE_THRESHOLD"])]
    assert "channel" not in request.asDict() and request.locale == "pt-BR"


def test_two_matches_make_one_alert_of_the_highest_severity(spark):
    out = run(spark, [event(1)], amount(1), amount(2), severities=["HIGH", "CRITICAL"])
    [alert] = out.alerts.collect()
    assert alert.severity == "CRITICAL" and len(alert.matchedRules) == 2


def test_replay_is_silent_and_reuse_is_quarantined(spark):
    out = run(spark, [event(1), event(1), event(1, eventId="other")], amount(1))
    assert outcomes(out) == ["accepted", "duplicate", "TRANSACTION_IDENTITY_CONFLICT"]
    [q] = out.quarantined.collect()
    assert (q.key, q.eventId, q.reasonCode, q.sourceOffset) == ("tx-1", "other", "TRANSACTION_IDENTITY_CONFLICT", 2)


def test_changed_event_is_a_fingerprint_conflict(spark):
    out = run(spark, [event(1), event(1, amountMinor=1)], amount(1))
    assert outcomes(out) == ["accepted", "EVENT_IDENTITY_CONFLICT"]
    [q] = out.quarantined.collect()
    assert q.payloadHash.startswith("sha256:") and q.payloadHash != q.conflictingIdentityHash


def test_invalid_records_do_not_disturb_the_next(spark):
    out = run(spark, [("k", "not json"), ("wrong", '{}'), ("tx-1", None), event(1)], amount(1))
    assert outcomes(out) == ["invalid", "invalid", "invalid", "accepted"]
    assert {r.reasonCode for r in out.invalid.collect()} == {"INVALID_TRANSACTION_EVENT"}


def test_wrong_key_and_blank_event_id_are_invalid(spark):
    import json
    out = run(spark, [("other", json.dumps(event(1))), (None, json.dumps(event(1))), event(2, eventId="  ")], amount(1))
    assert outcomes(out) == ["invalid"] * 3


def test_second_event_in_the_window_fires(spark):
    out = run(spark, [event(1, 60), event(2, 660), event(3, 1261)], count(600, 2))
    assert statuses(out) == {"event-1": "NOT_SUSPICIOUS", "event-2": "SUSPICIOUS", "event-3": "NOT_SUSPICIOUS"}


def test_arrival_out_of_order(spark):
    out = run(spark, [event(1, 120), event(2, 60), event(3, 180)], count(600, 3))
    assert statuses(out) == {"event-1": "NOT_SUSPICIOUS", "event-2": "NOT_SUSPICIOUS", "event-3": "SUSPICIOUS"}
    assert [r.late for r in out.assessments.orderBy("arrival_seq").collect()] == [False, True, False]


def test_old_event_is_inconclusive_also_by_another_customer(spark):
    out = run(spark, [event(1, HOUR, customerId="a"), event(2, 0, customerId="b")], count(600, 2))
    assert statuses(out)["event-2"] == "INCONCLUSIVE"
    [r] = out.assessments.filter("eventId = 'event-2'").collect()
    assert r.ruleResults[0].evidenceCodes == ["HISTORY_UNAVAILABLE"] and r.finalSeverity == "NONE"
    assert r.ruleResults[0].evaluatedValues == {"minimumCount": "2", "windowSeconds": "600"}


@pytest.mark.parametrize("age,expected", [(900, "NOT_SUSPICIOUS"), (901, "INCONCLUSIVE")])
def test_history_bound_is_inclusive(spark, age, expected):
    out = run(spark, [event(1, HOUR, customerId="a"), event(2, HOUR - age)], count(600, 2))
    assert statuses(out)["event-2"] == expected


def test_invalid_event_does_not_advance_stream_time(spark):
    out = run(spark, [event(1, 60), event(2, 10 * HOUR, currency="REAL"), event(3, 61)], count(600, 2))
    assert statuses(out)["event-3"] == "SUSPICIOUS"


def test_reaccepted_after_a_day_with_the_same_id(spark):
    out = run(spark, [event(1, 0), event(2, 25 * HOUR), event(1, 0), event(1, 0)], amount(1))
    assert outcomes(out) == ["accepted", "accepted", "accepted", "duplicate"]
    ids = [r.assessmentId for r in out.assessments.filter("eventId = 'event-1'").collect()]
    assert len(ids) == 2 and len(set(ids)) == 1


def test_two_windows_have_their_own_size_and_composites(spark):
    both = {"type": "ALL", "children": [amount(10000), count(600, 2)]}
    either = {"type": "ANY", "children": [amount(10**9), count(60, 5)]}
    out = run(spark, [event(1, 0), event(2, 300)], count(60, 2), count(600, 2), both, either)
    [r] = out.assessments.filter("eventId = 'event-2'").collect()
    assert [x.status for x in r.ruleResults] == ["NO_MATCH", "MATCHED", "MATCHED", "NO_MATCH"]
    assert r.ruleResults[2].evaluatedValues == {"evaluatedChildren": "2", "totalChildren": "2"}


def test_no_ruleset_means_counted_and_not_evaluated(spark):
    parsed = parse_events(record_frame(spark, [event(1), event(2)])).withColumn(
        "ruleset_version", F.when(F.col("arrival_seq") == 1, 1).cast("long"))
    out = run_batch(parsed, {1: ruleset(amount(1))})
    assert outcomes(out) == ["no_ruleset", "accepted"]


def test_payment_day_scenario(spark):
    """Five events, amount and burst rule: N, S, N, N, S."""
    stream = [event(1, 0, amountMinor=5000, customerId="a"), event(2, 1, amountMinor=15000, customerId="b")] + [
        event(3 + i, 2 + i, amountMinor=100, customerId="c") for i in range(3)]
    out = run(spark, stream, amount(10000), count(600, 3))
    assert [r.status for r in out.assessments.orderBy("arrival_seq").collect()] == [
        "NOT_SUSPICIOUS", "SUSPICIOUS", "NOT_SUSPICIOUS", "NOT_SUSPICIOUS", "SUSPICIOUS"]
