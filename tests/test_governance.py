import json
import random

import pytest
from pyspark.sql import functions as F

from helpers import amount
from ledgerlens.operators import governance, rulesets
from ledgerlens.session import materialize


def propose(spark, rows):
    """rows: (version, rule, change, author[, definition])."""
    data = [("h", r[1], r[0], r[2], json.dumps(r[4] if len(r) > 4 else amount(i + 1)), r[3], i) for i, r in enumerate(rows)]
    return materialize(governance.propose(spark.createDataFrame(
        data, "head_key string, rule_id string, rule_version_id string, change_type string, definition string, author string, proposal_seq long")))


def decide(spark, versions, rows, **limits):
    data = [(i, *r) for i, r in enumerate(rows)]
    log = spark.createDataFrame(data, "decision_seq long, rule_version_id string, decision string, approver string")
    return materialize(governance.decide(versions, log, **limits))


def outcomes(df):
    return [(r.outcome, r.reason, r["items"]) for r in df.orderBy("decision_seq").collect()]


def test_numbers_and_refused_proposals(spark):
    v = propose(spark, [("v1", "a", "UPSERT", "ann"), ("v2", "a", "DELETE", "ann"), ("v3", "a", "UPSERT", "ann", {"type": "SUM_WINDOW"}),
                        ("v4", "a", "RETIRE", "ann"), ("v5", "b", "UPSERT", "ann")])
    got = {r.rule_version_id: (r.reject_reason, r.version_number, r.definition is None) for r in v.collect()}
    assert got == {"v1": (None, 1, False), "v2": ("INVALID_CHANGE_TYPE", None, True), "v3": ("UNSUPPORTED_RULE_NODE", None, False),
                   "v4": (None, 2, True), "v5": (None, 1, False)}
    assert {r.rule_id: r.next_version for r in governance.next_version_number(v).collect()} == {"a": 3, "b": 2}


def test_lifecycle_and_denials(spark):
    v = propose(spark, [("a1", "a", "UPSERT", "ann"), ("b1", "b", "UPSERT", "ann"), ("a2", "a", "UPSERT", "ann"),
                        ("a3", "a", "RETIRE", "ann"), ("b2", "b", "RETIRE", "ann"), ("c1", "c", "UPSERT", "ann")])
    d = decide(spark, v, [
        ("a1", "APPROVE", "ann"), ("a1", "APPROVE", "bob"), ("a1", "APPROVE", "cat"), ("b1", "APPROVE", "bob"), ("a2", "APPROVE", "bob"),
        ("a3", "APPROVE", "bob"), ("b2", "APPROVE", "bob"), ("c1", "REJECT", "ann"), ("c1", "REJECT", "bob"), ("a1", "APPROVE", "ann"),
        ("b2", "REJECT", "bob")])
    assert outcomes(d) == [
        ("DENIED", "SELF_APPROVAL", None), ("SUCCESS", None, ["a1"]), ("DENIED", "VERSION_ALREADY_DECIDED", None),
        ("SUCCESS", None, ["a1", "b1"]), ("SUCCESS", None, ["b1", "a2"]), ("SUCCESS", None, ["b1"]),
        ("DENIED", "ACTIVE_RULESET_MUST_NOT_BE_EMPTY", None), ("DENIED", "SELF_REJECTION", None), ("SUCCESS", None, None),
        ("DENIED", "VERSION_ALREADY_DECIDED", None), ("SUCCESS", None, None)]
    status = {r.rule_version_id: r.status for r in governance.version_status(v, d).collect()}
    assert status == {"a1": "APPROVED", "b1": "APPROVED", "a2": "APPROVED", "a3": "APPROVED", "b2": "REJECTED", "c1": "REJECTED"}
    trail = [(r.actor, r.action, r.outcome) for r in governance.audit_trail(governance.audit_events(v, d)).collect()]
    assert ("ann", "RULE_APPROVAL_DENIED", "DENIED") in trail and ("bob", "RULE_VERSION_REJECTED", "SUCCESS") in trail
    assert len(trail) == 6 + 9  # every proposal; every decision but the two on settled versions
    [active] = governance.active_set(d).collect()
    assert (active.rule_version_id, active.evaluation_order, active.ruleset_version) == ("b1", 0, 4)
    assert governance.constraint_violations(governance.version_status(v, d)).isEmpty()


def test_rule_and_byte_limits_leave_the_set_unchanged(spark):
    v = propose(spark, [(f"v{i}", f"r{i}", "UPSERT", "ann") for i in range(102)])
    d = decide(spark, v, [(f"v{i}", "APPROVE", "bob") for i in range(102)])
    got = outcomes(d)
    assert [o for o, *_ in got].count("SUCCESS") == 100
    assert got[100][:2] == ("REFUSED", "RULESET_SIZE_EXCEEDS_LIMIT") and len(got[99][2]) == 100
    built = governance.build_snapshots(d, v, F.lit(1_767_225_660_123_456)).orderBy("ruleset_version").collect()
    exact = [r.payload_bytes for r in built]
    again = decide(spark, v, [(f"v{i}", "APPROVE", "bob") for i in range(12)], max_bytes=exact[10])
    assert [o[:2] for o in outcomes(again)][-2:] == [("SUCCESS", None), ("REFUSED", "RULESET_PAYLOAD_EXCEEDS_LIMIT")]


def test_built_snapshots_pass_every_check(spark):
    nested = {"type": "ALL", "children": [amount(1), {"type": "COUNT_WINDOW", "windowSeconds": 5, "minimumCount": 2}], "severity": "LOW"}
    v = propose(spark, [("a\"1", "a", "UPSERT", "ann", nested), ("b1", "b", "UPSERT", "ann")])
    d = decide(spark, v, [("a\"1", "APPROVE", "bob"), ("b1", "APPROVE", "bob")])
    built = materialize(governance.build_snapshots(d, v, F.lit(0)))
    out = rulesets.verify_publication(built.select(
        F.col("payload").alias("canonical_payload"), F.col("ruleset_version").alias("aggregate_version")))
    assert [r.verification for r in out.collect()] == ["OK", "OK"]
    last = json.loads(built.filter("ruleset_version = 2").first().payload)
    assert [(r["ruleId"], r["severity"], r["evaluationOrder"]) for r in last["rules"]] == [("a", "LOW", 0), ("b", "HIGH", 1)]


def test_publication_queue(spark):
    rows = [("x", 1, "PUBLISHED", 0), ("x", 3, "PENDING", 0), ("x", 2, "PENDING", 900), ("y", 1, "PENDING", 10)]
    box = spark.createDataFrame(rows, "aggregate_id string, aggregate_version long, status string, next_attempt_us long")
    # version 2 of x waits for its retry time, and version 3 does not overtake it
    assert [(r.aggregate_id, r.aggregate_version) for r in governance.next_publication(box, F.lit(100)).collect()] == [("y", 1)]
    heads = spark.createDataFrame([("x", 3, 1), ("z", 0, 0)], "head_key string, desired_version long, published_version long")
    got = {r.head_key: r.pending_outbox_events for r in governance.active_status(heads, box).collect()}
    assert got == {"x": 2, "z": 0}


@pytest.mark.parametrize("rows,expected", [
    ([("v1", "a", 1, "PENDING_APPROVAL", None), ("v2", "a", 2, "PENDING_APPROVAL", None)], "rule_version_one_pending_per_rule"),
    ([("v1", "a", 1, "APPROVED", "bob"), ("v2", "a", 1, "APPROVED", "bob")], "rule_version_unique_number"),
    ([("v1", "a", 1, "APPROVED", "ann")], "rule_version_different_approver"),
])
def test_constraint_report(spark, rows, expected):
    df = spark.createDataFrame(rows, "rule_version_id string, rule_id string, version_number int, status string, approver string")
    assert [r.violation for r in governance.constraint_violations(df.withColumn("author", F.lit("ann"))).collect()] == [expected]


def test_unknown_versions_and_words_are_refused_and_settle_nothing(spark):
    v = propose(spark, [("v1", "a", "UPSERT", "ann")])
    got = outcomes(decide(spark, v, [("v9", "APPROVE", "bob"), ("v1", "MAYBE", "bob"), ("v1", None, "bob"), ("v1", "APPROVE", "bob"), ("v1", "MAYBE", "bob")]))
    assert got == [("REFUSED", "RULE_VERSION_UNKNOWN", None), ("REFUSED", "DECISION_UNKNOWN", None), ("REFUSED", "DECISION_UNKNOWN", None),
                   ("SUCCESS", None, ["v1"]), ("REFUSED", "DECISION_UNKNOWN", None)]


@pytest.mark.parametrize("seed,limits", [(1, {}), (2, {"max_rules": 3}), (3, {"max_bytes": 700})])
def test_blocks_equal_the_plain_fold(spark, seed, limits):
    rng = random.Random(seed)
    rules = [f"r{i}" for i in range(6)]
    rows = [(f"v{i}", rng.choice(rules), "RETIRE" if rng.random() < 0.45 else "UPSERT", rng.choice(["ann", "bob"])) for i in range(160)]
    v = propose(spark, rows)
    log = [(rng.choice(rows)[0] if rng.random() < 0.4 else rows[i][0], rng.choice(["APPROVE", "APPROVE", "APPROVE", "REJECT"]), "cat") for i in range(160)]
    want = outcomes(decide(spark, v, log, **limits))
    assert {o for o, *_ in want} >= {"SUCCESS", "DENIED"}
    for block in (7, 50):
        assert outcomes(decide(spark, v, log, block=block, **limits)) == want
    versions_ = [r.ruleset_version for r in decide(spark, v, log, block=23, **limits).orderBy("decision_seq").collect()]
    assert [x for x in versions_ if x is not None] == list(range(1, 1 + sum(x is not None for x in versions_)))


@pytest.mark.parametrize("limits", [{}, {"block": 40}])
def test_a_log_without_surprises_is_folded_once(spark, monkeypatch, limits):
    """Blocks start from what first approvals lead to, so they are only folded again where a denial says otherwise."""
    n, folds, folded = 200, [], governance._folded
    v = propose(spark, [(f"v{i}", f"r{i % 5}", "RETIRE" if i % 7 == 6 else "UPSERT", "ann") for i in range(n)])
    monkeypatch.setattr(governance, "_folded", lambda log, *rest: folds.append(log.select("head_key", "block").distinct().count()) or folded(log, *rest))
    got = outcomes(decide(spark, v, [(f"v{i}", "APPROVE", "bob") for i in range(n)], **limits))
    assert all(o == "SUCCESS" for o, *_ in got)
    # the blocks in which the version gains a digit may be walked twice
    assert folds[0] == (5 if limits else 1) and len(folds) == 1
