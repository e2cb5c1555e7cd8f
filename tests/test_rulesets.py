import json

import pytest
from pyspark.sql import functions as F

from helpers import amount, count, snapshot
from ledgerlens.operators import rulesets
from ledgerlens.session import materialize


@pytest.fixture(scope="module")
def decided(spark):
    broken = {**snapshot(9, [amount(1)]), "contentHash": "sha256:0"}
    published = [
        ("ACTIVE", snapshot(2, [amount(10)])), ("ACTIVE", snapshot(1, [amount(20)])), ("OTHER", snapshot(50, [amount(1)])),
        ("ACTIVE", broken), ("ACTIVE", snapshot(8, [{"type": "SUM_WINDOW"}])), ("ACTIVE", snapshot(7, [])), ("ACTIVE", None),
        ("ACTIVE", snapshot(2, [amount(30)])), ("ACTIVE", snapshot(3, [amount(40), count(60, 2)])),
    ]
    rows = [(k, None if d is None else json.dumps(d), 10 * i) for i, (k, d) in enumerate(published)]
    df = spark.createDataFrame(rows, "key string, payload string, arrival_seq long")
    return materialize(rulesets.accept_snapshots(rulesets.validate_snapshots(df)))


def test_older_or_broken_sets_keep_the_last_good_one(decided):
    rows = decided.orderBy("arrival_seq").collect()
    assert [r.disposition for r in rows] == [
        "accepted", "not_newer", "ignored_key", "rejected", "rejected", "rejected", "rejected", "not_newer", "accepted"]
    assert [r.reject_reason for r in rows[3:7]] == [
        "INVALID_RULESET_HASH", "UNSUPPORTED_RULE_NODE", "INVALID_RULESET_SCHEMA", "INVALID_RULESET_SNAPSHOT"]


@pytest.mark.parametrize("span", [4, 16, 1 << 22])
def test_event_meets_the_version_active_on_arrival(spark, decided, span):
    events = spark.range(0, 120, 3).select(F.col("id").alias("arrival_seq"))
    got = rulesets.with_active_version(events, decided.filter("disposition = 'accepted'"), span)
    for r in got.collect():
        assert r.ruleset_version == (None if r.arrival_seq <= 0 else 2 if r.arrival_seq <= 80 else 3)


def test_accepted_sets_compile(decided):
    loaded = rulesets.load_rulesets(decided.filter("disposition = 'accepted'"))
    assert sorted(loaded) == [2, 3] and loaded[3].windows() == {60}


def test_publication_checks(spark):
    good = snapshot(4, [amount(1)])
    canonical = json.dumps(good, sort_keys=True, separators=(",", ":"))
    forged = json.dumps({**good, "snapshotId": "x"}, sort_keys=True, separators=(",", ":"))
    rows = [(0, canonical, 4), (1, canonical, 5), (2, json.dumps(good), 4), (3, forged, 4), (4, "{", 4), (5, "{}", 4)]
    df = spark.createDataFrame(rows, "i int, canonical_payload string, aggregate_version long")
    got = [r.verification for r in rulesets.verify_publication(df).orderBy("i").collect()]
    assert got == ["OK"] + [f"OUTBOX_SNAPSHOT_{x}" for x in
                            ("VERSION_INVALID", "NOT_CANONICAL", "HASH_INVALID", "INVALID_JSON", "SCHEMA_INVALID")]
