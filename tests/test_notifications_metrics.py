import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import metrics, notifications
from ledgerlens.session import materialize
from ledgerlens.sources import tables


def walk(log):
    status, n, out = "PENDING", 0, []
    for at, kind, attempt in log:
        if kind == "CLAIM":
            if status in ("PENDING", "FAILED"):
                status, n = "SENDING", n + 1
                out.append((at, "ACQUIRED"))
            else:
                out.append((at, "ALREADY_SENT" if status == "SENT" else "IN_PROGRESS"))
        elif status == "SENDING" and attempt == n:
            status = kind
            out.append((at, "APPLIED"))
        else:
            out.append((at, "DELIVERY_NOT_SENDING"))
    return status, n, out


def test_attempt_logs_against_a_walk(spark):
    rng, rows = random.Random(11), []
    for request in range(60):
        n = 0
        for at in range(rng.choice([0, 1, 3, 8, 40])):
            kind = rng.choice(["CLAIM", "CLAIM", "FAILED", "FAILED", "FAILED", "SENT" if rng.random() < 0.3 else "FAILED"])
            n += kind == "CLAIM"
            rows.append((f"r{request}", at * 100_000, kind, None if kind == "CLAIM" else max(1, rng.randrange(n // 2, n + 1))))
    log = spark.createDataFrame(rows, "notificationRequestId string, at long, kind string, attempt int")
    resolved = notifications.resolve_attempts(log)
    by_request = {}
    for rid, *rest in rows:
        by_request.setdefault(rid, []).append(tuple(rest))
    expected = {rid: walk(log_) for rid, log_ in by_request.items()}
    got = {}
    for r in resolved.collect():
        got.setdefault(r.notificationRequestId, []).append((r.at, r.result))
    assert {k: sorted(v) for k, v in got.items()} == {k: v[2] for k, v in expected.items()}
    state = {r.notificationRequestId: (r.status, r.attempt_count) for r in notifications.ledger(resolved).collect()}
    assert state == {k: v[:2] for k, v in expected.items()}
    assert max(n for _, n, _ in expected.values()) >= 3


def test_claims_contacts_and_replays(spark):
    requests = spark.createDataFrame([("n1", "a"), ("n2", "b"), ("n3", "c"), ("n3", "c")], "notificationRequestId string, customerId string")
    ledger = spark.createDataFrame([("n1", "SENT", 1), ("n2", "FAILED", 1)], "notificationRequestId string, status string, attempt_count int")
    got = {r.notificationRequestId: (r.claim, r.attempt_count) for r in notifications.to_send(requests, ledger).collect()}
    assert got == {"n1": ("ALREADY_SENT", 1), "n2": ("ACQUIRE", 2), "n3": ("ACQUIRE", 1)}
    assert [r.notificationRequestId for r in notifications.new_requests(requests, ledger).collect()] == ["n3"]
    assert [r.attempt_count for r in notifications.replayed_results(requests, ledger).collect()] == [1]
    contacts = spark.createDataFrame([("a", "a@x")], "customerId string, contact string")
    failed = notifications.with_contact(requests, contacts).filter("contact_failure IS NOT NULL").count()
    assert failed == 3


SENT = ["e1", "e2", "e3"]
GOOD = ([("e1", "SUSPICIOUS"), ("e2", "NOT_SUSPICIOUS"), ("e3", "SUSPICIOUS")], ["e1", "e3"])


@pytest.mark.parametrize("assessed,alerted,failure", [
    (*GOOD, None),
    (GOOD[0][:2], ["e1"], "'missing_assessments': 1"),
    (GOOD[0] + [("e9", "NOT_SUSPICIOUS")], GOOD[1], "'unexpected_assessments': 1"),
    (GOOD[0] + [("e1", "SUSPICIOUS")], GOOD[1], "'duplicate_assessments': 1"),
    (GOOD[0], ["e1"], "'missing_alerts': 1"),
    (GOOD[0], ["e1", "e2", "e3"], "'unexpected_alerts': 1"),
    (GOOD[0], ["e1", "e3", "e3"], "'duplicate_alerts': 1"),
])
def test_reconciliation(spark, assessed, alerted, failure):
    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)

    counts = metrics.reconcile(frame([(e,) for e in SENT], "eventId string"), frame(assessed, "eventId string, status string"),
                               frame([(e,) for e in alerted], "eventId string"))
    if failure is None:
        metrics.assert_reconciled(counts)
    else:
        with pytest.raises(metrics.IntegrityError, match=failure):
            metrics.assert_reconciled(counts)


def test_latency_summary_interpolates(spark):
    df = spark.createDataFrame([("s", float(v)) for v in range(100, 900, 100)], "name string, ms double")
    row = metrics.latency_summary(df, ["name"], "ms").first()
    assert [round(x, 6) for x in (row.p50, row.p95, row.p99, row.p999, row.maximum, row.within_objective_percent)] == [
        450, 765, 793, 799.3, 800, 62.5]


def test_exact_quantiles_equal_the_builtin(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), (F.pmod(F.xxhash64("id"), F.lit(9973)) / 7).alias("v"))
    qs = {"a": 0.1, "b": 0.5, "c": 0.999, "d": 0.0, "e": 1.0}
    got = {r.k: [round(r[n], 9) for n in qs] for r in metrics.exact_quantiles(df, ["k"], "v", qs, cell=10.0).collect()}
    want = {r.k: [round(x, 9) for x in r.p] for r in df.groupBy("k").agg(F.percentile("v", list(qs.values())).alias("p")).collect()}
    assert got == want


@pytest.mark.parametrize("limit,cells,accuracy", [(1, 4, 10_000), (40, 10, 100), (10**6, 500, 10_000)])
def test_quantiles_of_refined_brackets(spark, limit, cells, accuracy):
    kinds = {"unit": F.rand(1), "huge": F.rand(2) * 1e9, "one": F.lit(7.0), "few": F.floor(F.rand(3) * 3).cast("double"),
             "spiky": F.when(F.rand(4) < 0.6, 5.0).otherwise(F.rand(5)), "negative": -F.exp(F.rand(6) * 40)}
    df = materialize(spark.range(4000).select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in kinds.items()]))))
    df = df.unionByName(spark.createDataFrame([(None, 1.0), (None, 2.0), ("none", None), ("single", 3.5)], "k string, v double"))
    qs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.999, "e": 1.0}
    got = {r.k: [r[n] for n in qs] for r in metrics.exact_quantiles(df, ["k"], "v", qs, limit=limit, cells=cells, accuracy=accuracy).collect()}
    want = {r.k: r.p for r in df.groupBy("k").agg(F.percentile("v", list(qs.values())).alias("p")).filter("k IS NULL OR k <> 'none'").collect()}
    assert set(got) == set(want) and all(abs(x - y) <= 1e-9 * max(1, abs(y)) for k in want for x, y in zip(got[k], want[k]))
    [row] = metrics.exact_quantiles(df.filter("k = 'few'"), [], "v", {"p": 0.5}, limit=1, cells=4).collect()
    assert row.p == 1.0


def test_throughput_rollout_and_tables(spark, tmp_path):
    df = spark.createDataFrame([("s", i * 100_000, i * 100_000 + 500_000) for i in range(11)], "n string, a long, b long")
    row = metrics.throughput(df, ["n"], "a", "b", 7).first()
    assert (row.events, round(row.per_second, 3), row.target_met) == (11, round(11 / 1.5, 3), True)
    v = spark.createDataFrame([("h", 3), ("h", 5)], "head_key string, version long")
    r = metrics.rollout(v, v.filter("version < 5"), v.filter("version < 0")).first()
    assert (r.desired_version, r.published_version, r.loaded_version, r.lag) == (5, 3, 0, 5)

    tables.write_outputs({"x": v}, str(tmp_path), 4)
    tables.write_outputs({"x": v}, str(tmp_path), 4)
    tables.write_outputs({"x": v}, str(tmp_path), 5)
    assert spark.read.parquet(f"{tmp_path}/x").count() == 4
    assert tables.read_tables(spark, str(tmp_path), ["x"])["x"].count() == 4
    assert tables.compact(v, ["head_key"], "version").first().version == 5
    aged = spark.createDataFrame([(0,), (6 * 86_400_000_000,)], "us long")
    assert tables.within_retention(aged, "us", F.lit(8 * 86_400_000_000), 7).count() == 1


def test_latency_target_needs_both_outputs(spark):
    rows = [("a", 100, 100)] * 999 + [("a", 900, 100)] + [("b", 100, 100)] * 998 + [("b", 100, 900)] * 2 + [("c", 100, None)]
    df = spark.createDataFrame(rows, "k string, assessment long, alert long")
    assert {r.k: r.latency_target_met for r in metrics.latency_target(df, ["k"], "assessment", "alert").collect()} == {"a": True, "b": False, "c": True}
    silent = spark.createDataFrame([("none", None, None), ("alerts", None, 5)], "k string, assessment long, alert long")
    assert [r.latency_target_met for r in metrics.latency_target(silent, ["k"], "assessment", "alert").collect()] == [False, False]


def test_the_first_request_to_arrive_is_inserted(spark):
    df = spark.createDataFrame([("r", 5, "late"), ("r", 2, "first"), ("r", 9, "later"), ("s", 1, "known")], "notificationRequestId string, arrival_seq long, alertId string")
    ledger = spark.createDataFrame([("s",)], "notificationRequestId string")
    assert [tuple(r) for r in notifications.new_requests(df, ledger).collect()] == [("r", 2, "first")]
