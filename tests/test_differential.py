"""Random streams: the batch operators against a plain sequential pass over the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import T0, simulate
from ledgerlens.operators import history, identity
from ledgerlens.operators.ordering import first_at_or_after, follow_chain, running_max, running_sum
from ledgerlens.session import materialize

WINDOWS = (30, 300, 600)
COLUMNS = "seq long, part int, bucket long, txn string, eid string, cus string, value string, us long"


def stream(seed, n, customers=40, gap=240, hot=0.0):
    rng, rows, clock = random.Random(seed), [], T0 * 1_000_000
    for i in range(n):
        clock += rng.randrange(0, gap * 1_000_000)
        if rows and rng.random() < 0.25:
            old = dict(rng.choice(rows[-200:] if rng.random() < 0.5 else rows))
            kind = rng.randrange(4)
            if kind == 1:
                old["eid"] += "x"
            elif kind == 2:
                old["value"] += "x"
            elif kind == 3:
                old["txn"], old["part"] = f"t{i}", i % 3
            row = old
        else:
            late = rng.randrange(0, 2000) * 1_000_000 if rng.random() < 0.2 else 0
            c = 0 if rng.random() < hot else rng.randrange(customers)
            row = {"part": i % 3, "bucket": c % 4, "txn": f"t{i}", "eid": f"e{i}", "cus": f"c{c}", "value": "v", "us": clock - late}
        rows.append({**row, "seq": i * 3 + 1})
    return rows


def resolve(spark, rows, fold_limit, width):
    df = spark.createDataFrame(rows, COLUMNS).select(
        F.col("seq").alias("arrival_seq"), F.col("part").alias("partition"), "bucket", F.col("txn").alias("transactionId"),
        F.col("eid").alias("eventId"), F.col("cus").alias("customerId"), F.col("value").alias("fingerprint"),
        F.col("us").alias("occurred_us"), F.expr("us div 1000").alias("occurred_ms"))
    df = materialize(df)
    timed = running_max(df, ["partition"], "arrival_seq", "occurred_ms", "stream_time_1", width=width)
    conflicts = identity.transaction_conflicts(timed, fold_limit=fold_limit)
    left = df.join(conflicts.select("arrival_seq"), "arrival_seq", "left_anti")
    survivors = materialize(running_max(left, ["bucket"], "arrival_seq", "occurred_ms", "stream_time_2", width=width))
    repeats = materialize(identity.event_repeats(
        survivors, lambda df: df.withColumn("val", F.col("fingerprint")), fold_limit=fold_limit))
    accepted = survivors.join(repeats.select("arrival_seq"), "arrival_seq", "left_anti")
    return conflicts.unionByName(repeats), materialize(accepted)


@pytest.mark.parametrize("seed,fold_limit,width,unit_limit,hot", [
    (1, 10_000, 1 << 18, 10**6, 0.0),
    (2, 0, 64, 3, 0.0),
    (3, 2, 1000, 25, 0.4),
])
def test_batch_equals_sequential_pass(spark, seed, fold_limit, width, unit_limit, hot):
    rows = stream(seed, 1500, hot=hot, gap=240 if not hot else 20)
    expected = simulate(rows, WINDOWS)
    rejected, accepted = resolve(spark, rows, fold_limit, width)
    got = {r.arrival_seq: r.outcome for r in rejected.collect()}
    assert got == {s: o for s, o, *_ in expected if o != "accepted"}

    counted = history.with_history(accepted, WINDOWS, unit_limit=unit_limit, dense_cuts=4)
    names = [history.observed_column(w) for w in WINDOWS]
    seen = {r.arrival_seq: (r.history_available, r.late, tuple(r[n] for n in names)) for r in counted.collect()}
    want = {s: (a, late, c if a else (None,) * 3) for s, o, a, late, c in expected if o == "accepted"}
    assert seen == want
    kinds = {o for _, o, *_ in expected}
    assert kinds == {"accepted", "duplicate", "TRANSACTION_IDENTITY_CONFLICT", "EVENT_IDENTITY_CONFLICT"}


def test_dense_unit_with_many_ties(spark):
    rng = random.Random(5)
    rows = [{"arrival_seq": i, "customerId": "hot", "occurred_us": (T0 + rng.choice([0, 0, 0, 1, 5, 300, 899])) * 1_000_000}
            for i in range(400)]
    top = 0
    for r in rows:
        r["occurred_ms"] = r["occurred_us"] // 1000
        top = max(top, r["occurred_ms"])
        r["stream_time_2"] = top
    df = materialize(spark.createDataFrame(rows))
    names = ["arrival_seq", "observed_60", "observed_600"]
    plain = history.with_history(df, [60, 600]).select(names)
    cut = history.with_history(df, [60, 600], unit_limit=10, dense_cuts=5).select(names)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, cut.collect()))
    brute = [sum(h["occurred_us"] <= r["occurred_us"] and h["occurred_us"] >= r["occurred_us"] - 600_000_000
                 for h in rows[:i]) + 1 for i, r in enumerate(rows)]
    assert [r.observed_600 for r in plain.orderBy("arrival_seq").collect()] == brute


def test_running_operators_cross_chunks(spark):
    rng = random.Random(6)
    rows = [("a" if rng.random() < 0.7 else "b", i, rng.randrange(1000)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, s long, v long")
    for width, levels in ((7, 3), (50, 2), (1 << 20, 2), (3, 1)):
        out = running_sum(running_max(df, ["g"], "s", "v", "m", width=width, levels=levels), ["g"], "s", "v", "t", width=width, levels=levels)
        before = running_max(df, ["g"], "s", "v", "m", width=width, levels=levels, inclusive=False)
        state, expected, prior = {}, {}, {}
        for g, s, v in rows:
            m, t = state.get(g, (None, 0))
            prior[s] = m
            state[g] = (v if m is None else max(m, v), t + v)
            expected[s] = state[g]
        assert {r.s: (r.m, r.t) for r in out.collect()} == expected
        assert {r.s: r.m for r in before.collect()} == prior


def test_first_at_or_after_and_chains(spark):
    rng = random.Random(7)
    facts = sorted({rng.randrange(10_000) for _ in range(300)})
    probes = [(f, f + 77) for f in facts]
    f_df = spark.createDataFrame([("k", f) for f in facts], "k string, at long")
    p_df = spark.createDataFrame([("k", s, a) for s, a in probes], "k string, src long, at long")
    links = first_at_or_after(f_df, p_df, ["k"], 100)
    following = {s: min((f for f in facts if f >= a), default=None) for s, a in probes}
    assert {r.src: r.nxt for r in links.collect()} == following
    reached = follow_chain(spark.createDataFrame([("k", facts[0])], "k string, src long"), links, ["k"])
    chain, node = set(), facts[0]
    while node is not None:
        chain.add(node)
        node = following[node]
    assert {r.src for r in reached.collect()} == chain
