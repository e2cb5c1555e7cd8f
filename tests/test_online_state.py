"""State and commits of the online job: random streams in small batches against a sequential pass, replays, order from offsets."""

import json
import random

import pytest
from pyspark.sql import functions as F

from helpers import T0, amount, count, event, record_rows, simulate, snapshot
from ledgerlens.operators.ordering import with_arrival
from ledgerlens.operators.rules import compile_ruleset
from ledgerlens.plans.incremental import advance
from ledgerlens.session import names_in, staging
from ledgerlens.streaming import online, state as state_tables
from ledgerlens.streaming.commits import Commits
from ledgerlens.streaming.state import State
from test_differential import stream

WINDOWS = (30, 300, 600)
COLUMNS = "seq long, part int, bucket long, txn string, eid string, cus string, value string, us long"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).select(
        F.col("seq").alias("arrival_seq"), F.col("part").alias("partition"), "bucket", F.col("txn").alias("transactionId"),
        F.col("eid").alias("eventId"), F.col("cus").alias("customerId"), F.col("value").alias("fingerprint"), F.col("us").alias("occurred_us"),
        F.expr("us div 1000").alias("occurred_ms"), F.lit(True).alias("valid"), F.lit(True).alias("schema_valid"))


@pytest.mark.parametrize("seed,gap,sizes,fold", [(11, 240, (200, 1, 350, 49), 10_000), (12, 900, (150, 150, 150, 150), 1)])
def test_batches_continue_each_other(spark, tmp_path, monkeypatch, seed, gap, sizes, fold):
    monkeypatch.setattr(state_tables, "FAN", 2)  # runs are merged all the time
    rows = stream(seed, sum(sizes), gap=gap)
    expected, got, at, commit = simulate(rows, WINDOWS), [], 0, None
    for n, size in enumerate(sizes):
        state = State(spark, str(tmp_path), commit)
        with staging(spark):
            step = advance(frame(spark, rows[at:at + size]), state.clocks(), state.entries, WINDOWS, width=64, fold_limit=fold)
            names = [f"observed_{w}" for w in WINDOWS]
            history = {r.arrival_seq: (r.history_available, r.late, tuple(r[x] for x in names) if r.history_available else (None,) * 3)
                       for r in step.evaluable.collect()}
            got += [(r.arrival_seq, r.outcome, *history.get(r.arrival_seq, (None, None, None))) for r in step.resolved.collect()]
            kept = state.advanced(n, step.entries, step.clocks)
        state.forget(kept)
        commit, at = {"state": kept}, at + size
    assert sorted(got) == [(s, o, a, late, c) if o == "accepted" else (s, o, None, None, None) for s, o, a, late, c in expected]
    assert {o for _, o, *_ in got} == {"accepted", "duplicate", "TRANSACTION_IDENTITY_CONFLICT", "EVENT_IDENTITY_CONFLICT"}
    named = {r["path"] for r in commit["state"]["runs"]}
    assert max(r["level"] for r in commit["state"]["runs"]) > 0
    for table in state_tables.TABLES:  # nothing is left that no commit names
        assert {f"_state/{table}/{x}" for x in names_in(spark, f"{tmp_path}/_state/{table}")} == {p for p in named if f"/{table}/" in p}


def test_old_entries_are_dropped(spark, tmp_path):
    day = 24 * 3600
    commit, sizes = None, []
    for n in range(4):
        rows = [{"seq": 1000 * n + i, "part": i % 2, "bucket": i % 3, "txn": f"t{n}-{i}", "eid": f"e{n}-{i}", "cus": f"c{i}", "value": "v",
                 "us": (T0 + 2 * day * n + i) * 1_000_000} for i in range(60)]
        state = State(spark, str(tmp_path), commit)
        with staging(spark):
            step = advance(frame(spark, rows), state.clocks(), state.entries, WINDOWS)
            commit = {"state": state.advanced(n, step.entries, step.clocks)}
        state.forget(commit["state"])
        sizes.append({t: State(spark, str(tmp_path), commit).entries(t).count() for t in state_tables.TABLES})
    assert sizes[-1] == {"transactions": 60, "events": 60, "facts": 60}
    assert len(commit["state"]["runs"]) == 3


def job(spark, root, pieces, documents, **options):
    for path, rows, schema in [(f"{root}/rules", [("ACTIVE", json.dumps(d), i) for i, d in documents], "key string, payload string, arrival_seq long"),
                               (f"{root}/records", pieces, "key string, value string, partition int, offset long, timestamp timestamp")]:
        df = spark.createDataFrame(rows, schema)
        (df if rows else df.limit(0)).coalesce(1).write.mode("append").parquet(path)
    feeds = [spark.readStream.schema(spark.read.parquet(p).schema).parquet(p) for p in (f"{root}/records", f"{root}/rules")]
    for q in online.start(*feeds, None, f"{root}/out", f"{root}/state", buckets=4, **options):
        q.awaitTermination()


def records(events):
    return [(k, v, i % 2, o, T0 + i // 4) for i, (k, v, _, o, _, _) in enumerate(record_rows(events))]


def stamped(rows):
    from datetime import datetime, timezone
    return [(*r[:4], datetime.fromtimestamp(r[4], tz=timezone.utc)) for r in rows]


def test_start_refuses_without_a_sound_rule_set(spark, tmp_path):
    broken = {**snapshot(1, [amount(5)]), "contentHash": "sha256:0"}
    with pytest.raises(online.NotReady):
        job(spark, tmp_path, stamped(records([event(1)])), [(0, broken)])
    assert online.active_version(spark, f"{tmp_path}/out") is None
    job(spark, tmp_path, [], [(1, snapshot(3, [amount(5)]))])
    assert online.active_version(spark, f"{tmp_path}/out") == 3
    assert [r.rulesetVersion for r in online.read_output(spark, f"{tmp_path}/out", "assessment").collect()] == [3]


def test_an_uncommitted_batch_is_invisible_and_done_again(spark, tmp_path):
    out, rules = f"{tmp_path}/out", [(0, snapshot(1, [amount(5), count(600, 2)]))]
    events = [event(i, 60 + i, customerId=f"c{i % 3}") for i in range(30)]
    job(spark, tmp_path, stamped(records(events)[:20]), rules)
    before = sorted(map(tuple, online.read_output(spark, out, "disposition").collect()))

    def stop(batch):
        raise RuntimeError("stopped here")

    with pytest.raises(Exception, match="stopped here"):
        job(spark, tmp_path, stamped(records(events)[20:]), [(1, snapshot(2, [amount(5)]))], on_written=stop)
    assert len(names_in(spark, f"{out}/disposition")) == 2
    assert sorted(map(tuple, online.read_output(spark, out, "disposition").collect())) == before
    job(spark, tmp_path, [], [])
    rows = online.read_output(spark, out, "assessment").collect()
    assert sorted(r.arrival_seq for r in rows) == list(range(30)) and {r.arrival_seq >= 20: r.rulesetVersion for r in rows} == {False: 1, True: 2}
    commits = Commits(spark, out)
    facts = commits.get(1)
    left = {f"_state/{t}/{x}" for t in (*state_tables.TABLES, "clocks") for x in names_in(spark, f"{out}/_state/{t}")}
    last = commits.get(commits.last())["state"]
    assert left == {r["path"] for r in last["runs"]} | {last["clocks"]}  # the interrupted attempt's tables are gone
    online.process(spark.createDataFrame([], "valid boolean"), 1, out, None)  # committed: nothing is looked at
    assert commits.get(1) == facts


def test_compiled_rule_sets_come_from_the_accepted_table(spark, tmp_path):
    job(spark, tmp_path, stamped(records([event(1, amountMinor=7)])), [(0, snapshot(1, [amount(5)])), (1, snapshot(4, [amount(8)])), (2, snapshot(2, [amount(6)]))])
    load = online.stored_rulesets(spark, f"{tmp_path}/out")
    assert load(spark, {4})[4] == compile_ruleset(snapshot(4, [amount(8)])) and set(load(spark, {1})) == {1}
    rows = online.read_output(spark, f"{tmp_path}/out", "assessment").collect()
    assert [(r.rulesetVersion, r.status) for r in rows] == [(4, "NOT_SUSPICIOUS")]


def test_arrival_follows_offsets_and_merges_by_time(spark):
    rng, rows = random.Random(3), []
    for part in range(5):
        clock = 0
        for offset in range(rng.randrange(40, 80)):
            clock += rng.choice([0, 0, 1, 5])
            rows.append((part, offset * 3, max(0, clock - (rng.randrange(20) if rng.random() < 0.2 else 0)), f"{part}-{offset}"))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "partition int, offset long, s long, name string").withColumn("timestamp", F.timestamp_seconds("s"))

    def expected(rows, before):
        top, keyed = dict(before), []
        for p, o, s, name in sorted(rows):
            top[p] = max(top.get(p, 0), s * 1_000_000)
            keyed.append((top[p], p, o, name))
        return [name for *_, name in sorted(keyed)], top

    names, top = expected(rows, {})
    numbered, came = with_arrival(df.repartition(6), start=100, width=7)
    assert [(r.arrival_seq, r.name) for r in numbered.orderBy("arrival_seq").collect()] == list(enumerate(names, 100))
    assert {r.slot: r.time for r in came.collect()} == top
    stamps = spark.createDataFrame([(0, 10**9), (3, 5)], "slot long, time long")
    later, _ = with_arrival(df, stamps)
    assert [r.name for r in later.orderBy("arrival_seq").collect()] == expected(rows, {0: 10**9, 3: 5})[0]
