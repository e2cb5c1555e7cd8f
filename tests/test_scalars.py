import hashlib
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import BASE
from ledgerlens.functions import ids
from ledgerlens.functions.dominance import count_below
from ledgerlens.sources.ingest import instant_micros


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_ids_are_name_based_chained_and_distinct(spark):
    row = one(spark, a=ids.assessment_id(F.lit("event-1")), l=ids.alert_id(F.lit("event-1")),
              n=ids.notification_request_id(F.lit("event-1")), u=ids.assessment_id(F.lit("évènt")))
    for ns, got, text in (("ASSESSMENT", row.a, "event-1"), ("ALERT", row.l, "event-1"),
                          ("NOTIFICATION-REQUEST", row.n, "event-1"), ("ASSESSMENT", row.u, "évènt")):
        assert got == str(uuid.UUID(bytes=hashlib.md5(f"{ns}:{text}".encode()).digest(), version=3))
    assert len({row.a, row.l, row.n}) == 3


@pytest.mark.parametrize("blank", [None, "", "   ", "\t\n"])
def test_blank_ids_are_refused(spark, blank):
    assert one(spark, x=ids.assessment_id(F.lit(blank).cast("string"))).x is None


def test_fingerprint_covers_declared_fields_in_order(spark):
    df = spark.createDataFrame([{**BASE}]).withColumn("us", instant_micros(F.col("occurredAt"))).drop("occurredAt")
    df = df.withColumn("schemaVersion", F.col("schemaVersion").cast("int"))
    text = (
        '{"schemaVersion":1,"eventId":"evt-a0","transactionId":"pay-a0","customerId":"client-a","amountMinor":10000,'
        '"currency":"BRL","occurredAt":"2025-06-02T09:31:07Z","transactionType":"PURCHASE","channel":"APP",'
        '"merchantCountry":"BR","deviceIdHash":"dev-7f","traceId":"tr-00"}')
    assert df.select(ids.event_fingerprint(F.col("us"))).first()[0] == "sha256:" + hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("text,expected", [
    ("1970-01-01T00:00:01Z", 1_000_000), ("1970-01-01T00:00:00.123456789Z", 123_456),
    ("1970-01-01T01:00:00+01:00", 0), ("2026", None), ("2026-01-01", None), ("2026-01-01T00:00Z", None),
    ("2026-13-01T00:00:00Z", None), ("1970-01-01T00:00:01Z\n", None), ("soon", None),
])
def test_instants(spark, text, expected):
    assert one(spark, x=instant_micros(F.lit(text))).x == expected


def test_instant_text_and_backoff_and_message_id(spark):
    row = one(spark, a=ids.iso_instant(F.lit(1_767_225_660_120_000)), b=ids.iso_instant(F.lit(-1)),
              **{f"d{n}": ids.backoff_seconds(F.lit(n)) for n in (0, 1, 5, 6, 50)},
              m=ids.message_id(F.lit(" <a@b> ")), k=ids.message_id(F.lit("<>")), z=ids.message_id(F.lit(" ")))
    assert (row.a, row.b) == ("2026-01-01T00:01:00.120Z", "1969-12-31T23:59:59.999999Z")
    assert [row[f"d{n}"] for n in (0, 1, 5, 6, 50)] == [1, 2, 32, 60, 60]
    assert (row.m, row.k, row.z) == ("a@b", "<>", None)


def test_canonical_json_sorts_keys_only(spark):
    text = '{"b":[{"y":1,"x":2},3],"a":{"d":null,"c":"ü"}}'
    assert one(spark, x=ids.canonical_json(F.lit(text))).x == '{"a":{"c":"ü","d":null},"b":[{"x":2,"y":1},3]}'


def test_count_below_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = rng.integers(0, 50)
        g, a, b, w = rng.integers(0, 4, n), rng.integers(0, 15, n), rng.integers(0, 12, n), rng.integers(0, 3, n)
        expected = [sum(w[j] for j in range(n) if g[j] == g[i] and a[j] < a[i] and b[j] <= b[i]) for i in range(n)]
        asked = w == 0
        assert (count_below(g, a, b, w)[asked] == np.array(expected, dtype=np.int64)[asked]).all()
