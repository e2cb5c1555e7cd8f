"""Work that must not stay in one task, whatever the files look like."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import notifications
from ledgerlens.plans import catalog, fixtures
from ledgerlens.sources.contracts import violations


@pytest.fixture
def one_group(spark, tmp_path):
    """Events and orders, each in one row group of one file."""
    at = datetime(2024, 1, 1)
    spark.createDataFrame([(i, at + timedelta(seconds=i), i % 7, ("view", "click", "error")[i % 3], i / 4, "{}") for i in range(300)],
                          "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") \
        .coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(i, i % 50, "OFP"[i % 3], i / 4, at, "5-LOW" if i % 5 == 0 else "1-URGENT") for i in range(300)],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string") \
        .coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield str(tmp_path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def shares(df):
    """Rows of each task that makes them."""
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]


@pytest.mark.parametrize("build", [fixtures.records, fixtures.transactions, fixtures.raw_records, fixtures.delivery_log, fixtures.attempt_log, fixtures.proposals])
def test_records_of_one_row_group_are_made_by_many_tasks(spark, one_group, build):
    rows = build(spark, one_group)
    found = shares(rows)
    assert len(found) == 4 and max(found) < 0.5 * sum(found)


def test_requests_are_judged_by_their_contract_whatever_their_form(spark):
    sound = {"schemaVersion": 1, "notificationRequestId": "r1", "alertId": "a", "customerId": "c", "transactionId": "t",
             "category": "SUSPICIOUS_TRANSACTION", "templateId": "x", "locale": "en", "requestedAt": "2024-01-01T00:00:00Z", "traceId": "t"}
    compact = json.dumps(sound, separators=(",", ":"))
    texts = [compact, json.dumps(sound), json.dumps(dict(reversed(sound.items()))), compact.replace('"en"', '"\\u0065n"'),
             compact.replace('"en"', '""'), compact.replace('"en"', "null"), compact.replace('"en"', "7"), compact.replace('"en"', '"e\\"n"'),
             compact.replace('"schemaVersion":1', '"schemaVersion":1.0'), compact.replace('"schemaVersion":1', '"schemaVersion":2'),
             compact.replace("SUSPICIOUS", "OTHER"), compact[:-1] + ',"more":1}', compact[:-1], "[]", "", None, compact + " ", compact.replace('"alertId":"a",', ""),
             compact.replace('"alertId":"a"', '"alertId":"a","alertId":"b"')]
    rows = spark.createDataFrame([(i, key, text) for i, text in enumerate(texts) for key in ("r1", "other", None)], "i int, key string, value string")
    wrong = F.size(violations("notification_request", F.col("value"))) > 0
    rid = F.try_variant_get(F.try_parse_json("value"), "$.notificationRequestId", "string")
    expected = rows.select("i", "key", rid.alias("rid"), F.when(wrong, "INVALID_NOTIFICATION_REQUEST").when(
        ~F.coalesce(F.col("key") == rid, F.lit(False)), "KEY_MISMATCH").alias("reason"))
    found = notifications.check_requests(rows).select("i", "key", F.col("notificationRequestId").alias("rid"), F.col("reject_reason").alias("reason"))
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    assert {r.i for r in found.where("reason IS NULL").collect()} >= {0, 1, 2}


def test_only_what_is_evaluated_is_counted(spark, one_group):
    """Counting passes whole rows through Python, so they are narrow there."""
    assert not {"payload_hash", "value", "deviceIdHash", "key", "schema_valid"} & set(catalog.evaluated(spark, one_group, 60).columns)
