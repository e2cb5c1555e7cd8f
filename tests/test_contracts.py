import json

import pytest
from pyspark.sql import functions as F

from helpers import BASE, amount, snapshot
from ledgerlens.sources.contracts import CONTRACTS, struct_type, violations

VALID = {
    "transaction_event": BASE,
    "ruleset_snapshot": snapshot(1, [amount(1)]),
    "assessment": {"schemaVersion": 1, "assessmentId": "a", "eventId": "e", "transactionId": "t", "customerId": "c",
                   "status": "SUSPICIOUS", "finalSeverity": "HIGH", "ruleResults": [{"ruleId": "r"}], "rulesetVersion": 1,
                   "receivedAt": "x", "evaluatedAt": "x", "late": False, "traceId": "t"},
    "alert": {"schemaVersion": 1, "alertId": "l", "assessmentId": "a", "eventId": "e", "transactionId": "t", "customerId": "c",
              "severity": "HIGH", "matchedRules": [{"ruleId": "r", "ruleVersion": 1, "evidenceCodes": ["X"]}],
              "rulesetVersion": 1, "createdAt": "x", "traceId": "t"},
    "notification_request": {"schemaVersion": 1, "notificationRequestId": "n", "alertId": "l", "customerId": "c",
                             "transactionId": "t", "category": "SUSPICIOUS_TRANSACTION", "templateId": "x", "locale": "pt-BR",
                             "requestedAt": "x", "traceId": "t"},
    "notification_result": {"schemaVersion": 1, "notificationRequestId": "n", "channel": "EMAIL", "status": "SENT",
                            "attemptCount": 1, "providerReference": None, "reasonCode": None, "updatedAt": "x", "traceId": "t"},
    "invalid_ref": {"schemaVersion": 1, "sourceTopic": "s", "sourcePartition": 0, "sourceOffset": 3, "payloadHash": "h",
                    "sourceSchemaVersion": None, "reasonCode": "r", "detectedAt": "x"},
    "quarantine_ref": {"schemaVersion": 1, "sourceTopic": "s", "sourcePartition": 0, "sourceOffset": 3, "eventId": "e",
                       "transactionId": "t", "payloadHash": "h", "conflictingIdentityHash": "h2", "reasonCode": "r", "detectedAt": "x"},
    "feedback": {"schemaVersion": 1, "feedbackId": "f", "assessmentId": "a", "alertId": "l", "label": "FRAUD", "source": "s", "occurredAt": "x"},
}


def check(spark, contract, document):
    text = document if isinstance(document, str) or document is None else json.dumps(document)
    df = spark.createDataFrame([(text,)], "j string")
    return df.select(violations(contract, F.col("j"))).first()[0]


@pytest.mark.parametrize("contract", sorted(CONTRACTS))
def test_valid_document_extra_key_and_missing_field(spark, contract):
    document = VALID[contract]
    assert check(spark, contract, document) == []
    assert check(spark, contract, {**document, "extra": 1}) == ["additionalProperties"]
    assert check(spark, contract, {**document, "schemaVersion": 2}) == ["schemaVersion:const"]
    required = [f.name for f in CONTRACTS[contract] if f.required]
    missing = {k: v for k, v in document.items() if k != required[-1]}
    assert check(spark, contract, missing) == [f"{required[-1]}:required"]
    assert struct_type(contract).fieldNames() == [f.name for f in CONTRACTS[contract]]


@pytest.mark.parametrize("contract,change,expected", [
    ("transaction_event", {"currency": "REAL"}, "currency:pattern"),
    ("transaction_event", {"currency": "BRL\n"}, "currency:pattern"),
    ("transaction_event", {"amountMinor": -1}, "amountMinor:minimum"),
    ("transaction_event", {"amountMinor": "1"}, "amountMinor:type"),
    ("transaction_event", {"amountMinor": 1.5}, "amountMinor:type"),
    ("transaction_event", {"amountMinor": 2**70}, "amountMinor:type"),
    ("transaction_event", {"eventId": ""}, "eventId:minLength"),
    ("transaction_event", {"eventId": "x" * 129}, "eventId:maxLength"),
    ("transaction_event", {"merchantCategory": "541"}, "merchantCategory:pattern"),
    ("transaction_event", {"traceId": None}, "traceId:type"),
    ("ruleset_snapshot", {"rules": []}, "rules:minItems"),
    ("ruleset_snapshot", {"rules": [1]}, "rules[]:type"),
    ("ruleset_snapshot", {"version": 0}, "version:minimum"),
    ("alert", {"severity": "NONE"}, "severity:enum"),
    ("alert", {"matchedRules": [{"ruleId": "r", "ruleVersion": 1, "evidenceCodes": [1]}]}, "matchedRules[].evidenceCodes[]:type"),
    ("notification_request", {"channel": "EMAIL"}, "additionalProperties"),
    ("invalid_ref", {"sourceOffset": -1}, "sourceOffset:minimum"),
    ("feedback", {"label": "MAYBE"}, "label:enum"),
])
def test_single_violation(spark, contract, change, expected):
    assert check(spark, contract, {**VALID[contract], **change}) == [expected]


@pytest.mark.parametrize("text", [None, "", "nope", "[1]", "1", '"x"', '{"a":1'])
def test_not_an_object(spark, text):
    assert check(spark, "transaction_event", text) == ["document"]


def test_optional_field_is_accepted(spark):
    assert check(spark, "transaction_event", {**BASE, "merchantCategory": "5411"}) == []
