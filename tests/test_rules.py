import pytest
from pyspark.sql import functions as F

from helpers import amount, count, ruleset, snapshot
from ledgerlens.operators import assessment
from ledgerlens.operators.rule_checks import definition_reason
from ledgerlens.operators.rules import InvalidRule, compile_condition, compile_ruleset

import json


def facts(spark, minor=100, currency="BRL", available=True, **counts):
    row = {"amountMinor": minor, "currency": currency, "history_available": available, "ruleset_version": 1}
    return spark.createDataFrame([{**row, **{f"observed_{w[1:]}": n for w, n in counts.items()}}])


def result(df, definition):
    r = df.select(ruleset(definition).results()[0].alias("r")).first().r
    return r.status, r.evidenceCodes, r.evaluatedValues


def test_amount_evidence(spark):
    assert result(facts(spark, 100), amount(100)) == (
        "MATCHED", ["AMOUNT_AT_OR_ABOVE_THRESHOLD"], {"amountMinor": "100", "thresholdMinor": "100", "currency": "BRL"})
    assert result(facts(spark, 99), amount(100))[:2] == ("NO_MATCH", ["AMOUNT_BELOW_THRESHOLD"])
    assert result(facts(spark, 200, "USD"), amount(100)) == (
        "NO_MATCH", ["CURRENCY_MISMATCH"],
        {"amountMinor": "200", "thresholdMinor": "100", "eventCurrency": "USD", "ruleCurrency": "BRL"})


def test_count_evidence(spark):
    assert result(facts(spark, w60=3), count(60, 3)) == (
        "MATCHED", ["COUNT_AT_OR_ABOVE_MINIMUM"], {"observedCount": "3", "minimumCount": "3", "windowSeconds": "60"})
    assert result(facts(spark, w60=2), count(60, 3))[:2] == ("NO_MATCH", ["COUNT_BELOW_MINIMUM"])
    assert result(facts(spark, available=False, w60=2), count(60, 3)) == (
        "NOT_EVALUATED", ["HISTORY_UNAVAILABLE"], {"minimumCount": "3", "windowSeconds": "60"})


T, N, U = amount(1), amount(10**9), count(60, 3)  # matched, not matched, not evaluated


@pytest.mark.parametrize("kind,children,status,looked_at", [
    ("ANY", [T, U], "MATCHED", 1), ("ANY", [U, T], "MATCHED", 2), ("ANY", [U, N], "NOT_EVALUATED", 2), ("ANY", [N, N], "NO_MATCH", 2),
    ("ANY", [N, U, T, N], "MATCHED", 3),
    ("ALL", [N, U], "NO_MATCH", 1), ("ALL", [U, N], "NO_MATCH", 2), ("ALL", [U, T], "NOT_EVALUATED", 2), ("ALL", [T, T], "MATCHED", 2),
    ("ALL", [{"type": "ANY", "children": [N, U]}, T], "NOT_EVALUATED", 2),
])
def test_three_valued_composites(spark, kind, children, status, looked_at):
    got = result(facts(spark, available=False, w60=1), {"type": kind, "children": children})
    assert got == (status, [f"{kind}_{status}"], {"evaluatedChildren": str(looked_at), "totalChildren": str(len(children))})


@pytest.mark.parametrize("results,status,severity", [
    ([("MATCHED", "LOW"), ("MATCHED", "CRITICAL"), ("NOT_EVALUATED", "HIGH")], "SUSPICIOUS", "CRITICAL"),
    ([("NO_MATCH", "CRITICAL"), ("MATCHED", "LOW")], "SUSPICIOUS", "LOW"),
    ([("NO_MATCH", "LOW"), ("NOT_EVALUATED", "LOW")], "INCONCLUSIVE", "NONE"),
    ([("NO_MATCH", "LOW")], "NOT_SUSPICIOUS", "NONE"),
])
def test_aggregation(spark, results, status, severity):
    df = spark.createDataFrame([(results,)], "r array<struct<status:string,severity:string>>")
    row = df.select(assessment.overall_status(F.col("r")).alias("s"), assessment.final_severity(F.col("r")).alias("v")).first()
    assert (row.s, row.v) == (status, severity)


def test_empty_results_are_an_error(spark):
    df = spark.createDataFrame([([],)], "r array<struct<status:string,severity:string>>")
    with pytest.raises(Exception, match="RULE_RESULTS_MUST_NOT_BE_EMPTY"):
        df.select(assessment.overall_status(F.col("r"))).collect()
    with pytest.raises(InvalidRule):
        compile_ruleset({"version": 1, "rules": []})


def nest(levels):
    node = amount(1)
    for _ in range(levels - 1):
        node = {"type": "ALL", "children": [node]}
    return node


CASES = [
    (amount(0), None, None), (nest(5), None, None), (count(600, 1), None, None),
    (nest(6), "INVALID_RULE_DEFINITION", "RULE_DEPTH_EXCEEDS_LIMIT"),
    (amount(-1), "INVALID_AMOUNT_THRESHOLD", "INVALID_AMOUNT_THRESHOLD"),
    (amount(1, "brl"), "INVALID_AMOUNT_THRESHOLD", "INVALID_AMOUNT_THRESHOLD"),
    (amount("1"), "INVALID_AMOUNT_THRESHOLD", "INVALID_AMOUNT_THRESHOLD"),
    (count(601, 1), "INVALID_COUNT_WINDOW", "WINDOW_EXCEEDS_LIMIT"),
    (count(0, 1), "INVALID_COUNT_WINDOW", "INVALID_WINDOW"),
    (count(60, 0), "INVALID_COUNT_WINDOW", "INVALID_COUNT_WINDOW"),
    ({"type": "ALL"}, "INVALID_COMPOSITE_RULE", "INVALID_COMPOSITE_RULE"),
    ({"type": "ANY", "children": []}, "INVALID_COMPOSITE_RULE", "INVALID_COMPOSITE_RULE"),
    ({"type": "ANY", "children": [amount(1)] * 20}, None, None),
    ({"type": "ANY", "children": [amount(1)] * 21}, "INVALID_COMPOSITE_RULE", "COMPOSITE_WIDTH_EXCEEDS_LIMIT"),
    ({"type": "SUM_WINDOW"}, "UNSUPPORTED_RULE_NODE", "UNSUPPORTED_RULE_NODE"),
    ({"script": "x"}, "UNSUPPORTED_RULE_NODE", "INVALID_RULE_DEFINITION"),
    ([1], "INVALID_RULE_DEFINITION", "INVALID_RULE_DEFINITION"),
]


def test_definition_limits_in_both_forms(spark):
    rows = [(i, json.dumps(d)) for i, (d, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, d string").select("i", definition_reason(F.try_parse_json("d")).alias("r"))
    got = {r.i: r.r for r in df.collect()}
    for i, (definition, compiled, bulk) in enumerate(CASES):
        assert got[i] == bulk, definition
        if compiled is None:
            compile_condition(definition)
        else:
            with pytest.raises(InvalidRule, match=compiled):
                compile_condition(definition)


def test_rules_run_in_evaluation_order_and_many_versions(spark):
    doc = snapshot(1, [amount(1), amount(2)])
    doc["rules"][0]["evaluationOrder"] = 7
    assert [r.rule_id for r in compile_ruleset(doc).rules] == ["rule-1", "rule-0"]
    sets = {v: ruleset(amount(v * 10), version=v) for v in range(1, 21)}
    df = spark.range(1, 21).select(F.col("id").alias("ruleset_version"), F.lit(105).alias("amountMinor"), F.lit("BRL").alias("currency"))
    out = assessment.evaluate(df, sets).select("ruleset_version", F.col("ruleResults")[0]["status"].alias("s"))
    assert {r.ruleset_version: r.s for r in out.collect()} == {v: "MATCHED" if v <= 10 else "NO_MATCH" for v in range(1, 21)}


def test_versions_with_gaps_and_errors(spark):
    sets = {v: ruleset(amount(v * 10), amount(5), version=v) for v in range(3, 60, 5)}
    df = spark.createDataFrame([(v, 105, "BRL") for v in sets], "ruleset_version long, amountMinor long, currency string")
    out = assessment.evaluate(df, sets).select("ruleset_version", F.transform("ruleResults", lambda r: r["status"]).alias("s"))
    assert {r.ruleset_version: r.s for r in out.collect()} == {v: ["MATCHED" if v <= 10 else "NO_MATCH", "MATCHED"] for v in sets}
    for version, loaded in ((4, sets), (None, sets), (3, {}), (70, {3: sets[3]})):
        met = spark.createDataFrame([(version, 105, "BRL")], df.schema)
        with pytest.raises(Exception, match="RULE_SET_NOT_LOADED"):
            assessment.evaluate(met, loaded).collect()
    with pytest.raises(Exception, match="RULE_RESULTS_MUST_NOT_BE_EMPTY"):
        df.select(assessment.overall_status(F.lit(None).cast("array<struct<status:string>>"))).collect()


def test_deep_rules_stay_small(spark):
    def tree(depth):
        return amount(depth) if depth == 5 else {"type": "ANY" if depth % 2 else "ALL", "children": [tree(depth + 1) for _ in range(4)]}

    assert result(facts(spark, 100), tree(1)) == ("MATCHED", ["ANY_MATCHED"], {"evaluatedChildren": "1", "totalChildren": "4"})
