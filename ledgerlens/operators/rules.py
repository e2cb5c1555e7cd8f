"""The closed rule language, compiled to Columns.

A rule set is a small governance document (at most 100 rules), so it is parsed on
the driver once per version; evaluation is a Column expression that Catalyst puts
into the same code-generated stage as the projection around it.  A condition's
outcome is a nullable boolean: true matched, false did not, NULL not evaluated; ANY
and ALL are then SQL's own OR and AND.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.operators.history import observed_column
from ledgerlens.sources.contracts import SEVERITIES

# Limits of the rule language, one set for authoring and evaluation.
MAX_DEPTH = 5
MAX_CHILDREN = 20
MAX_WINDOW = 600
LEAF_TYPES = ("AMOUNT_THRESHOLD", "COUNT_WINDOW")
COMPOSITE_TYPES = ("ALL", "ANY")
STATUSES = ("MATCHED", "NO_MATCH", "NOT_EVALUATED")


class InvalidRule(ValueError):
    """A rule that is not part of the language; the message is the reason code."""


@dataclass(frozen=True)
class AmountThreshold:
    amount: int
    currency: str

    def outcome(self) -> Column:
        return (F.col("currency") == self.currency) & (F.col("amountMinor") >= self.amount)

    def evidence(self) -> Column:
        return (
            F.when(F.col("currency") != self.currency, "CURRENCY_MISMATCH")
            .when(F.col("amountMinor") >= self.amount, "AMOUNT_AT_OR_ABOVE_THRESHOLD")
            .otherwise("AMOUNT_BELOW_THRESHOLD")
        )

    def values(self) -> Column:
        amounts = {"amountMinor": F.col("amountMinor"), "thresholdMinor": F.lit(self.amount)}
        return F.when(
            F.col("currency") != self.currency,
            _text_map({**amounts, "eventCurrency": F.col("currency"), "ruleCurrency": F.lit(self.currency)}),
        ).otherwise(_text_map({**amounts, "currency": F.col("currency")}))

    def windows(self) -> set[int]:
        return set()


@dataclass(frozen=True)
class CountWindow:
    seconds: int
    minimum: int

    def outcome(self) -> Column:
        return F.when(F.col("history_available"), self._count() >= self.minimum)

    def evidence(self) -> Column:
        return (
            F.when(~F.col("history_available"), "HISTORY_UNAVAILABLE")
            .when(self._count() >= self.minimum, "COUNT_AT_OR_ABOVE_MINIMUM")
            .otherwise("COUNT_BELOW_MINIMUM")
        )

    def values(self) -> Column:
        limits = {"minimumCount": F.lit(self.minimum), "windowSeconds": F.lit(self.seconds)}
        return F.when(
            F.col("history_available"), _text_map({"observedCount": self._count(), **limits})
        ).otherwise(_text_map(limits))

    def windows(self) -> set[int]:
        return {self.seconds}

    def _count(self) -> Column:
        return F.col(observed_column(self.seconds))


@dataclass(frozen=True)
class Composite:
    kind: str  # ALL | ANY
    children: tuple

    def outcome(self) -> Column:
        return self._of(self.outcomes())

    def outcomes(self) -> Column:
        return F.array(*[c.outcome() for c in self.children])

    def _of(self, outcomes: Column) -> Column:
        # both follow SQL's OR and AND where an outcome is NULL
        return F.exists(outcomes, lambda x: x) if self.kind == "ANY" else F.forall(outcomes, lambda x: x)

    def evidence(self, outcomes: Column) -> Column:
        result = self._of(outcomes)
        return (
            F.when(result, f"{self.kind}_MATCHED")
            .when(~result, f"{self.kind}_NO_MATCH")
            .otherwise(f"{self.kind}_NOT_EVALUATED")
        )

    def values(self, outcomes: Column) -> Column:
        # Evaluation stops at the first child that settles the outcome.
        settled = F.array_position(outcomes, F.lit(self.kind == "ANY"))
        total = len(self.children)
        looked_at = F.when(settled > 0, settled).otherwise(F.lit(total)).cast("int")
        return _text_map({"evaluatedChildren": looked_at, "totalChildren": F.lit(total)})

    def windows(self) -> set[int]:
        return set().union(*(c.windows() for c in self.children))


Condition = AmountThreshold | CountWindow | Composite


def _text_map(values: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


@dataclass(frozen=True)
class Rule:
    rule_id: str
    version: int
    severity: str
    condition: Condition

    def result(self) -> Column:
        condition = self.condition
        if isinstance(condition, Composite):
            # The children's outcomes are named once, so a tree is as long an expression as it has leaves.
            return F.transform(F.array(condition.outcomes()), lambda found: self._result(
                condition._of(found), condition.evidence(found), condition.values(found)))[0]
        return self._result(condition.outcome(), condition.evidence(), condition.values())

    def _result(self, outcome: Column, evidence: Column, values: Column) -> Column:
        return F.struct(
            F.lit(self.rule_id).alias("ruleId"),
            F.lit(self.version).alias("ruleVersion"),
            F.lit(self.severity).alias("severity"),
            status_text(outcome).alias("status"),
            F.array(evidence).alias("evidenceCodes"),
            values.alias("evaluatedValues"),
        )


@dataclass(frozen=True)
class RuleSet:
    version: int
    rules: tuple[Rule, ...] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        if not self.rules:
            raise InvalidRule("RULE_RESULTS_MUST_NOT_BE_EMPTY")

    def windows(self) -> set[int]:
        return set().union(*(r.condition.windows() for r in self.rules))

    def results(self) -> Column:
        return F.array(*[r.result() for r in self.rules])

    def to_columns(self) -> dict[str, Column]:
        """One result column per rule, for ad-hoc use in a ``select``."""
        return {r.rule_id: r.result() for r in self.rules}


def status_text(outcome: Column) -> Column:
    return F.when(outcome, STATUSES[0]).when(~outcome, STATUSES[1]).otherwise(STATUSES[2])


def compile_ruleset(snapshot: dict) -> RuleSet:
    """Rules of a snapshot document in evaluation order; raises InvalidRule."""
    ordered = sorted(snapshot["rules"], key=lambda r: _whole(r.get("evaluationOrder"), 0))
    return RuleSet(int(snapshot["version"]), tuple(_rule(r) for r in ordered))


def _rule(item: object) -> Rule:
    if not isinstance(item, dict):
        raise InvalidRule("INVALID_RULE")
    rule_id, severity = str(item.get("ruleId") or ""), item.get("severity")
    version = _whole(item.get("ruleVersion"), -1)
    if not rule_id.strip() or version < 1 or severity not in SEVERITIES:
        raise InvalidRule("INVALID_RULE")
    return Rule(rule_id, version, severity, compile_condition(item.get("definition")))


def compile_condition(node: object, depth: int = 1) -> Condition:
    if not isinstance(node, dict) or depth > MAX_DEPTH:
        raise InvalidRule("INVALID_RULE_DEFINITION")
    kind = node.get("type")
    if kind == "AMOUNT_THRESHOLD":
        amount, currency = node.get("amountMinor"), node.get("currency")
        numeric = isinstance(amount, (int, float)) and not isinstance(amount, bool)
        if not numeric or not 0 <= amount < 2**63 or not isinstance(currency, str) \
                or not re.fullmatch("[A-Z]{3}", currency):
            raise InvalidRule("INVALID_AMOUNT_THRESHOLD")
        return AmountThreshold(int(amount), currency)
    if kind == "COUNT_WINDOW":
        seconds, minimum = _whole(node.get("windowSeconds"), -1), _whole(node.get("minimumCount"), -1)
        if not 1 <= seconds <= MAX_WINDOW or minimum < 1:
            raise InvalidRule("INVALID_COUNT_WINDOW")
        return CountWindow(seconds, minimum)
    if kind in COMPOSITE_TYPES:
        children = node.get("children")
        if not isinstance(children, list) or not 1 <= len(children) <= MAX_CHILDREN:
            raise InvalidRule("INVALID_COMPOSITE_RULE")
        return Composite(kind, tuple(compile_condition(c, depth + 1) for c in children))
    raise InvalidRule("UNSUPPORTED_RULE_NODE")


def parse_definition(text: str) -> Condition:
    return compile_condition(json.loads(text))


def _whole(value: object, default: int) -> int:
    """Numbers and numeric text as int, anything else as ``default``."""
    if isinstance(value, (int, float)):
        return int(value)
    if isinstance(value, str):
        try:
            return int(float(value))
        except ValueError:
            return default
    return default
