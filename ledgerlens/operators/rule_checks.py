"""Bulk validation of rule definitions held as JSON text in a table.

The recursion over ALL/ANY children is unrolled to the allowed depth as nested array
transforms, so a whole table is checked in one narrow pass without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.operators.rules import COMPOSITE_TYPES, MAX_CHILDREN, MAX_DEPTH, MAX_WINDOW


def definition_reason(
    node: Column, *, max_depth: int = MAX_DEPTH, max_window: int = MAX_WINDOW, depth: int = 1
) -> Column:
    """First reason a definition (a Variant) is refused, parents before children; NULL if sound."""
    kind = F.try_variant_get(node, "$.type", "string")
    out = F.when(
        ~F.coalesce(F.schema_of_variant(node).startswith("OBJECT<"), F.lit(False)) | kind.isNull(),
        "INVALID_RULE_DEFINITION",
    )
    if depth > max_depth:
        return out.otherwise("RULE_DEPTH_EXCEEDS_LIMIT")
    children = F.try_variant_get(node, "$.children", "array<variant>")
    width = F.coalesce(F.size(children), F.lit(0))
    return (
        out.when(kind == "AMOUNT_THRESHOLD", _amount_reason(node))
        .when(kind == "COUNT_WINDOW", _count_reason(node, max_window))
        .when(~kind.isin(*COMPOSITE_TYPES), "UNSUPPORTED_RULE_NODE")
        .when(children.isNull() | (width < 1), "INVALID_COMPOSITE_RULE")
        .when(width > MAX_CHILDREN, "COMPOSITE_WIDTH_EXCEEDS_LIMIT")
        .otherwise(
            F.get(
                F.array_compact(F.transform(
                    children,
                    lambda child: definition_reason(
                        child, max_depth=max_depth, max_window=max_window, depth=depth + 1),
                )),
                F.lit(0),
            )
        )
    )


def _amount_reason(node: Column) -> Column:
    described = F.schema_of_variant(F.try_variant_get(node, "$.amountMinor", "variant"))
    amount = F.try_variant_get(node, "$.amountMinor", "bigint")
    currency = F.try_variant_get(node, "$.currency", "string")
    sound = described.rlike("^(BIGINT|DECIMAL|DOUBLE)") & (amount >= 0) & currency.rlike(r"^[A-Z]{3}\z")
    return F.when(~F.coalesce(sound, F.lit(False)), "INVALID_AMOUNT_THRESHOLD")


def _count_reason(node: Column, max_window: int) -> Column:
    seconds = F.coalesce(F.try_variant_get(node, "$.windowSeconds", "int"), F.lit(-1))
    minimum = F.coalesce(F.try_variant_get(node, "$.minimumCount", "int"), F.lit(-1))
    return (
        F.when(seconds < 1, "INVALID_WINDOW")
        .when(seconds > max_window, "WINDOW_EXCEEDS_LIMIT")
        .when(minimum < 1, "INVALID_COUNT_WINDOW")
    )
