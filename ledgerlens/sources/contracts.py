"""The nine record contracts: field rules, checks over JSON text, table schemas.

A contract is data (``Field`` rows); ``violations`` turns it into one array column
of reason texts computed on a Variant, so a whole table is validated inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # string | integer | boolean | array | object
    required: bool = True
    nullable: bool = False
    const: int | None = None
    minimum: int | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    enum: tuple[str, ...] | None = None
    min_items: int | None = None
    items: tuple["Field", ...] | None = None  # fields of each element, when an object
    item_kind: str | None = None  # type of each element


def _text(name: str, **kw) -> Field:
    return Field(name, "string", **kw)


def _int(name: str, **kw) -> Field:
    return Field(name, "integer", **kw)


_VERSION = _int("schemaVersion", const=1)

# Field names, types, bounds, patterns and enumerations of the contracts.
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
CURRENCY_PATTERN = "^[A-Z]{3}$"
CATEGORY_CODE_PATTERN = "^[0-9]{4}$"

CONTRACTS: dict[str, tuple[Field, ...]] = {
    "transaction_event": (
        _VERSION,
        _text("eventId", min_length=1, max_length=128),
        _text("transactionId"),
        _text("customerId"),
        _int("amountMinor", minimum=0),
        _text("currency", pattern=CURRENCY_PATTERN),
        _text("occurredAt"),
        _text("transactionType"),
        _text("channel"),
        _text("merchantCountry"),
        _text("merchantCategory", required=False, pattern=CATEGORY_CODE_PATTERN),
        _text("deviceIdHash"),
        _text("traceId"),
    ),
    "ruleset_snapshot": (
        _VERSION,
        _text("snapshotId"),
        _int("version", minimum=1),
        _text("contentHash"),
        _text("approvedChangeRuleVersionId"),
        Field(
            "rules",
            "array",
            min_items=1,
            item_kind="object",
            items=(
                _text("ruleId"),
                _int("ruleVersion", minimum=1),
                _int("evaluationOrder", minimum=0),
                _text("severity", enum=SEVERITIES),
                Field("definition", "object"),
            ),
        ),
        _text("createdAt"),
    ),
    "assessment": (
        _VERSION,
        _text("assessmentId"),
        _text("eventId"),
        _text("transactionId"),
        _text("customerId"),
        _text("status", enum=("NOT_SUSPICIOUS", "SUSPICIOUS", "INCONCLUSIVE")),
        _text("finalSeverity", enum=("NONE", *SEVERITIES)),
        Field("ruleResults", "array", item_kind="object"),
        _int("rulesetVersion", minimum=1),
        _text("receivedAt"),
        _text("evaluatedAt"),
        Field("late", "boolean"),
        _text("traceId"),
    ),
    "alert": (
        _VERSION,
        _text("alertId"),
        _text("assessmentId"),
        _text("eventId"),
        _text("transactionId"),
        _text("customerId"),
        _text("severity", enum=SEVERITIES),
        Field(
            "matchedRules",
            "array",
            min_items=1,
            item_kind="object",
            items=(
                _text("ruleId"),
                _int("ruleVersion", minimum=1),
                Field("evidenceCodes", "array", item_kind="string"),
            ),
        ),
        _int("rulesetVersion", minimum=1),
        _text("createdAt"),
        _text("traceId"),
    ),
    "notification_request": (
        _VERSION,
        _text("notificationRequestId"),
        _text("alertId"),
        _text("customerId"),
        _text("transactionId"),
        _text("category", enum=("SUSPICIOUS_TRANSACTION",)),
        _text("templateId"),
        _text("locale"),
        _text("requestedAt"),
        _text("traceId"),
    ),
    "notification_result": (
        _VERSION,
        _text("notificationRequestId"),
        _text("channel", enum=("EMAIL",)),
        _text("status", enum=("SENT", "SUPPRESSED", "RETRY_PENDING", "FAILED")),
        _int("attemptCount", minimum=0),
        _text("providerReference", required=False, nullable=True),
        _text("reasonCode", required=False, nullable=True),
        _text("updatedAt"),
        _text("traceId"),
    ),
    "invalid_ref": (
        _VERSION,
        _text("sourceTopic"),
        _int("sourcePartition", minimum=0),
        _int("sourceOffset", minimum=0),
        _text("payloadHash"),
        _int("sourceSchemaVersion", required=False, nullable=True),
        _text("reasonCode"),
        _text("detectedAt"),
    ),
    "quarantine_ref": (
        _VERSION,
        _text("sourceTopic"),
        _int("sourcePartition", minimum=0),
        _int("sourceOffset", minimum=0),
        _text("eventId"),
        _text("transactionId"),
        _text("payloadHash"),
        _text("conflictingIdentityHash"),
        _text("reasonCode"),
        _text("detectedAt"),
    ),
    "feedback": (
        _VERSION,
        _text("feedbackId"),
        _text("assessmentId"),
        _text("alertId"),
        _text("label", enum=("FRAUD", "LEGITIMATE", "UNKNOWN")),
        _text("source"),
        _text("occurredAt"),
    ),
}

_SPARK_KIND = {"string": T.StringType(), "integer": T.LongType(), "boolean": T.BooleanType()}

RULE_RESULT_TYPE = T.StructType([
    T.StructField("ruleId", T.StringType()),
    T.StructField("ruleVersion", T.IntegerType()),
    T.StructField("severity", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("evidenceCodes", T.ArrayType(T.StringType())),
    T.StructField("evaluatedValues", T.MapType(T.StringType(), T.StringType())),
])

_SPECIAL = {
    ("ruleset_snapshot", "definition"): T.VariantType(),
    ("assessment", "ruleResults"): T.ArrayType(RULE_RESULT_TYPE),
}
_INT_FIELDS = {"schemaVersion", "ruleVersion", "evaluationOrder", "attemptCount", "sourcePartition",
               "sourceSchemaVersion"}
INSTANT_FIELDS = {"occurredAt", "createdAt", "receivedAt", "evaluatedAt", "requestedAt", "updatedAt",
                   "detectedAt"}


def struct_type(contract: str) -> T.StructType:
    """Table schema of a contract; never inferred from data."""

    def of(field: Field) -> T.DataType:
        if (contract, field.name) in _SPECIAL:
            return _SPECIAL[(contract, field.name)]
        if field.items is not None:
            return T.ArrayType(T.StructType([T.StructField(f.name, of(f)) for f in field.items]))
        if field.kind == "array":
            return T.ArrayType(T.StringType())
        if field.name in _INT_FIELDS:
            return T.IntegerType()
        if field.name in INSTANT_FIELDS:
            return T.TimestampType()
        return _SPARK_KIND[field.kind]

    return T.StructType([T.StructField(f.name, of(f), not f.required) for f in CONTRACTS[contract]])


# How schema_of_variant prints the JSON types.
_VARIANT_TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN"}


def _type_ok(kind: str, described: Column) -> Column:
    if kind == "array":
        return described.startswith("ARRAY<")
    if kind == "object":
        return described.startswith("OBJECT<")
    return described == _VARIANT_TYPES[kind]


def _value_checks(field: Field, variant: Column, path: str) -> list[tuple[str, Column]]:
    """(reason, passes) pairs for a value already known to have the right type."""
    checks: list[tuple[str, Column]] = []
    if field.const is not None:
        checks.append(("const", F.try_variant_get(variant, path, "bigint") == field.const))
    if field.minimum is not None:
        checks.append(("minimum", F.try_variant_get(variant, path, "bigint") >= field.minimum))
    text = F.try_variant_get(variant, path, "string")
    if field.min_length is not None:
        checks.append(("minLength", F.char_length(text) >= field.min_length))
    if field.max_length is not None:
        checks.append(("maxLength", F.char_length(text) <= field.max_length))
    if field.pattern is not None:
        checks.append(("pattern", text.rlike(field.pattern.replace("$", r"\z"))))
    if field.enum is not None:
        checks.append(("enum", text.isin(*field.enum)))
    return checks


def _field_violation(field: Field, variant: Column, path: str, label: str) -> Column:
    """First reason the field breaks its contract, NULL when it does not."""
    # A missing field is NULL here, an explicit JSON null is a value of type VOID.
    described = F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
    present = described.isNotNull()
    typed = F.coalesce(_type_ok(field.kind, described), F.lit(False))
    out = F.when(~present, F.lit(f"{label}:required") if field.required else F.lit(None).cast("string"))
    if field.nullable:
        out = out.when(described == "VOID", F.lit(None).cast("string"))
    out = out.when(~typed, F.lit(f"{label}:type"))
    for reason, passes in _value_checks(field, variant, path):
        out = out.when(~F.coalesce(passes, F.lit(False)), F.lit(f"{label}:{reason}"))
    return out


def _object_violations(fields: tuple[Field, ...], variant: Column, keys: Column, prefix: str) -> list[Column]:
    out = [
        _field_violation(f, variant, f"$.{f.name}", prefix + f.name)
        for f in fields
    ]
    allowed = F.array(*[F.lit(f.name) for f in fields])
    out.append(F.when(F.size(F.array_except(keys, allowed)) > 0, F.lit(prefix + "additionalProperties")))
    return out


def violations(contract: str, text: Column, variant: Column | None = None) -> Column:
    """Array of contract violations of a JSON text; empty when it conforms.

    Text that is NULL, not JSON, or not an object has the single entry ``document``.
    """
    variant = F.try_parse_json(text) if variant is None else variant
    is_object = F.coalesce(F.schema_of_variant(variant).startswith("OBJECT<"), F.lit(False))
    keys = F.json_object_keys(text)
    found = [F.array(*_object_violations(CONTRACTS[contract], variant, keys, ""))]
    for field in CONTRACTS[contract]:
        if field.kind != "array" or (field.item_kind is None and field.min_items is None):
            continue
        elements = F.try_variant_get(variant, f"$.{field.name}", "array<variant>")
        if field.min_items is not None:
            found.append(F.array(F.when(F.size(elements) < field.min_items, F.lit(f"{field.name}:minItems"))))
        found.append(F.flatten(F.transform(elements, partial(_element_violations, field))))
    all_found = F.flatten(F.transform(F.array(*found), lambda a: F.coalesce(a, F.array().cast("array<string>"))))
    return F.when(is_object, F.array_distinct(F.array_compact(all_found))).otherwise(F.array(F.lit("document")))


def flat_struct(contract: str) -> T.StructType:
    """Typed columns of a contract without nested fields, in declared order."""
    return T.StructType([T.StructField(f.name, _SPARK_KIND[f.kind]) for f in CONTRACTS[contract]])


def same_text(contract: str, typed: Column, text: Column, *, canonical: bool = False) -> Column:
    """Whether ``typed`` (the text read with ``flat_struct``) is written back as that very text.

    Then every field has its exact JSON type and nothing else is in the document.  Other
    field orders, spacing or escapes differ, which decides nothing.
    """
    names = [f.name for f in CONTRACTS[contract]]
    ordered = F.struct(*[typed[n].alias(n) for n in (sorted(names) if canonical else names)])
    return F.coalesce(F.to_json(ordered) == text, F.lit(False))


def values_conform(contract: str, typed: Column) -> Column:
    """Bounds, patterns and required fields of already typed values."""
    checks = []
    for field in CONTRACTS[contract]:
        value = typed[field.name]
        tests = []
        if field.const is not None:
            tests.append(value == field.const)
        if field.minimum is not None:
            tests.append(value >= field.minimum)
        if field.min_length is not None:
            tests.append(F.char_length(value) >= field.min_length)
        if field.max_length is not None:
            tests.append(F.char_length(value) <= field.max_length)
        if field.pattern is not None:
            tests.append(value.rlike(field.pattern.replace("$", r"\z")))
        if field.enum is not None:
            tests.append(value.isin(*field.enum))
        if field.required:
            checks += tests or [value.isNotNull()]
        else:
            checks += [value.isNull() | t for t in tests]
    return F.coalesce(reduce(lambda x, y: x & y, checks), F.lit(False))


def _has_wrong_type(kind: str, value: Column) -> Column:
    return ~F.coalesce(_type_ok(kind, F.schema_of_variant(value)), F.lit(False))


def _element_violations(field: Field, element: Column) -> Column:
    described = F.schema_of_variant(element)
    typed = F.coalesce(_type_ok(field.item_kind, described), F.lit(False))
    wrong = F.array(F.when(~typed, F.lit(f"{field.name}[]:type")))
    if field.items is None:
        return wrong
    keys = F.json_object_keys(F.to_json(element))
    inner = F.array(*_object_violations(field.items, element, keys, f"{field.name}[]."))
    for sub in field.items:
        if sub.item_kind is not None:
            members = F.try_variant_get(element, f"$.{sub.name}", "array<variant>")
            bad = F.exists(members, partial(_has_wrong_type, sub.item_kind))
            inner = F.concat(inner, F.array(F.when(bad, F.lit(f"{field.name}[].{sub.name}[]:type"))))
    return F.when(typed, inner).otherwise(wrong)
