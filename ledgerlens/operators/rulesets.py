"""Published rule sets: validation, acceptance, and which one an event met."""

from __future__ import annotations

import json
from collections.abc import Collection, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.ids import canonical_json, content_hash, is_blank
from ledgerlens.operators.ordering import running_max
from ledgerlens.operators.rule_checks import definition_reason
from ledgerlens.operators.rules import RuleSet, compile_ruleset
from ledgerlens.sources.contracts import violations

# The only key that carries a rule set, and the fields a hash covers.
ACTIVE_KEY = "ACTIVE"
HASHED_FIELDS = (
    "approvedChangeRuleVersionId", "createdAt", "rules", "schemaVersion", "snapshotId", "version",
)

# Arrival numbers in one chunk of the scan that carries the version on.
SPAN = 1 << 17


def unsigned_text(variant: Column) -> Column:
    """Canonical JSON of a snapshot without its hash."""
    return F.to_json(F.struct(*[
        F.try_variant_get(variant, f"$.{name}", "variant").alias(name) for name in HASHED_FIELDS
    ]))


def expected_hash(variant: Column) -> Column:
    return content_hash(unsigned_text(variant))


def validate_snapshots(snapshots: DataFrame) -> DataFrame:
    """Add version and reject_reason (NULL when sound) to (key, payload) rows."""
    v = F.col("__v")
    rules = F.try_variant_get(v, "$.rules", "array<variant>")
    bad_rule = F.exists(rules, lambda r: is_blank(F.try_variant_get(r, "$.ruleId", "string")))
    reasons = F.array_compact(F.transform(
        rules, lambda r: definition_reason(F.try_variant_get(r, "$.definition", "variant"))))
    reason = (
        F.when(~F.coalesce(F.schema_of_variant(v).startswith("OBJECT<"), F.lit(False)),
               "INVALID_RULESET_SNAPSHOT")
        .when(F.size(violations("ruleset_snapshot", F.col("payload"), v)) > 0, "INVALID_RULESET_SCHEMA")
        .when(is_blank(F.try_variant_get(v, "$.contentHash", "string"))
              | (F.try_variant_get(v, "$.contentHash", "string") != expected_hash(v)), "INVALID_RULESET_HASH")
        .when(bad_rule, "INVALID_RULE")
        .otherwise(F.get(reasons, F.lit(0)))
    )
    return (
        snapshots.withColumn("__v", F.try_parse_json("payload"))
        .withColumn("reject_reason", reason)
        .withColumn("version", F.try_variant_get(v, "$.version", "bigint"))
        .drop("__v")
    )


def verify_publication(outbox: DataFrame) -> DataFrame:
    """Checks of a stored payload before it is published: shape, version, form, hash."""
    v = F.try_parse_json(F.col("canonical_payload"))
    return outbox.withColumn("__v", v).withColumn(
        "verification",
        F.when(F.col("__v").isNull(), "OUTBOX_SNAPSHOT_INVALID_JSON")
        .when(F.size(violations("ruleset_snapshot", F.col("canonical_payload"), F.col("__v"))) > 0,
              "OUTBOX_SNAPSHOT_SCHEMA_INVALID")
        .when(F.try_variant_get("__v", "$.version", "bigint") != F.col("aggregate_version"),
              "OUTBOX_SNAPSHOT_VERSION_INVALID")
        .when(F.col("canonical_payload") != canonical_json(F.col("canonical_payload")),
              "OUTBOX_SNAPSHOT_NOT_CANONICAL")
        .when(F.try_variant_get("__v", "$.contentHash", "string") != expected_hash(F.col("__v")),
              "OUTBOX_SNAPSHOT_HASH_INVALID")
        .otherwise("OK"),
    ).drop("__v")


def accept_snapshots(validated: DataFrame) -> DataFrame:
    """Add disposition: only a sound snapshot of a higher version replaces the active one.

    Needs key, arrival_seq, version, reject_reason.
    """
    keyed = validated.withColumn(
        "__sound", F.when((F.col("key") == ACTIVE_KEY) & F.col("reject_reason").isNull(), F.col("version"))
    ).withColumn("__all", F.lit(0))
    prior = running_max(keyed, ["__all"], "arrival_seq", "__sound", "__current", inclusive=False)
    return prior.withColumn(
        "disposition",
        F.when(F.coalesce(F.col("key") != ACTIVE_KEY, F.lit(True)), "ignored_key")
        .when(F.col("reject_reason").isNotNull(), "rejected")
        .when(F.col("version") <= F.col("__current"), "not_newer")
        .otherwise("accepted"),
    ).drop("__sound", "__all", "__current")


def with_active_version(events: DataFrame, accepted: DataFrame, span: int = SPAN) -> DataFrame:
    """Add ``ruleset_version``: the one active when the event arrived, NULL before the first.

    Accepted versions rise, so the one in force is the largest so far: snapshots take their places among the events, and a running
    maximum in chunks of ``span`` arrival numbers carries it on.  A snapshot counts for events that arrive after it.
    """
    columns = events.columns
    rows = events.withColumn("__at", F.col("arrival_seq") * 2).unionByName(
        accepted.select((F.col("arrival_seq") * 2 + 1).alias("__at"), F.col("version").cast("long").alias("__version")), allowMissingColumns=True)
    carried = running_max(rows.withColumn("__all", F.lit(0)), ["__all"], "__at", "__version", "ruleset_version", width=2 * span)
    return carried.filter(F.col("__at") % 2 == 0).select(*columns, "ruleset_version")


def load_rulesets(accepted: DataFrame, versions: Collection[int] | None = None) -> dict[int, RuleSet]:
    """Compile accepted snapshots (or just the named versions), one document at a time.

    Each is at most 1 MiB and 100 rules, by the limits of governance.
    """
    wanted = accepted if versions is None else accepted.filter(F.col("version").isin(*versions))

    def documents() -> Iterator[dict]:
        for row in wanted.select("payload").toLocalIterator():
            yield json.loads(row["payload"])

    return {r.version: r for r in map(compile_ruleset, documents())}
