"""Rule governance as table jobs over a proposal log and a decision log.

Proposals: head_key, rule_id, rule_version_id, change_type, definition (JSON text),
author, proposal_seq.  Decisions: decision_seq, rule_version_id, decision (APPROVE or
REJECT), approver.  A head is one independent rule set.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.ids import content_hash, iso_instant, name_uuid
from ledgerlens.operators.ordering import running_sum
from ledgerlens.operators.rule_checks import definition_reason
from ledgerlens.operators.rulesets import HASHED_FIELDS
from ledgerlens.session import materialize

# Governance limits, actions and reason codes.
MAX_RULES = 100
MAX_SNAPSHOT_BYTES = 1_048_576
# Decision numbers of one block of a head's log.
BLOCK = 1 << 17
CHANGE_TYPES = ("UPSERT", "RETIRE")
DEFAULT_SEVERITY = "HIGH"
UNKNOWN_VERSION = "RULE_VERSION_UNKNOWN"
UNKNOWN_DECISION = "DECISION_UNKNOWN"
EMPTY_SET = "ACTIVE_RULESET_MUST_NOT_BE_EMPTY"
ALREADY_DECIDED = "VERSION_ALREADY_DECIDED"
TOO_MANY_RULES = "RULESET_SIZE_EXCEEDS_LIMIT"
TOO_MANY_BYTES = "RULESET_PAYLOAD_EXCEEDS_LIMIT"

# A snapshot document around its items and the two values of varying length; ids, hash
# and a microsecond instant have fixed lengths.
_ENVELOPE_BYTES = len(
    '{"approvedChangeRuleVersionId":"","contentHash":"sha256:' + 64 * "0"
    + '","createdAt":"2026-01-01T00:00:00.000000Z","rules":[],"schemaVersion":1,"snapshotId":"'
    + 36 * "0" + '","version":}'
)


def propose(proposals: DataFrame) -> DataFrame:
    """Add reject_reason, and version_number for the proposals that are recorded.

    Numbers count the recorded proposals of a rule in order; a rule with very many of
    them is numbered in chunks.
    """
    reason = (
        F.when(~F.col("change_type").isin(*CHANGE_TYPES), "INVALID_CHANGE_TYPE")
        .when(F.col("change_type") == "UPSERT",
              definition_reason(F.col("__v")))
    )
    marked = proposals.withColumn("__v", F.try_parse_json("definition")).withColumn("reject_reason", reason).withColumn(
        "__one", F.when(F.col("reject_reason").isNull(), 1).otherwise(0))
    numbered = running_sum(marked, ["rule_id"], "proposal_seq", "__one", "__n")
    return numbered.withColumn(
        "version_number", F.when(F.col("reject_reason").isNull(), F.col("__n").cast("int"))
    ).withColumn(
        "definition", F.when(F.col("change_type") == "UPSERT", F.col("definition"))
    ).drop("__one", "__n", "__v")


def next_version_number(versions: DataFrame) -> DataFrame:
    return versions.groupBy("rule_id").agg(
        (F.coalesce(F.max("version_number"), F.lit(0)) + 1).alias("next_version"))


def severity_of(definition: Column) -> Column:
    return F.coalesce(F.try_variant_get(definition, "$.severity", "string"), F.lit(DEFAULT_SEVERITY))


def item_json(order: Column) -> Column:
    """Canonical JSON of one rule item of a snapshot."""
    definition = F.try_parse_json(F.col("definition"))
    return F.to_json(F.struct(
        definition.alias("definition"),
        order.alias("evaluationOrder"),
        F.col("rule_id").alias("ruleId"),
        F.col("version_number").alias("ruleVersion"),
        severity_of(definition).alias("severity"),
    ))


def decide(versions: DataFrame, decisions: DataFrame, *, max_rules: int = MAX_RULES,
           max_bytes: int = MAX_SNAPSHOT_BYTES, block: int = BLOCK) -> DataFrame:
    """Outcome of every decision, and the active set after each approval.

    Adds author, rule_id, change_type, head_key, outcome (SUCCESS, DENIED, REFUSED),
    reason, ruleset_version and items (rule_version_id in evaluation order).  Decisions on
    unknown versions, and words other than APPROVE and REJECT, are refused and change nothing.

    Decisions on one's own proposal never change anything, so they are set aside
    first.  What is left of a head is folded in order, because each approval decides
    what the next one starts from; a long log is cut into blocks of ``block`` numbers that
    are folded side by side (see ``_fold_blocks``).
    """
    known = versions.filter(F.col("version_number").isNotNull()).select(
        "head_key", "rule_version_id", "rule_id", "change_type", "author",
        # without the one digit of the placeholder order
        (F.octet_length(item_json(F.lit(0))) - 1).alias("__bytes"))
    met = materialize(decisions.join(known, "rule_version_id", "left"))
    unknown, word = F.col("head_key").isNull(), F.coalesce(F.col("decision").isin("APPROVE", "REJECT"), F.lit(False))
    # What names no version or says neither word settles nothing, so it is answered before the fold.
    refused = met.filter(unknown | ~word).select(
        *_FOLD_COLUMNS, F.lit("REFUSED").alias("outcome"), F.when(unknown, UNKNOWN_VERSION).otherwise(UNKNOWN_DECISION).alias("reason"),
        F.lit(None).cast("long").alias("ruleset_version"), F.lit(None).cast("array<string>").alias("items"))
    log = met.filter(~unknown & word).withColumn("__own", F.col("author").eqNullSafe(F.col("approver")))
    folded = materialize(_fold_blocks(log.filter(~F.col("__own")), max_rules, max_bytes, block))
    settled = folded.filter(F.col("outcome") == "SUCCESS").groupBy("rule_version_id").agg(
        F.min("decision_seq").alias("__settled"))
    own = log.filter("__own").join(settled, "rule_version_id", "left").withColumn(
        "reason",
        F.when(F.col("decision_seq") > F.col("__settled"), ALREADY_DECIDED)
        .when(F.col("decision") == "APPROVE", "SELF_APPROVAL").otherwise("SELF_REJECTION"),
    ).select(
        *_FOLD_COLUMNS, F.lit("DENIED").alias("outcome"), "reason",
        F.lit(None).cast("long").alias("ruleset_version"),
        F.lit(None).cast("array<string>").alias("items"))
    return folded.unionByName(own).unionByName(refused)


_FOLD_COLUMNS = ("head_key", "decision_seq", "rule_version_id", "rule_id", "change_type", "decision",
                 "author", "approver")


# What a block starts from, and what it did to the active set, in order of the last effective action on each rule.
_ITEM = "struct<rule:string,vid:string,size:int>"
_START = f"head_key string, block long, items array<{_ITEM}>, version long, settled array<string>"
# Rounds after which the answers of blocks that were folded again are written in place of the earlier ones.
_MERGE_ROUNDS = 8


def _fold_blocks(log: DataFrame, max_rules: int, max_bytes: int, width: int) -> DataFrame:
    """Outcomes of a log, every block of a head in a task of its own.

    A block's effect on the active set is small and composes: untouched rules keep their places, touched ones leave, and those last
    upserted follow at the end.  Only which approvals are denied depends on the set a block starts from.  So blocks are folded from
    a guess (every first approval of a version took effect), their effects are composed along the head, and blocks that turn out to
    start from something else are folded again, until none does; the first wrong block is right after every round, and denials are
    rare, so a few rounds do.  The answers come from the same walk, with versions counted from the block's start.
    The composition walks one narrow row per block, not decisions.
    """
    # an order without a number comes before all others
    of_block = F.coalesce(F.floor(F.col("decision_seq") / F.lit(width)).cast("long"), F.lit(-(1 << 62)))
    log = log.select(*_FOLD_COLUMNS, "__bytes", of_block.alias("block"))
    tries = log.groupBy("rule_version_id").agg(
        F.when(F.min("block") < F.max("block"), 2).when(F.count("*") > 1, 1).otherwise(0).alias("__again"),  # 2: in more than one block
        F.min("decision_seq").alias("__first"))
    log = materialize(log.join(tries, "rule_version_id"))
    spark = log.sparkSession
    low, high = log.agg(F.min("block"), F.max("block")).first()
    if low == high:  # no head has a second block
        alone = _folded(log, spark.createDataFrame([], _START), max_rules, max_bytes)
        return alone.filter("outcome IS NOT NULL").select(*_ANSWER_COLUMNS)
    counts = materialize(log.groupBy("head_key", "block").count())
    again = materialize(log.filter("__again = 2").select("head_key", "block", "rule_version_id", F.floor(F.col("__first") / F.lit(width)).alias("__of")))
    starts = materialize(_with_settled(_composed(_first_effects(log), max_rules), again))
    used, effects, answers, todo, rounds = _marks(starts, counts), None, None, log, 0
    while True:
        fresh = materialize(_folded(todo, starts, max_rules, max_bytes))
        did = fresh.filter("outcome IS NULL").select("head_key", "block", "actions", "approved", "settled")
        if effects is None:
            effects, answers = materialize(did), fresh
        else:
            redone = did.select("head_key", "block")
            effects = materialize(effects.join(redone, ["head_key", "block"], "left_anti").unionByName(did))
            answers = answers.join(redone, ["head_key", "block"], "left_anti").unionByName(fresh)
        rounds += 1
        if rounds % _MERGE_ROUNDS == 0:
            answers = materialize(answers)
        before = used
        earlier = effects.select("head_key", F.col("block").alias("__of"), F.explode("settled").alias("rule_version_id"))
        met = again.drop("__of").join(earlier, ["head_key", "rule_version_id"])
        starts = materialize(_with_settled(_composed(effects), met))
        used = _marks(starts, counts)
        changed = materialize(used.join(before, ["head_key", "block", "mark"], "left_anti").select("head_key", "block"))
        if changed.isEmpty():
            begun = starts.select("head_key", "block", F.col("version").alias("__from"))
            return answers.filter("outcome IS NOT NULL").join(begun, ["head_key", "block"]).withColumn(
                "ruleset_version", F.col("ruleset_version") + F.col("__from")).select(*_ANSWER_COLUMNS)
        todo = log.join(changed, ["head_key", "block"], "left_semi")
        starts = starts.join(changed, ["head_key", "block"], "left_semi")


def _first_effects(log: DataFrame) -> DataFrame:
    """What blocks would do if the first decision on every version took effect."""
    first = (F.col("decision") == "APPROVE") & (F.col("decision_seq") == F.col("__first"))
    upsert = F.col("change_type") == "UPSERT"
    action = F.struct(F.col("rule_id").alias("rule"), F.when(upsert, F.col("rule_version_id")).alias("vid"),
                      F.when(upsert, F.col("__bytes")).otherwise(0).cast("int").alias("size"))
    last = log.groupBy("head_key", "block", "rule_id").agg(
        F.max(F.when(first, F.struct("decision_seq", action.alias("action")))).alias("last"), F.count_if(first).alias("n"))
    return last.groupBy("head_key", "block").agg(
        F.transform(F.sort_array(F.collect_list("last")), lambda x: x["action"]).alias("actions"), F.sum("n").alias("approved"))


def _with_settled(starts: DataFrame, met: DataFrame) -> DataFrame:
    """Adds which of the block's own versions were settled by blocks before it; ``met`` has head_key, block, rule_version_id, __of."""
    settled = met.filter("__of < block").groupBy("head_key", "block").agg(F.sort_array(F.collect_set("rule_version_id")).alias("settled"))
    return starts.join(settled, ["head_key", "block"], "left").withColumn("settled", F.coalesce("settled", F.array().cast("array<string>")))


def _marks(starts: DataFrame, counts: DataFrame) -> DataFrame:
    """A start as one number.  The version only counts in digits, unless the block may gain one."""
    now, then = F.length(F.col("version").cast("string")), F.length((F.col("version") + F.col("count")).cast("string"))
    return starts.join(counts, ["head_key", "block"]).select(
        "head_key", "block", F.xxhash64("items", "settled", F.when(now == then, -now).otherwise(F.col("version"))).alias("mark"))


def _composed(effects: DataFrame, most: int | None = None) -> DataFrame:
    """What each block starts from, given the effects of those before it: one pass over block rows in order.

    With ``most`` the effects are a guess, so a set is neither emptied nor grown beyond that.
    """
    ordered = effects.select("head_key", "block", "actions", "approved").repartition("head_key").sortWithinPartitions("head_key", "block")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, active, version = None, {}, 0
        for batch in batches:
            rows = []
            for key, block, actions, approved in zip(*[c.to_pylist() for c in batch.columns]):
                if key != head:
                    head, active, version = key, {}, 0
                rows.append((key, block, list(active.values()), version))
                for action in actions:
                    size = len(active) - (action["rule"] in active) + (action["vid"] is not None)
                    if most is not None and not 0 < size <= most:
                        continue
                    active.pop(action["rule"], None)
                    if action["vid"] is not None:
                        active[action["rule"]] = action
                version += approved
            kinds = [pa.string(), pa.int64(), batch.schema.field("actions").type, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)],
                                             names=["head_key", "block", "items", "version"])

    return ordered.mapInArrow(walk, _START.removesuffix(", settled array<string>"))


@cache
def _order_digits(n: int) -> int:
    return sum(len(str(i)) for i in range(n))


class _Set:
    """The active set while a block is folded."""

    def __init__(self, max_rules: int, max_bytes: int) -> None:
        self.max_rules, self.max_bytes = max_rules, max_bytes
        self.active: dict[str, tuple[str, int]] = {}
        self.version = self.approved = self.size = 0
        self.settled: set[str] = set()
        self.touched: dict[str, tuple[str | None, int]] = {}
        self.again: list[str] = []

    def begin(self, items: list[dict], version: int, settled: list[str]) -> None:
        self.active = {x["rule"]: (x["vid"], x["size"]) for x in items}
        self.version, self.settled, self.size = version, set(settled), sum(s for _, s in self.active.values())

    def answer(self, vid: str, rule: str, change: str, decision: str, size: int, again: int) -> tuple:
        """Outcome, reason, approvals of the block so far and items."""
        if vid in self.settled:
            return "DENIED", ALREADY_DECIDED, None, None
        if decision == "APPROVE":
            # The changed rule leaves its place and, unless retired, joins at the end.
            old, upsert = self.active.get(rule), change == "UPSERT"
            n = len(self.active) - (old is not None) + upsert
            if not n:
                return "DENIED", EMPTY_SET, None, None
            if n > self.max_rules:
                return "REFUSED", TOO_MANY_RULES, None, None
            sizes = self.size - (old[1] if old else 0) + (size if upsert else 0)
            total = _ENVELOPE_BYTES + len(vid.encode()) + len(str(self.version + self.approved + 1)) + n - 1 + sizes + _order_digits(n)
            if total > self.max_bytes:
                return "REFUSED", TOO_MANY_BYTES, None, None
            self.active.pop(rule, None)
            self.touched.pop(rule, None)
            self.touched[rule] = (vid, size) if upsert else (None, 0)
            if upsert:
                self.active[rule] = (vid, size)
            self.size, self.approved = sizes, self.approved + 1
        if again:
            self.settled.add(vid)
            if again == 2:
                self.again.append(vid)
        return ("SUCCESS", None, self.approved, [v for v, _ in self.active.values()]) if decision == "APPROVE" else ("SUCCESS", None, None, None)


_ROW = ("rule_version_id", "rule_id", "change_type", "decision", "__bytes", "__again")
_ANSWER_COLUMNS = (*_FOLD_COLUMNS, "outcome", "reason", "ruleset_version", "items")


def _folded(log: DataFrame, starts: DataFrame, max_rules: int, max_bytes: int) -> DataFrame:
    """The answer to every decision, each block from its start (versions counted from there), and one row per block, without an
    outcome, with what the block did to its set."""
    begun = starts.select("head_key", "block", F.col("items").alias("__items"), "version", F.col("settled").alias("__settled"), F.lit(True).alias("__start"))
    rows = log.withColumn("__start", F.lit(False)).unionByName(begun, allowMissingColumns=True).drop("__first")
    ordered = rows.repartition("head_key", "block").sortWithinPartitions("head_key", "block", F.desc("__start"), "decision_seq")
    kept = [f for f in ordered.schema.fields if f.name in (*_FOLD_COLUMNS, "block")]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kept] + [
        T.StructField("outcome", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("ruleset_version", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())), *T.StructType.fromDDL(
            f"actions array<{_ITEM}>, approved long, settled array<string>").fields])
    names = [f.name for f in schema.fields]
    texts = pa.list_(pa.string())
    answer_types = [pa.string(), pa.string(), pa.int64(), texts]
    effect_types = [pa.list_(pa.struct([("rule", pa.string()), ("vid", pa.string()), ("size", pa.int32())])), pa.int64(), texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, at = None, None

        def told(ended: list[tuple[tuple, _Set]], like: pa.Schema) -> pa.RecordBatch:
            n = len(ended)
            own = {"head_key": pa.array([k[0] for k, _ in ended], pa.string()), "block": pa.array([k[1] for k, _ in ended], pa.int64())}
            did = [[[{"rule": r, "vid": v, "size": s} for r, (v, s) in x.touched.items()] for _, x in ended],
                   [x.approved for _, x in ended], [x.again for _, x in ended]]
            return pa.RecordBatch.from_arrays(
                [own[f.name] if f.name in own else pa.nulls(n, like.field(f.name).type) for f in kept] + [pa.nulls(n, t) for t in answer_types]
                + [pa.array(d, t) for d, t in zip(did, effect_types)], names=names)

        like = None
        for batch in batches:
            like, begins = batch.schema, [batch.column(c) for c in ("__items", "version", "__settled")]
            found, answers, ended = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("head_key", "block", "__start", *_ROW)]
            for i, (head, block, start, *row) in enumerate(zip(*columns)):
                if at is None or block != of[1] or head != of[0]:
                    if at is not None:
                        ended.append((of, at))
                    of, at = (head, block), _Set(max_rules, max_bytes)
                if start:
                    at.begin(*[c[i].as_py() for c in begins])
                else:
                    found.append(i)
                    answers.append(at.answer(*row))
            if found:
                mine = batch.take(pa.array(found, pa.int64())) if len(found) < batch.num_rows else batch
                yield pa.RecordBatch.from_arrays(
                    [mine.column(f.name) for f in kept] + [pa.array([a[k] for a in answers], type=t) for k, t in enumerate(answer_types)]
                    + [pa.nulls(len(found), t) for t in effect_types], names=names)
            if ended:
                yield told(ended, like)
        if at is not None:
            yield told([(of, at)], like)

    return ordered.mapInArrow(run, schema)


def snapshot_items(decided: DataFrame) -> DataFrame:
    """(head_key, ruleset_version, rule_version_id, evaluation_order) of every approved set."""
    return decided.filter(F.col("items").isNotNull()).select(
        "head_key", "ruleset_version", F.posexplode("items").alias("evaluation_order", "rule_version_id"))


def build_snapshots(decided: DataFrame, versions: DataFrame, created_us: Column) -> DataFrame:
    """Canonical, hashed snapshot document per approval.

    At most 100 rules meet in one group, so collecting a set's items is bounded.
    ``created_us`` is evaluated on the decision row.
    """
    heads = decided.filter(F.col("items").isNotNull()).select(
        "head_key", "ruleset_version", F.col("rule_version_id").alias("approved_change"),
        iso_instant(created_us).alias("created_at"))
    items = snapshot_items(decided).join(
        versions.select("rule_version_id", "rule_id", "version_number", "definition"), "rule_version_id")
    ordered = items.select("head_key", "ruleset_version", "evaluation_order",
                           item_json(F.col("evaluation_order")).alias("text")) \
        .groupBy("head_key", "ruleset_version").agg(
            F.concat(F.lit("["), F.array_join(F.transform(
                F.sort_array(F.collect_list(F.struct("evaluation_order", "text"))), lambda s: s["text"]), ","),
                F.lit("]")).alias("rules"))
    document = heads.join(ordered, ["head_key", "ruleset_version"]).withColumn(
        "snapshot_id", name_uuid("SNAPSHOT", F.concat_ws(":", "head_key", "ruleset_version")))
    parts = {
        "approvedChangeRuleVersionId": _quoted("approved_change"),
        "createdAt": _quoted("created_at"),
        "rules": F.col("rules"),
        "schemaVersion": F.lit("1"),
        "snapshotId": _quoted("snapshot_id"),
        "version": F.col("ruleset_version").cast("string"),
    }
    hashed = document.withColumn("content_hash", content_hash(_object({k: parts[k] for k in HASHED_FIELDS})))
    signed = {**parts, "contentHash": _quoted("content_hash")}
    return hashed.withColumn("payload", _object(dict(sorted(signed.items())))).select(
        "head_key", "ruleset_version", "snapshot_id", "approved_change", "content_hash", "created_at", "payload",
        F.octet_length("payload").alias("payload_bytes"))


def _quoted(name: str) -> Column:
    # to_json of a one-field object, cut down to the escaped string itself
    return F.expr(f"substring(to_json(struct({name} as v)), 6, length(to_json(struct({name} as v))) - 6)")


def _object(parts: dict[str, Column]) -> Column:
    inner = [F.concat(F.lit(f'"{k}":'), v) for k, v in parts.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *inner), F.lit("}"))


def active_set(decided: DataFrame) -> DataFrame:
    """Current active set per head: the items of the latest approved version."""
    latest = decided.filter(F.col("items").isNotNull()).groupBy("head_key").agg(
        F.max_by("items", "ruleset_version").alias("items"), F.max("ruleset_version").alias("ruleset_version"))
    return latest.select("head_key", "ruleset_version",
                         F.posexplode("items").alias("evaluation_order", "rule_version_id"))


def version_status(versions: DataFrame, decided: DataFrame) -> DataFrame:
    """Stored state of every version: pending, or its effective decision."""
    effective = decided.filter(F.col("outcome") == "SUCCESS").select(
        "rule_version_id", F.when(F.col("decision") == "APPROVE", "APPROVED").otherwise("REJECTED").alias("status"),
        F.col("approver").alias("approver"), F.col("decision_seq").alias("decided_seq"))
    return versions.filter(F.col("version_number").isNotNull()).join(effective, "rule_version_id", "left").withColumn(
        "status", F.coalesce("status", F.lit("PENDING_APPROVAL")))


def constraint_violations(versions: DataFrame) -> DataFrame:
    """Rows the tables must not hold: (violation, entity, n)."""
    two_pending = versions.filter("status = 'PENDING_APPROVAL'").groupBy("rule_id").count().filter("count > 1") \
        .select(F.lit("rule_version_one_pending_per_rule").alias("violation"), F.col("rule_id").alias("entity"), F.col("count").alias("n"))
    same_number = versions.groupBy("rule_id", "version_number").count().filter("count > 1").select(
        F.lit("rule_version_unique_number").alias("violation"), F.col("rule_id").alias("entity"), F.col("count").alias("n"))
    own = versions.filter(F.col("approver") == F.col("author")).select(
        F.lit("rule_version_different_approver").alias("violation"), F.col("rule_version_id").alias("entity"),
        F.lit(1).cast("long").alias("n"))
    return two_pending.unionByName(same_number).unionByName(own)


def audit_events(versions: DataFrame, decided: DataFrame) -> DataFrame:
    """Append-only trail: one row per recorded proposal and per decision, denials included."""
    created = versions.filter(F.col("version_number").isNotNull()).select(
        F.col("author").alias("actor"), F.lit("RULE_VERSION_CREATED").alias("action"),
        F.lit("SUCCESS").alias("outcome"), F.col("rule_version_id").alias("entity_id"),
        F.col("proposal_seq").alias("at_seq"))
    # A second decision on a settled version, a refused size and what names no version or decision leave no trace.
    silent = F.coalesce(F.col("reason").isin(
        ALREADY_DECIDED, TOO_MANY_RULES, TOO_MANY_BYTES, UNKNOWN_VERSION, UNKNOWN_DECISION), F.lit(False))
    approved = F.col("decision") == "APPROVE"
    action = F.when(F.col("outcome") == "SUCCESS",
                    F.when(approved, "RULE_VERSION_APPROVED").otherwise("RULE_VERSION_REJECTED")) \
        .otherwise(F.when(approved, "RULE_APPROVAL_DENIED").otherwise("RULE_REJECTION_DENIED"))
    made = decided.filter(~silent).select(
        F.col("approver").alias("actor"), action.alias("action"), "outcome",
        F.col("rule_version_id").alias("entity_id"), F.col("decision_seq").alias("at_seq"))
    rows = created.unionByName(made).withColumn("entity_type", F.lit("RULE_VERSION"))
    return rows.withColumn("audit_event_id", name_uuid("AUDIT", F.concat_ws(":", "action", "entity_id", "at_seq")))


def audit_trail(audit: DataFrame) -> DataFrame:
    """Newest first, id as tie-break."""
    return audit.orderBy(F.col("at_seq").desc(), F.col("audit_event_id").desc())


def list_rules(rules: DataFrame) -> DataFrame:
    return rules.orderBy("rule_key")


def list_versions(versions: DataFrame, rule_id: str) -> DataFrame:
    return versions.filter(F.col("rule_id") == rule_id).orderBy("version_number")


def versions_of_rule(pairs: DataFrame, versions: DataFrame) -> DataFrame:
    """The (rule_id, rule_version_id) pairs that exist."""
    return pairs.join(versions.select("rule_id", "rule_version_id"), ["rule_id", "rule_version_id"], "left_semi")


def publications(outbox: DataFrame) -> DataFrame:
    return outbox.orderBy("aggregate_version")


def next_publication(outbox: DataFrame, now_us: Column, key: str = "aggregate_id") -> DataFrame:
    """Lowest pending version per aggregate, if its retry time has come; never a later one."""
    rest = [c for c in outbox.columns if c != key]
    head = outbox.filter("status = 'PENDING'").groupBy(key).agg(
        F.min_by(F.struct(*rest), "aggregate_version").alias("r"))
    return head.select(key, "r.*").filter(F.col("next_attempt_us") <= now_us)


def active_status(heads: DataFrame, outbox: DataFrame) -> DataFrame:
    """Desired and published version with the number of pending publications."""
    pending = outbox.groupBy(F.col("aggregate_id").alias("head_key")).agg(
        F.count_if(F.col("status") == "PENDING").alias("pending_outbox_events"))
    return heads.join(pending, "head_key", "left").withColumn(
        "pending_outbox_events", F.coalesce("pending_outbox_events", F.lit(0)))

